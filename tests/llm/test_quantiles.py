import numpy as np
import pytest
from pyspark.sql import functions as F

from arzyab.llm import quantiles as Q


def test_error_bound_and_merging(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([np.exp(rng.normal(20, 3, 4000)), -np.exp(rng.normal(1, 2, 800)), np.zeros(300), [1e-12, 1e15]])
    rows = [("a" if i % 3 else None, i % 5, float(v)) for i, v in enumerate(values)] + [("a", 1, None), ("a", 1, float("nan")), ("b", 1, None)]
    df = spark.createDataFrame(rows, "k string, part int, v double").withColumn("n", F.lit(7))
    error = 0.01
    parts = Q.bucket_sketch(df, ["k", "part"], "v", error)
    merged = Q.merge_sketches(parts, ["k"])
    whole = Q.bucket_sketch(df, ["k"], "v", error)
    assert merged.exceptAll(whole).isEmpty() and whole.exceptAll(merged).isEmpty()
    got = {r.k: r for r in Q.sketch_percentiles(merged, ["k"], error=error).collect()}
    assert set(got) == {"a", None}
    for k in got:
        mine = np.sort([v for x, _, v in rows if x == k and v is not None and v == v])
        assert got[k].n == len(mine)
        for q in Q.PERCENTILES:
            want = mine[int(np.floor(q * (len(mine) - 1)))]
            assert got[k][f"p{round(q * 100)}"] == pytest.approx(want, rel=error * 1.0001, abs=0)


def test_small_groups(spark):
    df = spark.createDataFrame([("one", 5.0), ("ties", 2.0), ("ties", 2.0)], "k string, v double")
    got = {r.k: r for r in Q.sketch_percentiles(Q.bucket_sketch(df, ["k"], "v"), ["k"]).collect()}
    assert got["one"].p10 == got["one"].p99 == pytest.approx(5, rel=0.01) and got["ties"].n == 2
    assert Q.sketch_percentiles(Q.bucket_sketch(df.limit(0), ["k"], "v"), ["k"]).count() == 0
