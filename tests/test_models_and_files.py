import numpy as np
import pytest
from pyspark.sql import functions as F

from arzyab.ml import features, ridge, segments
from arzyab.operators.quality import make_check
from arzyab.plans import models
from arzyab.plans.repository import BadRequest, Repository, UnknownDataset
from arzyab.sources import files
from arzyab.streaming.rollup import windowed_rollup


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        a, b, c = float(rng.normal()), bool(rng.random() < 0.4), "xyz"[int(rng.integers(3))]
        y = 1 + 2 * a + 0.5 * b + {"x": 0, "y": 1, "z": -1}[c] + float(rng.normal(0, 0.1))
        rows.append((i, None if i % 50 == 0 else a, None if i % 60 == 1 else b, None if i % 70 == 2 else c, y))
    return spark.createDataFrame(rows, "id long, a double, b boolean, c string, y double")


def test_ridge_equals_the_closed_form(sample):
    design = features.learn_design(sample, ["a"], ["b"], ["c"], 5)
    model = ridge.fit_ridge(sample, design, "y", 1.0)
    pdf = sample.toPandas()
    x = design.matrix(pdf)
    want = np.linalg.solve(x.T @ x + np.diag([1e-9] + [1.0] * (x.shape[1] - 1)), x.T @ pdf["y"].to_numpy())
    assert np.allclose(model.coefficients, want)
    m = ridge.metrics(ridge.with_prediction(sample, model), "y").first()
    assert m.n == 600 and m.r2_log > 0.9


def test_model_is_stored_and_read(sample, tmp_path):
    model = ridge.fit_ridge(sample, features.learn_design(sample, ["a"], ["b"], ["c"], 5), "y", 1.0)
    again = ridge.Ridge.load(model.save(str(tmp_path / "m.json")))
    pdf = sample.toPandas()
    assert np.allclose(again.predict(pdf), model.predict(pdf)) and again.effects() == model.effects()


def test_importance_contrast_crossfit(sample):
    design = features.learn_design(sample, ["a"], ["b"], ["c"], 5)
    model = ridge.fit_ridge(sample, design, "y", 1.0)
    got = {r.feature: r.rmse_increase for r in ridge.permutation_importance(sample, model, "y", {"a": ["a"], "b": ["b"]}, ["id"], 1).collect()}
    assert got["a"] > got["b"] > 0
    assert ridge.contrast(sample, model, "a", 0.0, 0.1).first().effect_pct == pytest.approx((np.exp(0.2) - 1) * 100, rel=0.1)
    out = ridge.cross_fitted(sample, ["a"], ["b"], ["c"], "y", "c", "id", 3, least_frequency=5)
    assert out.count() == 600 and abs(out.agg(F.avg("residual")).first()[0]) < 0.05
    alpha, scores = ridge.select_alpha(sample, sample, design, "y")
    assert alpha == 0.1 and len(scores) == 4


def test_crossfit_and_importance_queries_do_the_whole_job(spark, small):
    out = models.crossfit_residuals(spark, small).collect()
    assert sum(r.n for r in out) == spark.read.parquet(f"{small}/lineitem.parquet").count()
    assert {r.fold for r in out} == set(range(5)) and all(r.mean_residual is not None for r in out)
    assert {r.repeats for r in models.permutation_importance(spark, small).collect()} == {3}


def test_clusters_pass_the_gate_only_if_there_are_any(spark):
    rng = np.random.default_rng(1)
    rows = [(float(rng.normal(m, 0.2)), float(rng.normal(-m, 0.2))) for m in (0, 5, 10) for _ in range(80)]
    df, columns = segments.scaled_matrix(spark.createDataFrame(rows, "p double, q double"), ["p", "q"])
    table = segments.candidates(df, columns, (3, 4))
    assert segments.choose(table) == 3
    noise, columns = segments.scaled_matrix(spark.createDataFrame([(float(v),) for v in rng.uniform(size=50)], "p double"), ["p"])
    assert segments.choose(segments.candidates(noise, columns, (5,))) is None


def test_adjusted_rand(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 0), (2, 2)], "a int, b int")
    assert segments.adjusted_rand(df, "a", "b") == 1.0
    assert segments.adjusted_rand(df.withColumn("b", F.lit(1)), "a", "b") == 0.0


def test_raw_csv_keeps_texts(spark, tmp_path):
    p = tmp_path / "raw.csv"
    p.write_text('city_slug,price_value\na,"1,000"\n"b ""x""","line\nbreak"\n,007\n', encoding="utf-8")
    assert files.csv_columns(spark, str(p)) == ["city_slug", "price_value"]
    df = files.with_row_numbers(files.raw_csv(spark, str(p), ["city_slug", "price_value"]))
    assert [tuple(r) for r in df.collect()] == [(1, "a", "1,000"), (2, 'b "x"', "line\nbreak"), (3, None, "007")]
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.raw_csv(spark, str(bad), ["a", "b"]).collect()


def test_publish_only_after_checks(spark, tmp_path):
    target = str(tmp_path / "out")
    files.publish(spark.range(3), target, lambda df: [make_check("rows", df.count(), 3, df.count() == 3)])
    with pytest.raises(ValueError, match="rows"):
        files.publish(spark.range(2), target, lambda df: [make_check("rows", df.count(), 3, df.count() == 3)])
    assert spark.read.parquet(target).count() == 3
    files.write_parquet(spark.range(5), target)
    assert spark.read.parquet(target).count() == 5 and len(list(tmp_path.iterdir())) == 1
    files.write_json(str(tmp_path / "m" / "x.json"), {"a": 1})
    assert files.read_json(str(tmp_path / "m" / "x.json")) == {"a": 1} and files.read_json(str(tmp_path / "none"), {}) == {}
    assert files.setting({"a": {"b": 2}}, "a", "b") == 2 and files.setting({"a": 1}, "a", "b", default=9) == 9


def test_repository(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "a", None), (3, "b", 5.0), (4, None, 1.0)], "id long, c string, v double")
    r = Repository({"t": df}, {"t": ["id"]})
    n, page = r.query("t", sort_by="v", descending=True, limit=2)
    assert n == 4 and [x.id for x in page.collect()] == [1, 3]
    assert [x.id for x in r.query("t", sort_by="v", limit=9)[1].collect()] == [4, 1, 3, 2]
    assert r.query("t", {"c": None})[0] == 1 and r.query("t", in_filters={"c": ["a", "b"]})[0] == 3 and r.query("t", in_filters={"c": []})[0] == 0
    assert [x.id for x in r.query("t", sort_by="id", limit=2, offset=3)[1].collect()] == [4]
    with pytest.raises(UnknownDataset):
        r.query("u")
    with pytest.raises(BadRequest):
        r.query("t", {"zz": 1})
    with pytest.raises(BadRequest):
        r.query("t", limit=0)


def test_stream_equals_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    aggs = lambda: [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]
    folder = str(tmp_path / "in")
    events.orderBy("ts").coalesce(1).write.parquet(folder)
    stream = windowed_rollup(spark.readStream.schema(events.schema).parquet(folder), "ts", ["event_type"], aggs())
    q = stream.writeStream.format("memory").queryName("rolled").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r.window_start, r.event_type): (r.n, round(r.total, 6)) for r in windowed_rollup(events, "ts", ["event_type"], aggs()).collect()}
    assert {(r.window_start, r.event_type): (r.n, round(r.total, 6)) for r in spark.table("rolled").collect()} == want
