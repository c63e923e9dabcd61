"""Percentiles from mergeable logarithmic buckets (problem 5).

A value v goes to bucket (sign, ceil(log_g |v|)), g = (1+e)/(1-e); zero has its own. All values of a bucket lie within a factor g
of each other, so the bucket's middle 2 g^i / (g+1) is off by at most the relative error e. Sketches of parts are merged by adding
the counts of equal buckets. Everything is built-in expressions: one partial aggregation before one shuffle of compact counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


def bucket_sketch(df: DataFrame, keys: list[str], value: str, error: float = 0.01) -> DataFrame:
    """keys, bucket, n: how many values of each key lie in each bucket.

    bucket orders as the values do: 2 * index + offset for positive values, its mirror image for negative ones, 0 for zero. NULL
    and NaN values are left out; NULL keys are a key of their own. An empty table gives no rows. The number of buckets of a key
    depends on the range of its values (at e = 0.01 about 115 a decade), not on their number.
    """
    v = F.col(value).cast("double")
    step = math.log((1 + error) / (1 - error))
    # 100000 is beyond the index of any finite double at e >= 0.01; smaller errors get a larger offset.
    offset = F.lit(int(100_000 * max(1, 0.01 / error)))
    index = F.ceil(F.ln(F.abs(v)) / F.lit(step)).cast("long") + offset
    bucket = F.when(v > 0, index).when(v < 0, -index).when(v == 0, F.lit(0).cast("long"))
    return df.select(*keys, bucket.alias("bucket"), v.alias("v_")).where(F.col("bucket").isNotNull() & ~F.isnan("v_")).groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of parts added up over what is not in ``keys``."""
    return sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def bucket_value(bucket: Column, error: float) -> Column:
    offset = int(100_000 * max(1, 0.01 / error))
    g = (1 + error) / (1 - error)
    size = F.lit(2 / (g + 1)) * F.exp((F.abs(bucket) - offset) * F.lit(math.log(g)))
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket.cast("double")) * size)


def sketch_percentiles(sketches: DataFrame, keys: list[str], percentiles: tuple[float, ...] = PERCENTILES, error: float = 0.01, digits: int | None = None) -> DataFrame:
    """keys, n and a column per percentile (p50 ...): the value at rank floor(q * (n - 1)), within relative error ``error``; rounded if
    digits are given."""
    w = Window.partitionBy(*keys).orderBy("bucket")
    shown = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    run = sketches.withColumns({"upto": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(Window.partitionBy(*keys))})
    return run.groupBy(*keys).agg(
        F.max("all").alias("n"),
        *[shown(bucket_value(F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("all") - 1)), F.col("bucket"))), error)).alias(f"p{round(q * 100)}") for q in percentiles],
    )


def percentiles_sql(source: str, keys: list[str], value: str, percentiles: tuple[float, ...] = PERCENTILES, error: float = 0.01, digits: int = 2) -> str:
    """The same sketch and percentiles in DuckDB."""
    g = (1 + error) / (1 - error)
    offset, step, k = int(100_000 * max(1, 0.01 / error)), math.log(g), ", ".join(keys)
    picks = ", ".join(f"min(CASE WHEN upto > floor({q} * (alln - 1)) THEN bucket END) AS b{round(q * 100)}" for q in percentiles)
    out = ", ".join(f"round({2 / (g + 1)!r} * exp((b{round(q * 100)} - {offset}) * {step!r}), {digits}) AS p{round(q * 100)}" for q in percentiles)
    return (
        f"WITH v AS (SELECT {k}, CAST({value} AS DOUBLE) AS v FROM ({source})), b AS (SELECT {k}, CAST(ceil(ln(v) / {step!r}) AS BIGINT) + {offset} AS bucket, count(*) AS n FROM v WHERE v > 0 GROUP BY ALL), "
        f"r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY {k} ORDER BY bucket) AS BIGINT) AS upto, CAST(sum(n) OVER (PARTITION BY {k}) AS BIGINT) AS alln FROM b) "
        f"SELECT {k}, n, {out} FROM (SELECT {k}, max(alln) AS n, {picks} FROM r GROUP BY {k})"
    )
