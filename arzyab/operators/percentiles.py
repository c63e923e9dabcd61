"""Exact percentiles of groups of any size, without a state that grows with a group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arzyab.functions.session import written

RATIO = 1.002  # width of a bucket
MOST_BROADCAST = 100_000  # rows of (group, bucket, rank) that are broadcast, about 10 MB


def _bucket(v: Column) -> Column:
    """A whole number that orders as the values do and takes few distinct ones: the index of a logarithmic bucket, mirrored for negative
    values; 0 for zero and what is smaller than any price or size."""
    # 10,000,000 is beyond the index of the largest double; infinities have buckets of their own.
    size = F.when(F.abs(v) == float("inf"), F.lit(10_000_000)).otherwise(F.greatest(F.floor(F.log(F.abs(v)) / math.log(RATIO)).cast("long") + 1_000_000, F.lit(1)))
    return F.when(v == 0, F.lit(0).cast("long")).otherwise(F.signum(v).cast("long") * size)


def group_percentiles(df: DataFrame, keys: list[str], value: str | Column, wanted: dict[str, float], n: str = "n", least_rows: int = 1) -> DataFrame:
    """keys, n and a column per wanted percentile (name -> share): as ``percentile`` gives them, with linear interpolation.

    Two passes over narrow rows. The first counts values by group and logarithmic bucket (partial aggregation; the shuffle carries at
    most a few thousand counts a group and task) and finds the bucket of each rank. The second reads only values in those buckets, so
    about a five-hundredth of a group's values, and counts equal ones. NULL and NaN values are left out, so groups without
    values have no row; NULL keys are a key. With no keys there is one row, if there is a value. Groups of fewer than ``least_rows`` values
    are left out after the first pass.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    own = [f"k{i}_" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], v.alias("v_")).where(F.col("v_").isNotNull() & ~F.isnan("v_")).withColumn("bucket_", _bucket(F.col("v_")))
    group = Window.partitionBy(*own)
    counts = rows.groupBy(*own, "bucket_").agg(F.count(F.lit(1)).alias("c_"))
    run = counts.select(*own, "bucket_", "c_", F.coalesce(F.sum("c_").over(group.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"), F.sum("c_").over(group).alias("all_"))
    place = {name: (F.lit(float(q)) * (F.col("all_") - 1)) for name, q in wanted.items()}
    ranks = [f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil)]
    holds = F.exists(F.array(*ranks), lambda r: (r >= F.col("before_")) & (r < F.col("before_") + F.col("c_")))
    targets = written(run.where(holds & (F.col("all_") >= least_rows)).select(*[F.col(o).alias(f"t{o}") for o in own], F.col("bucket_").alias("at_"), "before_", "all_"))
    small = F.broadcast(targets) if targets.count() <= MOST_BROADCAST else targets
    on = F.col("bucket_") == F.col("at_")
    for o in own:
        on &= F.col(o).eqNullSafe(F.col(f"t{o}"))
    met = rows.join(small, on).groupBy(*own, "bucket_", "before_", "all_", "v_").agg(F.count(F.lit(1)).alias("c_"))
    inside = Window.partitionBy(*own, "bucket_").orderBy("v_").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("from_", F.col("before_") + F.coalesce(F.sum("c_").over(inside), F.lit(0)))
    at = lambda r: F.max(F.when((r >= F.col("from_")) & (r < F.col("from_") + F.col("c_")), F.col("v_")))
    picks = [x for i, name in enumerate(wanted) for x in (at(ranks[2 * i]).alias(f"lo_{name}"), at(ranks[2 * i + 1]).alias(f"hi_{name}"))]
    found = met.groupBy(*own, "all_").agg(*picks)
    between = lambda name: F.when(F.ceil(place[name]) == F.floor(place[name]), F.col(f"lo_{name}")).otherwise((F.ceil(place[name]) - place[name]) * F.col(f"lo_{name}") + (place[name] - F.floor(place[name])) * F.col(f"hi_{name}"))
    return found.select(*[F.col(o).alias(k) for k, o in zip(keys, own)], F.col("all_").alias(n), *[between(name).alias(name) for name in wanted])
