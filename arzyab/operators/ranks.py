"""Ranks, percentiles of rank, shares and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arzyab.functions.session import written


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank with ties sharing the mean of their places; NULL for NULL."""
    w = Window.partitionBy(*keys, F.col(value).isNull()).orderBy(value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.when(F.col(value).isNotNull(), F.rank().over(w) + (ties - 1) / 2)


def percentile_rank(value: str, keys: list[str]) -> Column:
    """Average rank over the number of values; 0.5 where all values of the group are one."""
    w = Window.partitionBy(*keys)
    n = F.count(value).over(w)
    one = F.min(value).over(w) == F.max(value).over(w)
    return F.when(F.col(value).isNull(), None).when(one, F.lit(0.5)).otherwise(average_rank(value, keys) / n)


def scaled_rank(value: str, keys: list[str], low: float = 0.0, high: float = 1.0) -> Column:
    """Average rank mapped to [low, high]; the middle where there is one value."""
    n = F.count(value).over(Window.partitionBy(*keys))
    return F.when(n <= 1, F.lit((low + high) / 2)).otherwise(F.lit(low) + F.lit(high - low) * F.try_divide(average_rank(value, keys) - 1, (n - 1).cast("double")))


def top_each(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark limits each partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_each(df, keys, order, 1).drop("place")


def share_within(value: str, keys: list[str]) -> Column:
    return F.try_divide(F.col(value).cast("double"), F.sum(value).over(Window.partitionBy(*keys)).cast("double"))


def cut_two(value: Column, first: float, second: float, labels: tuple[str, str, str]) -> Column:
    """Right-closed bins with two cut points; NULL stays NULL."""
    return F.when(value <= first, F.lit(labels[0])).when(value <= second, F.lit(labels[1])).when(value.isNotNull(), F.lit(labels[2]))


def running_total(counts: DataFrame, order: str | list[Column], n: str, name: str = "before") -> DataFrame:
    """``counts`` with the sum of n over all rows that come earlier in ``order``, which must tell all rows apart.

    A global prefix sum without a one-task window: rows are range-partitioned and written, each partition's total (one number a
    partition) is summed on the driver, and each partition adds its own offset.
    """
    by = [order] if isinstance(order, str) else order
    parts = written(counts.repartitionByRange(*by).withColumn("part_", F.spark_partition_id()))
    totals = sorted((r.part_, r.t or 0) for r in parts.groupBy("part_").agg(F.sum(n).alias("t")).collect())
    offsets, run = [], 0
    for p, t in totals:
        offsets.append((p, run))
        run += t
    if not offsets:
        return parts.drop("part_").withColumn(name, F.lit(0))
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in offsets for x in pair]), F.col("part_"))
    w = Window.partitionBy("part_").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(name, offset + F.coalesce(F.sum(n).over(w), F.lit(0))).drop("part_")


def before_within(df: DataFrame, keys: list[str], order: list[Column], weight: str, name: str = "before") -> DataFrame:
    """``df`` with the weight of the rows that come earlier in their key by ``order``, and ``<name>_of``, the key's whole weight.

    As a running sum over a window, but a key with a third of all rows is spread over many tasks: rows are range-partitioned by key and
    order and written; a key that crosses partitions gets the sums of its earlier ones as offsets (one row per key and partition).
    NULL keys are a key.
    """
    parts = written(df.repartitionByRange(*keys, *order).withColumn("part_", F.spark_partition_id()))
    pieces = parts.groupBy(*keys, "part_").agg(F.sum(weight).alias("c_"))
    w = Window.partitionBy(*keys)
    earlier = Window.unboundedPreceding, -1
    pieces = pieces.select(*[F.col(k).alias(f"key__{i}") for i, k in enumerate(keys)], F.col("part_").alias("piece__"), F.coalesce(F.sum("c_").over(w.orderBy("part_").rowsBetween(*earlier)), F.lit(0)).alias("offset_"), F.sum("c_").over(w).alias(f"{name}_of"))
    own = parts.withColumn("own_", F.coalesce(F.sum(weight).over(Window.partitionBy("part_", *keys).orderBy(*order).rowsBetween(*earlier)), F.lit(0)))
    on = own["part_"] == pieces["piece__"]
    for i, k in enumerate(keys):
        on &= own[k].eqNullSafe(pieces[f"key__{i}"])
    return own.join(pieces, on).select(*[own[c] for c in df.columns], (F.col("own_") + F.col("offset_")).alias(name), f"{name}_of")


def position_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with each row's place (from 1) within its key by ``order``, and ``<name>_of``, the key's number of rows; safe for hot keys."""
    placed = before_within(df.withColumn("one_", F.lit(1).cast("long")), keys, order, "one_", name)
    return placed.select(*df.columns, (F.col(name) + 1).alias(name), f"{name}_of")


def with_average_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``df`` with avg_rank (ties share the mean of their places) and ranked (the key's number of values); NULL values get NULL.

    As ``average_rank``, for keys of any size: distinct values are counted first, placed by ``before_within`` and joined back.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], F.col(value).alias("value_")).agg(F.count(F.lit(1)).alias("n_"))
    placed = before_within(counts, [f"key_{i}" for i in range(len(keys))], [F.col("value_")], "n_")
    on = df[value] == placed["value_"]
    for i, k in enumerate(keys):
        on &= df[k].eqNullSafe(placed[f"key_{i}"])
    return df.join(placed, on, "left").select(*[df[c] for c in df.columns], (F.col("before") + (F.col("n_") + 1) / 2).alias("avg_rank"), F.col("before_of").alias("ranked"))
