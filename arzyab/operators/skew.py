"""Per-key results without imbalance (problem 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arzyab.functions.session import written
from arzyab.functions.text import given


def key_statistics(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Row count and figures of ``values`` per key, as a plain grouping gives them.

    Every figure is algebraic (count, sum, min, max, and mean from sum and count), so Spark's partial hash aggregation runs
    before the shuffle: each map task keeps a bounded hash table of key states and hands over at most one compact state per
    key and task. A key with a third of all rows costs its reducer one row per map task, like any other key.

    NULL keys form a group of their own. NULL values are left out of their figures; a key without values gets NULL figures
    and a count of 0. An empty table gives no rows. Columns of ``df`` not named are ignored.
    """
    # Columns are read by position-free references of a narrowed frame, so extra columns with the names of results don't clash.
    narrow = df.select(*keys, *values)
    aggs: list[Column] = [F.count(F.lit(1)).alias("row_count")]
    for v in values:
        aggs += [F.count(v).alias(f"{v}_count"), F.sum(v).alias(f"{v}_sum"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max"), (F.sum(v) / F.count(v)).alias(f"{v}_mean")]
    return narrow.groupBy(*keys).agg(*aggs)


def heavy_keys(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Keys with all parts given that occur in at least ``share`` of all rows (rows without a key count in the total).

    The counts come from ``key_statistics``; the total is the sum over its groups, one more aggregation of compact states.
    Blank parts and words for "nothing given" are no parts. An empty table gives no rows.
    """
    counted = key_statistics(df.select(*[given(F.col(k)).alias(f"{k}_") for k in keys], *keys), [*keys, *[f"{k}_" for k in keys]], [])
    present = F.lit(True)
    for k in keys:
        present &= F.col(f"{k}_").isNotNull()
    # Counts by key are written once, so the table is scanned once for the counts and their total.
    by_key = written(counted.groupBy(*[F.when(present, F.col(f"{k}_")).alias(k) for k in keys]).agg(F.sum("row_count").alias("n")))
    total = by_key.agg(F.sum("n").alias("total"))  # one row
    found = F.lit(True)
    for k in keys:
        found &= F.col(k).isNotNull()
    return by_key.crossJoin(F.broadcast(total)).where(found & (F.col("n") >= F.lit(share) * F.col("total"))).select(*keys)
