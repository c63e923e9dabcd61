"""Multi-level rollups, change between periods, and joins of summaries on keys that may be NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arzyab.operators.percentiles import group_percentiles


QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def at_levels(df: DataFrame, levels: list[str]) -> DataFrame:
    """Each row once for every level (nothing / first level / first two levels ...), with ``level`` = number of levels kept. A NULL level
    value is data, not a total, and ``level`` tells them apart. At the finest level rows without its key are left out, as they name no
    place."""
    expanded = df.select("*", F.explode(F.array(*[F.lit(k) for k in range(len(levels) + 1)])).alias("level"))
    for i, name in enumerate(levels):
        expanded = expanded.withColumn(name, F.when(F.col("level") > i, F.col(name)))
    if levels:
        expanded = expanded.where((F.col("level") < len(levels)) | F.col(levels[-1]).isNotNull())
    return expanded


def rollup_levels(df: DataFrame, period: str, levels: list[str], aggs: list[Column]) -> DataFrame:
    """One row per period and level with its keys. Each row goes to every level once (after column pruning), then one aggregation serves all
    levels; aggregates should combine before the shuffle (for percentiles see ``level_percentiles``). NULL periods are a group."""
    return at_levels(df, levels).groupBy(period, "level", *levels).agg(*aggs)


def level_percentiles(df: DataFrame, period: str, levels: list[str], value: str, wanted: dict[str, float] = QUARTILES) -> DataFrame:
    """period, level, levels, n (values given) and exact percentiles of ``value``, safe for groups of any size."""
    return group_percentiles(at_levels(df.select(period, *levels, value), levels), [period, "level", *levels], value, wanted)


def named_places(df: DataFrame, levels: list[str], level: str = "level") -> DataFrame:
    """Rows whose keys are given exactly as far as their level goes, so that each names a place."""
    fits = F.lit(True)
    for i, name in enumerate(levels):
        fits &= F.col(name).isNotNull() == (F.col(level) > i)
    return df.where(fits)


def change_from_previous(df: DataFrame, keys: list[str], period: str, value: str, name: str, step: Column | None = None) -> DataFrame:
    """Percent change from the previous row of the key; with ``step`` (a period number) only from the directly preceding period.

    NULL where there is no previous value or it is NULL or 0.
    """
    w = Window.partitionBy(*keys).orderBy(period)
    before = F.lag(value).over(w)
    change = F.when((before.isNotNull()) & (before != 0), (F.col(value) / before - 1) * 100)
    if step is not None:
        change = F.when(step - F.lag(step).over(w) == 1, change)
    return df.withColumn(name, change)


def full_join_on(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with coalesced keys in which NULL equals NULL; a hash or sort-merge equi-join, not a nested loop."""
    right = b.select(*[F.col(k).alias(f"{k}__r") for k in keys], *[c for c in b.columns if c not in keys])
    on = reduce(lambda x, y: x & y, [a[k].eqNullSafe(right[f"{k}__r"]) for k in keys])
    joined = a.join(right, on, "full")
    return joined.select(*[F.coalesce(a[k], right[f"{k}__r"]).alias(k) for k in keys], *[a[c] for c in a.columns if c not in keys], *[right[c] for c in b.columns if c not in keys])


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str], relative: float = 1e-9, absolute: float = 1e-6) -> DataFrame:
    """One row per metric: rows only in a, only in b, matched, mismatched beyond tolerance."""
    left = a.select(*keys, *[F.col(m).cast("double").alias(f"{m}__a") for m in metrics], F.lit(True).alias("in_a"))
    right = b.select(*keys, *[F.col(m).cast("double").alias(f"{m}__b") for m in metrics], F.lit(True).alias("in_b"))
    both = full_join_on(left, right, keys)

    def off(m: str) -> Column:
        x, y = F.col(f"{m}__a"), F.col(f"{m}__b")
        return (x.isNull() != y.isNull()) | (F.abs(x - y) > F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(x), F.abs(y))))

    here = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    row = both.agg(
        F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"), F.count_if(here).alias("matched"),
        *[F.count_if(here & F.coalesce(off(m), F.lit(False))).alias(f"off_{m}") for m in metrics],
    )
    return row.select("only_a", "only_b", "matched", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"off_{m}").alias("mismatched")) for m in metrics])).alias("x")).select("x.metric", "only_a", "only_b", "matched", "x.mismatched")


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts by column name; columns that a part lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
