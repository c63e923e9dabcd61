"""Flags for values outside grouped bounds; rows are flagged, never removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arzyab.operators.percentiles import group_percentiles


def iqr_bounds(df: DataFrame, keys: list[str], value: str, multiplier: float, least_rows: int) -> DataFrame:
    """keys, n, lower, upper of groups with enough positive values and a spread; the lower bound is at least 0."""
    q1, q3 = F.col("q1"), F.col("q3")
    return (
        group_percentiles(df.where(F.col(value) > 0), keys, value, {"q1": 0.25, "q3": 0.75}, least_rows=least_rows).where(q3 > q1)
        .select(*keys, "n", F.greatest(F.lit(0.0), q1 - multiplier * (q3 - q1)).alias("lower"), (q3 + multiplier * (q3 - q1)).alias("upper"))
    )


def flag_outliers(df: DataFrame, value: str, keys: list[str], fallback_keys: list[str], name: str, reference: Column | None = None, multiplier: float = 3.0, least_rows: int = 50, least_fallback: int = 200) -> DataFrame:
    """``df`` with a never-NULL flag: a positive value outside its group's bounds, or its fallback group's where the group is too small.

    reference restricts the rows that shape the bounds. NULL keys match no bounds, so such rows use the fallback or stay unflagged.
    Bounds have one row per supported group; AQE broadcasts them where they are small.
    """
    base = df if reference is None else df.where(reference)
    local = iqr_bounds(base, keys, value, multiplier, least_rows).select(*keys, F.col("lower").alias("lo_l"), F.col("upper").alias("hi_l"))
    wide = iqr_bounds(base, fallback_keys, value, multiplier, least_fallback).select(*fallback_keys, F.col("lower").alias("lo_w"), F.col("upper").alias("hi_w"))
    lower, upper, v = F.coalesce("lo_l", "lo_w"), F.coalesce("hi_l", "hi_w"), F.col(value)
    flag = F.coalesce((v > 0) & ((v < lower) | (v > upper)), F.lit(False))
    return df.join(local, keys, "left").join(wide, fallback_keys, "left").withColumn(name, flag).select(*df.columns, name)


def sensitivity(df: DataFrame, value: str) -> DataFrame:
    """One row: n and how many values three global rules would flag (2 and 3 x IQR, log-MAD 3.5)."""
    v = F.col(value).cast("double")
    positive = df.where(v > 0).select(v.alias("v"), F.ln(v).alias("l"))
    a = group_percentiles(positive, [], "v", {"q1": 0.25, "q3": 0.75}).drop("n").crossJoin(group_percentiles(positive, [], "l", {"m": 0.5}).drop("n"))  # one row each
    with_a = positive.crossJoin(F.broadcast(a))
    d = group_percentiles(with_a, [], F.abs(F.col("l") - F.col("m")), {"mad": 0.5}).drop("n")
    out = lambda k: F.count_if((F.col("v") < F.greatest(F.lit(0.0), F.col("q1") - k * (F.col("q3") - F.col("q1")))) | (F.col("v") > F.col("q3") + k * (F.col("q3") - F.col("q1"))))
    return with_a.crossJoin(F.broadcast(d)).agg(F.count(F.lit(1)).alias("n"), out(2.0).alias("iqr2"), out(3.0).alias("iqr3"), F.count_if(F.abs(F.col("l") - F.col("m")) / (1.4826 * F.col("mad")) > 3.5).alias("log_mad"))


def minimum_n(df: DataFrame, keys: list[str], thresholds: list[int]) -> DataFrame:
    """threshold, groups, rows: how much support remains when small groups are left out."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    each = counts.select("c", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    return each.groupBy("threshold").agg(F.count_if(F.col("c") >= F.col("threshold")).alias("groups"), F.sum(F.when(F.col("c") >= F.col("threshold"), F.col("c")).otherwise(0)).alias("rows"))


def trimmed(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows within the central quantiles of each column in turn, each column's quantiles taken after the trims before it."""
    for c in columns:
        q = group_percentiles(df, [], c, {"lo_": low, "hi_": high}).drop("n")
        df = df.crossJoin(F.broadcast(q)).where(F.col(c).between(F.col("lo_"), F.col("hi_"))).drop("lo_", "hi_")
    return df
