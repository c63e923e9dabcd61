"""Measures of reports: sums under a level, latest period, values gated by eligibility, and period changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at_level(level: str, column: str = "level") -> Column:
    return F.col(column) == level


def latest(df: DataFrame, period: str, value: str, keys: list[str]) -> DataFrame:
    """keys, the last period with a value, and the value then."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max(period).alias(period), F.max_by(value, period).alias(value))


def eligible_value(df: DataFrame, value: str, eligible: str, keys: list[str]) -> DataFrame:
    """keys and the value where the flag allows it, NULL otherwise."""
    return df.groupBy(*keys).agg(F.max(F.when(F.coalesce(F.col(eligible), F.lit(False)), F.col(value))).alias(value))


def period_change(df: DataFrame, period: str, value: str, keys: list[str]) -> DataFrame:
    """keys, first and last value and their percent change; NULL on a zero start."""
    ends = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, period).alias("first_value"), F.max_by(value, period).alias("last_value"))
    return ends.withColumn("change_pct", (F.try_divide(F.col("last_value").cast("double"), F.col("first_value").cast("double")) - 1) * 100)
