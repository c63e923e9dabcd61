"""Conformed dimensions and common columns of published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arzyab.functions.columns import humanised, location_key


def month_dimension(df: DataFrame, month: str) -> DataFrame:
    """One row per distinct month: key yyyyMM, parts, and its place in time."""
    keys = df.select(F.col(month).alias("month")).where("month IS NOT NULL").distinct().withColumn("month_key", (F.year("month") * 100 + F.month("month")).cast("int"))
    return keys.select("month", "month_key", F.floor(F.col("month_key") / 100).cast("int").alias("year"), (F.col("month_key") % 100).alias("month_number"), F.ceil((F.col("month_key") % 100) / 3).cast("int").alias("quarter"), F.dense_rank().over(Window.orderBy("month_key")).alias("chronological_sort"))


def location_dimension(df: DataFrame, city: str, part: str) -> DataFrame:
    """National, city and neighborhood rows with their keys; parts without a city name no place."""
    places = df.select(F.col(city).alias("city"), F.col(part).alias("part")).where("city IS NOT NULL").distinct()
    level = lambda x: F.lit(x).alias("location_level")
    empty = F.lit(None).cast("string")
    cities = places.select("city").distinct().select(level("city"), "city", empty.alias("part"))
    parts = places.where("part IS NOT NULL").select(level("neighborhood"), "city", "part")
    nation = df.sparkSession.range(1).select(level("national"), empty.alias("city"), empty.alias("part"))
    rows = nation.unionByName(cities).unionByName(parts)
    return rows.select(location_key(F.col("location_level"), F.col("city"), F.col("part")).alias("location_key"), "location_level", "city", "part", F.coalesce(humanised(F.lower("part")), humanised(F.lower("city")), F.lit("National")).alias("display_name"))


def with_conflicts(df: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """key, each attribute's least value and how many distinct values it has; more than one is a conflict."""
    return df.groupBy(key).agg(*[f for a in attributes for f in (F.min(a).alias(a), F.count_distinct(a).alias(f"{a}_values"))])


def standardised(df: DataFrame, stamps: dict[str, str], last: list[str]) -> DataFrame:
    """Constant columns added and the common columns moved to the end; a common column that is absent becomes a NULL text."""
    df = df.withColumns({k: F.lit(v) for k, v in stamps.items()})
    df = df.withColumns({c: F.lit(None).cast("string") for c in last if c not in df.columns})
    return df.select(*[c for c in df.columns if c not in last], *last)
