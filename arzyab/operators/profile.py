"""Profiles and audits: each is one pass over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arzyab.functions.columns import normalized_text
from arzyab.operators.ranks import running_total


def _short(text: Column) -> Column:
    """Long texts by their SHA-256, so that telling them apart doesn't move them."""
    return F.when(F.length(text) > 64, F.sha2(text, 256)).otherwise(text)


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, rows, missing (null-like texts count) and exact distinct of the others.

    The table is unpivoted and counted per (column, value) first, so many distinct counts need no Expand per column and combine
    before the shuffle.
    """
    # The raw values are unpivoted, and then one expression normalises them: one per column would be too much code to compile.
    raw = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("raw")) for c in columns])).alias("x")).select("x.column_name", "x.raw")
    pairs = raw.select("column_name", normalized_text(F.col("raw")).alias("v")).select("column_name", _short(F.col("v")).alias("v"))
    counted = pairs.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("column_name").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("missing"), F.count("v").alias("distinct_values"))


def frequencies(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """value, n, place by falling count then value; the k most frequent ones if k is given. NULL is a value and comes last among ties.

    Without k the places are a prefix count over range partitions, as a column may have any number of values.
    """
    order = [F.desc("n"), F.asc_nulls_last("value")]
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    if k is not None:
        first = counted.orderBy(*order).limit(k)
        return first.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # k rows
    return running_total(counted.withColumn("one_", F.lit(1)), order, "one_").select("value", "n", (F.col("before") + 1).alias("place"))


def parse_diagnostics(df: DataFrame, source: str, typed: Column, name: str) -> DataFrame:
    """One row: texts given, parsed, failed, and the range of parsed values."""
    t = normalized_text(F.col(source))
    return df.agg(F.lit(name).alias("field"), F.count(t).alias("given"), F.count(F.when(t.isNotNull(), typed)).alias("parsed"), F.count_if(t.isNotNull() & typed.isNull()).alias("failed"), F.min(typed).alias("least"), F.max(typed).alias("most"))


def counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row with how many rows meet each condition (NULL: not met)."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in conditions.items()])


def long_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """name, rows, n, rate: the same counts as rows."""
    one = counts(df, conditions)
    return one.select("rows", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("n")) for k in conditions])).alias("x")).select("x.name", "rows", "x.n", F.try_divide(F.col("x.n").cast("double"), F.col("rows").cast("double")).alias("rate"))
