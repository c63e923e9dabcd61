"""Readers of the Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arzyab.functions.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table; Catalyst prunes its columns and pushes filters into the scan."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """The columns (all without names) over at least as many partitions as there are cores.

    For work that costs far more per row than moving the row. A table of one or a few files with few row groups would otherwise be
    read, and worked on, by as few tasks. A table with enough input partitions is left alone, so at scale nothing is shuffled.
    """
    df = df.select(*columns) if columns else df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)
