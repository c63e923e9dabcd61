"""Readers and sinks of files. Sinks write beside the target and rename, so a reader never sees half a table."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from arzyab.operators.quality import Check, overall


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file with a header; reads its first line only."""
    return spark.read.text(path).first()[0].split(",")


def raw_csv(spark: SparkSession, path: str, columns: list[str], most_rows: int | None = None) -> DataFrame:
    """A CSV table as texts, nothing inferred; quoted line ends and doubled quotes belong to values, ragged lines fail."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", enforceSchema=False).csv(path)
    return df if most_rows is None else df.limit(most_rows)


def with_row_numbers(df: DataFrame, name: str = "source_row_id") -> DataFrame:
    """Dense numbers from 1 in file order: one count a partition, then an offset each."""
    schema = T.StructType([T.StructField(name, T.LongType(), False), *df.schema.fields])
    return df.rdd.zipWithIndex().map(lambda x: (x[1] + 1, *x[0])).toDF(schema)


def read_json(path: str, default=None):
    """A small JSON document; ``default`` where the file is absent."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        if default is None:
            raise
        return default


def setting(tree: dict, *keys: str, default=None):
    """A value of nested settings, or the default where a level is absent."""
    for k in keys:
        if not isinstance(tree, dict) or k not in tree:
            return default
        tree = tree[k]
    return tree


def write_text(path: str, text: str) -> str:
    """Small texts (manifests, reports): written beside the target, then renamed."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    part.write_text(text, encoding="utf-8")
    os.replace(part, target)
    return str(target)


def write_json(path: str, value) -> str:
    return write_text(path, json.dumps(value, ensure_ascii=False, indent=2, default=str))


def _rename(spark: SparkSession, source: str, target: str) -> None:
    jvm = spark._jvm
    to = jvm.org.apache.hadoop.fs.Path(target)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(to, True)
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(source), to):
        raise OSError(f"{source} can't be renamed to {target}")


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Zstandard Parquet, written to a sibling and renamed to ``path`` on whatever file system it is."""
    part = f"{path.rstrip('/')}.part-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*(partition_by or [])).parquet(part)
    _rename(df.sparkSession, part, path)
    return path


def publish(df: DataFrame, path: str, gate: Callable[[DataFrame], list[Check]]) -> list[Check]:
    """Candidate, checks, then publication: the candidate is written, its written form is checked, and only without a critical failure
    does it take the target's place. A failing candidate is removed."""
    spark = df.sparkSession
    part = f"{path.rstrip('/')}.candidate-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(part)
    checks = gate(spark.read.parquet(part))
    if overall(checks) == "FAIL":
        p = spark._jvm.org.apache.hadoop.fs.Path(part)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        raise ValueError("; ".join(f"{c.name}: {c.actual}, expected {c.expected}" for c in checks if c.status == "FAIL"))
    _rename(spark, part, path)
    return checks
