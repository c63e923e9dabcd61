"""Checks with a status, keys, grain and column contracts."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """One check's outcome: PASS, REVIEW (does not block) or FAIL."""

    name: str
    actual: str
    expected: str
    status: str
    critical: bool = True
    notes: str = ""


def make_check(name: str, actual, expected, passed: bool, critical: bool = True, review: bool = False, notes: str = "") -> Check:
    return Check(name, str(actual), str(expected), "PASS" if passed else "REVIEW" if review else "FAIL", critical, notes)


def overall(checks: list[Check]) -> str:
    """FAIL if a critical check fails, else REVIEW if any check asks for it, else PASS."""
    if any(c.status == "FAIL" and c.critical for c in checks):
        return "FAIL"
    return "REVIEW" if any(c.status == "REVIEW" for c in checks) else "PASS"


def check_table(spark, checks: list[Check]) -> DataFrame:
    return spark.createDataFrame([asdict(c) for c in checks], "name string, actual string, expected string, status string, critical boolean, notes string")


def missing_keys(facts: DataFrame, key: str, dimension: DataFrame, dimension_key: str) -> DataFrame:
    """Distinct non-NULL fact keys that the dimension lacks."""
    keys = facts.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct()
    return keys.join(dimension.select(F.col(dimension_key).alias("key")), "key", "left_anti")


def repeated_grain(df: DataFrame, keys: list[str]) -> DataFrame:
    """Grain keys with more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def contract_checks(df: DataFrame, name: str, required: list[str], grain: list[str], forbidden: tuple[str, ...] = (), least_rows: int = 1) -> list[Check]:
    """Columns that must and must not be there, rows, uniqueness and non-NULL parts of the grain: one aggregate job and one count."""
    lacking = sorted(set(required) - set(df.columns))
    bad = sorted(c for c in df.columns if any(t in c.lower() for t in forbidden))
    there = [g for g in grain if g in df.columns]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(g).isNull()).alias(f"null_{g}") for g in there]).first()
    out = [
        make_check(f"{name}: columns", lacking or "all", "all", not lacking),
        make_check(f"{name}: forbidden columns", bad or "none", "none", not bad),
        make_check(f"{name}: rows", row["n"], f">= {least_rows}", row["n"] >= least_rows),
        *[make_check(f"{name}: {g} given", row[f"null_{g}"], 0, row[f"null_{g}"] == 0, critical=False, review=True) for g in there],
    ]
    if len(there) == len(grain):
        repeated = repeated_grain(df, grain).count()
        out.append(make_check(f"{name}: grain", repeated, 0, repeated == 0))
    return out


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, column_type, position of everything that is published."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(n, f.name, f.dataType.simpleString(), i) for n, t in sorted(tables.items()) for i, f in enumerate(t.schema.fields, 1)], "table_name string, column_name string, column_type string, position int")


def relationship_checks(tables: dict[str, DataFrame], relationships: list[tuple[str, str, str, str]], nullable: tuple[tuple[str, str], ...] = ()) -> list[Check]:
    """(fact, key, dimension, key) by (fact, key, dimension, key): facts' keys that the dimension lacks, NULL keys, repeated dimension keys."""
    out = []
    for fact, key, dimension, dimension_key in relationships:
        lost = missing_keys(tables[fact], key, tables[dimension], dimension_key).count()
        empty = tables[fact].where(F.col(key).isNull()).limit(1).count()
        twice = repeated_grain(tables[dimension], [dimension_key]).limit(1).count()
        out.append(make_check(f"{fact}.{key} -> {dimension}.{dimension_key}", lost, 0, lost == 0))
        out.append(make_check(f"{fact}.{key}: given", empty, 0, empty == 0 or (fact, key) in nullable))
        out.append(make_check(f"{dimension}.{dimension_key}: unique", twice, 0, twice == 0))
    return out
