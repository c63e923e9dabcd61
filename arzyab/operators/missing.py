"""Which fields have no usable value though they apply (problem 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arzyab.functions.text import fold, fold_sql, given, given_sql

FIELDS = ("construction_year", "rooms_count", "floor", "neighborhood_slug")
# Prefixes of cat3_slug to which a field applies.
APPLIES = {
    "construction_year": ("apartment-", "house-villa-", "office-", "shop-", "industry-agriculture-business-"),
    "rooms_count": ("apartment-", "house-villa-", "office-"),
    "floor": ("apartment-", "office-", "shop-"),
}
YEARS = r"^(1[23]\d\d|14\d\d|19\d\d|20\d\d)$"


def usable(name: str) -> Column:
    """The folded value of a field, NULL if it says nothing or, for a year, is a bare number that cannot be one."""
    t = given(F.col(name))
    if name == "construction_year":
        t = F.when(t.rlike(r"^[\d\s.,-]+$") & ~t.rlike(YEARS), F.lit(None)).otherwise(t)
    return t


def applies(name: str) -> Column:
    """Whether the field belongs to the kind of property; never NULL."""
    if name == "neighborhood_slug":
        return given(F.col("city_slug")).isNotNull()
    kind = fold(F.col("cat3_slug"))
    return F.coalesce(_any([kind.startswith(p) for p in APPLIES[name]]), F.lit(False))


def _any(cs: list[Column]) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out |= c
    return out


def missing_fields(listings: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row (source_row_id, field_name) for each field without usable value where it applies. No shuffle.

    NULL cat3_slug: none of the property fields applies. Rows with equal ids repeat. An empty table gives no rows.
    """
    return listed(listings, {f: applies(f) & usable(f).isNull() for f in fields})


def listed(rows: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """One row (source_row_id, field_name) for each mark that is true."""
    cases = F.filter(F.array(*[F.when(on, F.lit(f)) for f, on in marks.items()]), lambda x: x.isNotNull())
    return rows.select("source_row_id", F.explode(cases).alias("field_name"))


def missing_sql(table: str = "listings") -> str:
    parts = []
    for f in FIELDS:
        t = given_sql(f)
        if f == "construction_year":
            t = rf"CASE WHEN regexp_matches({t}, '^[\d\s.,-]+$') AND NOT regexp_matches({t}, '{YEARS}') THEN NULL ELSE {t} END"
        on = f"({given_sql('city_slug')}) IS NOT NULL" if f == "neighborhood_slug" else "(" + " OR ".join(f"starts_with({fold_sql('cat3_slug')}, '{p}')" for p in APPLIES[f]) + ")"
        parts.append(f"SELECT source_row_id, '{f}' AS field_name FROM {table} WHERE {on} AND ({t}) IS NULL")
    return " UNION ALL ".join(parts)
