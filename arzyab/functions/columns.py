"""Column expressions for typing, keys and flags. All are built-in expressions; NULL means unknown and is never filled blindly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that stand for NULL in the raw table.
NULL_LIKE = ("", "null", "<null>", "none", "nan", "n/a", "na")
# Words of the rooms field.
ROOM_WORDS = {"بدون اتاق": 0, "یک": 1, "دو": 2, "سه": 3, "چهار": 4, "پنج یا بیشتر": 5}
# White space of Unicode, for trimming without a pattern.
WHITE_SPACE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
PERSIAN_DIGITS, ARABIC_DIGITS = "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def normalized_text(c: Column) -> Column:
    """Trimmed of all white space; NULL where a null-like text stands."""
    t = F.trim(c.cast("string"), F.lit(WHITE_SPACE))
    return F.when(F.lower(t).isin(*NULL_LIKE), F.lit(None)).otherwise(t)


def number_text(c: Column) -> Column:
    """ASCII digits without thousands separators, underscores and blanks."""
    return F.translate(normalized_text(c), PERSIAN_DIGITS + ARABIC_DIGITS + ",٬_ ", "0123456789" * 2)


def numeric(c: Column, kind: str) -> Column:
    """Cast that gives NULL instead of an error, also on overflow."""
    return number_text(c).try_cast(kind)


def boolean_text(c: Column) -> Column:
    """true and false only; anything else is unknown."""
    t = F.lower(normalized_text(c))
    return F.when(t == "true", F.lit(True)).when(t == "false", F.lit(False))


def truthy(c: Column) -> Column:
    """Whether a text says yes in any usual way; never NULL."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "y", "t"), F.lit(False))


def mapped(c: Column, table: dict, default: Column | None = None) -> Column:
    """Value of a small lookup table; ``default`` or NULL where it has none."""
    out = None
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(None) if default is None else default)


def capped_integer(c: Column, marker: str, bound: int) -> Column:
    return F.when(normalized_text(c) == marker, F.lit(bound)).otherwise(numeric(c, "int"))


def category(c: Column, groups: dict[str, list[str]], other: str = "other") -> Column:
    """The group whose list holds the value."""
    return mapped(c, {v: g for g, vs in groups.items() for v in vs}, F.lit(other))


def flexible_date(c: Column) -> Column:
    """Date from 'yyyy-MM-dd HH:mm:ss' or 'yyyy-MM-dd'."""
    t = normalized_text(c)
    return F.coalesce(F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")).cast("date"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")).cast("date"))


def is_text(c: Column, text: str) -> Column:
    """Never-NULL test for a marker."""
    return F.coalesce(normalized_text(c) == text, F.lit(False))


def parse_errors(pairs: list[tuple[str, Column, tuple[str, ...]]]) -> Column:
    """How many (source, typed value, allowed markers) have a source text but no value."""
    parts = []
    for source, value, allowed in pairs:
        t = normalized_text(F.col(source))
        bad = t.isNotNull() & value.isNull()
        if allowed:
            bad &= ~t.isin(*allowed)
        parts.append(F.coalesce(bad, F.lit(False)).cast("int"))
    return reduce(lambda a, b: a + b, parts)


def clean_words(c: Column) -> Column:
    """For matching: lower case, Persian letters, everything but letters and digits to single spaces; NULL as ''."""
    t = F.translate(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "يك", "یک")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def nearest_bin(c: Column, width: float) -> Column:
    return F.round(c / F.lit(float(width))).cast("long")


def safe_ln(c: Column) -> Column:
    return F.when((c > 0) & ~F.isnan(c.cast("double")), F.ln(c))


def month_key(c: Column) -> Column:
    """yyyyMM as a number from a text that starts with yyyy-MM."""
    return F.replace(F.substring(c.cast("string"), 1, 7), F.lit("-"), F.lit("")).try_cast("int")


def location_key(level: Column, city: Column, part: Column) -> Column:
    """NATIONAL, CITY:c or NEIGHBORHOOD:c:n; NULL where a needed part is NULL."""
    return F.when(level == "national", F.lit("NATIONAL")).when(level == "city", F.concat(F.lit("CITY:"), city)).when(level == "neighborhood", F.concat(F.lit("NEIGHBORHOOD:"), city, F.lit(":"), part))


def joined_key(columns: list[str], missing: str = "__ALL__") -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in columns])


def first_existing(df: DataFrame, names: list[str], kind: str = "string") -> Column:
    """The values of the named columns that exist, coalesced in this order; a typed NULL if none does."""
    there = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*there).cast(kind) if there else F.lit(None).cast(kind)


def humanised(c: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(c, r"[-_\s]+", " ")))


def masked_digits(c: Column, length: int = 220) -> Column:
    """Runs of four or more digits hidden, white space collapsed, cut to ``length`` for display."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(c, r"\d{4,}", "####"), r"\s+", " ")), 1, length)


def clipped(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def keyword_flags(c: Column, patterns: dict[str, str]) -> list[Column]:
    return [F.coalesce(c.rlike(p), F.lit(False)).alias(k) for k, p in patterns.items()]


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))
