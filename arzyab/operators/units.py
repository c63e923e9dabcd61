"""Amounts recorded in different units, brought to whole toman (problem 6).

A source is one money field of one kind of property with one wording: what stands beside the number in the field, else the ad's remark
on its amounts, else nothing (a bare number). Its history is the sequence of its amounts by month; amounts of one month form a cell
with sufficient statistics of their log values (per square metre where the size is given). An exact penalised changepoint search over
each history finds its segments of one level. The level of a segment less the level of the field's bare amounts is its shift, and the
shift decides which known factors are possible. Only where several are (rial and a year's rent differ by 1.2) the wording breaks the
tie; segments of too few amounts to have a level keep the factor that their wording names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arzyab.functions.session import written
from arzyab.functions.text import fold, fold_chars, plain_characters

FIELDS = ("price_value", "credit_value", "rent_value")
# Amount words and unit words of remarks, and subjects that are not the ad's amounts.
AMOUNT = r"(?<!\p{L})(?:مبلغ|مبالغ|قیمت|رقم|ارقام|اعداد|واحد پول|نرخ|amounts?|prices?|figures?|values?|numbers?)"
UNIT = r"(?<!\p{L})(?:(?:هزار|میلیون|میلیارد|thousands?|millions?|billions?|mln|bn)(?: of)? ?)?(?:تومان|تومن|ریال|tomans?|rials?|irr)"
OTHER = r"وام|بودجه|شارژ|اقساط|loan|budget|charge"
PERIOD = r"(?:سالانه|سالیانه|در سال|هر سال|per year|yearly|annual(?:ly)?)"
SCALE = r"(?:به|برحسب|بر حسب|in) (?:هزار|میلیون|میلیارد|thousands?|millions?|billions?)(?!\p{L})"
STOP = r"[^0-9۰-۹\n.;|/()\[\]•،,!?؟-]"
# log10 of (amount as written / amount in toman) of known units; a year's rent is twelve months'.
YEAR = float(np.log10(12))
KNOWN = (0.0, 1.0, -3.0, -6.0, -9.0, -2.0, -5.0, -8.0)


def remark(description: Column) -> Column:
    """The ad's remarks on its own amounts, '' if there are none: the units, scales and periods they name, so wordings stay few.
    Remarks on other amounts (a loan, a budget) don't hide those that follow."""
    # Texts of plain characters need no folding; the others are rare.
    text = F.when(plain_characters(description), F.lower(description)).otherwise(fold_chars(description))
    measure = rf"(?:{UNIT}(?: {PERIOD})?|{PERIOD}|{SCALE})"
    found = F.regexp_extract_all(text, F.lit(rf"((?:(?:{OTHER})\p{{L}}* +)?{AMOUNT}{STOP}{{0,60}}?{measure}|{UNIT}{STOP}{{0,30}}?{AMOUNT})"), F.lit(1))
    own = F.filter(found, lambda x: ~x.rlike(OTHER))
    short = F.array_distinct(F.flatten(F.transform(own, lambda x: F.regexp_extract_all(x, F.lit(rf"({UNIT}|{PERIOD}|{SCALE})"), F.lit(1)))))
    return F.coalesce(F.when(F.size(found) > 0, F.array_join(F.array_sort(short), "; ")), F.lit(""))


def wording(value: Column) -> Column:
    """What stands in the field beside the number, the number as ``#``; '#' for a bare number, NULL without a digit."""
    return F.when(value.rlike(r"\d"), F.regexp_replace(value, r"\d[\d.,]*", "#"))


def number(value: Column) -> Column:
    """The number as written; '2 billion and 300 million' is 2.3 (of billions). NULL if there is none."""

    def one(text: Column) -> Column:
        grouped = text.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$")
        dots = text.rlike(r"^\d{1,3}(\.\d{3}){2,}$")
        plain = F.when(grouped, F.regexp_replace(text, ",", "")).when(dots, F.regexp_replace(text, r"\.", "")).otherwise(F.regexp_replace(text, ",", "."))
        return F.regexp_extract(plain, r"^(\d+(?:\.\d+)?)", 1).try_cast("double")

    first = one(F.regexp_extract(value, r"(\d[\d.,]*)", 1))
    second = one(F.regexp_extract(value, r"\d[\d.,]*[^\d]+(\d[\d.,]*)", 1))
    compound = value.rlike(r"میلیارد و ?\d[\d.,]* ?میلیون")
    return F.when(compound, first + second / 1000).otherwise(first)


def named_unit(words: Column, rent: Column) -> Column:
    """log10 of (written / toman) that the wording names, NULL if it names no unit and no scale."""
    billion = words.rlike(r"میلیارد|billion|\bbn\b|# ?b\b")
    million = words.rlike(r"میلیون|million|\bmln\b|م ?\. ?ت|# ?م( |$)|# ?m\b")
    thousand = words.rlike(r"هزار|thousand|# ?k\b")
    rial = words.rlike(r"(?<!\p{L})ریال|\brials?\b|\brls\b|\birr\b")
    toman = words.rlike(r"تومان|تومن|\btomans?\b|م ?\. ?ت|\birt\b")
    year = words.rlike(r"سالانه|سالیانه|در سال|هر سال|per year|yearly|annual|/ ?year")
    scale = F.when(billion, -9.0).when(million, -6.0).when(thousand, -3.0).otherwise(0.0)
    said = billion | million | thousand | rial | toman | year
    return F.when(said, scale + F.when(rial, 1.0).otherwise(0.0) + F.when(year & rent, YEAR).otherwise(0.0))


def amounts(listings: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per money field with a digit: row, field, number, wording, month, size, property kind, the unit that is named (NULL if
    none is), and whether the number stands without any wording."""
    size = F.expr("try_cast(building_size AS DOUBLE)")
    about = F.when(F.coalesce(*[F.col(f) for f in FIELDS]).isNotNull(), remark(F.col("description"))).otherwise("")
    long = listings.select(
        F.col("source_row_id"), *keep, F.coalesce(fold(F.col("cat3_slug")), F.lit("")).alias("kind"),
        F.coalesce(F.substring(F.col("created_at_month"), 1, 7), F.lit("")).alias("month"), F.when(size > 0, size).alias("size"), about.alias("about"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), fold(F.col(f)).alias("text")) for f in FIELDS])).alias("x"),
    ).select("*", "x.field_name", "x.text").where(F.col("text").rlike(r"\d"))
    # Layer by layer: each expression would otherwise be repeated inside all that use it.
    step = long.select("source_row_id", *keep, "field_name", "kind", "month", "size", "about", number(F.col("text")).alias("number"), wording(F.col("text")).alias("own")).where(F.col("number").isNotNull())
    step = step.select("*", (F.regexp_replace("own", r"[#\s+\-]", "") == "").alias("bare"))
    # The field speaks first; the remark counts for a bare number only.
    step = step.select("*", F.when(F.col("bare"), F.col("about")).otherwise(F.col("own")).alias("wording"))
    named = named_unit(F.col("wording"), F.col("field_name") == "rent_value")
    return step.select("source_row_id", *keep, "field_name", "kind", "month", "size", "number", "wording", named.alias("named"), (F.col("bare") & (F.col("about") == "")).alias("plain"))


def with_stated_toman(df: DataFrame, field: str, name: str) -> DataFrame:
    """``df`` with a field's amount in whole toman by the unit that its wording or the ad's remark names; NULL without an amount.

    The row-wise part of ``marked_amounts``, for operators that need a price beside other work on the same rows. It is done in
    layers, as each expression would otherwise be repeated inside all that use it.
    """
    rent = F.lit(field == "rent_value")
    step = df.select("*", fold(F.col(field)).alias("u_text"))
    step = step.select("*", wording(F.col("u_text")).alias("u_words"), number(F.col("u_text")).alias("u_number"))
    step = step.select("*", (F.regexp_replace("u_words", r"[#\s+\-]", "") == "").alias("u_bare"))
    step = step.select("*", F.when(F.col("u_bare"), remark(F.col("description"))).otherwise(F.col("u_words")).alias("u_said"))
    step = step.select("*", F.coalesce(named_unit(F.col("u_said"), rent), F.lit(0.0)).alias("u_unit"))
    return step.select(*df.columns, toman(F.col("u_number"), F.col("u_unit")).alias(name))


def toman(amount: Column, unit: Column) -> Column:
    """An amount in whole toman. Powers of ten by exact doubles; a year's rent by twelve."""
    yearly = F.abs(unit - F.round(unit)) > 0.01
    whole = F.round(F.when(yearly, unit - YEAR).otherwise(unit)).cast("int")
    factor = F.when(whole > 0, 1.0 / F.pow(F.lit(10.0), whole)).otherwise(F.pow(F.lit(10.0), -whole))
    return F.round(F.when(yearly, amount * factor / 12).otherwise(amount * factor)).cast("long")


def changepoints(n: np.ndarray, s: np.ndarray, q: np.ndarray, penalty: float) -> list[int]:
    """Starts of the segments that minimise (squared error within segments + penalty per segment), found exactly.

    n, s, q: count, sum and sum of squares of each cell, in order. Optimal partitioning by dynamic programming with the pruning
    of candidate starts that can never win again (PELT), which keeps the search exact.
    """
    N, S, Q = (np.concatenate([[0.0], np.cumsum(a)]) for a in (n, s, q))
    m = len(n)
    best, back = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int)
    best[0], starts = -penalty, np.array([0])
    for e in range(1, m + 1):
        weight = N[e] - N[starts]
        cost = Q[e] - Q[starts] - (S[e] - S[starts]) ** 2 / np.maximum(weight, 1e-12)
        total = best[starts] + cost
        k = int(total.argmin())
        best[e], back[e] = total[k] + penalty, starts[k]
        starts = np.append(starts[total <= best[e]], e)
    out, e = [], m
    while e > 0:
        e = int(back[e])
        out.append(e)
    return out[::-1]


def possible_units(rent: bool) -> np.ndarray:
    """log10 of all known factors."""
    return np.array([*KNOWN, *(k + YEAR for k in KNOWN if rent)])


def _segments(pdf: pd.DataFrame, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, level, amounts) of the segment of each cell of a history in order of months."""
    n, s, q = (pdf[c].to_numpy(float) for c in ("n", "s", "q"))
    marks = np.zeros(len(n), dtype=int)
    marks[changepoints(n, s, q, penalty)[1:]] = 1
    of = np.cumsum(marks)
    count = np.bincount(of, n)
    return of, (np.bincount(of, s) / count)[of], count[of]


def base_levels(cells: DataFrame, strength: float = 3.0) -> DataFrame:
    """(kind, field_name, base, variance, penalty): the level of plain amounts, that of the segment with most amounts in the history of
    bare numbers. A history is bounded by the months."""

    def level(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month", kind="stable")
        n, s, q = (pdf[c].to_numpy(float) for c in ("n", "s", "q"))
        variance = max((q - s * s / n).sum() / max(n.sum() - len(n), 1), 1e-4)
        penalty = strength * variance * np.log(max(n.sum(), 2))
        _, levels, counts = _segments(pdf, penalty)
        return pd.DataFrame({"kind": pdf["kind"].iloc[:1], "field_name": pdf["field_name"].iloc[:1], "base": levels[counts.argmax()], "variance": variance, "penalty": penalty})

    bare = cells.where("plain").select("kind", "field_name", "month", "n", "s", "q")
    return bare.groupBy("kind", "field_name").applyInPandas(level, "kind string, field_name string, base double, variance double, penalty double")


def unit_changes(cells: DataFrame, tolerance: float = 0.35, least: int = 5, least_against: int = 30, use_wording: bool = True) -> DataFrame:
    """The unit of each cell: (kind, field_name, wording, month, shift, unit, decided).

    cells: kind, field_name, wording, named, plain, month, n, s, q; one row per wording and month. One history (kind, field, wording)
    is one group, bounded by the months. The factors within ``tolerance`` of the shift, or three standard errors if that is more, are
    possible. decided: ``shift`` if one factor is possible or the wording doesn't name one that is (the nearest is taken), ``tie`` if the
    wording picks one of several, ``wording`` if the history has no level (fewer than ``least`` amounts in the segment, no bare amounts to
    compare with, or no factor near), so that what the wording names, else plain toman, is taken. use_wording=False: nothing is taken from the wording but the
    name of the source. least_against: so many amounts a segment needs to overrule a factor that its wording names.
    """
    based = cells.join(base_levels(cells), ["kind", "field_name"], "left")

    def history(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month", kind="stable").reset_index(drop=True)
        known = possible_units(pdf["field_name"].iloc[0] == "rent_value")
        base, variance, penalty = (float(pdf[c].iloc[0]) for c in ("base", "variance", "penalty"))
        named = float(pdf["named"].iloc[0]) if use_wording and pd.notna(pdf["named"].iloc[0]) else None
        compared = base == base
        _, level, count = _segments(pdf, penalty if compared else np.inf)
        shift = level - base
        unit, decided = np.full(len(pdf), named or 0.0), np.full(len(pdf), "wording", dtype=object)
        for i in range(len(pdf) if compared else 0):
            reach = max(tolerance, 3 * (variance / count[i]) ** 0.5)
            far = np.abs(known - shift[i])
            near = known[far <= reach]
            if count[i] < (least if named is None or len(near) and np.abs(near - named).min() < 1e-6 else least_against) or not len(near):
                continue
            told = named is not None and bool((np.abs(near - named) < 1e-6).any())
            if told and len(near) > 1:
                decided[i] = "tie"
            elif not told:
                # Within the reach of plain toman a wording that names nothing is plain.
                unit[i] = 0.0 if named is None and (np.abs(near) < 1e-6).any() else known[far.argmin()]
                decided[i] = "shift"
            else:
                unit[i], decided[i] = near[0], "shift"
        return pdf[["kind", "field_name", "wording", "month"]].assign(shift=shift, unit=unit, decided=decided)

    return based.groupBy("kind", "field_name", "wording").applyInPandas(history, "kind string, field_name string, wording string, month string, shift double, unit double, decided string")


def marked_amounts(listings: DataFrame, use_wording: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every amount with its unit: source_row_id, field_name, number, wording, unit (log10 written/toman), decided, toman, and the
    columns of ``listings`` to keep.

    The amounts are written once; only compact cells are shuffled, as the cells' units (bounded by kinds x fields x wordings x months) are
    joined back. A zero amount is zero in any unit. NULL, blank and non-numeric fields have no row. Empty table: no rows.
    """
    rows = written(amounts(listings, keep))  # the descriptions are read once
    value = F.log10(F.col("number") / F.coalesce(F.col("size"), F.lit(1.0)))
    keys = ["kind", "field_name", "wording", "month"]
    sized = rows.where("number > 0")
    cells = sized.groupBy(*keys).agg(F.first("named").alias("named"), F.bool_and("plain").alias("plain"), F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum(value * value).alias("q"))
    units = unit_changes(cells, use_wording=use_wording)
    unit = F.coalesce(F.col("unit"), F.lit(0.0))
    return rows.join(units, keys, "left").select("source_row_id", *keep, "field_name", "number", "wording", unit.alias("unit"), F.coalesce("decided", F.lit("wording")).alias("decided"), toman(F.col("number"), unit).alias("toman"))


def decisions(listings: DataFrame) -> DataFrame:
    """field_name, decided, amounts, differ: by what amounts got their unit, and how many of them the wording names otherwise."""
    marked = marked_amounts(listings)
    named = F.coalesce(named_unit(F.col("wording"), F.col("field_name") == "rent_value"), F.lit(0.0))
    return marked.where("number > 0").groupBy("field_name", "decided").agg(F.count(F.lit(1)).alias("amounts"), F.count_if(F.abs(named - F.col("unit")) > 1e-6).alias("differ"))


def not_plain(listings: DataFrame) -> DataFrame:
    """Fields with a non-zero amount that is not in plain toman: (source_row_id, field_name)."""
    return marked_amounts(listings).where((F.col("number") > 0) & (F.abs("unit") > 1e-6)).select("source_row_id", "field_name")


def in_toman(listings: DataFrame) -> DataFrame:
    """One row per listing: source_row_id and each field in whole toman (rent a month), NULL where no amount is given."""
    marked = marked_amounts(listings)
    wide = marked.groupBy("source_row_id").agg(*[F.max(F.when(F.col("field_name") == f, F.col("toman"))).alias(f.replace("_value", "_toman")) for f in FIELDS])
    return listings.select("source_row_id").join(wide, "source_row_id", "left")
