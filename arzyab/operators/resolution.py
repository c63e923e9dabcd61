"""Deterministic multi-pass entity resolution on exact, high-confidence and medium keys.

Groups are found by windows over the key columns themselves, so NULL fields compare equal inside a key and no hash can confuse
(NULL, a) with (a, NULL). Rows are only flagged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arzyab.functions.session import written
from arzyab.functions.columns import clean_words, nearest_bin


def digest(columns: list[str]) -> Column:
    """A key's SHA-256 over its values with NULLs kept apart from texts; its length is fixed however wide the key is."""
    # Each value is preceded by its length, NULL by none, so no two keys run together to one text.
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat_ws("|", *parts), 256))


def group_flags(df: DataFrame, keys: list[Column], eligible: Column, id_column: str, name: str) -> DataFrame:
    """Adds ``<name>_size`` (1 for ineligible rows) and ``<name>_first`` (least id of the group).

    The group is one grouped aggregation with partial combining, joined back on the keys' digest: a key shared by a third of all
    rows costs one row per map task, where a window would bring all its rows to one task.
    """
    names = [f"f{i}_" for i in range(len(keys))]
    with_key = df.withColumns(dict(zip(names, keys))).withColumn("k_", F.when(eligible, digest(names))).drop(*names)
    groups = with_key.where("k_ IS NOT NULL").groupBy("k_").agg(F.count(F.lit(1)).alias("n_"), F.min(id_column).alias("first_")).where("n_ > 1")
    return with_key.join(groups, "k_", "left").withColumns({f"{name}_size": F.coalesce("n_", F.lit(1)), f"{name}_first": F.coalesce("first_", id_column)}).drop("k_", "n_", "first_")


HIGH = ["cat2_slug", "cat3_slug", "city_slug", "neighborhood_slug", "user_type", "price_value", "rent_value", "credit_value", "building_size", "land_size", "floor", "rooms_count", "construction_year", "has_parking", "has_elevator", "has_warehouse", "location_latitude", "location_longitude"]


def resolve_listings(df: DataFrame, raw: list[str], month: Column, area: Column, rooms: Column, price: Column) -> DataFrame:
    """source_row_id with group sizes and flags: exact (all raw columns), high (cleaned texts and fields, within a month), cross-month
    repeats of the high key, medium (blocked bins, unless exact or high), confidence and keep flag.

    Only excess rows of exact and high groups lose their keep flag; the least id is kept. An empty table gives no rows.
    """
    base = df.select("source_row_id", *raw, *[c.alias(n) for n, c in (("month_", month), ("area_", area), ("rooms_", rooms), ("price_", price))])
    base = base.withColumns({"t_": clean_words(F.col("title")), "d_": clean_words(F.col("description")), "m_": F.col("month_"), "a_": nearest_bin(F.col("area_"), 5.0), "r_": F.col("rooms_"), "p_": nearest_bin(F.col("price_"), 10_000_000.0)})
    base = base.withColumns({"x_": digest(raw), "h_": digest(["t_", "d_", *HIGH])})
    high_ok = (F.length("t_") >= 5) & (F.length("d_") >= 20) & F.col("city_slug").isNotNull() & F.col("cat3_slug").isNotNull()
    medium_ok = F.col("city_slug").isNotNull() & F.col("neighborhood_slug").isNotNull() & F.col("cat3_slug").isNotNull() & F.col("m_").isNotNull() & (F.length("t_") >= 5) & F.col("a_").isNotNull() & F.col("r_").isNotNull() & F.col("p_").isNotNull()
    narrow = base.select("source_row_id", "m_", "x_", F.when(high_ok, F.col("h_")).alias("h_"), F.when(medium_ok, digest(["m_", "city_slug", "neighborhood_slug", "cat3_slug", "user_type", "t_", "a_", "r_", "p_"])).alias("q_"))
    narrow = written(narrow)  # texts are cleaned once; every pass below reads compact keys
    out = group_flags(narrow, [F.col("x_")], F.lit(True), "source_row_id", "exact")
    out = group_flags(out, [F.col("m_"), F.col("h_")], F.col("h_").isNotNull() & F.col("m_").isNotNull(), "source_row_id", "high")
    out = group_flags(out, [F.col("q_")], F.col("q_").isNotNull(), "source_row_id", "medium")
    months = narrow.where("h_ IS NOT NULL").groupBy("h_", "m_").agg(F.count(F.lit(1)).alias("c_")).groupBy("h_").agg(F.sum("c_").alias("cross_rows"), F.count("m_").alias("cross_months")).where("cross_months > 1")
    out = out.join(months, "h_", "left")
    exact, high, cross = F.col("exact_size") > 1, F.col("high_size") > 1, F.coalesce(F.col("cross_months") > 1, F.lit(False))
    medium = (F.col("medium_size") > 1) & ~exact & ~high
    return out.select(
        "source_row_id", "exact_size", "high_size", exact.alias("exact_flag"), (exact & (F.col("source_row_id") != F.col("exact_first"))).alias("exact_excess_flag"),
        high.alias("high_flag"), (high & (F.col("source_row_id") != F.col("high_first"))).alias("high_excess_flag"), cross.alias("cross_month_flag"),
        F.coalesce("cross_months", F.lit(1)).alias("cross_month_count"),
        F.when(exact, "exact").when(high, "high").when(medium, "medium").otherwise("none").alias("confidence"),
        (~((exact & (F.col("source_row_id") != F.col("exact_first"))) | (high & (F.col("source_row_id") != F.col("high_first"))))).alias("keep_flag"),
    )
