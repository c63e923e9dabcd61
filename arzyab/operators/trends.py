"""Log-linear trends of monthly series, their consistency, and scores from ranks of trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arzyab.functions.columns import clipped
from arzyab.operators.ranks import percentile_rank


def log_trend(df: DataFrame, keys: list[str], month: str, value: str, name: str, when: Column | None = None) -> DataFrame:
    """keys, <name>_pct: (e^slope - 1) * 100 of ln(value) on the month number, <name>_consistency: share of steps whose sign is the
    slope's (0.5 for a flat series or without steps), <name>_months. Fewer than two positive values give NULL trends. NULL keys are
    keys."""
    used = (F.col(value) > 0) if when is None else (F.col(value) > 0) & F.coalesce(when, F.lit(False))
    rows = df.where(used).select(*keys, (F.year(month) * 12 + F.month(month)).cast("double").alias("x_"), F.ln(value).alias("y_"))
    w = Window.partitionBy(*keys).orderBy("x_")
    steps = rows.withColumn("d_", F.col("y_") - F.lag("y_").over(w))
    slopes = steps.groupBy(*keys).agg(F.regr_slope("y_", "x_").alias("s_"), F.count("y_").alias(f"{name}_months"), F.sum(F.when(F.col("d_") > 0, 1).otherwise(0)).alias("up_"), F.sum(F.when(F.col("d_") < 0, 1).otherwise(0)).alias("down_"), F.count("d_").alias("steps_"))
    flat = F.coalesce(F.abs("s_") < 1e-15, F.lit(True)) | (F.col("steps_") == 0)
    agree = F.when(F.col("s_") > 0, F.col("up_")).otherwise(F.col("down_")) / F.col("steps_")
    enough = F.col(f"{name}_months") >= 2
    return slopes.select(*keys, F.when(enough, (F.exp("s_") - 1) * 100).alias(f"{name}_pct"), F.when(enough, F.when(flat, F.lit(0.5)).otherwise(agree)).alias(f"{name}_consistency"), f"{name}_months")


def temperature(features: DataFrame, universe: list[str], weight_price: float = 0.6, weight_activity: float = 0.4, least_months: int = 4, hot: float = 0.8, cold: float = 0.2, gate: str = "price_only") -> DataFrame:
    """Adds evidence, score, percentile, label and place to rows with price_pct, activity_pct, consistencies and months.

    score = 200 * (w_p * rank(price) + w_a * rank(activity) - 0.5) * evidence, ranks as average-rank percentiles within the
    universe; evidence = 0.65 + 0.2 * coverage + 0.15 * stability. gate: what must point the label's way too: ``price_only``,
    ``price_and_supply`` or ``none``.
    """
    usable = F.least("price_months", "activity_months")
    coverage = F.least(F.lit(1.0), usable / F.lit(float(max(4, least_months))))
    stability = (F.col("price_consistency") + F.col("activity_consistency")) / 2
    rows = features.where("price_pct IS NOT NULL AND activity_pct IS NOT NULL").withColumn("evidence", clipped(0.65 + 0.20 * coverage + 0.15 * stability, 0.0, 1.0))
    rows = rows.withColumns({"rp_": percentile_rank("price_pct", universe), "ra_": percentile_rank("activity_pct", universe)})
    rows = rows.withColumn("score", 200 * (weight_price * F.col("rp_") + weight_activity * F.col("ra_") - 0.5) * F.col("evidence"))
    rows = rows.withColumn("percentile", percentile_rank("score", universe))
    signs = {"price_only": ["price_pct"], "price_and_supply": ["price_pct", "activity_pct"], "none": []}[gate]
    up, down = F.lit(True), F.lit(True)
    for c in signs:
        up, down = up & (F.col(c) > 0), down & (F.col(c) < 0)
    label = F.when((F.col("percentile") >= hot) & up, "HOT").when((F.col("percentile") <= cold) & down, "COLD").otherwise("NEUTRAL")
    place = F.row_number().over(Window.partitionBy(*universe).orderBy(F.desc("score"), *[F.asc_nulls_last(c) for c in features.columns if c not in universe]))
    return rows.withColumns({"label": label, "place": place}).drop("rp_", "ra_")


def top_overlap(a: DataFrame, b: DataFrame, key: str, k: int = 5) -> DataFrame:
    """One row: how many of the first k of a are among the first k of b."""
    first = lambda x: x.where(F.col("place") <= k).select(key)
    return first(a).intersect(first(b)).agg(F.count(F.lit(1)).alias("overlap"))
