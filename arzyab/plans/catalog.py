"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import functions as F

from arzyab.plans import analysis, models, problems, relational, reports

MODULES = (problems, relational, analysis, models, reports)
DIGITS = 6
# Computed doubles of queries with SQL. They are rounded on both sides, as engines add and interpolate in different orders.
DOUBLES = {
    "bh": "q_value",
    "corr_coherence": "log_corr p05 p50 p95",
    "cut_sensitivity": "adjusted_rand",
    "decade_share": "within tenth tenfold",
    "domain_ranges": "rate",
    "event_windows": "total",
    "keyword_monthly": "positive_rate",
    "kruskal": "h",
    "local_reference": "reference",
    "location_mart": "median",
    "mann_whitney": "u z",
    "market_summary": "p25 median p75 iqr",
    "mart_monthly": "median",
    "measure_latest": "median",
    "measure_period_change": "first_value last_value change_pct",
    "median_monthly_change": "median_change coverage",
    "missing_actions": "rate",
    "mom_adjacent_months": "mom_pct",
    "monthly_dedup_impact": "reduction",
    "monthly_mix": "share",
    "p1_observation_prices": "price_value_toman_mean",
    "precision_gate": "precision",
    "rank_percentiles": "avg_rank pct scaled",
    "rank_within": "median",
    "raw_median_gap": "gap_pct",
    "rollup_levels": "p25 median p75",
    "rollup_mom": "median mom_pct",
    "segment_positioning": "median_index",
    "segment_profile": "median_price median_size share",
    "seller_strata": "weight effect",
    "spearman": "rho",
    "supply_price_fulljoin": "median",
    "temperature": "evidence score percentile",
    "temperature_extremes": "score",
    "temperature_surfaced": "score",
    "top5_each": "median",
    "trend_features": "price_pct price_consistency activity_pct activity_consistency",
    "trimmed_totals": "total",
    "welch": "difference se t df low high",
}


def _rounded(f: Callable, columns: list[str]) -> Callable:
    @wraps(f)
    def query(spark, d):
        return f(spark, d).withColumns({c: F.round(c, DIGITS) for c in columns})

    return query


def queries() -> dict:
    found = {k: f for m in MODULES for k, f in m.QUERIES.items()}
    return found | {k: _rounded(found[k], cs.split()) for k, cs in DOUBLES.items()}


def oracle_sql() -> dict[str, str]:
    found = {k: s for m in MODULES for k, s in m.SQL.items()}
    return found | {k: f"SELECT * REPLACE ({', '.join(f'round({c}, {DIGITS}) AS {c}' for c in cs.split())}) FROM ({found[k]})" for k, cs in DOUBLES.items()}
