"""Queries of the general training-data problems 1, 4 and 6, with SQL where SQL can say it."""

from __future__ import annotations

from arzyab.functions.text import given_sql
from arzyab.operators import impute, missing, skew, units
from arzyab.sources.tables import spread, table


AMOUNTS = ("source_row_id", "description", "price_value", "credit_value", "rent_value", "cat3_slug", "created_at_month", "building_size")


def p1_found(spark, d):
    return skew.heavy_keys(table(spark, d, "listings"), ["city_slug", "neighborhood_slug"], 0.03)


def p1_observation_prices(spark, d):
    return skew.key_statistics(table(spark, d, "price_observations"), ["city_slug", "neighborhood_slug"], ["price_value_toman"])


def p1_listing_counts(spark, d):
    return skew.key_statistics(table(spark, d, "listings"), ["city_slug", "neighborhood_slug"], [])


def p4_found(spark, d):
    return impute.filled_fields(table(spark, d, "listings"))


def p4_filled(spark, d):
    return impute.fill_missing(table(spark, d, "listings"))


def p6_found(spark, d):
    return units.not_plain(spread(table(spark, d, "listings"), *AMOUNTS))


def p6_toman(spark, d):
    return units.in_toman(spread(table(spark, d, "listings"), *AMOUNTS))


def p6_decisions(spark, d):
    return units.decisions(spread(table(spark, d, "listings"), *AMOUNTS))


QUERIES = {f.__name__: f for f in (p1_found, p1_observation_prices, p1_listing_counts, p4_found, p4_filled, p6_found, p6_toman, p6_decisions)}

_C, _N = given_sql("city_slug"), given_sql("neighborhood_slug")
SQL = {
    "p1_found": f"WITH k AS (SELECT {_C} AS city_slug, {_N} AS neighborhood_slug FROM listings) SELECT city_slug, neighborhood_slug FROM k WHERE city_slug IS NOT NULL AND neighborhood_slug IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 0.03 * (SELECT count(*) FROM listings)",
    "p1_observation_prices": "SELECT city_slug, neighborhood_slug, count(*) AS row_count, count(price_value_toman) AS price_value_toman_count, CAST(sum(price_value_toman) AS BIGINT) AS price_value_toman_sum, min(price_value_toman) AS price_value_toman_min, max(price_value_toman) AS price_value_toman_max, CAST(sum(price_value_toman) AS DOUBLE) / CAST(count(price_value_toman) AS DOUBLE) AS price_value_toman_mean FROM price_observations GROUP BY 1, 2",
    "p1_listing_counts": "SELECT city_slug, neighborhood_slug, count(*) AS row_count FROM listings GROUP BY 1, 2",
    "p4_found": missing.missing_sql(),
}
