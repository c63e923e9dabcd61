"""Queries of the problems on text and large collections, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from arzyab.llm import language, mixing, neardup, normalize, packing, pii, quantiles
from arzyab.operators import units
from arzyab.plans.problems import AMOUNTS
from arzyab.sources.tables import spread, table


ADS = ("source_row_id", "title", "description", "price_value", "building_size")
TEXTS = ("doc_id", "text", "lang")


def p2_found(spark, d):
    return normalize.inconsistent_fields(spread(table(spark, d, "listings"), "source_row_id", *normalize.FIELDS))


def p2_normalised(spark, d):
    return normalize.normalise_fields(spread(table(spark, d, "listings"), "source_row_id", *normalize.FIELDS))


def p3_found(spark, d):
    return pii.pii_types(spread(table(spark, d, "listings"), "source_row_id", "description"))


def p3_masked(spark, d):
    return pii.mask_descriptions(spread(table(spark, d, "listings"), "source_row_id", "description"))


def observed_prices(spark, d):
    """Each observation once: the delivery received last (of equal ones the larger price)."""
    rows = table(spark, d, "price_observations").select("observation_id", "received_at", "city_slug", "analysis_month", "price_value_toman")
    last = rows.groupBy("observation_id").agg(F.max(F.struct("received_at", "price_value_toman", "city_slug", "analysis_month")).alias("x"))
    return last.select("x.city_slug", "x.analysis_month", "x.price_value_toman").where("price_value_toman > 0")


def p5_observed_percentiles(spark, d):
    return quantiles.sketch_percentiles(quantiles.bucket_sketch(observed_prices(spark, d), ["city_slug", "analysis_month"], "price_value_toman"), ["city_slug", "analysis_month"], digits=2)


def p5_city_percentiles(spark, d):
    """Monthly sketches merged to cities."""
    monthly = quantiles.bucket_sketch(observed_prices(spark, d), ["city_slug", "analysis_month"], "price_value_toman")
    return quantiles.sketch_percentiles(quantiles.merge_sketches(monthly, ["city_slug"]), ["city_slug"], digits=2)


def p5_listing_percentiles(spark, d):
    prices = units.marked_amounts(spread(table(spark, d, "listings"), "city_slug", *AMOUNTS), keep=("city_slug", "created_at_month")).where("field_name = 'price_value' AND toman > 0")
    prices = prices.select("city_slug", F.substring("created_at_month", 1, 7).alias("month"), "toman")
    return quantiles.sketch_percentiles(quantiles.bucket_sketch(prices, ["city_slug", "month"], "toman"), ["city_slug", "month"], digits=2)


def p7_found(spark, d):
    return neardup.pairs_found(spread(table(spark, d, "listings"), *ADS))


def p7_offers(spark, d):
    return neardup.offer_groups(spread(table(spark, d, "listings"), *ADS))


def p8_containers(spark, d):
    return packing.pack(spread(table(spark, d, "documents"), "doc_id", "text"), table(spark, d, "pack_capacities"))


def p8_fill(spark, d):
    return packing.fill_report(p8_containers(spark, d), table(spark, d, "pack_capacities"))


def p8_tight(spark, d):
    """Containers in which all three constraints bind: at most 1/256 of the capacity in pieces, a third of its square in attention cost."""
    bounds = dict(max_documents_share=1 / 256, attention_share=1 / 3)
    capacities = table(spark, d, "pack_capacities")
    return packing.constraint_report(packing.pack(spread(table(spark, d, "documents"), "doc_id", "text"), capacities, **bounds), capacities, **bounds)


def p9_mix(spark, d):
    return mixing.mix(spread(table(spark, d, "documents"), "doc_id", "text", "source"), table(spark, d, "source_targets"))


def p9_shares(spark, d):
    return mixing.share_report(p9_mix(spark, d), table(spark, d, "source_targets"))


def _language_model(spark, d):
    return language.train(table(spark, d, "lang_samples"), table(spark, d, "documents"))


def p10_found(spark, d):
    return language.languages_to_report(spread(table(spark, d, "documents"), *TEXTS), _language_model(spark, d))


def p10_documents(spark, d):
    return language.document_languages(spread(table(spark, d, "documents"), *TEXTS), _language_model(spark, d))


def p10_segments(spark, d):
    return language.language_segments(spread(table(spark, d, "documents"), *TEXTS), _language_model(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_normalised, p3_found, p3_masked, p5_listing_percentiles, p5_observed_percentiles, p5_city_percentiles, p7_found, p7_offers, p8_containers, p8_fill, p8_tight, p9_mix, p9_shares, p10_found, p10_documents, p10_segments)}

_LAST = "SELECT city_slug, analysis_month, price_value_toman FROM (SELECT *, row_number() OVER (PARTITION BY observation_id ORDER BY received_at DESC NULLS LAST, price_value_toman DESC NULLS LAST, city_slug DESC NULLS LAST, analysis_month DESC NULLS LAST) AS k FROM price_observations) WHERE k = 1"
SQL = {
    "p5_observed_percentiles": quantiles.percentiles_sql(_LAST, ["city_slug", "analysis_month"], "price_value_toman"),
    "p5_city_percentiles": quantiles.percentiles_sql(_LAST, ["city_slug"], "price_value_toman"),
}
