"""Queries of trends, statistics, lookups and entity resolution, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from arzyab.functions import columns as C
from arzyab.functions.session import written
from arzyab.operators import lookup, profile, ranks, resolution, statistics, trends
from arzyab.operators.percentiles import group_percentiles
from arzyab.operators.rollup import union_all
from arzyab.plans.relational import PLACED, placed_orders
from arzyab.sources.tables import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _market(spark, d):
    return group_percentiles(placed_orders(spark, d), ["city", "month"], "o_totalprice", {"median": 0.5})


def _features(spark, d):
    m = _market(spark, d)
    price = trends.log_trend(m, ["city"], "month", "median", "price", F.col("n") >= 5)
    return price.join(trends.log_trend(m, ["city"], "month", "n", "activity"), "city")


def _trend_sql(name: str, value: str, where: str) -> str:
    return (
        f"SELECT city, CASE WHEN count(*) >= 2 THEN (exp(regr_slope(y, x)) - 1) * 100 END AS {name}_pct, CASE WHEN count(*) >= 2 THEN CASE WHEN coalesce(abs(regr_slope(y, x)) < 1e-15, true) OR count(d) = 0 THEN 0.5 WHEN regr_slope(y, x) > 0 THEN count_if(d > 0) / CAST(count(d) AS DOUBLE) ELSE count_if(d < 0) / CAST(count(d) AS DOUBLE) END END AS {name}_consistency, count(*) AS {name}_months "
        f"FROM (SELECT *, y - lag(y) OVER (PARTITION BY city ORDER BY x) AS d FROM (SELECT city, CAST(year(month) * 12 + month(month) AS DOUBLE) AS x, ln({value}) AS y FROM m WHERE {value} > 0 AND {where})) GROUP BY city"
    )


_FEATURES = f"WITH m AS (SELECT city, month, median(o_totalprice) AS median, count(*) AS n FROM ({PLACED}) GROUP BY ALL), tp AS ({_trend_sql('price', 'median', 'n >= 5')}), ta AS ({_trend_sql('activity', 'n', 'true')}), f AS (SELECT tp.city, round(price_pct, 9) AS price_pct, price_consistency, price_months, round(activity_pct, 9) AS activity_pct, activity_consistency, activity_months FROM tp JOIN ta ON tp.city = ta.city)"


def _rounded(f):
    return f.withColumns({"price_pct": F.round("price_pct", 9), "activity_pct": F.round("activity_pct", 9)})


@query(f"{_FEATURES} SELECT * FROM f")
def trend_features(spark, d):
    return _rounded(_features(spark, d))


def _pct(v: str, src: str) -> str:
    return f"CASE WHEN min({v}) OVER () = max({v}) OVER () THEN 0.5 ELSE (rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0) / count(*) OVER () END"


def _temperature_sql(wp: float, wa: float) -> str:
    return (
        f"{_FEATURES}, e AS (SELECT *, least(1.0, greatest(0.0, 0.65 + 0.20 * least(1.0, least(price_months, activity_months) / 4.0) + 0.15 * (price_consistency + activity_consistency) / 2)) AS evidence, {_pct('price_pct', 'f')} AS rp, {_pct('activity_pct', 'f')} AS ra FROM f WHERE price_pct IS NOT NULL AND activity_pct IS NOT NULL), "
        f"s AS (SELECT *, round(200 * ({wp} * rp + {wa} * ra - 0.5) * evidence, 9) AS score FROM e) SELECT city, evidence, score, {_pct('score', 's')} AS percentile, CASE WHEN {_pct('score', 's')} >= 0.8 AND price_pct > 0 THEN 'HOT' WHEN {_pct('score', 's')} <= 0.2 AND price_pct < 0 THEN 'COLD' ELSE 'NEUTRAL' END AS label FROM s"
    )


def _temperature(spark, d, wp=0.6, wa=0.4):
    f = _rounded(_features(spark, d)).withColumn("all_", F.lit(1))
    return trends.temperature(f, ["all_"], wp, wa)


_GATES = {"price_only": ("price_pct > 0", "price_pct < 0"), "price_and_supply": ("price_pct > 0 AND activity_pct > 0", "price_pct < 0 AND activity_pct < 0"), "none": ("true", "true")}
_SCENARIOS = [("w60_40", 0.6, "price_only"), ("w70_30", 0.7, "price_only"), ("w60_40_both", 0.6, "price_and_supply"), ("w60_40_open", 0.6, "none"), ("price_alone", 1.0, "price_only")]


def _gated_sql(name: str, weight: float, gate: str) -> str:
    hot, cold = _GATES[gate]
    return f"SELECT '{name}' AS scenario, CASE WHEN t.percentile >= 0.8 AND {hot} THEN 'HOT' WHEN t.percentile <= 0.2 AND {cold} THEN 'COLD' ELSE 'NEUTRAL' END AS label, count(*) AS places FROM ({_temperature_sql(weight, round(1 - weight, 6))}) t JOIN ({_FEATURES} SELECT city, price_pct, activity_pct FROM f) g USING (city) GROUP BY ALL"


@query(" UNION ALL ".join(f"({_gated_sql(*s)})" for s in _SCENARIOS))
def temperature_gates(spark, d):
    """Labels of five scenarios: two weights, three direction gates and price alone."""
    f = written(_rounded(_features(spark, d))).withColumn("all_", F.lit(1))  # read by five scenarios
    parts = [trends.temperature(f, ["all_"], w, round(1 - w, 6), gate=g).select(F.lit(n).alias("scenario"), "label") for n, w, g in _SCENARIOS]
    return union_all(parts).groupBy("scenario", "label").agg(F.count(F.lit(1)).alias("places"))


@query(_temperature_sql(0.6, 0.4))
def temperature(spark, d):
    return _temperature(spark, d).select("city", "evidence", F.round("score", 9).alias("score"), "percentile", "label")


_FIRST = "SELECT city FROM (SELECT city, row_number() OVER (ORDER BY score DESC, city) AS place FROM ({}) t) WHERE place <= 5"


@query(f"SELECT count(*) AS overlap FROM ({_FIRST.format(_temperature_sql(0.6, 0.4))}) a JOIN ({_FIRST.format(_temperature_sql(0.7, 0.3))}) b USING (city)")
def temperature_weight_overlap(spark, d):
    return trends.top_overlap(_temperature(spark, d), _temperature(spark, d, 0.7, 0.3), "city")


@query("WITH m AS (SELECT CAST(c_acctbal AS DOUBLE) AS v, c_mktsegment AS g FROM customer), a AS (SELECT count(v) AS n_a, avg(v) AS ma, var_samp(v) / count(v) AS va FROM m WHERE g = 'BUILDING'), b AS (SELECT count(v) AS n_b, avg(v) AS mb, var_samp(v) / count(v) AS vb FROM m WHERE g = 'MACHINERY') SELECT n_a, n_b, ma - mb AS difference, sqrt(va + vb) AS se, (ma - mb) / sqrt(va + vb) AS t, (va + vb) * (va + vb) / (va * va / (n_a - 1) + vb * vb / (n_b - 1)) AS df, (ma - mb) - 1.96 * sqrt(va + vb) AS low, (ma - mb) + 1.96 * sqrt(va + vb) AS high FROM a, b")
def welch(spark, d):
    return statistics.welch(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY")


@query()
def welch_p_value(spark, d):
    return statistics.with_p(welch(spark, d), "t", "t", "df")


_MW = "WITH r AS (SELECT p_brand AS g, p_size AS v, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS k FROM part WHERE p_brand IN ('Brand#11', 'Brand#12')), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY v)), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count_if(g = 'Brand#11') AS DOUBLE) AS na, sum(CASE WHEN g = 'Brand#11' THEN k END) AS ra FROM r) SELECT CAST(na AS BIGINT) AS n_a, CAST(n - na AS BIGINT) AS n_b, ra - na * (na + 1) / 2 AS u, (ra - na * (na + 1) / 2 - na * (n - na) / 2) / sqrt(na * (n - na) / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM s, t"


@query(_MW)
def mann_whitney(spark, d):
    return statistics.mann_whitney(table(spark, d, "part"), "p_brand", "p_size", "Brand#11", "Brand#12")


@query("WITH x AS (SELECT p_brand AS g, p_size AS v FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= 20)), r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS k FROM x), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY v)), p AS (SELECT g, count(*) AS n, sum(k) AS s FROM r GROUP BY g), q AS (SELECT count(*) AS groups, CAST(sum(n) AS DOUBLE) AS n, sum(s * s / n) AS q FROM p) SELECT groups, CAST(n AS BIGINT) AS n, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h, groups - 1 AS df FROM q, t")
def kruskal(spark, d):
    return statistics.kruskal(table(spark, d, "part"), "p_brand", "p_size")


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS b FROM lineitem) SELECT count(*) AS n, corr(a, b) AS rho FROM r")
def spearman(spark, d):
    return statistics.spearman(table(spark, d, "lineitem"), "l_quantity", "l_discount")


@query("WITH p AS (SELECT p_brand AS name, avg(p_size) / 100 AS p FROM part GROUP BY 1), r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS raw FROM p) SELECT name, p, least(1.0, min(raw) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q_value FROM r")
def bh(spark, d):
    rows = table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg((F.avg("p_size") / 100).alias("p"))
    return statistics.benjamini_hochberg(rows, "p")


@query()
def bootstrap(spark, d):
    return statistics.bootstrap_mean(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", "c_custkey")


@query("WITH l AS (SELECT city_slug, cat3_slug, user_type, ln(TRY_CAST(building_size AS DOUBLE)) AS v FROM listings WHERE TRY_CAST(building_size AS DOUBLE) > 0 AND city_slug IS NOT NULL AND cat3_slug IS NOT NULL), s AS (SELECT city_slug, cat3_slug, count(CASE WHEN user_type = 'مشاور املاک' THEN v END) AS na, count(CASE WHEN user_type = 'شخصی' THEN v END) AS nb, avg(CASE WHEN user_type = 'مشاور املاک' THEN v END) AS ma, avg(CASE WHEN user_type = 'شخصی' THEN v END) AS mb FROM l GROUP BY ALL HAVING na >= 5 AND nb >= 5) SELECT count(*) AS strata, CAST(sum(least(na, nb)) AS DOUBLE) AS weight, exp(sum(least(na, nb) * (ma - mb)) / sum(least(na, nb))) - 1 AS effect FROM s")
def seller_strata(spark, d):
    size = F.col("building_size").try_cast("double")
    rows = table(spark, d, "listings").where(size > 0).select("city_slug", "cat3_slug", "user_type", F.ln(size).alias("v"))
    return statistics.strata_effect(rows, ["city_slug", "cat3_slug"], "user_type", "مشاور املاک", "شخصی", "v")


@query("WITH l AS (SELECT source_row_id, cat3_slug, city_slug, neighborhood_slug, TRY_CAST(building_size AS DOUBLE) AS v FROM listings), a AS (SELECT cat3_slug AS a1, city_slug AS a2, neighborhood_slug AS a3, median(v) AS m FROM l WHERE v IS NOT NULL GROUP BY ALL HAVING count(*) >= 20), b AS (SELECT cat3_slug AS b1, city_slug AS b2, median(v) AS m FROM l WHERE v IS NOT NULL GROUP BY ALL HAVING count(*) >= 20), c AS (SELECT cat3_slug AS c1, median(v) AS m FROM l WHERE v IS NOT NULL GROUP BY ALL HAVING count(*) >= 20), g AS (SELECT median(v) AS m FROM l WHERE v IS NOT NULL HAVING count(*) >= 20) SELECT source_row_id, coalesce(a.m, b.m, c.m, g.m) AS reference, CASE WHEN a.m IS NOT NULL THEN 'cat3_slug+city_slug+neighborhood_slug' WHEN b.m IS NOT NULL THEN 'cat3_slug+city_slug' WHEN c.m IS NOT NULL THEN 'cat3_slug' WHEN g.m IS NOT NULL THEN 'all' END AS reference_level FROM l LEFT JOIN a ON cat3_slug IS NOT DISTINCT FROM a1 AND city_slug IS NOT DISTINCT FROM a2 AND neighborhood_slug IS NOT DISTINCT FROM a3 LEFT JOIN b ON cat3_slug IS NOT DISTINCT FROM b1 AND city_slug IS NOT DISTINCT FROM b2 LEFT JOIN c ON cat3_slug IS NOT DISTINCT FROM c1 LEFT JOIN g ON true")
def local_reference(spark, d):
    rows = table(spark, d, "listings").select("source_row_id", "cat3_slug", "city_slug", "neighborhood_slug", F.col("building_size").try_cast("double").alias("v"))
    chains = [["cat3_slug", "city_slug", "neighborhood_slug"], ["cat3_slug", "city_slug"], ["cat3_slug"], []]
    return lookup.fallback_reference(rows, "v", chains, 20, "reference").select("source_row_id", "reference", "reference_level")


@query(f"WITH o AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY o_totalprice, o_orderkey) / CAST(count(*) OVER (PARTITION BY part) AS DOUBLE) AS r FROM ({PLACED})) SELECT o_orderkey, CASE WHEN r <= 0.3 THEN 'SEG01' WHEN r <= 0.8 THEN 'SEG02' ELSE 'SEG03' END AS segment FROM o")
def typology(spark, d):
    o = ranks.position_within(placed_orders(spark, d).select("part", "o_totalprice", "o_orderkey"), ["part"], [F.col("o_totalprice"), F.col("o_orderkey")])
    r = F.col("position") / F.col("position_of")
    return o.select("o_orderkey", r.alias("r")).select("o_orderkey", ranks.cut_two(F.col("r"), 0.3, 0.8, ("SEG01", "SEG02", "SEG03")).alias("segment"))


_NT = "CASE WHEN lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')) IN ('', 'null', '<null>', 'none', 'nan', 'n/a', 'na') THEN NULL ELSE regexp_replace({0}, '^\\s+|\\s+$', '', 'g') END"
_NUM = "TRY_CAST(translate({0}, '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩,٬_ ', '01234567890123456789') AS {1})"
_CLEAN = "trim(regexp_replace(translate(lower(coalesce({0}, '')), 'يك', 'یک'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _raw(df):
    return [c for c in df.columns if c != "source_row_id"]


_HIGH = ", ".join(["t", "de", *resolution.HIGH])
_MED = "m, city_slug, neighborhood_slug, cat3_slug, user_type, t, ab, rooms, pb"
_ER = f"""WITH b AS (SELECT * EXCLUDE (rooms), rooms, {_CLEAN.format('title')} AS t, {_CLEAN.format('description')} AS de FROM (SELECT *, strftime(CAST(coalesce(TRY_STRPTIME({_NT.format('created_at_month')}, '%Y-%m-%d %H:%M:%S'), TRY_STRPTIME({_NT.format('created_at_month')}, '%Y-%m-%d')) AS DATE), '%Y-%m') AS m, CASE {_NT.format('rooms_count')} WHEN 'بدون اتاق' THEN 0 WHEN 'یک' THEN 1 WHEN 'دو' THEN 2 WHEN 'سه' THEN 3 WHEN 'چهار' THEN 4 WHEN 'پنج یا بیشتر' THEN 5 END AS rooms, CAST(round({_NUM.format(_NT.format('building_size'), 'DOUBLE')} / 5.0) AS BIGINT) AS ab, CAST(round(TRY_CAST(CASE WHEN regexp_full_match(translate({_NT.format('price_value')}, '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩,٬_ ', '01234567890123456789'), '[+-]?[0-9]+') THEN translate({_NT.format('price_value')}, '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩,٬_ ', '01234567890123456789') END AS BIGINT) / 10000000.0) AS BIGINT) AS pb FROM listings)),
k AS (SELECT *, length(t) >= 5 AND length(de) >= 20 AND city_slug IS NOT NULL AND cat3_slug IS NOT NULL AS hok, city_slug IS NOT NULL AND neighborhood_slug IS NOT NULL AND cat3_slug IS NOT NULL AND m IS NOT NULL AND length(t) >= 5 AND ab IS NOT NULL AND rooms IS NOT NULL AND pb IS NOT NULL AS mok FROM b),
w AS (SELECT *, count(*) OVER x AS exact_size, min(source_row_id) OVER x AS ef, CASE WHEN hok AND m IS NOT NULL THEN count(*) OVER h ELSE 1 END AS high_size, min(source_row_id) OVER h AS hf, CASE WHEN hok THEN count(DISTINCT m) OVER c ELSE 0 END AS months, CASE WHEN mok THEN count(*) OVER q ELSE 1 END AS ms FROM k WINDOW x AS (PARTITION BY RAWCOLUMNS), h AS (PARTITION BY hok, m, {_HIGH}), c AS (PARTITION BY hok, {_HIGH}), q AS (PARTITION BY mok, {_MED}))
SELECT source_row_id, exact_size, high_size, exact_size > 1 AS exact_flag, exact_size > 1 AND source_row_id <> ef AS exact_excess_flag, high_size > 1 AS high_flag, high_size > 1 AND source_row_id <> hf AS high_excess_flag, months > 1 AS cross_month_flag, CASE WHEN months > 1 THEN months ELSE 1 END AS cross_month_count, CASE WHEN exact_size > 1 THEN 'exact' WHEN high_size > 1 THEN 'high' WHEN ms > 1 THEN 'medium' ELSE 'none' END AS confidence, NOT ((exact_size > 1 AND source_row_id <> ef) OR (high_size > 1 AND source_row_id <> hf)) AS keep_flag FROM w"""
# The raw columns of listings.
RAW = "cat2_slug cat3_slug city_slug neighborhood_slug created_at_month user_type description title rent_mode rent_value rent_to_single rent_type price_mode price_value credit_mode credit_value rent_credit_transform transformable_price transformable_credit transformed_credit transformable_rent transformed_rent land_size building_size deed_type has_business_deed floor rooms_count total_floors_count unit_per_floor has_balcony has_elevator has_warehouse has_parking construction_year is_rebuilt has_water has_warm_water_provider has_electricity has_gas has_heating_system has_cooling_system has_restroom has_security_guard has_barbecue building_direction has_pool has_jacuzzi has_sauna floor_material property_type regular_person_capacity extra_person_capacity cost_per_extra_person rent_price_on_regular_days rent_price_on_special_days rent_price_at_weekends location_latitude location_longitude location_radius"


@query(_ER.replace("RAWCOLUMNS", ", ".join(RAW.split())))
def er_flags(spark, d):
    df = spread(table(spark, d, "listings"))
    month = F.date_format(C.flexible_date(F.col("created_at_month")), "yyyy-MM")
    rooms = C.mapped(C.normalized_text(F.col("rooms_count")), C.ROOM_WORDS)
    return resolution.resolve_listings(df, _raw(df), month, C.numeric(F.col("building_size"), "double"), rooms, C.numeric(F.col("price_value"), "bigint"))


@query("SELECT confidence, count(*) AS rows FROM (SELECT CASE WHEN count(*) OVER (PARTITION BY lang, source, text) > 1 THEN 'exact' WHEN count(*) OVER (PARTITION BY text) > 1 THEN 'text' ELSE 'none' END AS confidence FROM documents) GROUP BY 1")
def dedup_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "text")
    out = resolution.group_flags(docs, [F.col("lang"), F.col("source"), F.col("text")], F.lit(True), "doc_id", "exact")
    out = resolution.group_flags(out.drop("lang", "source"), [F.col("text")], F.lit(True), "doc_id", "text")
    return out.groupBy(F.when(F.col("exact_size") > 1, "exact").when(F.col("text_size") > 1, "text").otherwise("none").alias("confidence")).agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT text_sources, count(*) AS texts, CAST(sum(n) AS BIGINT) AS documents FROM (SELECT text, count(DISTINCT source) AS text_sources, count(*) AS n FROM documents GROUP BY text) GROUP BY 1")
def dedup_cross(spark, d):
    t = table(spark, d, "documents").groupBy("text").agg(F.count_distinct("source").alias("text_sources"), F.count(F.lit(1)).alias("n"))
    return t.groupBy("text_sources").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("documents"))


_TYPED = f"SELECT source_row_id, {_NUM.format(_NT.format('building_size'), 'DOUBLE')} AS building_size_sqm, {_NUM.format(_NT.format('land_size'), 'DOUBLE')} AS land_size_sqm, {_NUM.format(_NT.format('location_latitude'), 'DOUBLE')} AS latitude, {_NUM.format(_NT.format('location_longitude'), 'DOUBLE')} AS longitude, CASE {_NT.format('rooms_count')} WHEN 'بدون اتاق' THEN 0 WHEN 'یک' THEN 1 WHEN 'دو' THEN 2 WHEN 'سه' THEN 3 WHEN 'چهار' THEN 4 WHEN 'پنج یا بیشتر' THEN 5 END AS rooms, CAST(coalesce(TRY_STRPTIME({_NT.format('created_at_month')}, '%Y-%m-%d %H:%M:%S'), TRY_STRPTIME({_NT.format('created_at_month')}, '%Y-%m-%d')) AS DATE) AS analysis_month, CASE lower({_NT.format('has_elevator')}) WHEN 'true' THEN true WHEN 'false' THEN false END AS has_elevator_bool, coalesce({_NT.format('total_floors_count')} = 'unselect', false) AS floors_unselected_flag, CASE WHEN cat3_slug IN ('apartment-sell', 'apartment-rent') THEN 'apartment' WHEN cat3_slug IN ('house-villa-sell', 'house-villa-rent') THEN 'villa' WHEN cat3_slug = 'plot-old' THEN 'land' WHEN cat3_slug IN ('office-sell', 'office-rent', 'shop-sell', 'shop-rent') THEN 'commercial' WHEN cat3_slug IN ('industry-agriculture-business-sell', 'industry-agriculture-business-rent') THEN 'industrial' ELSE 'other' END AS property_family FROM listings"
# Categories of each property family.
FAMILIES = {
    "apartment": ["apartment-sell", "apartment-rent"], "villa": ["house-villa-sell", "house-villa-rent"], "land": ["plot-old"],
    "commercial": ["office-sell", "office-rent", "shop-sell", "shop-rent"], "industrial": ["industry-agriculture-business-sell", "industry-agriculture-business-rent"],
}


@query(_TYPED)
def typed_listings(spark, d):
    c = F.col
    return table(spark, d, "listings").select(
        "source_row_id", C.numeric(c("building_size"), "double").alias("building_size_sqm"), C.numeric(c("land_size"), "double").alias("land_size_sqm"),
        C.numeric(c("location_latitude"), "double").alias("latitude"), C.numeric(c("location_longitude"), "double").alias("longitude"),
        C.mapped(C.normalized_text(c("rooms_count")), C.ROOM_WORDS).alias("rooms"), C.flexible_date(c("created_at_month")).alias("analysis_month"),
        C.boolean_text(c("has_elevator")).alias("has_elevator_bool"), C.is_text(c("total_floors_count"), "unselect").alias("floors_unselected_flag"), C.category(c("cat3_slug"), FAMILIES).alias("property_family"),
    )


@query(f"WITH t AS ({_TYPED}) SELECT name, rows, n, CAST(n AS DOUBLE) / rows AS rate FROM (SELECT count(*) AS rows, count_if(building_size_sqm <= 0) AS nonpositive_area, count_if((latitude IS NULL) <> (longitude IS NULL)) AS partial_coordinates, count_if(latitude BETWEEN 24 AND 40.5 AND longitude BETWEEN 43 AND 64.5) AS in_country, count_if(latitude BETWEEN 43 AND 64.5 AND longitude BETWEEN 24 AND 40.5) AS swapped FROM t) UNPIVOT (n FOR name IN (nonpositive_area, partial_coordinates, in_country, swapped))")
def domain_ranges(spark, d):
    lat, lon = F.col("latitude"), F.col("longitude")
    return profile.long_counts(typed_listings(spark, d), {"nonpositive_area": F.col("building_size_sqm") <= 0, "partial_coordinates": lat.isNull() != lon.isNull(), "in_country": lat.between(24, 40.5) & lon.between(43, 64.5), "swapped": lat.between(43, 64.5) & lon.between(24, 40.5)})


@query("SELECT column_name, CAST(count(*) AS BIGINT) AS rows, CAST(count_if(v IS NULL) AS BIGINT) AS missing, count(DISTINCT v) AS distinct_values FROM (SELECT column_name, " + _NT.format("x") + " AS v FROM (FROM (SELECT * EXCLUDE (source_row_id) FROM listings) UNPIVOT INCLUDE NULLS (x FOR column_name IN (COLUMNS(*)))) t) GROUP BY 1")
def listing_profile(spark, d):
    df = spread(table(spark, d, "listings"))
    return profile.column_profile(df, _raw(df))


@query(f"WITH t AS ({_TYPED}) SELECT property_family, round(median(latitude), 2) AS latitude, round(median(longitude), 2) AS longitude, count(latitude) AS n FROM t WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1")
def median_coordinates(spark, d):
    rows = typed_listings(spark, d).where("latitude IS NOT NULL AND longitude IS NOT NULL").select("property_family", "latitude", "longitude")
    of = lambda c: group_percentiles(rows, ["property_family"], c, {c: 0.5})
    return of("latitude").join(of("longitude").drop("n"), "property_family").select("property_family", F.round("latitude", 2).alias("latitude"), F.round("longitude", 2).alias("longitude"), "n")
