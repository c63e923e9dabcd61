"""Queries of published tables and reports: marts with keys and metadata, profiles, gates, reconciliation, sensitivity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arzyab.functions import columns as C
from arzyab.operators import marts, profile, quality, ranks, rollup, spatial, statistics, trends
from arzyab.operators.percentiles import group_percentiles
from arzyab.plans.analysis import _FEATURES, _TYPED, _features, _rounded, _temperature, _temperature_sql, typed_listings
from arzyab.plans.relational import _LEVELS, PLACED, _levels, placed_orders
from arzyab.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


COMMON = ["unit", "scope", "location_key", "month_key"]


@query(f"WITH p AS ({PLACED}), r AS ({_LEVELS}) SELECT level, city, part, n, median, CASE WHEN n >= 5 THEN 'RELIABLE' WHEN n >= 2 THEN 'LOW_N' ELSE 'INSUFFICIENT' END AS reliability, 'toman' AS unit, 'orders' AS scope, CASE level WHEN 0 THEN 'NATIONAL' WHEN 1 THEN 'CITY:' || city ELSE 'NEIGHBORHOOD:' || city || ':' || part END AS location_key, CAST(strftime(month, '%Y%m') AS INTEGER) AS month_key FROM r")
def mart_monthly(spark, d):
    level = F.element_at(F.array(F.lit("national"), F.lit("city"), F.lit("neighborhood")), F.col("level") + 1)
    rows = rollup.named_places(_levels(spark, d), ["city", "part"])
    rows = rows.select("level", "city", "part", "n", "median", F.when(F.col("n") >= 5, "RELIABLE").when(F.col("n") >= 2, "LOW_N").otherwise("INSUFFICIENT").alias("reliability"), C.location_key(level, F.col("city"), F.col("part")).alias("location_key"), C.month_key(F.col("month")).alias("month_key"))
    return marts.standardised(rows, {"unit": "toman", "scope": "orders"}, COMMON)


@query("WITH s AS (SELECT p_brand AS segment, median(p_retailprice) AS median_price, median(p_size) AS median_size, count(*) AS n FROM part GROUP BY 1), t AS (SELECT p_brand AS segment, p_type, count(*) AS c FROM part GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY c DESC, p_type) AS place FROM t), g AS (SELECT segment, max(CASE WHEN place = 1 THEN p_type END) AS top_1, max(CASE WHEN place = 2 THEN p_type END) AS top_2 FROM k GROUP BY 1) SELECT s.segment, median_price, median_size, n, CAST(n AS DOUBLE) / (SELECT sum(n) FROM s) AS share, top_1, top_2 FROM s JOIN g ON s.segment = g.segment")
def segment_profile(spark, d):
    p = table(spark, d, "part")
    own = p.withColumnRenamed("p_brand", "segment")
    s = group_percentiles(own, ["segment"], "p_retailprice", {"median_price": 0.5}).join(group_percentiles(own, ["segment"], "p_size", {"median_size": 0.5}).drop("n"), "segment")
    top = ranks.top_each(p.groupBy(F.col("p_brand").alias("segment"), "p_type").agg(F.count(F.lit(1)).alias("c")), ["segment"], [F.desc("c"), F.asc("p_type")], 2)
    two = top.groupBy("segment").agg(*[F.max(F.when(F.col("place") == k, F.col("p_type"))).alias(f"top_{k}") for k in (1, 2)])
    total = s.agg(F.sum("n").alias("all_"))
    return s.join(two, "segment").crossJoin(F.broadcast(total)).withColumn("share", C.share(F.col("n"), F.col("all_"))).drop("all_")


@query("WITH r AS (SELECT p_brand, p_type, p_retailprice AS v FROM part), a AS (SELECT p_brand AS b, p_type AS t, median(v) AS m FROM r GROUP BY ALL HAVING count(*) >= 15), c AS (SELECT p_type AS t, median(v) AS m FROM r GROUP BY ALL), j AS (SELECT r.p_brand, 100 * v / coalesce(a.m, c.m) AS i FROM r LEFT JOIN a ON p_brand = a.b AND p_type = a.t LEFT JOIN c ON p_type = c.t) SELECT p_brand AS segment, median(i) AS median_index, count(*) AS n FROM j GROUP BY 1")
def segment_positioning(spark, d):
    from arzyab.operators.lookup import fallback_reference

    rows = fallback_reference(table(spark, d, "part").select("p_brand", "p_type", F.col("p_retailprice").alias("v")), "v", [["p_brand", "p_type"], ["p_type"]], 15, "m")
    # the narrow level needs 15 rows, the wide one takes what there is
    return group_percentiles(rows.select(F.col("p_brand").alias("segment"), (100 * F.col("v") / F.col("m")).alias("index")), ["segment"], "index", {"median_index": 0.5})


@query("SELECT name, n, hits, CAST(hits AS DOUBLE) / n AS precision, n >= 20 AND CAST(hits AS DOUBLE) / n >= 0.8 AS accepted FROM (SELECT event_type AS name, count(*) AS n, count_if(value > 30) AS hits FROM events GROUP BY 1)")
def precision_gate(spark, d):
    """Reviewed rows of each rule, their precision, and whether there are enough of both."""
    by = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 30).alias("hits"))
    precision = C.share(F.col("hits"), F.col("n"))
    return by.select("name", "n", "hits", precision.alias("precision"), ((F.col("n") >= 20) & (precision >= 0.8)).alias("accepted"))


@query(f"WITH t AS ({_temperature_sql(0.6, 0.4)}) SELECT city, score, label, place FROM (SELECT *, row_number() OVER (ORDER BY score DESC, city) AS place, row_number() OVER (ORDER BY score, city) AS back FROM t) WHERE place <= 5 OR back <= 5")
def temperature_extremes(spark, d):
    t = _temperature(spark, d).select("city", F.round("score", 9).alias("score"), "label")
    w = lambda *o: F.row_number().over(Window.orderBy(*o))  # noqa: E731 -- one row a place
    both = t.withColumns({"place": w(F.desc("score"), "city"), "back": w("score", "city")})
    return both.where("place <= 5 OR back <= 5").drop("back")


@query(f"WITH a AS ({_temperature_sql(0.6, 0.4)}), b AS ({_temperature_sql(0.7, 0.3)}) SELECT 'w60_40' AS scenario, label, count(*) AS places FROM a GROUP BY ALL UNION ALL SELECT 'w70_30', label, count(*) FROM b GROUP BY ALL")
def temperature_scenarios(spark, d):
    parts = [_temperature(spark, d, w, 1 - w).select(F.lit(n).alias("scenario"), "label") for n, w in (("w60_40", 0.6), ("w70_30", 0.7))]
    return rollup.union_all(parts).groupBy("scenario", "label").agg(F.count(F.lit(1)).alias("places"))


@query(f"WITH p AS (SELECT city, month, median(o_totalprice) AS m FROM ({PLACED}) GROUP BY ALL), s AS (SELECT *, CASE WHEN (year(month) * 12 + month(month)) - lag(year(month) * 12 + month(month)) OVER w = 1 AND lag(m) OVER w <> 0 THEN (m / lag(m) OVER w - 1) * 100 END AS c FROM p WINDOW w AS (PARTITION BY city ORDER BY month)) SELECT city, median(c) AS median_change, count(c) AS changes, CAST(count(c) AS DOUBLE) / nullif(count(*) - 1, 0) AS coverage FROM s GROUP BY city")
def median_monthly_change(spark, d):
    p = group_percentiles(placed_orders(spark, d), ["city", "month"], "o_totalprice", {"m": 0.5}).drop("n")
    s = rollup.change_from_previous(p, ["city"], "month", "m", "c", F.year("month") * 12 + F.month("month"))
    return s.groupBy("city").agg(F.percentile("c", 0.5).alias("median_change"), F.count("c").alias("changes"), C.share(F.count("c"), F.count(F.lit(1)) - 1).alias("coverage"))


@query("SELECT n_a, n_b, (a / b - 1) * 100 AS gap_pct FROM (SELECT count_if(user_type = 'مشاور املاک') AS n_a, count_if(user_type = 'شخصی') AS n_b, median(CASE WHEN user_type = 'مشاور املاک' THEN v END) AS a, median(CASE WHEN user_type = 'شخصی' THEN v END) AS b FROM (SELECT user_type, TRY_CAST(building_size AS DOUBLE) AS v FROM listings) WHERE v > 0)")
def raw_median_gap(spark, d):
    v = F.col("building_size").try_cast("double")
    a, b = "مشاور املاک", "شخصی"
    by = group_percentiles(table(spark, d, "listings").where((v > 0) & F.col("user_type").isin(a, b)).select("user_type", v.alias("v")), ["user_type"], "v", {"m": 0.5})  # two rows
    of = lambda g, c: F.max(F.when(F.col("user_type") == g, F.col(c)))
    return by.agg(F.coalesce(of(a, "n"), F.lit(0)).alias("n_a"), F.coalesce(of(b, "n"), F.lit(0)).alias("n_b"), ((of(a, "m") / of(b, "m") - 1) * 100).alias("gap_pct"))


@query(f"WITH t AS ({_TYPED}) SELECT strftime(analysis_month, '%Y-%m') AS month, count(*) AS rows, count_if(rooms IS NULL) AS missing, CAST(count_if(rooms IS NULL) AS DOUBLE) / count(*) AS rate, CASE WHEN CAST(count_if(rooms IS NULL) AS DOUBLE) / count(*) > 0.5 THEN 'exclude' WHEN CAST(count_if(rooms IS NULL) AS DOUBLE) / count(*) > 0.05 THEN 'impute_with_mark' ELSE 'keep' END AS action FROM t GROUP BY 1")
def missing_actions(spark, d):
    t = typed_listings(spark, d).groupBy(F.date_format("analysis_month", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("rooms").isNull()).alias("missing"))
    rate = C.share(F.col("missing"), F.col("rows"))
    return t.withColumns({"rate": rate, "action": F.when(rate > 0.5, "exclude").when(rate > 0.05, "impute_with_mark").otherwise("keep")})


@query("SELECT city_slug, min(upper(city_slug)) AS label, count(DISTINCT upper(city_slug)) AS label_values FROM listings WHERE city_slug IS NOT NULL GROUP BY 1")
def dimension_conflicts(spark, d):
    return marts.with_conflicts(table(spark, d, "listings").where("city_slug IS NOT NULL").select("city_slug", F.upper("city_slug").alias("label")), "city_slug", ["label"])


@query("WITH c(k, label) AS (VALUES ('apartment', 'Apartment'), ('villa', 'Villa'), ('castle', 'Castle')), o AS (SELECT DISTINCT split_part(cat3_slug, '-', 1) AS k FROM listings WHERE cat3_slug IS NOT NULL) SELECT coalesce(c.k, o.k) AS property_key, coalesce(label, coalesce(c.k, o.k)) AS label, c.k IS NOT NULL AS configured, o.k IS NOT NULL AS observed FROM c FULL JOIN o ON c.k = o.k")
def dims_property(spark, d):
    """Configured members united with those observed."""
    c = spark.createDataFrame([("apartment", "Apartment"), ("villa", "Villa"), ("castle", "Castle")], "k string, label string").withColumn("configured", F.lit(True))
    o = table(spark, d, "listings").where("cat3_slug IS NOT NULL").select(F.split("cat3_slug", "-")[0].alias("k")).distinct().withColumn("observed", F.lit(True))
    j = rollup.full_join_on(c, o, ["k"])
    return j.select(F.col("k").alias("property_key"), F.coalesce("label", "k").alias("label"), F.coalesce("configured", F.lit(False)).alias("configured"), F.coalesce("observed", F.lit(False)).alias("observed"))


@query()
def published_checks(spark, d):
    """Contract, grain and key checks of a published table as rows."""
    mart, months = mart_monthly(spark, d), marts.month_dimension(placed_orders(spark, d), "month")
    checks = quality.contract_checks(mart, "mart_monthly", ["location_key", "month_key", "median"], ["location_key", "month_key"], ("latitude", "longitude"))
    lost = quality.missing_keys(mart, "month_key", months, "month_key").count()
    checks.append(quality.make_check("mart_monthly: months", lost, 0, lost == 0))
    return quality.check_table(spark, checks)


@query("WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS gross FROM lineitem GROUP BY 1) SELECT count(*) AS rows, count_if(gross IS NULL) AS without_lines, count_if(gross IS NOT NULL AND abs(o_totalprice - gross) > 0.5 * o_totalprice) AS total_off, count_if(o_totalprice IS NULL OR o_totalprice <= 0) AS not_positive FROM orders LEFT JOIN l ON o_orderkey = l_orderkey")
def metric_rederivation(spark, d):
    """Orders whose stored total is far from the sum of their lines, derived again."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("gross"))
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    off = F.col("gross").isNotNull() & (F.abs(F.col("o_totalprice") - F.col("gross")) > 0.5 * F.col("o_totalprice"))
    return profile.counts(o, {"without_lines": F.col("gross").isNull(), "total_off": off, "not_positive": F.col("o_totalprice").isNull() | (F.col("o_totalprice") <= 0)})


@query("SELECT month, rows, kept, CAST(rows - kept AS DOUBLE) / rows AS reduction FROM (SELECT CAST(date_trunc('month', published_at) AS DATE) AS month, count(*) AS rows, count_if(k = 1) AS kept FROM (SELECT published_at, row_number() OVER (PARTITION BY text, date_trunc('month', published_at) ORDER BY doc_id) AS k FROM documents) GROUP BY 1)")
def monthly_dedup_impact(spark, d):
    month = F.date_trunc("month", "published_at").cast("date")
    by = table(spark, d, "documents").groupBy(month.alias("month"), "text").agg(F.count(F.lit(1)).alias("c")).groupBy("month").agg(F.sum("c").alias("rows"), F.count(F.lit(1)).alias("kept"))
    return by.withColumn("reduction", C.share(F.col("rows") - F.col("kept"), F.col("rows")))


@query("SELECT source_row_id, length(x) AS shown, x FROM (SELECT source_row_id, substr(trim(regexp_replace(regexp_replace(description, '[0-9]{4,}', '####', 'g'), '\\s+', ' ', 'g')), 1, 220) AS x FROM listings WHERE description IS NOT NULL) ORDER BY sha256(CAST(source_row_id AS VARCHAR)), source_row_id LIMIT 300")
def review_sample(spark, d):
    """A repeatable review sample of 300 rows with digits hidden: the limit is the feature."""
    t = table(spark, d, "listings").where("description IS NOT NULL").orderBy(F.sha2(F.col("source_row_id").cast("string"), 256), "source_row_id").limit(300)
    return t.select("source_row_id", C.masked_digits(F.col("description")).alias("x")).select("source_row_id", F.length("x").alias("shown"), "x")


@query(f"WITH o AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY o_totalprice, o_orderkey) / CAST(count(*) OVER (PARTITION BY part) AS DOUBLE) AS r FROM ({PLACED})), c AS (SELECT CASE WHEN r <= 0.3 THEN 1 WHEN r <= 0.8 THEN 2 ELSE 3 END AS a, CASE WHEN r <= 0.25 THEN 1 WHEN r <= 0.75 THEN 2 ELSE 3 END AS b FROM o), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM c), ij AS (SELECT sum(k * (k - 1) / 2) AS v FROM (SELECT CAST(count(*) AS DOUBLE) AS k FROM c GROUP BY a, b)), i AS (SELECT sum(k * (k - 1) / 2) AS v FROM (SELECT CAST(count(*) AS DOUBLE) AS k FROM c GROUP BY a)), j AS (SELECT sum(k * (k - 1) / 2) AS v FROM (SELECT CAST(count(*) AS DOUBLE) AS k FROM c GROUP BY b)) SELECT (ij.v - i.v * j.v / (n * (n - 1) / 2)) / ((i.v + j.v) / 2 - i.v * j.v / (n * (n - 1) / 2)) AS adjusted_rand FROM n, ij, i, j")
def cut_sensitivity(spark, d):
    """How much other cut points change a typology."""
    from arzyab.ml.segments import adjusted_rand

    o = ranks.position_within(placed_orders(spark, d).select("part", "o_totalprice", "o_orderkey"), ["part"], [F.col("o_totalprice"), F.col("o_orderkey")])
    o = o.select((F.col("position") / F.col("position_of")).alias("r"))
    c = o.select(ranks.cut_two(F.col("r"), 0.3, 0.8, ("1", "2", "3")).alias("a"), ranks.cut_two(F.col("r"), 0.25, 0.75, ("1", "2", "3")).alias("b"))
    return spark.createDataFrame([(adjusted_rand(c, "a", "b"),)], "adjusted_rand double")


@query(f"WITH p AS ({PLACED}), s AS (SELECT city, count(*) AS n, min(o_totalprice) AS least FROM p GROUP BY 1), x AS (SELECT n_name AS city, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT x.s_suppkey, x.city, s.n FROM x JOIN s ON x.city = s.city WHERE s.n >= (SELECT median(n) FROM s)")
def supported_cells(spark, d):
    """Rows of cells that have at least the median support."""
    s = placed_orders(spark, d).groupBy("city").agg(F.count(F.lit(1)).alias("n"))
    least = s.agg(F.percentile("n", 0.5).alias("least"))
    supported = s.crossJoin(F.broadcast(least)).where("n >= least").select("city", "n")
    x = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("city"))
    return x.join(supported, "city").select("s_suppkey", "city", "n")


@query()
def kruskal_p_value(spark, d):
    return statistics.with_p(statistics.kruskal(table(spark, d, "part"), "p_brand", "p_size"), "chi2", "h", "df")


@query()
def mann_whitney_p_value(spark, d):
    return statistics.with_p(statistics.mann_whitney(table(spark, d, "part"), "p_brand", "p_size", "Brand#11", "Brand#12"), "normal", "z")


_TOKENS = "list_filter(string_split(trim(regexp_replace(lower(translate({}, 'áàâäãåéèêëíìîïóòôöõúùûüçñ', 'aaaaaaeeeeiiiiooooouuuucn')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '' AND x NOT IN ('city', 'county', 'district', 'province', 'of', 'the', 'shahrestan', 'ostan', 'bakhsh'))"


@query(f"SELECT location_level, count(*) AS places, count_if(len(a) > 0 AND len(b) > 0 AND (list_has_all(b, a) OR list_has_all(a, b))) AS agreeing FROM (SELECT location_level, {_TOKENS.format('location_display_name')} AS a, {_TOKENS.format('coalesce(neighborhood_slug, city_slug, $$national$$)')} AS b FROM dim_location) GROUP BY 1")
def place_names(spark, d):
    """How many places of each level have a shown name that agrees with their slug's tokens."""
    x = table(spark, d, "dim_location")
    slug = F.coalesce("neighborhood_slug", "city_slug", F.lit("national"))
    return x.groupBy("location_level").agg(F.count(F.lit(1)).alias("places"), F.count_if(spatial.names_agree(F.col("location_display_name"), slug)).alias("agreeing"))


@query(f"WITH f AS ({_temperature_sql(0.6, 0.4)}) SELECT city, score, label FROM f JOIN ({_FEATURES} SELECT city, price_months FROM f) g USING (city) WHERE label <> 'NEUTRAL' AND price_months >= 5")
def temperature_surfaced(spark, d):
    """Places that pass the gate of months and direction."""
    return _temperature(spark, d).where("label <> 'NEUTRAL' AND price_months >= 5").select("city", F.round("score", 9).alias("score"), "label")


@query(f"{_FEATURES} SELECT city, price_months, activity_months, least(price_months, activity_months) AS usable_months FROM f")
def trend_months(spark, d):
    """How many months each place's trends rest on, as a support table."""
    return _rounded(_features(spark, d)).select("city", "price_months", "activity_months", F.least("price_months", "activity_months").alias("usable_months"))


_LINKS = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey")]


def _check_sql(name: str, count: str) -> str:
    return f"SELECT '{name}' AS name, CAST(n AS VARCHAR) AS actual, '0' AS expected, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status, true AS critical, '' AS notes FROM ({count})"


_LINK_SQL = " UNION ALL ".join(
    part
    for f, k, dim, dk in _LINKS
    for part in (
        _check_sql(f"{f}.{k} -> {dim}.{dk}", f"SELECT count(DISTINCT {k}) AS n FROM {f} WHERE {k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {dim} WHERE {dk} = {k})"),
        _check_sql(f"{f}.{k}: given", f"SELECT count(*) AS n FROM (SELECT 1 FROM {f} WHERE {k} IS NULL LIMIT 1)"),
        _check_sql(f"{dim}.{dk}: unique", f"SELECT count(*) AS n FROM (SELECT {dk} FROM {dim} GROUP BY 1 HAVING count(*) > 1 LIMIT 1)"),
    )
)


@query(_LINK_SQL)
def relationship_checks(spark, d):
    """Foreign keys, NULL keys and dimension keys of the star schema as check rows."""
    tables = {n: table(spark, d, n) for n in ("lineitem", "orders", "customer", "nation", "region", "part", "supplier")}
    return quality.check_table(spark, quality.relationship_checks(tables, _LINKS))


@query()
def published_inventory(spark, d):
    return quality.inventory({"mart_monthly": mart_monthly(spark, d), "segment_profile": segment_profile(spark, d)})
