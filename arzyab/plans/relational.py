"""Queries of the relational operators on the star-schema tables, each with the same statement in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arzyab.functions import columns as C
from arzyab.operators import outliers, profile, ranks, rollup
from arzyab.operators.percentiles import group_percentiles
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


def placed_orders(spark, d):
    """Orders with month, nation and market segment."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(F.date_trunc("month", "o_orderdate").cast("date").alias("month"), F.col("n_name").alias("city"), F.col("c_mktsegment").alias("part"), "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")


PLACED = "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, n_name AS city, c_mktsegment AS part, o_orderkey, o_totalprice, o_orderpriority, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
_FOUR = "count(o_totalprice) AS n, round(quantile_cont(o_totalprice, 0.25), 6) AS p25, round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.75), 6) AS p75"
_LEVELS = f"SELECT month, 0 AS level, CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS part, {_FOUR} FROM p GROUP BY month UNION ALL SELECT month, 1, city, NULL, {_FOUR} FROM p GROUP BY month, city UNION ALL SELECT month, 2, city, part, {_FOUR} FROM p GROUP BY month, city, part"


def _levels(spark, d):
    return rollup.level_percentiles(placed_orders(spark, d), "month", ["city", "part"], "o_totalprice")


@query(f"WITH p AS ({PLACED}) {_LEVELS}")
def rollup_levels(spark, d):
    return _levels(spark, d)


@query(f"WITH p AS ({PLACED}), r AS ({_LEVELS}) SELECT month, level, city, part, median, CASE WHEN lag(median) OVER w <> 0 THEN (median / lag(median) OVER w - 1) * 100 END AS mom_pct FROM r WINDOW w AS (PARTITION BY level, city, part ORDER BY month)")
def rollup_mom(spark, d):
    return rollup.change_from_previous(_levels(spark, d), ["level", "city", "part"], "month", "median", "mom_pct").select("month", "level", "city", "part", "median", "mom_pct")


@query(f"WITH p AS ({PLACED}), r AS (SELECT month, city, part, median(o_totalprice) AS median FROM p WHERE part <> 'BUILDING' OR month(month) % 3 <> 0 GROUP BY ALL) SELECT month, city, part, CASE WHEN (year(month) * 12 + month(month)) - (lag(year(month) * 12 + month(month)) OVER w) = 1 AND lag(median) OVER w <> 0 THEN (median / lag(median) OVER w - 1) * 100 END AS mom_pct FROM r WINDOW w AS (PARTITION BY city, part ORDER BY month)")
def mom_adjacent_months(spark, d):
    rows = placed_orders(spark, d).where((F.col("part") != "BUILDING") | (F.month("month") % 3 != 0))
    rows = group_percentiles(rows, ["month", "city", "part"], "o_totalprice", {"median": 0.5}).drop("n")
    return rollup.change_from_previous(rows, ["city", "part"], "month", "median", "mom_pct", F.year("month") * 12 + F.month("month")).select("month", "city", "part", "mom_pct")


@query("WITH s AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, nullif(l_returnflag, 'N') AS flag, count(*) AS supply FROM lineitem GROUP BY ALL), p AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, nullif(o_orderstatus, 'O') AS flag, median(o_totalprice) AS median FROM orders GROUP BY ALL) SELECT coalesce(s.month, p.month) AS month, coalesce(s.flag, p.flag) AS flag, supply, median FROM s FULL JOIN p ON s.month IS NOT DISTINCT FROM p.month AND s.flag IS NOT DISTINCT FROM p.flag")
def supply_price_fulljoin(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").cast("date").alias("month"), F.nullif(F.col("l_returnflag"), F.lit("N")).alias("flag")).agg(F.count(F.lit(1)).alias("supply"))
    p = table(spark, d, "orders").select(F.date_trunc("month", "o_orderdate").cast("date").alias("month"), F.nullif(F.col("o_orderstatus"), F.lit("O")).alias("flag"), "o_totalprice")
    p = group_percentiles(p, ["month", "flag"], "o_totalprice", {"median": 0.5}).drop("n")
    return rollup.full_join_on(s, p, ["month", "flag"])


@query("WITH a AS (SELECT c_nationkey AS k, nullif(c_mktsegment, 'BUILDING') AS s, count(*) AS n, sum(c_acctbal) AS v FROM customer GROUP BY ALL), b AS (SELECT c_nationkey AS k, nullif(c_mktsegment, 'BUILDING') AS s, count(*) AS n, sum(c_acctbal) AS v FROM customer WHERE c_custkey % 97 <> 0 AND c_nationkey <> 3 GROUP BY ALL), j AS (SELECT a.n AS an, b.n AS bn, a.v AS av, b.v AS bv, a.k IS NOT NULL AND a.n IS NOT NULL AS ina, b.n IS NOT NULL AS inb FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k AND a.s IS NOT DISTINCT FROM b.s) SELECT m AS metric, count_if(NOT inb) AS only_a, count_if(NOT ina) AS only_b, count_if(ina AND inb) AS matched, count_if(ina AND inb AND CASE WHEN m = 'n' THEN abs(an - bn) > greatest(1e-6, 1e-9 * greatest(an, bn)) ELSE abs(av - bv) > greatest(1e-6, 1e-9 * greatest(abs(av), abs(bv))) END) AS mismatched FROM j, (VALUES ('n'), ('v')) t(m) GROUP BY m")
def reconcile_keyed(spark, d):
    c = table(spark, d, "customer").withColumn("s", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))).withColumnRenamed("c_nationkey", "k")
    agg = lambda x: x.groupBy("k", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("v"))
    return rollup.reconcile(agg(c), agg(c.where("c_custkey % 97 <> 0 AND k <> 3")), ["k", "s"], ["n", "v"])


_BOUNDS = "quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3, count(*) AS n"


@query(f"WITH p AS ({PLACED}), l AS (SELECT city, part, {_BOUNDS} FROM p WHERE o_totalprice > 0 GROUP BY ALL HAVING count(*) >= 100 AND q3 > q1), f AS (SELECT part, {_BOUNDS} FROM p WHERE o_totalprice > 0 GROUP BY ALL HAVING count(*) >= 200 AND q3 > q1), j AS (SELECT p.o_orderkey, p.o_totalprice AS v, greatest(0.0, coalesce(l.q1 - 0.5 * (l.q3 - l.q1), f.q1 - 0.5 * (f.q3 - f.q1))) AS lo, coalesce(l.q3 + 0.5 * (l.q3 - l.q1), f.q3 + 0.5 * (f.q3 - f.q1)) AS hi FROM p LEFT JOIN l ON p.city = l.city AND p.part = l.part LEFT JOIN f ON p.part = f.part) SELECT o_orderkey, coalesce(v > 0 AND (v < lo OR v > hi), false) AS price_flag FROM j")
def outlier_flags(spark, d):
    return outliers.flag_outliers(placed_orders(spark, d), "o_totalprice", ["city", "part"], ["part"], "price_flag", multiplier=0.5, least_rows=100).select("o_orderkey", "price_flag")


@query("WITH p AS (SELECT o_totalprice AS v, ln(o_totalprice) AS l FROM orders WHERE o_totalprice > 0), a AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, median(l) AS m FROM p), x AS (SELECT median(abs(l - m)) AS mad FROM p, a) SELECT count(*) AS n, count_if(v < greatest(0.0, q1 - 2 * (q3 - q1)) OR v > q3 + 2 * (q3 - q1)) AS iqr2, count_if(v < greatest(0.0, q1 - 3 * (q3 - q1)) OR v > q3 + 3 * (q3 - q1)) AS iqr3, count_if(abs(l - m) / (1.4826 * mad) > 3.5) AS log_mad FROM p, a, x")
def outlier_sensitivity(spark, d):
    return outliers.sensitivity(table(spark, d, "orders"), "o_totalprice")


@query(f"WITH p AS ({PLACED}), c AS (SELECT city, part, count(*) AS c FROM p GROUP BY ALL) SELECT threshold, count_if(c >= threshold) AS groups, CAST(sum(CASE WHEN c >= threshold THEN c ELSE 0 END) AS BIGINT) AS rows FROM c, (VALUES (30), (50), (100), (120), (200)) t(threshold) GROUP BY threshold")
def min_n_sensitivity(spark, d):
    return outliers.minimum_n(placed_orders(spark, d), ["city", "part"], [30, 50, 100, 120, 200])


@query("WITH a AS (SELECT * FROM lineitem WHERE l_extendedprice BETWEEN (SELECT quantile_cont(l_extendedprice, 0.01) FROM lineitem) AND (SELECT quantile_cont(l_extendedprice, 0.99) FROM lineitem)), b AS (SELECT * FROM a WHERE l_quantity BETWEEN (SELECT quantile_cont(l_quantity, 0.01) FROM a) AND (SELECT quantile_cont(l_quantity, 0.99) FROM a)) SELECT l_returnflag, count(*) AS n, sum(l_extendedprice) AS total FROM b GROUP BY 1")
def trimmed_totals(spark, d):
    rows = outliers.trimmed(table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity"), ["l_extendedprice", "l_quantity"])
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("total"))


_PARTS = "SELECT p_brand, p_type, count(*) AS n, median(p_retailprice / p_size) AS median, quantile_cont(p_retailprice / p_size, 0.25) AS p25, quantile_cont(p_retailprice / p_size, 0.75) AS p75 FROM part GROUP BY ALL"


def _parts(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type", (F.col("p_retailprice") / F.col("p_size")).alias("v")).transform(group_percentiles, ["p_brand", "p_type"], "v", rollup.QUARTILES)


@query(f"SELECT *, p75 - p25 AS iqr, n >= 10 AS reliable FROM ({_PARTS})")
def market_summary(spark, d):
    return _parts(spark, d).withColumns({"iqr": F.col("p75") - F.col("p25"), "reliable": F.col("n") >= 10})


@query(f"SELECT p_brand, p_type, median, dense_rank() OVER (PARTITION BY p_brand ORDER BY median DESC) AS from_top, dense_rank() OVER (PARTITION BY p_brand ORDER BY median) AS from_bottom, dense_rank() OVER (ORDER BY median DESC) AS overall FROM ({_PARTS})")
def rank_within(spark, d):
    w = lambda c, *k: F.dense_rank().over((Window.partitionBy(*k) if k else Window).orderBy(c))
    return _parts(spark, d).select("p_brand", "p_type", "median", w(F.desc("median"), "p_brand").alias("from_top"), w(F.asc("median"), "p_brand").alias("from_bottom"), w(F.desc("median")).alias("overall"))


@query(f"SELECT p_brand, p_type, median, place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY median DESC, p_type) AS place FROM ({_PARTS})) WHERE place <= 5")
def top5_each(spark, d):
    return ranks.top_each(_parts(spark, d), ["p_brand"], [F.desc("median"), F.asc("p_type")], 5).select("p_brand", "p_type", "median", "place")


@query("SELECT p_partkey, p_brand, (rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0) AS avg_rank, (rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0) / count(*) OVER (PARTITION BY p_brand) AS pct, -1 + 2 * ((rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0) - 1) / (count(*) OVER (PARTITION BY p_brand) - 1) AS scaled FROM part")
def rank_percentiles(spark, d):
    r = ranks.with_average_ranks(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size")
    a, n = F.col("avg_rank"), F.col("ranked")
    return r.select("p_partkey", "p_brand", "avg_rank", (a / n).alias("pct"), (-1 + 2 * (a - 1) / (n - 1)).alias("scaled"))


@query("WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY month) AS share FROM m")
def monthly_mix(spark, d):
    m = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return m.withColumn("share", ranks.share_within("n", ["month"]))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_query(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").offset(100).limit(50)


@query("SELECT column_name, CAST(count(*) AS BIGINT) AS rows, CAST(count_if(v IS NULL) AS BIGINT) AS missing, count(DISTINCT v) AS distinct_values FROM (SELECT column_name, CASE WHEN lower(t) IN ('', 'null', '<null>', 'none', 'nan', 'n/a', 'na') THEN NULL ELSE t END AS v FROM (SELECT unnest(['c_mktsegment', 'c_nationkey', 'c_name']) AS column_name, trim(unnest([c_mktsegment, CAST(c_nationkey AS VARCHAR), c_name])) AS t FROM customer)) GROUP BY column_name")
def column_profile(spark, d):
    return profile.column_profile(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey", "c_name"])


@query("SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS place FROM (SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1)")
def frequency(spark, d):
    return profile.frequencies(table(spark, d, "part"), "p_type")


@query("SELECT 'k' AS field, count(*) AS given, count(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS parsed, count_if(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL) AS failed, min(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS least, max(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS most FROM events")
def parse_diag(spark, d):
    e = table(spark, d, "events")
    return profile.parse_diagnostics(e, "props", F.get_json_object("props", "$.k").try_cast("bigint"), "k")


@query("SELECT (SELECT count(*) FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_custkey IS NULL) AS orders_without_customer, (SELECT count(*) FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey IS NULL) AS lines_without_order, (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)) AS repeated_line_keys")
def fk_grain_check(spark, d):
    from arzyab.operators import quality

    o, c, li = (table(spark, d, t) for t in ("orders", "customer", "lineitem"))
    a = quality.missing_keys(o, "o_custkey", c, "c_custkey").agg(F.count(F.lit(1)).alias("orders_without_customer"))
    b = quality.missing_keys(li, "l_orderkey", o, "o_orderkey").agg(F.count(F.lit(1)).alias("lines_without_order"))
    g = quality.repeated_grain(li, ["l_orderkey", "l_linenumber"]).agg(F.count(F.lit(1)).alias("repeated_line_keys"))
    return a.crossJoin(b).crossJoin(g)  # one row each


@query("SELECT month, month_key, month_key // 100 AS year, month_key % 100 AS month_number, CAST(ceil((month_key % 100) / 3.0) AS INTEGER) AS quarter, dense_rank() OVER (ORDER BY month_key) AS chronological_sort FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) AS month_key FROM orders)")
def dims_month(spark, d):
    from arzyab.operators import marts

    return marts.month_dimension(table(spark, d, "orders").select(F.date_trunc("month", "o_orderdate").cast("date").alias("month")), "month")


@query("SELECT 'NATIONAL' AS location_key, 'national' AS location_level, CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS part, 'National' AS display_name UNION ALL SELECT DISTINCT 'CITY:' || n_name, 'city', n_name, NULL, array_to_string(list_transform(string_split(trim(regexp_replace(n_name, '[-_\\s]+', ' ', 'g')), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') FROM nation UNION ALL SELECT DISTINCT 'NEIGHBORHOOD:' || n_name || ':' || c_mktsegment, 'neighborhood', n_name, c_mktsegment, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) FROM nation JOIN customer ON n_nationkey = c_nationkey")
def dims_location(spark, d):
    from arzyab.operators import marts

    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("city"), F.col("c_mktsegment").alias("part"))
    cities = table(spark, d, "nation").select(F.col("n_name").alias("city"), F.lit(None).cast("string").alias("part"))
    return marts.location_dimension(rollup.union_all([rows, cities]), "city", "part")


@query(f"WITH p AS ({PLACED}), a AS (SELECT city, count(*) AS n, median(o_totalprice) AS median FROM p WHERE part = 'BUILDING' GROUP BY 1), b AS (SELECT n_name AS city, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 8000 GROUP BY 1) SELECT a.city, n, median, suppliers, 'both_or_price' AS origin FROM a LEFT JOIN b ON a.city = b.city UNION ALL SELECT b.city, NULL, NULL, suppliers, 'supply_only' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.city = b.city)")
def location_mart(spark, d):
    p = placed_orders(spark, d)
    a = group_percentiles(p.where("part = 'BUILDING'"), ["city"], "o_totalprice", {"median": 0.5})
    b = table(spark, d, "supplier").where("s_acctbal > 8000").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("city")).agg(F.count(F.lit(1)).alias("suppliers"))
    return rollup.union_all([a.join(b, "city", "left").withColumn("origin", F.lit("both_or_price")), b.join(a, "city", "left_anti").withColumn("origin", F.lit("supply_only"))])


@query(f"WITH p AS ({PLACED}), c AS (SELECT city, month, median(o_totalprice) AS m, count(*) AS k FROM p GROUP BY ALL HAVING count(*) >= 5), j AS (SELECT o_totalprice / m AS r FROM p JOIN c USING (city, month)) SELECT count(*) AS n, avg(CAST(r BETWEEN 0.5 AND 2 AS INT)) AS within, avg(CAST(r BETWEEN 0.08 AND 0.125 AS INT)) AS tenth, avg(CAST(r BETWEEN 8 AND 12.5 AS INT)) AS tenfold FROM j")
def decade_share(spark, d):
    p = placed_orders(spark, d)
    cells = group_percentiles(p, ["city", "month"], "o_totalprice", {"m": 0.5}, least_rows=5).drop("n")
    r = p.join(cells, ["city", "month"]).select((F.col("o_totalprice") / F.col("m")).alias("r"))
    part = lambda a, b, n: F.avg(F.col("r").between(a, b).cast("int")).alias(n)
    return r.agg(F.count(F.lit(1)).alias("n"), part(0.5, 2, "within"), part(0.08, 0.125, "tenth"), part(8, 12.5, "tenfold"))


@query("WITH s AS (SELECT n_name, avg(l_extendedprice) AS a, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), r AS (SELECT n_name, avg(o_totalprice) AS b FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT count(*) AS cells, corr(ln(a), ln(b)) AS log_corr, quantile_cont(b / a, 0.05) AS p05, quantile_cont(b / a, 0.5) AS p50, quantile_cont(b / a, 0.95) AS p95 FROM s JOIN r USING (n_name)")
def corr_coherence(spark, d):
    o, c, n, li = (table(spark, d, t) for t in ("orders", "customer", "nation", "lineitem"))
    placed = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    s = li.join(placed, li.l_orderkey == o.o_orderkey).groupBy("n_name").agg(F.avg("l_extendedprice").alias("a"), F.count(F.lit(1)).alias("n"))
    r = placed.groupBy("n_name").agg(F.avg("o_totalprice").alias("b")).join(s, "n_name").withColumn("q", F.col("b") / F.col("a"))
    return r.agg(F.count(F.lit(1)).alias("cells"), F.corr(F.ln("a"), F.ln("b")).alias("log_corr"), F.percentile("q", 0.05).alias("p05"), F.percentile("q", 0.5).alias("p50"), F.percentile("q", 0.95).alias("p95"))


# Keyword families and their patterns.
KEYWORDS = {
    "new_build": r"(?:نوساز|نو\s*ساز)",
    "unused": r"(?:کلیدنخورده|کلید\s*نخورده)",
    "urgent": r"فوری",
    "exchange": r"معاوضه",
    "below_market": r"(?:زیر\s*قیمت|زیرقیمت)",
    "migration_sale": r"(?:به\s*(?:دلیل|علت)\s*مهاجرت|بخاطر\s*مهاجرت|به\s*خاطر\s*مهاجرت|فروش(?:\s*فوری)?\s*به\s*(?:دلیل|علت)\s*مهاجرت|فروش.{0,24}مهاجرت|مهاجرت.{0,24}فروش)",
}
_FLAGS = ", ".join(f"coalesce(regexp_matches(t, '{p}'), false) AS {k}" for k, p in KEYWORDS.items())
_TEXT = "SELECT source_row_id, substr(created_at_month, 1, 7) AS month, coalesce(title, '') || ' ' || coalesce(description, '') AS t FROM listings"


@query(f"SELECT source_row_id, {_FLAGS} FROM ({_TEXT})")
def keyword_flags(spark, d):
    t = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    return table(spark, d, "listings").select("source_row_id", t.alias("t")).select("source_row_id", *C.keyword_flags(F.col("t"), KEYWORDS))


_MONTHLY = " UNION ALL ".join(f"SELECT month, '{k}' AS keyword, count(*) AS population_n, count_if({k}) AS positive_n FROM f GROUP BY 1" for k in KEYWORDS)


@query(f"WITH f AS (SELECT month, {_FLAGS} FROM ({_TEXT})) SELECT *, CAST(positive_n AS DOUBLE) / population_n AS positive_rate FROM ({_MONTHLY})")
def keyword_monthly(spark, d):
    t = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    f = table(spark, d, "listings").select(F.substring("created_at_month", 1, 7).alias("month"), t.alias("t")).select("month", *C.keyword_flags(F.col("t"), KEYWORDS))
    wide = f.groupBy("month").agg(F.count(F.lit(1)).alias("population_n"), *[F.count_if(k).alias(k) for k in KEYWORDS])
    long = wide.select("month", "population_n", F.explode(F.array(*[F.struct(F.lit(k).alias("keyword"), F.col(k).alias("positive_n")) for k in KEYWORDS])).alias("x")).select("month", "x.keyword", "population_n", "x.positive_n")
    return long.withColumn("positive_rate", C.share(F.col("positive_n"), F.col("population_n")))
