"""Queries of models, spatial operators, measures and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from arzyab.ml import features, ridge, segments
from arzyab.operators import measures, spatial
from arzyab.operators.percentiles import group_percentiles
from arzyab.plans.analysis import typed_listings
from arzyab.plans.relational import PLACED, placed_orders
from arzyab.sources.tables import table
from arzyab.streaming.rollup import windowed_rollup

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


NUMERIC, BINARY, CATEGORICAL = ["p_size", "l_quantity", "l_discount"], ["is_air"], ["p_brand", "l_returnflag"]


def _lines(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select("l_orderkey", "l_linenumber", F.ln("l_extendedprice").alias("y"), "p_size", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("l_quantity"), "l_discount", (F.col("l_linestatus") == "O").cast("int").alias("is_air"), "p_brand", "l_returnflag", F.year("l_shipdate").alias("year"))


def _split(df):
    return df.where("year <= 1998"), df.where("year = 1999"), df.where("year >= 2000")


@query()
def ridge_metrics(spark, d):
    train, valid, test = _split(_lines(spark, d))
    design = features.learn_design(train, NUMERIC, BINARY, CATEGORICAL)
    alpha, _ = ridge.select_alpha(train, valid, design, "y")
    final = train.unionByName(valid)
    model = ridge.fit_ridge(final, features.learn_design(final, NUMERIC, BINARY, CATEGORICAL), "y", alpha)
    return ridge.metrics(ridge.with_prediction(test, model), "y", ["l_returnflag"])


@query()
def ridge_effects(spark, d):
    train = _lines(spark, d)
    model = ridge.fit_ridge(train, features.learn_design(train, NUMERIC, BINARY, CATEGORICAL), "y", 1.0)
    return spark.createDataFrame(model.effects(), "term string, coefficient double")


@query()
def permutation_importance(spark, d):
    train = _lines(spark, d)
    model = ridge.fit_ridge(train, features.learn_design(train, NUMERIC, BINARY, CATEGORICAL), "y", 1.0)
    return ridge.permutation_importance(train, model, "y", {"quantity": ["l_quantity"], "type": ["p_brand", "l_returnflag"]}, ["l_orderkey", "l_linenumber"])


@query()
def adjusted_contrast(spark, d):
    train = _lines(spark, d)
    model = ridge.fit_ridge(train, features.learn_design(train, NUMERIC, BINARY, CATEGORICAL), "y", 1.0)
    return ridge.contrast(train, model, "l_quantity", 10.0, 20.0)


@query()
def crossfit_residuals(spark, d):
    out = ridge.cross_fitted(_lines(spark, d), NUMERIC, BINARY, CATEGORICAL, "y", "l_returnflag", "l_orderkey")
    return out.groupBy("l_returnflag", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("residual").alias("mean_residual"))


@query()
def tree_benchmark(spark, d):
    train, valid, _ = _split(_lines(spark, d))
    return ridge.tree_benchmark(train, valid, NUMERIC, "y")


@query()
def kmeans_gate(spark, d):
    parts, columns = segments.scaled_matrix(table(spark, d, "part"), ["p_size", "p_retailprice"])
    return segments.candidates(parts, columns)


SQUARE = {"type": "Polygon", "coordinates": [[[50, 30], [56, 30], [56, 36], [50, 36], [50, 30]], [[52, 32], [54, 32], [54, 34], [52, 34], [52, 32]]]}


@query("SELECT property_family, count(*) AS n, count_if(inside) AS inside FROM (SELECT property_family, longitude >= 50 AND longitude < 56 AND latitude >= 30 AND latitude < 36 AND NOT (longitude >= 52 AND longitude < 54 AND latitude >= 32 AND latitude < 34) AS inside FROM (SELECT CASE WHEN cat3_slug IN ('apartment-sell', 'apartment-rent') THEN 'apartment' ELSE 'rest' END AS property_family, TRY_CAST(location_latitude AS DOUBLE) AS latitude, TRY_CAST(location_longitude AS DOUBLE) AS longitude FROM listings) WHERE latitude IS NOT NULL AND longitude IS NOT NULL) GROUP BY 1")
def points_in_polygon(spark, d):
    rows = typed_listings(spark, d).select(F.when(F.col("property_family") == "apartment", "apartment").otherwise("rest").alias("property_family"), "longitude", "latitude")
    return spatial.within(rows, "longitude", "latitude", SQUARE, "inside").where("inside IS NOT NULL").groupBy("property_family").agg(F.count(F.lit(1)).alias("n"), F.count_if("inside").alias("inside"))


@query("WITH s AS (SELECT l_returnflag AS stratum, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY sha256(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)), l_orderkey, l_linenumber) AS k FROM lineitem) SELECT stratum, l_orderkey, l_linenumber FROM s WHERE k <= CASE WHEN stratum = 'R' THEN 80 ELSE 40 END")
def stratified_sample(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("stratum"), "l_orderkey", "l_linenumber")
    return spatial.stratified_sample(rows, "stratum", ["l_orderkey", "l_linenumber"], 40, {"R": 80})


@query("SELECT uses, count(*) AS pairs, CAST(sum(uses) AS BIGINT) AS rows FROM (SELECT round(lat, 2) AS a, round(lon, 2) AS b, count(*) AS uses FROM (SELECT TRY_CAST(location_latitude AS DOUBLE) AS lat, TRY_CAST(location_longitude AS DOUBLE) AS lon FROM listings) WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY ALL) GROUP BY 1")
def coordinate_reuse(spark, d):
    return spatial.coordinate_reuse(typed_listings(spark, d), "latitude", "longitude", 2)


_MONTHLY = f"SELECT city, month, median(o_totalprice) AS median FROM ({PLACED}) GROUP BY ALL"


def _monthly(spark, d):
    return group_percentiles(placed_orders(spark, d), ["city", "month"], "o_totalprice", {"median": 0.5}).drop("n")


@query(f"SELECT city, max(month) AS month, max_by(median, month) AS median FROM ({_MONTHLY}) GROUP BY 1")
def measure_latest(spark, d):
    return measures.latest(_monthly(spark, d), "month", "median", ["city"])


@query(f"SELECT city, min_by(median, month) AS first_value, max_by(median, month) AS last_value, (max_by(median, month) / min_by(median, month) - 1) * 100 AS change_pct FROM ({_MONTHLY}) GROUP BY 1")
def measure_period_change(spark, d):
    return measures.period_change(_monthly(spark, d), "month", "median", ["city"])


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return windowed_rollup(table(spark, d, "events"), "ts", ["event_type"], [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")])
