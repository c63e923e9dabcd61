"""Relational operators on tables with NULLs, ties, empty groups and repeated rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from arzyab.operators import lookup, marts, outliers, profile, quality, ranks, resolution, rollup, spatial, statistics, trends


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_rollup_tells_totals_from_null_places(spark):
    df = spark.createDataFrame([(1, "a", "x", 10), (1, "a", None, 20), (1, None, "x", 30), (1, None, None, 40)], "m int, c string, n string, v int")
    got = {(r.level, r.c, r.n): r.s for r in rollup.rollup_levels(df, "m", ["c", "n"], [F.sum("v").alias("s")]).collect()}
    assert got == {(0, None, None): 100, (1, "a", None): 30, (1, None, None): 70, (2, "a", "x"): 10, (2, None, "x"): 30}
    named = rollup.named_places(rollup.rollup_levels(df, "m", ["c", "n"], [F.sum("v").alias("s")]), ["c", "n"])
    assert rows(named.select("level", "s")) == [(0, 100), (1, 30), (2, 10)]


def test_change_bridges_gaps_unless_told_not_to(spark):
    df = spark.createDataFrame([("k", 1, 100.0), ("k", 3, 150.0), ("k", 4, 0.0), ("k", 5, 10.0)], "k string, p int, v double")
    assert [r.c for r in rollup.change_from_previous(df, ["k"], "p", "v", "c").orderBy("p").collect()] == [None, 50.0, -100.0, None]
    assert [r.c for r in rollup.change_from_previous(df, ["k"], "p", "v", "c", F.col("p")).orderBy("p").collect()] == [None, None, -100.0, None]


def test_full_join_matches_null_keys(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("y", 20)], "k string, b int")
    joined = rollup.full_join_on(a, b, ["k"])
    assert rows(joined) == rows(spark.createDataFrame([(None, 1, 10), ("x", 2, None), ("y", None, 20)], "k string, a int, b int"))
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()


def test_reconcile_counts_each_kind_of_difference(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (None, 4.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-12), (2, 2.1), (3, 3.0), (5, 5.0)], "k int, v double")
    assert rows(rollup.reconcile(a, b, ["k"], ["v"])) == [("v", 1, 1, 3, 2)]


def test_ranks(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 1.0), ("g", 3.0), ("g", None), ("h", 5.0), ("e", 2.0), ("e", 2.0)], "g string, v double")
    got = df.select("g", "v", ranks.average_rank("v", ["g"]).alias("a"), ranks.percentile_rank("v", ["g"]).alias("p"), ranks.scaled_rank("v", ["g"], -1, 1).alias("s"))
    wide = ranks.with_average_ranks(df, ["g"], "v")
    assert rows(wide.select("g", "v", "avg_rank")) == rows(got.select("g", "v", "a"))
    assert rows(got.where("g = 'g'")) == rows(spark.createDataFrame([("g", 1.0, 1.5, 0.5, -0.5), ("g", 1.0, 1.5, 0.5, -0.5), ("g", 3.0, 3.0, 1.0, 1.0), ("g", None, None, None, None)], got.schema))
    assert [r.p for r in got.where("g <> 'g'").collect()] == [0.5] * 3


def test_running_total_over_partitions(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("v"), (F.col("id") % 7).alias("n"))
    got = {r.v: r.before for r in ranks.running_total(df, "v", "n").collect()}
    total = 0
    for v in range(1000):
        assert got[v] == total
        total += v % 7
    assert ranks.running_total(df.limit(0), "v", "n").count() == 0


def test_position_within_a_hot_key_equals_row_number(spark):
    from pyspark.sql import Window

    df = spark.range(0, 3000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), (F.hash("id") % 97).alias("v"), "id")
    got = ranks.position_within(df, ["k"], [F.col("v"), F.col("id")])
    w = Window.partitionBy("k")
    want = df.select("*", F.row_number().over(w.orderBy("v", "id")).cast("long").alias("position"), F.count(F.lit(1)).over(w).alias("position_of"))
    assert rows(got) == rows(want)
    assert ranks.position_within(df.limit(0), ["k"], [F.col("v")]).count() == 0


def test_outliers_fall_back_and_never_flag_null(spark):
    data = [("a", "k", float(v)) for v in range(1, 61)] + [("a", "k", 10_000.0), ("b", "k", 10_000.0), (None, "k", 10_000.0), ("a", None, 9e9), ("b", "k", None)]
    df = spark.createDataFrame(data, "c string, k string, v double")
    got = outliers.flag_outliers(df, "v", ["c", "k"], ["k"], "flag", least_rows=50, least_fallback=60)
    assert got.count() == len(data)
    assert rows(got.where("flag").select("c", "k")) == [("a", "k"), ("b", "k"), (None, "k")]  # a NULL key matches no local bounds and falls back
    flat = outliers.flag_outliers(df.withColumn("v", F.lit(5.0)), "v", ["c"], ["k"], "flag", least_rows=2, least_fallback=2)
    assert not flat.where("flag").count()


def test_entity_resolution(listings):
    base = {"title": "Nice flat", "description": "A bright flat with a large yard", "city_slug": "c", "neighborhood_slug": "n", "cat3_slug": "apartment-sell", "price_value": "100", "building_size": "80", "rooms_count": "2"}
    data = [
        {"source_row_id": 1, **base, "created_at_month": "2024-05"},
        {"source_row_id": 2, **base, "created_at_month": "2024-05", "title": "NICE flat!"},
        {"source_row_id": 3, **base, "created_at_month": "2024-05", "title": "Other place", "description": "x" * 30},
        {"source_row_id": 4, **base, "created_at_month": "2024-05", "title": "Other place", "description": "y" * 30, "price_value": "101"},
        {"source_row_id": 5, **base, "created_at_month": "2024-06"},
        {"source_row_id": 6, "created_at_month": "2024-06"},
        {"source_row_id": 7, "created_at_month": "2024-06"},
    ]
    df = listings(data)
    raw = [c for c in df.columns if c != "source_row_id"]
    got = {r.source_row_id: r for r in resolution.resolve_listings(df, raw, F.col("created_at_month"), F.col("building_size").cast("double"), F.col("rooms_count"), F.col("price_value").cast("double")).collect()}
    assert [got[i].confidence for i in range(1, 8)] == ["high", "high", "medium", "medium", "none", "exact", "exact"]
    assert [got[i].keep_flag for i in range(1, 8)] == [True, False, True, True, True, True, False]
    assert [got[i].cross_month_flag for i in range(1, 6)] == [True, True, False, False, True]


def test_digest_keeps_null_from_text(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), (None, "a")], "x string, y string")
    assert df.select(resolution.digest(["x", "y"]).alias("h")).distinct().count() == 2


def test_trend_and_temperature(spark):
    months = [dt.date(2024, m, 1) for m in range(1, 7)]
    data = [("up", m, 100 * 1.1**i, 50 + i) for i, m in enumerate(months)] + [("down", m, 100 * 0.9**i, 50 - i) for i, m in enumerate(months)] + [("flat", m, 100.0, 50) for m in months] + [(None, m, 100 * 1.01**i, 50) for i, m in enumerate(months)] + [("one", months[0], 5.0, 1)]
    df = spark.createDataFrame(data, "c string, m date, v double, n int")
    price = trends.log_trend(df, ["c"], "m", "v", "price")
    got = {r.c: r for r in price.collect()}
    assert got["up"].price_pct == pytest.approx(10) and got["up"].price_consistency == 1
    assert got["flat"].price_consistency == 0.5 and got["one"].price_pct is None and got[None].price_pct == pytest.approx(1)
    both = price.join(trends.log_trend(df, ["c"], "m", "n", "activity"), "c").withColumn("all", F.lit(1))
    t = {r.c: r for r in trends.temperature(both, ["all"]).collect()}
    assert (t["up"].label, t["down"].label, t["up"].place) == ("HOT", "NEUTRAL", 1) and 0 < t["down"].evidence <= 1


def test_statistics_against_known_values(spark):
    assert statistics.t_tail(2.0, 10) == pytest.approx(0.07338803477074, abs=1e-12)
    assert statistics.t_tail(0.0, 5) == pytest.approx(1.0)
    assert statistics.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert statistics.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-10)
    assert statistics.normal_tail(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 2.0, 4.0)] + [("b", v) for v in (2.0, 5.0, 6.0)] + [("b", None), (None, 3.0)], "g string, v double")
    m = statistics.mann_whitney(df, "g", "v", "a", "b").first()
    assert (m.n_a, m.n_b, m.u) == (4, 3, 2.0)
    w = statistics.welch(df, "g", "v", "a", "b").first()
    assert w.difference == pytest.approx(2.25 - 13 / 3)
    same = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "g string, v double")
    assert statistics.welch(same, "g", "v", "a", "b").first().t is None


def test_benjamini_hochberg(spark):
    p = [0.0001, 0.0002, 0.014, 0.038, 0.116, 0.954, None]
    got = {r.p: r.q_value for r in statistics.benjamini_hochberg(spark.createDataFrame([(x,) for x in p], "p double"), "p").collect()}
    assert [got[x] < 0.05 for x in p[:6]] == [True, True, True, False, False, False] and got[None] is None
    assert got[0.0002] == pytest.approx(0.0006) and got[0.954] == pytest.approx(0.954)


def test_lookup_matches_null_keys_and_falls_back(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 3.0), ("a", "y", 9.0), (None, "z", 5.0), (None, "z", 7.0)], "c string, n string, v double")
    got = {(r.c, r.n): (r.ref, r.ref_level) for r in lookup.fallback_reference(df, "v", [["c", "n"], ["c"], []], 2, "ref").collect()}
    assert got == {("a", "x"): (2.0, "c+n"), ("a", "y"): (3.0, "c"), (None, "z"): (6.0, "c+n")}


def test_polygon_with_hole_and_null_points(spark):
    shape = {"type": "FeatureCollection", "features": [{"geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [4, 0], [4, 4], [0, 4]], [[1, 1], [2, 1], [2, 2], [1, 2]]], [[[10, 10], [11, 10], [11, 11]]]]}}]}
    df = spark.createDataFrame([(0.5, 0.5), (1.5, 1.5), (10.9, 10.5), (20.0, 20.0), (None, 1.0)], "x double, y double")
    assert [r.i for r in spatial.within(df, "x", "y", shape, "i").collect()] == [True, False, True, False, None]
    assert [r.i for r in spatial.within(df, "x", "y", {"type": "Polygon", "coordinates": []}, "i").collect()] == [False] * 4 + [None]


def test_names_and_replay(spark):
    df = spark.createDataFrame([("Téhran City", "tehran"), ("Old Town of X", "x old town"), ("a", "b"), (None, "b")], "a string, b string")
    assert [r.x for r in df.select(spatial.names_agree(F.col("a"), F.col("b")).alias("x")).collect()] == [True, True, False, False]
    replies = spark.createDataFrame([("ok", True, True)] * 99 + [("ok", True, False)], "request_status string, country_match boolean, locality_match boolean")
    row = spatial.replay_summary(replies.withColumn("locality_match", F.lit(False))).first()
    assert (row.core_gate, row.status) == ("PASS", "REVIEW")


def test_checks_and_contracts(spark):
    checks = [quality.make_check("a", 1, 1, True), quality.make_check("b", 0, 1, False, critical=False), quality.make_check("c", 0, 1, False, review=True)]
    assert quality.overall(checks) == "REVIEW" and quality.overall(checks[:2]) == "PASS"
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, latitude string")
    status = {c.name: c.status for c in quality.contract_checks(df, "t", ["k", "v"], ["k"], ("latitude",))}
    assert status == {"t: columns": "FAIL", "t: forbidden columns": "FAIL", "t: rows": "PASS", "t: k given": "PASS", "t: grain": "FAIL"}
    assert rows(quality.missing_keys(df, "k", spark.range(1, 2), "id")) == [(2,)]
    assert quality.check_table(spark, checks).count() == 3


def test_profiles_and_dimensions(spark):
    df = spark.createDataFrame([("a", " "), ("a", "null"), ("b", "x"), (None, "x ")], "p string, q string")
    assert rows(profile.column_profile(df, ["p", "q"])) == [("p", 4, 1, 2), ("q", 4, 2, 1)]
    assert rows(profile.frequencies(df, "p", 1)) == [("a", 2, 1)]
    months = spark.createDataFrame([(dt.date(2024, 12, 1),), (dt.date(2024, 2, 1),), (None,), (dt.date(2024, 2, 1),)], "m date")
    assert [(r.month_key, r.quarter, r.chronological_sort) for r in marts.month_dimension(months, "m").orderBy("month_key").collect()] == [(202402, 1, 1), (202412, 4, 2)]
    places = spark.createDataFrame([("c-one", None)] * 101 + [("c-one", "n-a"), (None, "lost")], "c string, n string")
    assert [r.location_key for r in marts.location_dimension(places, "c", "n").orderBy("location_key").collect()] == ["CITY:c-one", "NATIONAL", "NEIGHBORHOOD:c-one:n-a"]
    assert math.isclose(len(marts.standardised(df, {"unit": "toman"}, ["unit", "version"]).columns), 4)


def test_percentiles_of_groups_equal_the_builtin_ones(spark):
    """Ties, negative and zero values, infinities, NULL and NaN values, NULL keys, one-row groups, a group with most rows, no rows."""
    import random

    from arzyab.operators.percentiles import group_percentiles

    r = random.Random(4)
    rows = [("hot", r.choice([r.lognormvariate(20, 2), 5.0, 0.0, -r.random() * 100, 1e-320, 1e300])) for _ in range(3000)] + [(None, 1.0), (None, 3.0), ("one", 7.5), ("nothing", None), ("nan", float("nan"))]
    df = spark.createDataFrame(rows + [("far", float("inf")), ("far", float("-inf")), ("far", 2.0)], "k string, v double").withColumn("bucket_", F.lit(1))
    wanted = {"p1": 0.01, "p25": 0.25, "median": 0.5, "p99": 0.99, "top": 1.0}
    given = df.where("v IS NOT NULL AND NOT isnan(v)")
    want = {x.k: x for x in given.where("k IS NULL OR k <> 'far'").groupBy("k").agg(F.count("v").alias("n"), *[F.percentile("v", q).alias(c) for c, q in wanted.items()]).collect()}
    got = {x.k: x for x in group_percentiles(df, ["k"], "v", wanted).collect()}
    assert set(got) == set(want) | {"far"} and got["far"].median == 2.0
    for k, x in want.items():
        assert x.n == got[k].n and all(abs(x[c] - got[k][c]) <= 1e-9 * max(1, abs(x[c])) for c in wanted), k
    whole = group_percentiles(given.where("k <> 'far'"), [], "v", {"m": 0.5}).first()
    assert whole.m == given.where("k <> 'far'").agg(F.percentile("v", 0.5)).first()[0]
    assert group_percentiles(df.limit(0), ["k"], "v", wanted).count() == 0
    assert {x.k for x in group_percentiles(df, ["k"], "v", wanted, least_rows=3).collect()} == {"hot", "far"}
