"""Problems 1, 4 and 6: true cases, nulls, ties, empty tables, repeated rows, extra columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arzyab.operators import impute, missing, skew, units
from arzyab.plans import problems


def test_statistics_equal_a_plain_grouping(spark):
    rows = [("a", None if i % 7 == 0 else i) for i in range(400)] + [("b", 5), (None, 1), (None, None)]
    df = spark.createDataFrame(rows, "k string, v long").withColumn("row_count", F.lit(9))  # a clashing name
    got = {r.k: r for r in skew.key_statistics(df, ["k"], ["v"]).collect()}
    vs = [v for k, v in rows if k == "a" and v is not None]
    assert (got["a"].row_count, got["a"].v_count, got["a"].v_sum, got["a"].v_min, got["a"].v_max) == (400, len(vs), sum(vs), min(vs), max(vs))
    assert got[None].row_count == 2 and got["b"].v_mean == 5
    assert skew.key_statistics(df.limit(0), ["k"], ["v"]).count() == 0


def test_heavy_keys(spark):
    rows = [("a", "x")] * 40 + [("a", None)] * 30 + [("a", " - ")] * 20 + [("b", "x")] * 9 + [(None, "x")] * 1
    df = spark.createDataFrame(rows, "city string, part string")
    assert {tuple(r) for r in skew.heavy_keys(df, ["city", "part"], 0.1).collect()} == {("a", "x")}
    assert {tuple(r) for r in skew.heavy_keys(df, ["city", "part"], 0.09).collect()} == {("a", "x"), ("b", "x")}  # just the share
    assert skew.heavy_keys(df.limit(0), ["city", "part"], 0.1).count() == 0


def test_missing_fields(listings):
    full = {"cat3_slug": "apartment-sell", "city_slug": "c", "neighborhood_slug": "n", "construction_year": "قبل از ۱۳۷۰", "rooms_count": "بدون اتاق", "floor": "همکف"}
    rows = [
        {"source_row_id": 1, **full},
        {"source_row_id": 2, **full, "construction_year": "9999", "floor": "؟", "rooms_count": "unselect"},
        {"source_row_id": 3, **full, "cat3_slug": "plot-old", "construction_year": None, "floor": None, "rooms_count": None},
        {"source_row_id": 4, **full, "cat3_slug": None, "floor": None, "city_slug": None, "neighborhood_slug": None},
        {"source_row_id": 5, **full, "cat3_slug": "shop-rent", "rooms_count": None, "neighborhood_slug": "null", "floor": "30+"},
        {"source_row_id": 6, **full, "construction_year": "0000"},
    ]
    got = {tuple(r) for r in missing.missing_fields(listings(rows, ["field_name"])).collect()}
    assert got == {(2, "construction_year"), (2, "floor"), (2, "rooms_count"), (5, "neighborhood_slug"), (6, "construction_year")}
    assert missing.missing_fields(listings([])).count() == 0


def test_mixture_fills_what_belongs_together(listings):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        old = i % 2 == 0
        rows.append({"source_row_id": i, "cat3_slug": "apartment-sell", "city_slug": "c", "neighborhood_slug": "old-town" if old else "new-town", "construction_year": str(int(rng.normal(1372 if old else 1400, 1))), "rooms_count": "یک" if old else "سه", "floor": "1" if old else "9", "building_size": str(50 if old else 150)})
    for i in range(0, 600, 20):
        rows[i] |= {"construction_year": None, "neighborhood_slug": "-"}
        rows[i + 1] |= {"rooms_count": "نامشخص", "floor": None}
    got = {r.source_row_id: r for r in impute.fill_missing(listings(rows), classes=3, rounds=8).collect()}
    assert len(got) == 600
    for i in range(0, 600, 20):
        assert got[i].construction_year_filled and abs(int(got[i].construction_year) - 1372) <= 3
        assert got[i].neighborhood_slug_filled and got[i].neighborhood_slug == "old-town"
        assert got[i + 1].rooms_count == "سه" and got[i + 1].floor == "9" and got[i + 1].floor_filled
    assert got[2].construction_year == rows[2]["construction_year"] and not got[2].construction_year_filled


@pytest.fixture
def models(monkeypatch):
    """The models that are fitted while a test runs."""
    made, fit = [], impute.fit_mixture
    monkeypatch.setattr(impute, "fit_mixture", lambda *a, **k: made.append(fit(*a, **k)) or made[-1])
    return made


def test_found_fields_are_those_the_converged_mixture_fills(spark, small, models):
    found = problems.p4_found(spark, small)
    (model,) = models
    steps = np.diff(model.loglik) / np.abs(model.loglik[:-1])
    assert abs(steps[-1]) <= 1e-4 and len(model.loglik) > 10
    for city in model.levels["city"]:  # a place says no more than where in its city
        own = [i for p, i in model.levels["place"].items() if p.startswith(f"{city}|")]
        assert not own or np.allclose(np.exp(model.logp["place"][:, own]).sum(axis=1), 1)
    want = missing.missing_fields(spark.read.parquet(f"{small}/listings.parquet"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) != []


def test_sizes_and_places_that_are_no_numbers_leave_the_mixture_finite(listings, models):
    full = {"cat3_slug": "apartment-sell", "city_slug": "c", "neighborhood_slug": "n", "construction_year": "1390", "rooms_count": "یک", "floor": "1"}
    rows = [{"source_row_id": i, **full, "building_size": s, "location_latitude": s, "location_longitude": s} for i, s in enumerate(["70", "80", "Infinity", "-Infinity", "NaN", "x"])]
    got = impute.fill_missing(listings([*rows, {"source_row_id": 9, **full, "neighborhood_slug": None, "location_latitude": "70"}]), classes=2)
    assert {r.neighborhood_slug for r in got.collect()} == {"n"} and np.isfinite(models[0].mean).all()


def test_filling_empty_and_hopeless_tables(listings):
    assert impute.fill_missing(listings([]), classes=2, rounds=2).count() == 0
    row = impute.fill_missing(listings([{"source_row_id": 1, "cat3_slug": "apartment-sell", "city_slug": "c"}]), classes=2, rounds=2).first()
    assert row.neighborhood_slug is None and row.neighborhood_slug_filled and row.floor is None and row.floor_filled


def brute_changepoints(x, penalty):
    """All segmentations of a short series."""
    n, best = len(x), (np.inf, None)
    for mask in range(1 << (n - 1)):
        cuts = [0, *[i + 1 for i in range(n - 1) if mask >> i & 1], n]
        cost = sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip(cuts, cuts[1:])) + penalty * (len(cuts) - 2)
        if cost < best[0] - 1e-12:
            best = (cost, cuts[:-1])
    return best


@pytest.mark.parametrize("seed", range(6))
def test_changepoints_are_exact(seed):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.normal(0, 3, 4), 3) + rng.normal(0, 0.5, 12)
    starts = units.changepoints(np.ones(12), x, x * x, 1.5)
    cuts = [*starts, 12]
    cost = sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip(cuts, cuts[1:])) + 1.5 * (len(starts) - 1)
    assert cost == pytest.approx(brute_changepoints(x, 1.5)[0], abs=1e-9)


CASES = [
    ("price_value", "2,600,000,000", "", 2_600_000_000, False), ("price_value", "۶٫۳۴", "اعداد فیلد قیمت میلیارد تومان هستند", 6_340_000_000, True),
    ("price_value", "۹۷۰ م.ت", "", 970_000_000, True), ("price_value", "IRR 9,000,000,000", "", 900_000_000, True),
    ("price_value", "3 میلیارد و 200 میلیون تومان", "", 3_200_000_000, True), ("price_value", "4.5B", "", 4_500_000_000, True),
    ("price_value", "٩٠٠٠٠٠٠٠٠٠تومان", "همه مبالغ این آگهی به ریال است", 9_000_000_000, False), ("price_value", "5000", "وام 224 میلیون تومانی", 5000, False),
    ("price_value", "2,660,000,000", "طراحی با متریال Premium تاپا با قیمت کارشناسی روز", 2_660_000_000, False), ("price_value", "0", "prices are in million toman", 0, False),
    ("rent_value", "73,800,000 تومان در سال", "", 6_150_000, True), ("rent_value", "57.6M per year", "", 4_800_000, True), ("credit_value", "327000k", "", 327_000_000, True),
    ("rent_value", "12.5", "amounts entered in million toman", 12_500_000, True), ("credit_value", "100000000", "all amounts above are in rials", 10_000_000, True),
]


def test_units(listings):
    rows = [{"source_row_id": i, "cat3_slug": "apartment-sell", "created_at_month": "2024-05-01", f: v, "description": d, "building_size": "100"} for i, (f, v, d, _, _) in enumerate(CASES)]
    df = listings(rows + [{"source_row_id": 99, "price_value": "توافقی"}, {"source_row_id": 100}], ["wording", "unit"])
    got = {r.source_row_id: r for r in units.marked_amounts(df).collect()}
    for i, (f, v, d, toman, _) in enumerate(CASES):
        assert got[i].toman == toman, (v, d, got[i])
    assert {r.source_row_id for r in units.not_plain(df).collect()} == {i for i, c in enumerate(CASES) if c[4]}
    assert units.in_toman(df).count() == len(CASES) + 2
    assert 99 not in got and units.not_plain(df.limit(0)).count() == 0


def test_shift_gives_the_unit_of_an_unknown_wording(listings):
    rows = [{"source_row_id": i, "cat3_slug": "apartment-sell", "price_value": str(2_000_000_000 + i * 1_000_000), "building_size": "100"} for i in range(300)]
    rows += [{"source_row_id": 1000 + i, "cat3_slug": "apartment-sell", "price_value": f"{2000 + i} zz", "building_size": "100"} for i in range(60)]
    got = {r.source_row_id: r for r in units.marked_amounts(listings(rows)).collect()}
    assert got[1005].toman == 2_005_000_000 and got[1005].decided == "shift" and got[5].toman == 2_005_000_000


def test_a_silent_change_of_unit_is_reversed(listings):
    """Bare numbers of one source that are ten times as large from some month on."""
    rows = [{"source_row_id": 100 * m + i, "price_value": str((2000 + i) * 1_000_000 * (10 if m > 6 else 1)), "cat3_slug": "apartment-sell", "created_at_month": f"2024-{m:02d}-01", "building_size": "100"} for m in range(1, 11) for i in range(12)]
    got = units.marked_amounts(listings(rows)).collect()
    assert {(r.unit, r.decided) for r in got if r.source_row_id >= 700} == {(1.0, "shift")} and {r.unit for r in got if r.source_row_id < 700} == {0.0}
    assert {r.toman for r in got if r.source_row_id % 100 == 3} == {2_003_000_000}


def test_shift_and_wording(listings):
    """The shift decides without named units; the wording breaks ties, and holds against a thin segment but not against a thick one."""
    plain = [{"source_row_id": i, "rent_value": str(10_000_000 + i), "cat3_slug": "apartment-rent", "created_at_month": "2024-01-01", "building_size": "100"} for i in range(60)]
    said = lambda at, n, text, value: [{"source_row_id": at + i, "rent_value": text.format(value + i), "cat3_slug": "apartment-rent", "created_at_month": "2024-01-01", "building_size": "100"} for i in range(n)]
    df = listings(plain + said(1000, 10, "{} ریال", 100_000_000) + said(2000, 10, "{} سالانه", 120_000_000) + said(3000, 8, "{} میلیون", 10_000_000) + said(4000, 40, "{} هزار", 10_000_000))
    got = {r.source_row_id: r for r in units.marked_amounts(df).collect()}
    assert got[1000].unit == 1 and got[1000].decided == "tie" and abs(got[2000].unit - units.YEAR) < 1e-9 and got[2000].toman == 10_000_000
    assert got[3000].unit == -6 and got[3000].decided == "wording" and got[4000].unit == 0 and got[4000].decided == "shift"
    blind = {r.source_row_id: r for r in units.marked_amounts(df, use_wording=False).collect()}
    assert abs(blind[1000].unit - 1) < 0.1 and abs(blind[2000].unit - 1) < 0.1 and blind[3000].unit == 0


def test_remarks(spark):
    cases = [
        ("مبلغ وام به تومان است. همه مبالغ این آگهی به ریال است.", 1.0), ("همه مبالغ به میلیون تومان", -6.0), ("figures in millions", -6.0), ("مبلغ اجاره سالانه است", units.YEAR),
        ("مبلغ وام ۲۰۰ میلیون تومان", None), ("loan amounts are in rials", None), (None, None), ("", None), ("نور " * 20_000 + "ارقام به ریال", 1.0),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.u for r in df.select("i", units.named_unit(units.remark(F.col("t")), F.lit(True)).alias("u")).collect()}
    for i, (text, want) in enumerate(cases):
        assert (got[i] is None and want is None) or abs(got[i] - want) < 1e-9, (text, got[i])
