from pyspark.sql import functions as F

from arzyab.functions import columns as C
from arzyab.functions.text import fold, given


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("x")).first().x


def test_fold_unifies_alike_characters(spark):
    assert one(spark, fold, " ي\u200cك ٣٤\u00a0۵６ ") == "یک 3456".replace("3456", "34 56")
    assert one(spark, fold, "ﺱلام Ａb") == "سلام ab"
    assert one(spark, fold, None) is None


def test_given_knows_nothing_given(spark):
    for nothing in ("", "  ", "-", "؟", "NaN", "<null>", "N/A", "نامشخص", "ثبت\u200c نشده"):
        assert one(spark, given, nothing) is None, nothing
    for value in ("0", "همکف", "30+", "بدون اتاق"):
        assert one(spark, given, value) is not None


def test_numbers(spark):
    number = lambda c: C.numeric(c, "bigint")
    assert one(spark, number, "۱۲۳٬۴۵۶") == 123456
    assert one(spark, number, "١٢٣,٤٥٦") == 123456
    assert one(spark, number, None) is None
    assert one(spark, number, "12 m") is None
    assert one(spark, lambda c: C.numeric(c, "smallint"), "99999") is None


def test_three_valued_booleans(spark):
    assert [one(spark, C.boolean_text, v) for v in ("true", "FALSE", "unselect", None)] == [True, False, None, None]
    assert [one(spark, C.truthy, v) for v in ("Yes", "0", None)] == [True, False, False]


def test_dates_markers_keys(spark):
    assert str(one(spark, C.flexible_date, "2024-05-01 00:00:00")) == str(one(spark, C.flexible_date, "2024-05-01")) == "2024-05-01"
    assert one(spark, C.flexible_date, "soon") is None
    assert one(spark, lambda c: C.capped_integer(c, "30+", 30), "30+") == 30
    assert one(spark, C.month_key, "2024-05-01") == 202405
    assert one(spark, lambda c: C.location_key(F.lit("city"), c, F.lit(None)), "a") == "CITY:a"
    assert one(spark, lambda c: C.location_key(F.lit("neighborhood"), c, F.lit(None)), "a") is None


def test_columns_that_may_be_absent(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    row = df.select(C.first_existing(df, ["zz", "b", "a"]).alias("x"), C.first_existing(df, ["zz"]).alias("y"), C.joined_key(["a", "b"]).alias("k")).first()
    assert (row.x, row.y, row.k) == ("1", None, "1|__ALL__")


def test_parse_errors_count_only_given_texts(spark):
    df = spark.createDataFrame([("x", None), ("5", "unselect"), (None, "maybe")], "a string, b string")
    errors = C.parse_errors([("a", C.numeric(F.col("a"), "int"), ()), ("b", C.boolean_text(F.col("b")), ("unselect",))])
    assert [r.n for r in df.select(errors.alias("n")).collect()] == [1, 0, 1]
