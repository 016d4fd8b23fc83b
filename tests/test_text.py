"""Text cleaning and coercion."""

from matchmart.functions.lookup import region_name
from matchmart.functions.text import coerce_int, normalize_text, null_if_empty_list, parse_bool


def test_normalize_text_unicode_strip_and_nulls(spark):
    df = spark.createDataFrame([(" Ab\t", 1), (" X ", 2), (None, 3)], "s string, n int")
    assert [r.s for r in normalize_text(df).collect()] == ["ab", "x", None]
    assert [r.s for r in normalize_text(df, null_text="none").collect()] == ["ab", "x", "none"]
    assert normalize_text(df).schema == df.schema


def test_coerce_int(spark):
    df = spark.createDataFrame([("3",), ("3.0",), ("0.5",), ("False",), ("abc",), (None,)],
                               "s string")
    assert [r[0] for r in df.select(coerce_int("s")).collect()] == [3, 3, None, None, None, None]


def test_parse_bool(spark):
    df = spark.createDataFrame([("Yes",), ("no",), ("TRUE",), ("nan",), (None,)], "s string")
    assert [r[0] for r in df.select(parse_bool("s")).collect()] == [True, False, True, None, None]


def test_null_if_empty_list(spark):
    df = spark.createDataFrame([("[]",), (" [] ",), ("[1]",), (None,)], "s string")
    assert [r[0] for r in df.select(null_if_empty_list("s")).collect()] == [None, None, "[1]",
                                                                            None]


def test_region_lookup_unknown_and_null(spark):
    df = spark.createDataFrame([(1,), (5,), (38,), (None,)], "r long")
    got = [r[0] for r in df.select(region_name("r")).collect()]
    assert got == ["US West (Seattle)", "Unknown", "US East 2", "Unknown"]


def test_large_integers_are_exact(spark):
    from matchmart.functions.text import coerce_int
    df = spark.createDataFrame([("9007199254740993",), ("3.0",), ("0.5",), ("x",)], "t string")
    assert [r[0] for r in df.select(coerce_int("t")).collect()] == [9007199254740993, 3, None, None]
