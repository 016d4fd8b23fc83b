"""Numeric semantics of the marts (PostgreSQL rules D6-D12)."""

from decimal import Decimal

from pyspark.sql import functions as F

from matchmart.functions import numeric as N


def _one(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_per_minute_rounds_half_up_and_exact(spark):
    # 3 s = 0.05 min exactly; 27 s = 0.45; 1 s = 0.0166.. → 0.02; 125 s → 2.08
    got = _one(spark, N.per_minute("x"), [(3,), (27,), (1,), (125,), (None,)], "x long")
    assert got == [Decimal("0.05"), Decimal("0.45"), Decimal("0.02"), Decimal("2.08"), None]


def test_whole_minutes_truncates(spark):
    got = _one(spark, N.whole_minutes("x"), [(125,), (59,), (60,), (-61,)], "x long")
    assert got == [2, 0, 1, -1]


def test_round2_of_double_uses_15_significant_digits(spark):
    # 0.125 exact; 2.675 is 2.67499999... as a double but 2.675 as numeric
    got = _one(spark, N.round2("x"), [(0.125,), (2.675,), (None,)], "x double")
    assert got == [Decimal("0.13"), Decimal("2.68"), None]


def test_avg2_is_exact_decimal(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (None,)], "x int")
    (v,) = df.agg(N.avg2("x")).first()
    assert v == Decimal("1.67")


def test_avg2_of_all_null_is_null(spark):
    df = spark.createDataFrame([(None,), (None,)], "x int")
    assert df.agg(N.avg2("x")).first()[0] is None


def test_pct2_multiplies_before_dividing_and_zero_gives_null(spark):
    df = spark.createDataFrame([(1, 3), (1, 8), (5, 0)], "n long, d long")
    got = [r[0] for r in df.select(N.pct2(F.col("n"), F.col("d"))).collect()]
    assert got == [Decimal("33.33"), Decimal("12.50"), None]


def test_bool_sum_and_cond_sum_null_rules(spark):
    df = spark.createDataFrame([(None,), (None,)], "b boolean")
    bsum, csum = df.agg(N.bool_sum("b"), N.cond_sum("b")).first()
    assert bsum is None and csum == 0


def test_bins_edges_and_null(spark):
    rows = [(900,), (901,), (1500,), (1501,), (3000,), (3001,), (None,)]
    got = _one(spark, N.duration_bin_small("d"), rows, "d long")
    assert got == ["<=15", "16-20", "21-25", "26-30", "46-50", "late(>50)", "late(>50)"]


def test_duration_category_uses_rounded_minutes(spark):
    # 1500 s = 25.00 → bin 1; 1501 s = 25.0166 → 25.02 → bin 2; NULL → last bin
    rows = [(1500,), (1501,), (None,)]
    got = _one(spark, N.duration_category(N.per_minute_hundredths("d")), rows, "d long")
    assert got == ["1 (<= 25)", "2 (26-30)", "7 (>50)"]


def test_per_minute_hundredths_equals_decimal_form(spark):
    vals = [0, 1, 2, 3, 27, 29, 30, 31, 125, 899, 900, 901, 59999, -1, -3, -31, 10**12 + 7,
            899_999_999_999_999, 900_000_000_000_001, None]
    df = spark.createDataFrame([(v,) for v in vals], "x long")
    rows = df.select(N.per_minute_hundredths("x").alias("h"),
                     N.per_minute_hundredths(F.col("x")).alias("hc"),
                     (N.per_minute("x") * 100).cast("long").alias("d"),
                     N.whole_minutes("x").alias("w")).collect()
    assert [r.h for r in rows] == [r.d for r in rows] == [r.hc for r in rows]
    assert [r.w for r in rows][:12] == [0, 0, 0, 0, 0, 0, 0, 0, 2, 14, 15, 15]
