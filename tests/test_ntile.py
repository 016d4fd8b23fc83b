"""Distributed NTILE equals Spark's single-partition NTILE."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from matchmart.operators.ntile import cut_ranks, ntile


@settings(max_examples=10, deadline=None)
@given(st.lists(st.none() | st.integers(0, 5), min_size=1, max_size=60), st.integers(1, 12),
       st.integers(1, 5))
def test_ntile_matches_window(spark, values, n, parts):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k long, v long")
    order = [F.col("v").asc_nulls_last(), F.col("k")]
    got = {r.k: r.t for r in ntile(df, n, ["v", "k"], "t", partitions=parts).collect()}
    want = {r.k: r.t for r in df.select("k", F.ntile(n).over(Window.orderBy(*order)).alias("t"))
            .collect()}
    assert got == want


def test_ntile_with_hot_value(spark):
    # a third of the rows share one value; the tie-break key spreads them
    df = spark.range(0, 3000).selectExpr("id AS k", "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS v")
    order = [F.col("v"), F.col("k")]
    got = ntile(df, 10, ["v", "k"], "t", partitions=6)
    want = df.select("k", F.ntile(10).over(Window.orderBy(*order)).alias("w"))
    bad = got.join(want, "k").where(F.col("t") != F.col("w")).count()
    assert bad == 0


def test_cut_ranks():
    assert cut_ranks(10, 3) == [4, 7]
    assert cut_ranks(2, 5) == [1]
    assert cut_ranks(0, 4) == cut_ranks(1, 4) == []


def test_empty_input_odd_types_and_one_column(spark):
    empty = spark.createDataFrame([], "k long, v double")
    assert ntile(empty, 4, ["v", "k"]).collect() == []
    rows = [(i, v) for i, v in enumerate(["b", None, "a'", "", "é", "b"])]
    df = spark.createDataFrame(rows, "k long, v string")
    got = {r.k: r.tile for r in ntile(df, 3, ["v", "k"]).collect()}
    assert got == {3: 1, 2: 1, 0: 2, 5: 2, 4: 3, 1: 3}
    one = ntile(spark.range(9), 3, ["id"], "t").collect()
    assert {r.id: r.t for r in one} == {i: i // 3 + 1 for i in range(9)}


def test_rows_are_neither_moved_nor_copied(spark):
    df = spark.range(0, 3000).selectExpr("id AS k", "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS v")
    plan = ntile(df, 10, ["v", "k"], "t")._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Exchange", "Sort", "Join", "RDDScan", "Window"))
