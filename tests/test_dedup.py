"""Keep-first dedup equals row_number() = 1 over the same total order."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchmart.operators.dedup import duplicate_keys, first_per_key, first_per_stored_key


def test_first_per_key_equals_row_number(spark):
    rows = [(1, 1, "b", 2.0), (1, 1, "a", 9.0), (1, 2, "z", 1.0), (2, 1, "a", 1.0),
            (2, 1, "a", 0.5), (3, 3, None, 1.0)]
    df = spark.createDataFrame(rows, "k1 int, k2 int, s string, x double")
    got = sorted(first_per_key(df, ["k1", "k2"], ["s", "x"]).collect())
    w = Window.partitionBy("k1", "k2").orderBy(F.col("s").asc_nulls_last(), "x")
    want = sorted(df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
                  .collect())
    assert got == want
    assert first_per_key(df, ["k1", "k2"]).columns == df.columns


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "a int, b int")
    assert [tuple(r) for r in duplicate_keys(df, ["a", "b"]).collect()] == [(1, 1, 2)]


def test_first_per_key_sorts_nulls_last_like_sql(spark):
    import duckdb
    import pandas as pd

    rows = [(1, None, 5.0), (1, "a", 7.0), (2, None, 1.0), (2, None, None), (3, "b", None),
            (3, "b", 2.0)]
    df = spark.createDataFrame(rows, "k int, s string, x double")
    got = sorted(tuple(r) for r in first_per_key(df, ["k"], ["s", "x"]).collect())
    pdf = pd.DataFrame(rows, columns=["k", "s", "x"])
    want = duckdb.sql("""SELECT k, s, x FROM (SELECT *, row_number() OVER (PARTITION BY k
                         ORDER BY s, x) AS rn FROM pdf) WHERE rn = 1""").fetchall()
    norm = lambda r: tuple(None if (isinstance(v, float) and v != v) else v for v in r)
    assert got == sorted(norm(r) for r in want)


def test_stored_rows_give_the_same_and_single_keys_are_not_sorted(spark, tmp_dir):
    rows = [(i % 50 if i % 10 else None, i % 3, f"t{i % 7}" if i % 4 else None, float(i)) for i in range(400)]
    rows += [(1000 + i, 0, "single", 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, l int, s string, x double")
    df.write.parquet(f"{tmp_dir}/t")
    stored = spark.read.parquet(f"{tmp_dir}/t")
    for keys, order in ((["k", "l"], None), (["k"], ["s", "x"]), (["l", "k"], ["x"])):
        want = first_per_key(df, keys, order)
        got = first_per_stored_key(stored, keys, order)
        assert got.columns == want.columns
        assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)
    keys_only = first_per_stored_key(stored, ["k", "l"]).select("k", "l")
    plan = keys_only._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[k#" in plan and "BroadcastHashJoin" in plan
    single = plan[plan.index("LeftAnti"):plan.index("LeftSemi")]
    assert "Sort" not in single
    scans = [ln for ln in plan.splitlines() if "ReadSchema" in ln]
    assert sum("x:double" not in ln for ln in scans) >= 2
    assert first_per_stored_key(stored.where("false"), ["k"]).count() == 0
