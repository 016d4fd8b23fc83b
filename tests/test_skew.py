"""Hot keys: one key or group holding a third of all rows."""

from pyspark.sql import functions as F

from matchmart.operators.dedup import first_per_key
from matchmart.operators.joins import left_join_children
from matchmart.operators.quantiles import metric_stats


def _hot(spark, n=6000):
    # every third child row belongs to parent 0
    return spark.range(0, n).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS match_id", "id AS slot", "id % 5 AS v")


def test_left_join_children_equals_left_join_on_hot_key(spark):
    parents = spark.range(0, 8000).selectExpr("id AS match_id", "id * 2 AS d")
    child = _hot(spark)
    got = left_join_children(parents, child, "match_id")
    want = parents.join(child, "match_id", "left")
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert want.select(*cols).exceptAll(got.select(*cols)).count() == 0
    assert got.where("match_id = 0").count() == 2000


def test_first_per_key_hot_duplicates(spark):
    dup = spark.range(0, 9000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS k",
                                          "9000 - id AS v")
    one = first_per_key(dup, ["k"], ["v"])
    assert one.count() == dup.select("k").distinct().count()
    assert one.where("k = 1").first()["v"] == dup.where("k = 1").agg(F.min("v")).first()[0]


def test_metric_stats_hot_group_exact(spark):
    df = _hot(spark).selectExpr("match_id = 0 AS hot", "CAST(v AS INT) AS v")
    r = {x["hot"]: x for x in metric_stats(df, ["hot"], ["v"]).collect()}
    assert r[True]["rows"] == 2000 and r[False]["rows"] == 4000
    assert r[True]["v_p50"] == 2.0
