"""Idempotent load, FK filter, batch ETL rerun and crash repair."""

import os

from pyspark.sql import Observation
from pyspark.sql import functions as F

from matchmart.operators.load import insert_ignore, read_table
from matchmart.plans import etl
from matchmart.sources import jsonl
from matchmart.sources.roles import warehouse
from matchmart.operators.reshape import players_wide_from_tables

from conftest import SF_SMALL


def _lines(spark):
    w = warehouse(spark, SF_SMALL)
    pw = players_wide_from_tables(w.players, w.players_stat, w.player_items_wide)
    return jsonl.documents_from_tables(w.matches, pw)


def test_insert_ignore_twice_equals_once(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    path = os.path.join(tmp_dir, "t")
    assert insert_ignore(spark, df, path, ["k"]).first()["inserted"] == 2
    assert insert_ignore(spark, df, path, ["k"]).first()["inserted"] == 0
    more = spark.createDataFrame([(2, "z"), (3, "d")], "k long, v string")
    assert insert_ignore(spark, more, path, ["k"]).first()["inserted"] == 1
    got = sorted(tuple(r) for r in read_table(spark, path).collect())
    assert got == [(1, "a"), (2, "c"), (3, "d")]


def test_batch_load_rerun_adds_nothing_and_fk_holds(spark, tmp_dir):
    root = os.path.join(tmp_dir, "wh")
    s1 = {r["table"]: r["inserted"] for r in etl.load_batch(spark, _lines(spark), root).collect()}
    s2 = {r["table"]: r["inserted"] for r in etl.load_batch(spark, _lines(spark), root).collect()}
    assert all(v > 0 for v in s1.values()) and all(v == 0 for v in s2.values())
    t = etl.warehouse_tables(spark, root)
    orphans = t["matches"].join(t["players"].select("match_id").distinct(), "match_id",
                                "left_anti")
    assert orphans.count() == 0
    assert t["players_items"].count() == 6 * t["players"].count()
    assert t["players_items"].where(F.col("item_id") == 0).count() == 0


def test_crash_between_tables_is_repaired(spark, tmp_dir):
    """A run that stopped after the child tables: the rerun completes matches only."""
    root = os.path.join(tmp_dir, "wh")
    clean = os.path.join(tmp_dir, "clean")
    docs_path = os.path.join(tmp_dir, "docs")
    parsed = jsonl.parse_lines(_lines(spark))
    jsonl.dedup_batch(parsed).select("match_key", "doc").write.parquet(docs_path)
    tables = etl.build_tables(spark.read.parquet(docs_path))
    for name in ("players_stat", "players_items", "players"):      # "crash" before matches
        insert_ignore(spark, tables[name], f"{root}/{name}", etl.KEYS[name], bucket_of="match_id")
    status = {r["table"]: r["inserted"] for r in etl.load_batch(spark, _lines(spark), root)
              .collect()}
    assert status["players"] == 0 and status["matches"] > 0
    etl.load_batch(spark, _lines(spark), clean).collect()
    for name in etl.LOAD_ORDER:
        a = read_table(spark, f"{root}/{name}")
        b = read_table(spark, f"{clean}/{name}")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_bucketed_load_prunes_target_partitions(spark, tmp_dir):
    path = os.path.join(tmp_dir, "tb")
    first = spark.range(0, 1000).selectExpr("id AS match_id", "CAST(id % 7 AS STRING) AS v")
    assert insert_ignore(spark, first, path, ["match_id"], "match_id", 100).first()[1] == 1000
    batch = spark.range(950, 1050).selectExpr("id AS match_id", "'new' AS v")
    assert insert_ignore(spark, batch, path, ["match_id"], "match_id", 100).first()[1] == 50
    got = read_table(spark, path)
    assert got.count() == 1050 and got.select("match_id").distinct().count() == 1050
    assert sorted(got.columns) == ["match_id", "v"]
    # the target scan only reads the batch's buckets, also with a late id far from the others
    from matchmart.operators.load import BUCKET_COL, key_bucket, new_rows
    late = batch.union(spark.range(1).selectExpr("-950 AS match_id", "'late' AS v"))
    late = late.union(spark.createDataFrame([(250, "late")], "match_id long, v string"))
    b = late.withColumn(BUCKET_COL, key_bucket("match_id", 100))
    rows = new_rows(b, spark.read.parquet(path), ["match_id"], bucketed=True)
    assert rows.count() == 1
    plan = rows._jdf.queryExecution()
    scan = [ln for ln in plan.executedPlan().toString().splitlines() if "FileScan" in ln and "PartitionFilters" in ln][0]
    assert "dynamicpruning" in scan
    seen = Observation()
    spark.read.parquet(path).join(F.broadcast(b.select(BUCKET_COL).where(F.col(BUCKET_COL) > -99).distinct()),
                                  BUCKET_COL, "left_semi").observe(seen, F.count(F.lit(1)).alias("n")).count()
    assert seen.get["n"] == 250                        # buckets 2, 9 and 10 of eleven


def test_dimension_cleaning_and_load(spark, tmp_dir):
    import json

    from pyspark.sql import types as T

    from matchmart.schemas import HERO_LIST_ITEM
    from matchmart.sources import files
    from matchmart.sources.roles import load_tables

    item_value = T.StructType([T.StructField(c, T.StringType()) for c in
                               ["id", "cost", "bkbpierce", "hint", "mc", "cd", "charges"]])
    items_doc = json.dumps({
        "Blink": {"id": "1", "cost": "2250", "bkbpierce": "yes", "hint": "['x']", "mc": "False",
                  "cd": "15.0", "charges": "0.5"},
        "tango ": {"id": "44", "cost": "90", "bkbpierce": "no", "hint": " [] "},
    })
    items = files.json_map_rows(spark.createDataFrame([(items_doc,)], "value string"), item_value)
    heroes_doc = json.dumps([{"id": 1, "localized_name": " Anti-Mage ", "roles": [" Carry "]}])
    heroes = files.json_array_rows(spark.createDataFrame([(heroes_doc,)], "value string"),
                                   HERO_LIST_ITEM)
    root = os.path.join(tmp_dir, "wh")
    st = {r["table"]: r["inserted"] for r in
          etl.load_dimensions(spark, root, heroes, items).collect()}
    assert st == {"heroes": 1, "items": 2}
    assert etl.load_dimensions(spark, root, heroes, items).where("inserted > 0").count() == 0
    t = load_tables(spark, root, ("heroes", "items"))
    it = {r.item_key: r for r in t["items"].collect()}
    assert it["blink"].item_id == 1 and it["blink"].cost == 2250 and it["blink"].bkbpierce
    assert it["blink"].mc is None and it["blink"].cd == 15 and it["blink"].charges is None
    assert it["tango"].hint is None and it["tango"].bkbpierce is False
    h = t["heroes"].first()
    assert h.hero_id == 1 and h.localized_name == "anti-mage" and h.roles == ["carry"]


def test_known_match_keys(spark, tmp_dir):
    root = os.path.join(tmp_dir, "wh")
    assert etl.known_match_keys(spark, root).count() == 0
    etl.load_batch(spark, _lines(spark), root).collect()
    assert etl.known_match_keys(spark, root).count() == read_table(
        spark, f"{root}/matches").count()


def test_run_daily_end_to_end(spark, tmp_dir):
    from matchmart.plans import publish
    from matchmart.sources.roles import warehouse as lazy_warehouse

    landing, root, marts_root = (os.path.join(tmp_dir, x) for x in ("land", "wh", "marts"))
    jsonl.land(_lines(spark), landing)
    heroes = lazy_warehouse(spark, SF_SMALL).heroes
    insert_ignore(spark, heroes, f"{root}/heroes", ["hero_id"]).collect()
    st = {r["step"]: (r["rows"], r["status"]) for r in
          etl.run_daily(spark, landing, root, marts_root).collect()}
    assert st["matches"][0] > 0 and st["players"][0] > 0
    assert all(st[m][1] == "refreshed" for m in ("win_factors", "heroes_stat", "gmp_winrate"))
    assert publish.current(spark, marts_root, "unknown_players").count() == st["unknown_players"][0]
    again = {r["step"]: r["rows"] for r in etl.run_daily(spark, landing, root, marts_root)
             .collect() if r["status"] == "loaded"}
    assert set(again.values()) == {0}


def test_rejects_are_not_duplicated_on_retry(spark, tmp_dir):
    lines = spark.createDataFrame([("{bad",), ("",), ('{"match_id": 5, "players": []}',)],
                                  "value string")
    root = os.path.join(tmp_dir, "wh")
    etl.load_batch(spark, lines, root).collect()
    etl.load_batch(spark, lines, root).collect()
    rej = read_table(spark, f"{root}/_rejects")
    assert sorted(r.reject for r in rej.collect()) == ["blank", "unparsable_or_no_match_id"]
