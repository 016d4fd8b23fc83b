"""Disk and memory: what is written, shuffled and landed grows with what a query needs."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from matchmart import catalog, session, storage
from matchmart.operators import dedup
from matchmart.operators.load import insert_ignore, new_rows
from matchmart.operators.reshape import players_wide_from_tables
from matchmart.plans import etl
from matchmart.schemas import KEYS, STAT_COLUMNS
from matchmart.session import sized_for
from matchmart.sources import jsonl, roles
from matchmart.sources.roles import stored_warehouse, warehouse


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_warehouse_tables_are_written_when_asked_for(spark):
    w = stored_warehouse(spark, SF_SMALL, force=True)
    assert w.matches.count() > 0
    root = os.path.dirname(w.matches.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0])
    assert sorted(n for n in os.listdir(root) if not n.startswith("_")) == ["matches"]
    lazy = warehouse(spark, SF_SMALL)
    for name in ("players_stat", "player_items_wide"):
        got, want = getattr(w, name), getattr(lazy, name)
        assert got.schema == want.schema and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


LINES = [("b", '{"match_id":1,"duration":5}'), ("a", '{"match_id":1,"duration":9}'),
         ("a", '{"match_id":1,"duration":10,"players":[]}'), ("b", '{"match_id":2,"duration":"7"}'),
         ("b", '{"match_id":2,"duration":"7"}'), (None, '{"match_id":2,"duration":1}'), (None, '{"match_id":3}'),
         ("a", '{"match_id":4,"radiant_win":1}'), ("b", "junk")]


def test_fields_of_the_first_line_without_shuffling_lines(spark):
    lines = spark.createDataFrame(LINES, "source_file string, value string")
    parsed = jsonl.parse_lines(lines)
    want = jsonl.project_matches(jsonl.dedup_batch(parsed))
    docs = jsonl.dedup_batch(parsed, fields=jsonl.MATCH_FIELDS)
    assert "value" not in docs.columns
    got = jsonl.project_matches(docs)
    assert got.schema.names == want.schema.names
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert {r.match_id: r.duration for r in got.collect()} == {1: 10, 2: 7, 3: None, 4: None}
    single = jsonl.dedup_batch(jsonl.parse_lines(lines.where("source_file = 'b'")), fields=jsonl.MATCH_FIELDS)
    assert "Exchange" not in _plan(single)


@pytest.mark.parametrize("many", [500_000, 1, 0])
def test_known_ids_and_duplicates_by_any_way(spark, tmp_dir, monkeypatch, many):
    monkeypatch.setattr(jsonl, "MANY_KEYS", many)
    monkeypatch.setattr(dedup, "MANY_KEYS", many)
    spark.createDataFrame(LINES, "source_file string, value string").write.parquet(f"{tmp_dir}/lines")
    parsed = jsonl.parse_lines(spark.read.parquet(f"{tmp_dir}/lines"))
    for known in ([], [9], [1, 2], [1, 2, 3, 4]):
        keys = spark.createDataFrame([(k,) for k in known], "match_id long")
        want = jsonl.dedup_batch(parsed, keys).select("match_key", "source_file", "value")
        got = jsonl.dedup_batch(parsed, keys, stored=True).select("match_key", "source_file", "value")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_rows_without_duplicates_are_not_shuffled(spark, tmp_dir):
    spark.range(50).selectExpr("id AS k", "'x' AS v").write.parquet(f"{tmp_dir}/rows")
    stored = spark.read.parquet(f"{tmp_dir}/rows")
    one = dedup.first_per_stored_key(stored, ["k"])
    assert one.count() == 50 and "Exchange" not in _plan(one)
    assert "Exchange" not in _plan(new_rows(stored, None, ["k"], unique=True))


def test_landed_files_are_compressed(spark, tmp_dir):
    lines = spark.createDataFrame([('{"match_id":1}', "2020-01-01")], "value string, day string")
    jsonl.land(lines, f"{tmp_dir}/plain")
    jsonl.land(lines, f"{tmp_dir}/dated", "day")
    for name in ("plain", "dated"):
        back = jsonl.read_lines(spark, f"{tmp_dir}/{name}").collect()
        assert [r.value for r in back] == ['{"match_id":1}'] and back[0].source_file.endswith(".gz")


def test_sizes_are_set_for_the_jobs_within_only(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")
    before = [spark.conf.get(n) for n in names]
    with sized_for(spark, [SF_SMALL], target_partition_bytes=1024):
        assert int(spark.conf.get(names[0])) > int(before[0])
        assert int(spark.conf.get(names[1])) == 16 << 20
    assert [spark.conf.get(n) for n in names] == before


def test_partitions_are_put_together_to_a_split_at_most(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    with sized_for(spark, [SF_SMALL]):
        assert int(spark.conf.get(name)) == 16 << 20
    assert spark.conf.get(name) == before


def test_documents_are_assembled_by_match_alone(spark):
    rows = "match_id long, player_slot int, steam_id long, personaname string, hero_id long, is_radiant boolean, win boolean"
    players = spark.createDataFrame([(1, 0, 5, "a", 2, True, True), (1, 1, 6, "b", 3, True, True),
                                     (None, 0, 7, "c", 4, True, True)], rows)
    stat = spark.createDataFrame([(1, 0, *range(10)), (None, 0, *range(10)), (1, None, *range(10))],
                                 ", ".join(f"{c} {'long' if c == 'match_id' else 'int'}" for c in STAT_COLUMNS))
    items = spark.createDataFrame([(1, 1, *range(6))], "match_id long, player_slot int, " + ", ".join(
        f"item_{k} int" for k in range(6)))
    matches = spark.createDataFrame([(1, 60, 1, True, 1)], "match_id long, duration long, first_blood_time long, "
                                    "radiant_win boolean, region long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = players_wide_from_tables(players, stat, items)
        plan = _plan(jsonl.documents_from_tables(matches, wide))
        got = {(r.match_id, r.player_slot): (r.kills, r.item_5) for r in wide.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning(") == 4 and "player_slot" not in "".join(
        line for line in plan.splitlines() if "Exchange hashpartitioning(" in line)
    assert got == {(1, 0): (0, None), (1, 1): (None, 5), (None, 0): (None, None)}


def _odd_lines(spark, d):
    """Line items with repeated and NULL keys, a supplier that comes twice and one that is missing."""
    rows = [(o, o and o * 7 + n, s, n, float(n), 1000.0 + n, 0.1, 0.02, "NAR"[n % 3], "FO"[n % 2], None)
            for o in (1, 2, 3, None) for n in (1, 2, 3) for s in (10, 11, 12)]
    names = ["l_orderkey long", "l_partkey long", "l_suppkey long", "l_linenumber int", "l_quantity double",
             "l_extendedprice double", "l_discount double", "l_tax double", "l_returnflag string",
             "l_linestatus string", "l_shipdate timestamp"]
    spark.createDataFrame(rows + rows[:5], ", ".join(names)).write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(10, "a"), (10, "b"), (11, "c")], "s_suppkey long, s_name string").write.parquet(
        f"{d}/supplier.parquet")


def test_players_by_match_are_the_same_rows(spark, tmp_dir):
    _odd_lines(spark, tmp_dir)
    lines, supplier = roles.line_one(spark, tmp_dir), roles.table(spark, tmp_dir, "supplier")
    want = players_wide_from_tables(roles.players_from_lines(lines, supplier), roles.stat_from_lines(lines),
                                    roles.items_wide_from_lines(lines))
    got = players_wide_from_tables(*stored_warehouse(spark, tmp_dir).players_by_match)
    assert got.schema.names == want.schema.names and got.count() > 0
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_raw_documents_deal_the_matches_only(spark):
    """Line items are stored by match: neither the players' tables nor the lists of a match are dealt."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(catalog._raw_lines(spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning(") == 1


def test_land_raw_appends_the_batch_twice_and_stores_no_other_copy(spark, monkeypatch):
    landed, staged = [], []
    land, written = jsonl.land, session.written
    monkeypatch.setattr(jsonl, "land", lambda lines, path: (land(lines, path), landed.append(path)))
    for module in (catalog, jsonl):
        monkeypatch.setattr(module, "written", lambda df, name: (staged.append(name), written(df, name))[1])
    matches = catalog.QUERIES["land_raw"](spark, SF_SMALL)
    assert len(landed) == 2 and len(set(landed)) == 1 and "raw-lines" not in staged
    copies = jsonl.read_lines(spark, landed[0]).groupBy("value").count().select("count").distinct().collect()
    assert [r[0] for r in copies] == [2]
    want = stored_warehouse(spark, SF_SMALL).matches.count()
    assert matches.count() == want == matches.select("match_id").distinct().count()


def test_a_load_broadcasts_no_ids_that_only_their_files_make_small(spark, tmp_dir, monkeypatch):
    """Ids in order take less than the limit in a file, many times it in the driver."""
    monkeypatch.setattr(jsonl, "MANY_KEYS", 10)
    ids, root = spark.range(400_000).withColumnRenamed("id", "match_id"), f"{tmp_dir}/wh"
    insert_ignore(spark, ids, f"{root}/matches", KEYS["matches"], bucket_of="match_id", unique=True)
    ids.select(F.concat(F.lit('{"match_id":'), "match_id", F.lit("}")).alias("value"),
               F.lit("a").alias("source_file")).write.parquet(f"{tmp_dir}/lines")
    limits = {"spark.sql.autoBroadcastJoinThreshold": "2m", "spark.sql.maxBroadcastTableSize": "8m"}
    before = {n: spark.conf.get(n) for n in limits}
    for n, limit in limits.items():
        spark.conf.set(n, limit)
    try:
        status = etl.load_batch(spark, spark.read.parquet(f"{tmp_dir}/lines"), root).collect()
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "2m"
        assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None
    finally:
        for n, limit in before.items():
            spark.conf.set(n, limit)
    assert {r.table: r.inserted for r in status} == dict.fromkeys(etl.LOAD_ORDER, 0)


def test_documents_are_staged_only_where_lines_fell_away(spark, tmp_dir):
    def line(i):
        return (f'{{"match_id": {i}, "duration": 60, "players": [{{"player_slot": 0}}]}}', "a")

    def load(rows, name):
        etl.load_batch(spark, spark.createDataFrame(rows, "value string, source_file string"),
                       f"{tmp_dir}/wh", f"{tmp_dir}/{name}").collect()
        return storage.exists(spark, f"{tmp_dir}/{name}/docs")

    assert not load([line(1), line(2)], "new")
    assert load([line(2), line(3)], "known") and load([line(4), line(4)], "twice")
    assert sorted(r.match_id for r in etl.warehouse_tables(spark, f"{tmp_dir}/wh")["matches"].collect()) == [1, 2, 3, 4]
    assert etl.warehouse_tables(spark, f"{tmp_dir}/wh")["players"].count() == 4
