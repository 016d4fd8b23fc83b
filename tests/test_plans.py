"""Physical-plan properties that matter at scale."""

import re

from matchmart.operators.load import by_match
from matchmart.plans import marts
from matchmart.sources import jsonl
from matchmart.sources.roles import stored_warehouse

from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_line_is_parsed_once_for_its_key_and_once_for_its_fields(spark):
    """One parse for the key, one into types, and one as text that only odd lines reach."""
    lines = spark.createDataFrame([('{"match_id": 1, "players": [{"player_slot": 0}]}',)], "value string")
    parsed = jsonl.parse_lines(lines)
    docs = jsonl.dedup_batch(parsed)
    for df in (jsonl.project_matches(jsonl.accepted(parsed)), jsonl.project_matches(docs), jsonl.explode_players(docs)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 3 and plan.count("CASE WHEN isnotnull(_plain") >= 1
    # a rejects report needs no fields at all
    assert jsonl.rejects(parsed)._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_mart_scans_read_only_used_columns(spark):
    w = stored_warehouse(spark, SF_SMALL)
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = _plan(marts.unknown_players(w.matches, w.players, w.players_stat))
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    cols = set()
    for s in schemas:
        cols |= {f.split(":")[0] for f in s.split(",")}
    assert "hero_id" not in cols and "is_radiant" not in cols and "last_hits" not in cols
    assert {"steam_id", "personaname", "duration", "hero_damage"} <= cols


def test_team_totals_aggregate_before_joining_matches(spark):
    w = stored_warehouse(spark, SF_SMALL)
    p = _plan(marts.team_stats(w.matches, w.players, w.players_stat))
    join_at = p.find("Join [match_id")
    assert join_at >= 0
    # the per-(match, side) sum sits below the join with matches
    assert "sum(coalesce(gold_per_min" in p[join_at:].lower()


def test_size_shuffle_partitions(spark):
    from matchmart.session import input_bytes, size_shuffle_partitions
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        paths = [f"{SF_SMALL}/lineitem.parquet", f"{SF_SMALL}/orders.parquet"]
        assert input_bytes(spark, paths) > 0
        assert size_shuffle_partitions(spark, paths) == 8          # tiny input: the floor
        n = size_shuffle_partitions(spark, paths, target_partition_bytes=10_000)
        assert n > 8 and spark.conf.get("spark.sql.shuffle.partitions") == str(n)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def _exchanges(df) -> list[str]:
    return [ln.strip(" +-:*()0123456789") for ln in _plan(df).splitlines() if "Exchange hashpartitioning" in ln]


def test_player_tables_are_dealt_once_by_match(spark, tmp_dir):
    """Plain files are dealt by match, once each; stored side by side they are not dealt at all."""
    w = stored_warehouse(spark, SF_SMALL)
    names = ("matches", "players", "players_stat")
    for name in names:
        getattr(w, name).write.parquet(f"{tmp_dir}/{name}")
    plain = [spark.read.parquet(f"{tmp_dir}/{name}") for name in names]
    stored = [by_match(getattr(w, name), f"{tmp_dir}/bucketed/{name}", 4) for name in names]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for make in (marts.match_player_facts, marts.team_stats):
            assert len(_exchanges(make(*plain))) == 3 and _exchanges(make(*stored)) == []
        for mart in (marts.win_factors, marts.unknown_players):
            # what is left deals histograms, by group, metric and value
            assert all("metric" in e or "match_id" not in e for e in _exchanges(mart(*stored)))
            assert sorted(map(repr, mart(*stored).collect())) == sorted(map(repr, mart(*plain).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
