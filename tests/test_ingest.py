"""Tolerant JSONL ingest with the edge rows of the feed."""

import json
import os

import pytest

from matchmart.sources import jsonl


def _player(slot, **kw):
    p = {"player_slot": slot, "account_id": 100 + slot, "personaname": f" Name{slot} ",
         "hero_id": slot, "win": 1, "isRadiant": slot < 128, "kills": 3, "item_0": 0,
         "item_1": 5}
    p.update(kw)
    return p


EDGE_LINES = [
    json.dumps({"match_id": 1, "duration": 1500, "radiant_win": True, "region": 3,
                "players": [_player(0), _player(128, win=0)]}),
    "",                                     # blank
    "   ",                                  # blank with spaces
    "{not json",                            # unparsable
    "[1]",                                  # not an object
    json.dumps({"duration": 5}),            # missing match_id
    json.dumps({"match_id": None}),         # null match_id
    json.dumps({"match_id": "abc"}),        # non-numeric id
    json.dumps({"match_id": "3", "duration": 60, "players": []}),   # id as text, empty list
    json.dumps({"match_id": 1, "duration": 9999}),                   # same id again
    json.dumps({"match_id": 4, "duration": 61}),                     # players missing
    json.dumps({"match_id": 5, "duration": 62, "players": None}),    # players null
    json.dumps({"match_id": 6, "duration": 63, "players": [_player(1)]}),  # known id
]


@pytest.fixture()
def landing(tmp_dir):
    path = os.path.join(tmp_dir, "landing")
    os.makedirs(path)
    with open(os.path.join(path, "matches_raw_day1.jsonl"), "w") as f:
        f.write("\n".join(EDGE_LINES) + "\n")
    return path


def test_tolerant_reader_skips_bad_lines_and_dedups(spark, landing):
    parsed = jsonl.parse_lines(jsonl.read_lines(spark, landing))
    reasons = sorted(r.reject for r in jsonl.rejects(parsed).collect())
    assert reasons == ["bad_match_id", "blank", "blank", "not_an_object",
                       "unparsable_or_no_match_id", "unparsable_or_no_match_id",
                       "unparsable_or_no_match_id"]
    known = spark.createDataFrame([(6,)], "match_id long")
    docs = jsonl.dedup_batch(parsed, known)
    m = {r.match_id: r for r in jsonl.project_matches(docs).collect()}
    assert sorted(m) == [1, 3, 4, 5]
    # "first" of the two id-1 lines is the smaller line text (a total order)
    first = min(EDGE_LINES[0], EDGE_LINES[9])
    assert m[1].duration == json.loads(first)["duration"]
    assert m[3].radiant_win is None and m[3].region is None


def test_explode_players_missing_null_empty_give_no_rows(spark, landing):
    docs = jsonl.dedup_batch(jsonl.parse_lines(jsonl.read_lines(spark, landing)))
    p = jsonl.explode_players(docs)
    keys = sorted((r.match_id, r.player_slot) for r in p.collect())
    assert keys == [(1, 0), (1, 128), (6, 1)]
    row = p.where("match_id = 1 AND player_slot = 0").first()
    assert row.steam_id == 100 and row.is_radiant is True and row.item_0 == 0
    assert row.assists is None            # field absent in the document → NULL


def test_strict_reader_fails_on_bad_line(spark, landing):
    parsed = jsonl.parse_lines(jsonl.read_lines(spark, landing), strict=True)
    with pytest.raises(Exception):
        parsed.select("doc").collect()


def test_documents_roundtrip(spark, tmp_dir):
    m = spark.createDataFrame([(1, 100, 5, True, 3), (2, 200, 6, None, None)],
                              "match_id long, duration long, first_blood_time long, "
                              "radiant_win boolean, region int")
    pw = spark.createDataFrame(
        [(1, 0, 7, "a", 1, 2, 3, 4, 5, 0, 1, 2, 3, 4, 5, 9, 8, True, 1, 6, 7, 8, 9)],
        "match_id long, player_slot int, steam_id long, personaname string, assists int, "
        "deaths int, denies int, gold_per_min int, hero_id int, item_0 int, item_1 int, "
        "item_2 int, item_3 int, item_4 int, item_5 int, kills int, xp_per_min int, "
        "is_radiant boolean, win int, last_hits int, hero_damage long, hero_healing long, "
        "tower_damage long")
    path = os.path.join(tmp_dir, "land")
    jsonl.land(jsonl.documents_from_tables(m, pw), path)
    docs = jsonl.read_raw_matches(spark, path)
    assert sorted(r.match_id for r in jsonl.project_matches(docs).collect()) == [1, 2]
    back = jsonl.explode_players(docs).first().asDict()
    assert back == pw.first().asDict()


def _lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_strict_reader_raises_on_each_kind_of_bad_line_and_keeps_missing_ids(spark):
    good = jsonl.parse_lines(_lines(spark, '{"match_id":1}', " ", '{"duration":3}'), strict=True)
    assert sorted((r.match_key or 0, r.doc.duration or 0) for r in jsonl.accepted(good).collect()) == [(0, 3), (1, 0)]
    for bad in ("garbage", "[1", "[1]", '{"match_id":9} junk', "{not json"):
        with pytest.raises(Exception, match="not one JSON object"):
            jsonl.accepted(jsonl.parse_lines(_lines(spark, '{"match_id":1}', bad), strict=True)).count()


def test_ids_and_lines_that_are_good_all_the_same(spark):
    parsed = jsonl.parse_lines(_lines(
        spark, '\t{"match_id":1}\u00a0', '{"match_id":3.0}', '{"match_id":" 4 "}', '{"match_id":9} junk',
        '{"match_id":3.7}', '{"match_id":true}', '{"match_id":5},{"match_id":6}', '{"match_id":9007199254740993}'))
    assert sorted(r.match_key for r in jsonl.accepted(parsed).collect()) == [1, 3, 4, 9007199254740993]
    assert sorted(r.reject for r in jsonl.rejects(parsed).collect()) == [
        "bad_match_id", "bad_match_id", "unparsable_or_no_match_id", "unparsable_or_no_match_id"]


def test_scalars_of_another_type_are_cast_or_reported(spark):
    parsed = jsonl.parse_lines(_lines(
        spark, '{"match_id":1,"duration":"1500","first_blood_time":12.0,"radiant_win":1,"players":'
        '[{"player_slot":"0","hero_id":"5","win":true,"hero_damage":3.0,"kills":"many","isRadiant":"false"}]}',
        '{"match_id":2,"duration":1.5}'))
    docs = jsonl.dedup_batch(parsed)
    m = {r.match_id: r for r in jsonl.project_matches(docs).collect()}
    assert (m[1].duration, m[1].first_blood_time, m[1].radiant_win, m[2].duration) == (1500, 12, True, None)
    p = jsonl.explode_players(docs).first()
    assert (p.player_slot, p.hero_id, p.win, p.hero_damage, p.kills, p.is_radiant) == (0, 5, 1, 3, None, False)
    assert {r.field: r["values"] for r in jsonl.lost_values(parsed).collect()} == {"duration": 1, "players[].kills": 1}


def test_regular_and_odd_lines_give_the_same_values(spark):
    """A line with one odd scalar goes the text way; its other fields are as in a regular one."""
    plain = json.loads(EDGE_LINES[0])
    odd = json.loads(EDGE_LINES[0])
    odd["match_id"], odd["duration"], odd["players"][1]["kills"], odd["players"][0]["personaname"] = 2, "1500", 3.0, 7
    docs = jsonl.dedup_batch(jsonl.parse_lines(_lines(spark, json.dumps(plain), json.dumps(odd))))
    for form in (docs, jsonl.typed_documents(docs), docs.drop("value")):
        m = {r.match_id: r for r in jsonl.project_matches(form).collect()}
        assert m[1][1:] == m[2][1:] == (1500, None, True, 3)
        p = {(r.match_id, r.player_slot): r for r in jsonl.explode_players(form).collect()}
        assert p[1, 128][1:] == p[2, 128][1:] and (p[1, 0].personaname, p[2, 0].personaname) == (" Name0 ", "7")
        assert p[1, 0].is_radiant is True and p[1, 0].kills == p[2, 0].kills == 3
