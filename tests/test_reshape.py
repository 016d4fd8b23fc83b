"""Reshaping properties."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchmart.operators.reshape import cast_player_types, unpivot_items
from matchmart.schemas import ITEM_SLOTS

SCHEMA = "match_id long, player_slot int, " + ", ".join(f"{s} int" for s in ITEM_SLOTS)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 5), st.integers(0, 9),
                          *[st.one_of(st.none(), st.integers(0, 3)) for _ in ITEM_SLOTS]),
                min_size=1, max_size=15, unique_by=lambda r: (r[0], r[1])))
def test_unpivot_then_pivot_is_identity_up_to_zero(spark, rows):
    wide = spark.createDataFrame(rows, SCHEMA)
    long = unpivot_items(wide)
    assert long.count() == 6 * len(rows)
    back = (long.groupBy("match_id", "player_slot").pivot("item_slot", [str(k) for k in range(6)])
            .agg(F.first("item_id")))
    got = {(r[0], r[1]): tuple(r[2:]) for r in back.collect()}
    want = {(r[0], r[1]): tuple(None if v in (0, None) else v for v in r[2:]) for r in rows}
    assert got == want


def test_missing_win_stays_null(spark):
    df = spark.createDataFrame([(1, 0, 5, 1), (1, 1, None, None), (1, 2, 7, 0)],
                               "match_id long, player_slot int, steam_id long, win int")
    got = {r.player_slot: r.win for r in cast_player_types(df).collect()}
    assert got == {0: True, 1: None, 2: False}


def test_null_text_switch_changes_named_flag_only_for_missing_names(spark):
    from matchmart.operators.reshape import clean_players
    rows = [(1, 0, 7, None, 1), (1, 1, None, "B ", 1), (1, 2, 9, " C", 0)]
    df = spark.createDataFrame(rows, "match_id long, player_slot int, steam_id long, "
                                     "personaname string, win int")
    named = (F.col("steam_id").isNotNull() & F.col("personaname").isNotNull())

    def flags(null_text):
        out = clean_players(df, null_text).select("player_slot", named.alias("named"))
        return {r.player_slot: r.named for r in out.collect()}

    assert flags(None) == {0: False, 1: False, 2: True}
    assert flags("none") == {0: True, 1: False, 2: True}
