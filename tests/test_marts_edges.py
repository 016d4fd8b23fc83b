"""The six marts on a hand-made warehouse holding every edge row of the spec.

Edge rows: a match without players, a player without stat, a hero id with no
hero, a player whose match is missing, NULL radiant_win / region / duration,
an unmapped region, durations exactly on bin edges and one second over, ties
in team gold, NULL steam_id and NULL personaname. The same tables are read by
DuckDB running the oracle SQL bodies; results must be equal value for value.
"""

import math
import os

import duckdb
import pandas as pd
import pytest

from matchmart import oracle_sql as O
from matchmart.plans import marts

MATCHES = [  # match_id, duration, first_blood_time, radiant_win, region
    (1, 900, 100, True, 3), (2, 901, 200, False, 5), (3, 1500, None, None, None),
    (4, None, 50, True, 1), (5, 3001, 30, False, 1), (6, 2400, 10, True, 3),
    (8, 1501, 75, False, 38),
]
PLAYERS = [  # match_id, slot, steam_id, personaname, hero_id, is_radiant, win
    (1, 1, 11, "a", 1, True, True), (1, 2, None, "b", 2, True, True),
    (1, 3, 13, None, 99, False, False), (1, 4, 14, "d", 1, False, False),
    (2, 1, 21, "e", 2, True, False), (2, 2, 22, "f", 3, False, True),
    (3, 1, 31, "g", 1, True, None),
    (5, 1, 51, "h", 2, True, False), (5, 2, 52, "i", 3, False, True),
    (6, 1, 61, "j", 1, True, True), (6, 2, 62, "k", 2, False, False),
    (7, 1, 71, "l", 3, True, True), (8, 1, None, None, 1, True, False),
]
STATS = [  # match_id, slot, kills, deaths, assists, denies, last_hits, gpm, xpm, hd, hh, td
    (1, 1, 5, 1, 2, 3, 40, 500, 600, 12345, 0, 61), (1, 2, 1, 4, 7, 0, 10, 300, 350, 3000, 999, 0),
    (1, 3, 0, 9, 1, 1, 20, 250, 260, 1500, 30, 7), (1, 4, 3, 3, 3, 3, 30, 400, 410, 9000, 0, 120),
    (2, 1, 2, 2, 2, 2, 25, 350, 300, 4000, 10, 15), (2, 2, 7, 1, 9, 4, 80, 650, 700, 20000, 0, 3000),
    (5, 1, 4, 5, 6, 1, 50, 400, 450, 8000, 100, 200), (5, 2, 6, 2, 8, 2, 60, 400, 500, 9500, 0, 2),
    (6, 1, 9, 0, 4, 5, 90, 700, 800, 25000, 0, 4000), (6, 2, 1, 8, 2, 0, 15, 280, 300, 2500, 1, 0),
    (7, 1, 2, 2, 2, 2, 20, 300, 300, 3000, 0, 0), (8, 1, 3, 1, 1, 1, 33, 333, 333, 3333, 33, 33),
]
HEROES = [(1, "alpha"), (2, "beta"), (3, "gamma")]

SCHEMAS = {
    "matches": "match_id long, duration long, first_blood_time long, radiant_win boolean, "
               "region int",
    "players": "match_id long, player_slot int, steam_id long, personaname string, "
               "hero_id long, is_radiant boolean, win boolean",
    "players_stat": "match_id long, player_slot int, kills int, deaths int, assists int, "
                    "denies int, last_hits int, gold_per_min int, xp_per_min int, "
                    "hero_damage long, hero_healing long, tower_damage long",
    "heroes": "hero_id long, localized_name string",
}
DATA = {"matches": MATCHES, "players": PLAYERS, "players_stat": STATS, "heroes": HEROES}


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("edge"))
    con = duckdb.connect()
    dfs = {}
    for name, rows in DATA.items():
        path = os.path.join(root, name)
        spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1).write.parquet(path)
        dfs[name] = spark.read.parquet(path)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return dfs, con


def _norm(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    return v.item() if hasattr(v, "item") else v


def _rows(records):
    return sorted((tuple(_norm(v) for v in r) for r in records), key=repr)


MARTS = {
    "radiant_win_by_duration": lambda t: marts.radiant_win_by_duration(t["matches"]),
    "regions_stat": lambda t: marts.regions_stat(t["matches"]),
    "win_factors": lambda t: marts.win_factors(t["matches"], t["players"], t["players_stat"]),
    "heroes_stat": lambda t: marts.heroes_stat(t["matches"], t["players"], t["heroes"]),
    "gmp_winrate": lambda t: marts.gmp_winrate(t["matches"], t["players"], t["players_stat"],
                                               partitions=3),
    "unknown_players": lambda t: marts.unknown_players(t["matches"], t["players"],
                                                       t["players_stat"]),
}


@pytest.mark.parametrize("name", list(MARTS))
def test_mart_equals_sql_on_edge_rows(fixture, name):
    dfs, con = fixture
    got = MARTS[name](dfs)
    cols = sorted(got.columns)
    oracle = con.execute(O.MART_BODIES[name]).df()
    assert sorted(oracle.columns) == cols
    want = _rows(oracle[cols].astype(object).itertuples(index=False, name=None))
    have = _rows(tuple(r[c] for c in cols) for r in got.collect())
    assert have == want


def test_heroes_stat_null_hero_ranks_first(fixture):
    dfs, _ = fixture
    rows = MARTS["heroes_stat"](dfs).collect()
    first = rows[0]
    assert first.localized_name is None and first.pickup_rate is None
    assert first.rank_pickup_rate == 1
    assert first.winrate_best_flag == "0" and first.pickup_worst_flag == "0"


def test_match_without_players_forms_null_win_group(fixture):
    dfs, _ = fixture
    wf = {r.win: r for r in MARTS["win_factors"](dfs).collect()}
    assert None in wf and wf[None].first_blood_time_mean == round(50 / 60, 2)


def test_shared_fact_refresh_equals_standalone_marts(spark, fixture, tmp_path):
    from matchmart.plans.refresh import mart_builders
    dfs, _ = fixture
    builders = mart_builders(spark, dfs, str(tmp_path / "facts"))
    for name in ("win_factors", "gmp_winrate", "unknown_players"):
        a = builders[name]()
        b = MARTS[name](dfs)
        cols = sorted(b.columns)
        assert sorted(a.columns) == cols
        assert _rows(tuple(r[c] for c in cols) for r in a.collect()) == \
            _rows(tuple(r[c] for c in cols) for r in b.collect())


def test_incremental_regions_state_equals_full(spark, fixture, tmp_path):
    from pyspark.sql import functions as F

    from matchmart.plans import incremental
    dfs, _ = fixture
    m = dfs["matches"]
    root = str(tmp_path / "state")
    incremental.add_batch(spark, root, m.where(F.col("match_id") <= 3))
    incremental.add_batch(spark, root, m.where(F.col("match_id") > 3))
    a = incremental.regions_stat_from_state(incremental.current_state(spark, root))
    b = marts.regions_stat(m)
    cols = sorted(b.columns)
    assert _rows(tuple(r[c] for c in cols) for r in a.collect()) == \
        _rows(tuple(r[c] for c in cols) for r in b.collect())
    mart = "radiant_win_by_duration"
    incremental.add_batch(spark, root, m.where(F.col("match_id") <= 3), mart)
    incremental.add_batch(spark, root, m.where(F.col("match_id") > 3), mart)
    a = incremental.mart_from_state(spark, root, mart)
    b = marts.radiant_win_by_duration(m)
    cols = sorted(b.columns)
    assert _rows(tuple(r[c] for c in cols) for r in a.collect()) == \
        _rows(tuple(r[c] for c in cols) for r in b.collect())


def test_marts_on_empty_tables(spark, tmp_path):
    empty = {n: spark.createDataFrame([], SCHEMAS[n]) for n in SCHEMAS}
    for name, build in MARTS.items():
        assert build(empty).count() == 0, name
