"""Registry of named queries: ``name -> (spark, sf_dir) -> DataFrame`` plus oracle SQL.

Each query reads the driver's test tables through the role views
(``sources.roles``), so its work grows with the tables, and each has an
oracle text (``oracle_sql`` plus the SQL next to each query) restating its
semantics for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchmart import oracle_sql as O
from matchmart.functions.lookup import region_name
from matchmart.functions.numeric import (
    avg2, bool_int, bool_sum, cond_sum, duration_bin_small, duration_category, from_hundredths,
    minutes_double, pct2, per_minute, per_minute_hundredths, round2, to_out, whole_minutes,
)
from matchmart.functions.text import coerce_int, normalize_text, null_if_empty_list
from matchmart.operators import integrity
from matchmart.operators.dedup import distinct_rows, duplicate_keys, first_per_stored_key
from matchmart.operators.joins import join_dim, left_join_children
from matchmart.operators.load import insert_ignore, read_table
from matchmart.operators.ntile import ntile
from matchmart.operators.quantiles import (
    grouped_quantiles, merge_histograms, quantile_from_histogram, scalar_quantile,
    value_histogram,
)
from matchmart.operators.reshape import (
    cast_player_types, clean_items, clean_players, players_wide_from_tables, rename_keys, split_players,
    split_stat, unpivot_items,
)
from matchmart.plans import etl, marts, publish
from matchmart.schemas import HERO_FRACTIONS, HERO_LIST_ITEM, HERO_NUMBERS, ITEM_MAP_VALUE, KEYS
from matchmart.session import scratch_path, sized_for, written
from matchmart.sources import files, jsonl
from matchmart.sources.roles import LINE_ORDER, SOURCES, table
from matchmart.sources.roles import stored_warehouse as warehouse

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


# --------------------------------------------------------------------------- marts

@register("radiant_win_by_duration", O.MARTS["radiant_win_by_duration"])
def q_radiant_win_by_duration(spark, d):
    return marts.radiant_win_by_duration(warehouse(spark, d).matches)


@register("regions_stat", O.MARTS["regions_stat"])
def q_regions_stat(spark, d):
    return marts.regions_stat(warehouse(spark, d).matches)


@register("win_factors", O.MARTS["win_factors"])
def q_win_factors(spark, d):
    w = warehouse(spark, d)
    return marts.win_factors(w.matches, w.players, w.players_stat)


@register("heroes_stat", O.MARTS["heroes_stat"])
def q_heroes_stat(spark, d):
    w = warehouse(spark, d)
    return marts.heroes_stat(w.matches, w.players, w.heroes)


@register("gmp_winrate", O.MARTS["gmp_winrate"])
def q_gmp_winrate(spark, d):
    w = warehouse(spark, d)
    return marts.gmp_winrate(w.matches, w.players, w.players_stat)


@register("unknown_players", O.MARTS["unknown_players"])
def q_unknown_players(spark, d):
    w = warehouse(spark, d)
    return marts.unknown_players(w.matches, w.players, w.players_stat)


# =========================================================================== operators
# Single-operator queries over the role views. Engine side: DataFrame API;
# oracle side: SQL over the same role views.


W = O.with_roles
pm, r2, avg2_sql, pct2_sql, med = O.pm, O.r2, O.avg2, O.pct2, O.med


def _wide(w):
    return players_wide_from_tables(w.players, w.players_stat, w.player_items_wide)


def _stored_wide(spark, d):
    wide = _wide(warehouse(spark, d))
    with sized_for(spark, _given(d)):
        return written(wide, "players-wide")


def _given(d):
    return [f"{d.rstrip('/')}/{t}.parquet" for t in SOURCES]


def _raw_lines(spark, d):
    w = warehouse(spark, d)
    return jsonl.documents_from_tables(w.matches, players_wide_from_tables(*w.players_by_match))


_LANDED: dict[tuple[str, ...], str] = {}


def _landing(spark, d):
    """The raw feed for ``d``: one JSON document per match, landed once per
    application as text files under the checkpoint dir (the production input
    of the ingest path is a landing folder, not a query) for as long as the
    given files stay as they are."""
    from matchmart.operators.load import table_exists
    from matchmart.session import files_stamp
    key = (spark.sparkContext.applicationId, d, files_stamp(spark, _given(d)))
    path = _LANDED.get(key)
    if path is None or not table_exists(spark, f"{path}/_SUCCESS"):
        path = scratch_path(spark, "landing")
        lines = _raw_lines(spark, d)
        with sized_for(spark, _given(d)):
            jsonl.land(lines, path)
        _LANDED[key] = path
    return path


def _landed_lines(spark, d):
    return jsonl.read_lines(spark, _landing(spark, d))


def _docs(spark, d, strict=False, fields=None):
    return jsonl.dedup_batch(jsonl.parse_lines(_landed_lines(spark, d), strict), stored=fields is None, fields=fields)


_MATCH_SQL = """SELECT match_id, duration, first_blood_time, radiant_win,
       CAST(region AS BIGINT) AS region FROM matches"""

_WIDE_SQL = """SELECT p.match_id, p.player_slot, p.steam_id, p.personaname, s.assists, s.deaths,
       s.denies, s.gold_per_min, CAST(p.hero_id AS INT) AS hero_id,
       i.item_0, i.item_1, i.item_2, i.item_3, i.item_4, i.item_5, s.kills, s.xp_per_min,
       p.is_radiant, CAST(p.win AS INT) AS win, s.last_hits, s.hero_damage, s.hero_healing,
       s.tower_damage
FROM players p
LEFT JOIN players_stat s ON p.match_id = s.match_id AND p.player_slot = s.player_slot
LEFT JOIN player_items_wide i ON p.match_id = i.match_id AND p.player_slot = i.player_slot"""


# --------------------------------------------------------------------------- ingest

@register("ingest_jsonl", W(["matches"], _MATCH_SQL))
def q_ingest_jsonl(spark, d):
    """Tolerant JSONL parse, batch key dedup, match projection."""
    return jsonl.project_matches(_docs(spark, d, fields=jsonl.MATCH_FIELDS))


@register("ingest_jsonl_strict", W(["matches"], _MATCH_SQL))
def q_ingest_jsonl_strict(spark, d):
    """Fail-fast parse of the same documents."""
    return jsonl.project_matches(_docs(spark, d, strict=True, fields=jsonl.MATCH_FIELDS))


@register("project_match", W(["matches"], _MATCH_SQL))
def q_project_match(spark, d):
    """Nested-document projection without the batch dedup."""
    parsed = jsonl.accepted(jsonl.parse_lines(_landed_lines(spark, d)))
    return jsonl.project_matches(parsed)


@register("explode_players", W(["matches", "players", "players_stat", "player_items_wide"],
                               _WIDE_SQL + "\nWHERE p.match_id IN (SELECT match_id FROM matches)"))
def q_explode_players(spark, d):
    """One row per player from the nested list, with renames."""
    return jsonl.explode_players(_docs(spark, d))


@register("split_players", W(["players"], """
SELECT match_id, player_slot, steam_id, lower(trim(personaname)) AS personaname,
       CAST(hero_id AS INT) AS hero_id, is_radiant, win
FROM players"""))
def q_split_players(spark, d):
    """Clean the flattened frame and keep the players columns."""
    return split_players(clean_players(_stored_wide(spark, d)))


@register("split_stat", W(["players", "players_stat"], """
SELECT p.match_id, p.player_slot, s.kills, s.deaths, s.assists, s.denies, s.last_hits,
       s.gold_per_min, s.xp_per_min, s.hero_damage, s.hero_healing, s.tower_damage
FROM players p
LEFT JOIN players_stat s ON p.match_id = s.match_id AND p.player_slot = s.player_slot"""))
def q_split_stat(spark, d):
    """Statistics columns of the flattened frame."""
    return split_stat(clean_players(_stored_wide(spark, d)))


_ITEMS_SQL = " UNION ALL ".join(
    f"SELECT i.match_id, i.player_slot, '{k}' AS item_slot, nullif(i.item_{k}, 0) AS item_id "
    f"FROM player_items_wide i JOIN players p "
    f"ON p.match_id = i.match_id AND p.player_slot = i.player_slot"
    for k in range(6))


@register("unpivot_items", W(["players", "player_items_wide"], _ITEMS_SQL))
def q_unpivot_items(spark, d):
    """item_0..5 → (item_slot, item_id), 0 → NULL."""
    return unpivot_items(clean_players(_stored_wide(spark, d)))


@register("rename_keys", W(["heroes"], "SELECT hero_id, localized_name FROM heroes"))
def q_rename_keys(spark, d):
    """The hero list's ``id`` becomes the key ``hero_id``."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"),
                                         F.col("n_name").alias("localized_name"))
    return rename_keys(n, {"id": "hero_id"})


@register("null_if_empty_list", W(["matches", "players"], """
SELECT m.match_id,
       CASE WHEN count(p.hero_id) FILTER (WHERE p.win) = 0 THEN NULL
            ELSE CAST(to_json(list_sort(list(p.hero_id) FILTER (WHERE p.win))) AS VARCHAR)
       END AS hint
FROM matches m LEFT JOIN players p ON m.match_id = p.match_id
GROUP BY m.match_id"""))
def q_null_if_empty_list(spark, d):
    """A JSON list column whose '[]' means "none" becomes NULL."""
    w = warehouse(spark, d)
    winners = (w.players.groupBy("match_id")
               .agg(F.to_json(F.sort_array(F.collect_list(F.when(F.col("win"), F.col("hero_id")))))
                    .alias("hint")))
    m = w.matches.select("match_id").join(winners, "match_id", "left")
    hint = F.coalesce(F.col("hint"), F.lit("[]"))
    return m.select("match_id", null_if_empty_list(hint).alias("hint"))


# --------------------------------------------------------------------------- filters / keys

@register("anti_known_keys", W(["players"], """
SELECT DISTINCT o_orderkey AS match_id FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM players p WHERE p.match_id = o.o_orderkey)"""))
def q_anti_known_keys(spark, d):
    """Page ids not yet known (anti join against loaded keys, batch dedup)."""
    w = warehouse(spark, d)
    page = table(spark, d, "orders").select(F.col("o_orderkey").alias("match_id")).distinct()
    return page.join(w.players.select("match_id").distinct(), "match_id", "left_anti")


@register("backlog_top_n", W(["players"], """
SELECT DISTINCT o_orderkey AS match_id FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM players p WHERE p.match_id = o.o_orderkey)
ORDER BY match_id DESC LIMIT 100"""))
def q_backlog_top_n(spark, d):
    """P10/O2: the next 100 ids to fetch, newest first (the limit is the feature)."""
    return q_anti_known_keys(spark, d).orderBy(F.col("match_id").desc()).limit(100)


@register("semi_matches_with_players", W(["matches", "players"], """
SELECT m.* FROM matches m
WHERE EXISTS (SELECT 1 FROM players p WHERE p.match_id = m.match_id)"""))
def q_semi(spark, d):
    """Keep matches that have players."""
    w = warehouse(spark, d)
    return integrity.with_children(w.matches, w.players, "match_id")


@register("known_keys", W(["matches"], "SELECT match_id FROM matches"))
def q_known_keys(spark, d):
    """Key scan of the matches table (only the key column is read)."""
    return warehouse(spark, d).matches.select("match_id")


@register("min_key", W(["matches"], "SELECT min(match_id) AS min_match_id FROM matches"))
def q_min_key(spark, d):
    """Smallest id (the paging cursor)."""
    return warehouse(spark, d).matches.agg(F.min("match_id").alias("min_match_id"))


# --------------------------------------------------------------------------- expressions

_BINS7_SQL = """CASE WHEN {x} <= 25 THEN '1 (<= 25)' WHEN {x} <= 30 THEN '2 (26-30)'
 WHEN {x} <= 35 THEN '3 (31-35)' WHEN {x} <= 40 THEN '4 (36-40)'
 WHEN {x} <= 45 THEN '5 (41-45)' WHEN {x} <= 50 THEN '6 (46-50)' ELSE '7 (>50)' END"""


@register("duration_bins7", W(["matches"], f"""
SELECT match_id, CAST(duration_min AS DOUBLE) AS duration_min,
       {_BINS7_SQL.format(x="duration_min")} AS duration_category
FROM (SELECT match_id, {pm("duration")} AS duration_min FROM matches) t"""))
def q_duration_bins7(spark, d):
    """7-bin scale over rounded minutes."""
    m = warehouse(spark, d).matches.select("match_id",
                                           per_minute_hundredths("duration").alias("dm"))
    return m.select("match_id", from_hundredths("dm").alias("duration_min"),
                    duration_category("dm").alias("duration_category"))


@register("duration_bins9", W(["matches"], f"""
SELECT match_id, {O.bins9("duration")} AS duration_bin_small FROM matches"""))
def q_duration_bins9(spark, d):
    """9-bin scale over unrounded minutes."""
    m = warehouse(spark, d).matches
    return m.select("match_id", duration_bin_small("duration").alias("duration_bin_small"))


@register("region_lookup", W(["matches"], f"""
SELECT match_id, region, {O.region_label('region')} AS region_name FROM matches"""))
def q_region_lookup(spark, d):
    """Code → name lookup with 'Unknown' for the rest (and NULL)."""
    m = warehouse(spark, d).matches
    return m.select("match_id", "region", region_name("region").alias("region_name"))


@register("named_flag", W(["players"], """
SELECT match_id, player_slot,
       CASE WHEN steam_id IS NOT NULL AND personaname IS NOT NULL THEN 'named'
            ELSE 'unknown' END AS is_named
FROM players"""))
def q_named_flag(spark, d):
    """IS NOT NULL AND IS NOT NULL."""
    p = warehouse(spark, d).players
    named = F.col("steam_id").isNotNull() & F.col("personaname").isNotNull()
    return p.select("match_id", "player_slot",
                    F.when(named, F.lit("named")).otherwise(F.lit("unknown")).alias("is_named"))


@register("team_win_flag", W(["matches", "players"], """
SELECT p.match_id, p.player_slot,
       CASE WHEN p.is_radiant = true AND m.radiant_win = true THEN 1
            WHEN p.is_radiant = false AND m.radiant_win = false THEN 1 ELSE 0 END AS team_win
FROM matches m JOIN players p ON m.match_id = p.match_id"""))
def q_team_win_flag(spark, d):
    """Side and result both known and equal → 1, else 0 (NULL → 0)."""
    w = warehouse(spark, d)
    j = w.matches.select("match_id", "radiant_win").join(
        w.players.select("match_id", "player_slot", "is_radiant"), "match_id", "inner")
    s, rw = F.col("is_radiant"), F.col("radiant_win")
    flag = (F.when((s == F.lit(True)) & (rw == F.lit(True)), F.lit(1))
            .when((s == F.lit(False)) & (rw == F.lit(False)), F.lit(1)).otherwise(F.lit(0)))
    return j.select("match_id", "player_slot", flag.alias("team_win"))


@register("per_minute", W(["players_stat"], f"""
SELECT match_id, player_slot,
       CAST({pm("kills")} AS DOUBLE) AS kills_per_min,
       CAST({pm("hero_damage")} AS DOUBLE) AS hero_damage_per_min,
       CAST({pm("hero_healing")} AS DOUBLE) AS hero_healing_per_min,
       CAST({pm("tower_damage")} AS DOUBLE) AS tower_damage_per_min
FROM players_stat"""))
def q_per_minute(spark, d):
    """ROUND(x::numeric/60, 2) kept exact until output."""
    s = warehouse(spark, d).players_stat
    return s.select("match_id", "player_slot",
                    *[from_hundredths(per_minute_hundredths(c)).alias(f"{c}_per_min")
                      for c in ["kills", "hero_damage", "hero_healing", "tower_damage"]])


@register("int_minutes", W(["matches"], """
SELECT match_id, CAST(floor(duration / 60) AS BIGINT) AS duration_min FROM matches"""))
def q_int_minutes(spark, d):
    """Integer division truncates (whole minutes)."""
    m = warehouse(spark, d).matches
    return m.select("match_id", whole_minutes("duration").alias("duration_min"))


@register("cast_numeric", W(["matches"], f"""
SELECT match_id, CAST(radiant_win AS INT) AS radiant_win_int,
       CAST({pm("first_blood_time")} AS DOUBLE) AS first_blood_min
FROM matches"""))
def q_cast_numeric(spark, d):
    """``::int`` on a boolean, ``::numeric`` division."""
    m = warehouse(spark, d).matches
    return m.select("match_id", bool_int("radiant_win").alias("radiant_win_int"),
                    from_hundredths(per_minute_hundredths("first_blood_time"))
                    .alias("first_blood_min"))


@register("normalize_text", """
SELECT p_partkey, lower(trim(p_name)) AS p_name, lower(trim(p_brand)) AS p_brand,
       lower(trim(p_type)) AS p_type, p_size, p_retailprice
FROM part""")
def q_normalize_text(spark, d):
    """lower + strip every string column of the item dictionary source."""
    return normalize_text(table(spark, d, "part"))


@register("coerce_int", """
SELECT event_id, CASE WHEN value = floor(value) THEN CAST(value AS BIGINT) END AS value_int
FROM events""")
def q_coerce_int(spark, d):
    """text → number (coerce) → nullable integer; fractions become NULL."""
    e = table(spark, d, "events")
    return e.select("event_id", coerce_int(F.col("value").cast("string")).alias("value_int"))


@register("cast_types", W(["players"], """
SELECT match_id, player_slot, steam_id, win FROM players"""))
def q_cast_types(spark, d):
    """F8: nullable bigint steam_id, int win → boolean."""
    wide = _wide(warehouse(spark, d))
    return cast_player_types(wide).select("match_id", "player_slot", "steam_id", "win")


@register("json_roundtrip", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       '{"k":' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) || '}' AS props_json
FROM events""")
def q_json_roundtrip(spark, d):
    """parse JSON text with a schema and serialise it back."""
    e = table(spark, d, "events").select(
        "event_id", F.from_json("props", "k bigint").alias("p"))
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json("p").alias("props_json"))


@register("run_partition", W(["matches"], """
SELECT match_id, CAST(year(o_orderdate) AS VARCHAR) || '-12-31' AS run_date
FROM matches JOIN orders ON o_orderkey = match_id WHERE year(o_orderdate) >= 1998"""))
def q_run_partition(spark, d):
    """documents landed into folders by run date (a run a year); a filter on the date
    reads only the folders of its runs."""
    run = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("match_id"),
        F.concat(F.year("o_orderdate").cast("string"), F.lit("-12-31")).alias(jsonl.RUN_DATE))
    w = warehouse(spark, d)
    path = scratch_path(spark, "landing")
    lines = jsonl.documents_from_tables(w.matches.join(run, "match_id"), _wide(w), keep=(jsonl.RUN_DATE,))
    with sized_for(spark, _given(d)):
        jsonl.land(lines, path, jsonl.RUN_DATE)
    late = jsonl.read_lines(spark, path).where(F.col(jsonl.RUN_DATE) >= "1998-01-01")
    parsed = jsonl.accepted(jsonl.parse_lines(late))
    return parsed.select(F.col("match_key").alias("match_id"), jsonl.RUN_DATE)


# --------------------------------------------------------------------------- joins

@register("left_join_players", W(["matches", "players"], """
SELECT m.match_id, m.duration, m.first_blood_time, m.radiant_win, m.region, p.player_slot,
       p.steam_id, p.personaname, p.hero_id, p.is_radiant, p.win
FROM matches m LEFT JOIN players p ON m.match_id = p.match_id"""))
def q_left_join_players(spark, d):
    """Match → players 1:N, a match without players keeps one row."""
    w = warehouse(spark, d)
    return left_join_children(w.matches, w.players, "match_id")


@register("left_join_stat", W(["matches", "players", "players_stat"], """
SELECT m.match_id, p.player_slot, p.win, s.kills, s.gold_per_min, s.tower_damage
FROM matches m LEFT JOIN players p ON m.match_id = p.match_id
LEFT JOIN players_stat s ON p.match_id = s.match_id AND p.player_slot = s.player_slot"""))
def q_left_join_stat(spark, d):
    """Then players → stat on the composite key (keys from the player side)."""
    w = warehouse(spark, d)
    f = marts.match_player_facts(w.matches, w.players, w.players_stat)
    return f.select("match_id", "player_slot", "win", "kills", "gold_per_min", "tower_damage")


@register("left_join_dim", W(["players", "heroes"], """
SELECT p.match_id, p.player_slot, p.hero_id, h.localized_name
FROM players p LEFT JOIN heroes h ON p.hero_id = h.hero_id"""))
def q_left_join_dim(spark, d):
    """Fact → dimension; broadcast only after the dimension's size is checked."""
    w = warehouse(spark, d)
    return join_dim(w.players.select("match_id", "player_slot", "hero_id"), w.heroes,
                    "hero_id", "left").select("match_id", "player_slot", "hero_id",
                                              "localized_name")


@register("left_join_parent", W(["matches", "players"], """
SELECT p.match_id, p.player_slot, m.match_id AS m_match_id, m.duration
FROM players p LEFT JOIN matches m ON p.match_id = m.match_id"""))
def q_left_join_parent(spark, d):
    """Fact → parent; the parent key stays NULL when unmatched."""
    w = warehouse(spark, d)
    m = w.matches.select(F.col("match_id").alias("m_match_id"), "duration")
    p = w.players.select("match_id", "player_slot")
    return p.join(m, p["match_id"] == m["m_match_id"], "left")


@register("inner_join_players", W(["matches", "players"], """
SELECT m.match_id, p.player_slot, p.is_radiant, m.radiant_win, m.duration
FROM matches m JOIN players p ON m.match_id = p.match_id"""))
def q_inner_join_players(spark, d):
    """Inner equi-join."""
    w = warehouse(spark, d)
    return (w.matches.select("match_id", "radiant_win", "duration")
            .join(w.players.select("match_id", "player_slot", "is_radiant"), "match_id")
            .select("match_id", "player_slot", "is_radiant", "radiant_win", "duration"))


@register("scalar_threshold", W(["matches"], f"""
SELECT match_id, (SELECT {med(pm("duration"), 0.75)} FROM matches) AS dur_thresh,
       CASE WHEN CAST(duration AS DOUBLE) / 60 <
                 (SELECT {med(pm("duration"), 0.75)} FROM matches)
            THEN 'normal' ELSE 'late' END AS duration_bin
FROM matches"""))
def q_scalar_threshold(spark, d):
    """Uncorrelated scalar subquery used in SELECT and in CASE."""
    m = warehouse(spark, d).matches
    thr = scalar_quantile(m, per_minute("duration"), 0.75).scalar()
    return m.select("match_id", thr.alias("dur_thresh"),
                    F.when(minutes_double("duration") < thr, F.lit("normal"))
                    .otherwise(F.lit("late")).alias("duration_bin"))


# --------------------------------------------------------------------------- aggregates

_HERO_BINS_SQL = f"""
SELECT hero AS localized_name, CASE WHEN short THEN 'normal' ELSE 'late' END AS game_length,
       count(DISTINCT game) AS games,
       CASE WHEN bool_or(judged) THEN count(*) FILTER (WHERE won) END AS wins,
       CAST({O.rate("CASE WHEN bool_or(judged) THEN count(*) FILTER (WHERE won) END", "count(DISTINCT game)")} AS DOUBLE)
         AS win_rate
FROM ({O.HERO_FACTS}) AS facts GROUP BY hero, short"""


def _hero_bins(spark, d):
    w = warehouse(spark, d)
    thr = scalar_quantile(w.matches, per_minute("duration"), 0.75).scalar()
    p = join_dim(w.players.select("match_id", "hero_id", "win"),
                 w.heroes.select("hero_id", "localized_name"), "hero_id", "left")
    m = w.matches.select(F.col("match_id").alias("m_match_id"), "duration")
    base = p.join(m, p["match_id"] == m["m_match_id"], "left").select(
        "localized_name", "m_match_id", "win",
        F.when(minutes_double("duration") < thr, F.lit("normal")).otherwise(F.lit("late"))
        .alias("game_length"))
    return base.groupBy("localized_name", "game_length").agg(
        F.count_distinct("m_match_id").alias("games"),
        bool_sum("win").alias("wins"),
    )


@register("group_by_ordinal", W(["matches", "players", "heroes"], _HERO_BINS_SQL))
def q_group_by_ordinal(spark, d):
    """GROUP BY a column and a CASE (ordinals 1, 2)."""
    b = _hero_bins(spark, d)
    return b.withColumn("win_rate", to_out(pct2(
        F.col("wins"), F.col("games"))))


@register("pivot_max", W(["matches", "players", "heroes"], f"""
WITH by_length AS ({_HERO_BINS_SQL})
SELECT coalesce(l.localized_name, s.localized_name) AS localized_name,
       l.win_rate AS winrate_late, s.win_rate AS winrate_normal,
       coalesce(l.games, 0) AS match_count_late, coalesce(s.games, 0) AS match_count_normal
FROM (FROM by_length WHERE game_length = 'late') AS l
FULL JOIN (FROM by_length WHERE game_length = 'normal') AS s
  ON l.localized_name IS NOT DISTINCT FROM s.localized_name"""))
def q_pivot_max(spark, d):
    """Conditional pivot with MAX(CASE …) and COALESCE 0, via ``pivot``."""
    b = q_group_by_ordinal(spark, d)
    piv = (b.groupBy("localized_name").pivot("game_length", ["late", "normal"])
           .agg(F.max("win_rate").alias("wr"),
                F.max("games").alias("mc")))
    return piv.select(
        "localized_name",
        F.col("late_wr").alias("winrate_late"), F.col("normal_wr").alias("winrate_normal"),
        F.coalesce(F.col("late_mc"), F.lit(0)).alias("match_count_late"),
        F.coalesce(F.col("normal_mc"), F.lit(0)).alias("match_count_normal"))


@register("team_totals", W(["matches", "players", "players_stat"], """
SELECT m.match_id, p.is_radiant, m.duration,
       CAST(SUM(COALESCE(ps.gold_per_min, 0)) AS BIGINT) AS team_gpm,
       CASE WHEN p.is_radiant = true AND m.radiant_win = true THEN 1
            WHEN p.is_radiant = false AND m.radiant_win = false THEN 1 ELSE 0 END AS win
FROM matches m JOIN players p ON m.match_id = p.match_id
LEFT JOIN players_stat ps ON p.match_id = ps.match_id AND p.player_slot = ps.player_slot
GROUP BY m.match_id, p.is_radiant, m.duration, m.radiant_win"""))
def q_team_totals(spark, d):
    """Per (match, side) SUM(COALESCE(gpm, 0)), pre-aggregated before the join."""
    w = warehouse(spark, d)
    return marts.team_stats(w.matches, w.players, w.players_stat)


_REGION_BASE = f"SELECT match_id, region, radiant_win, {pm('duration')} AS duration_min FROM matches"


@register("count_variants", W(["matches"], """
SELECT region, COUNT(*) AS n_rows, COUNT(radiant_win) AS n_radiant_known
FROM matches GROUP BY region"""))
def q_count_variants(spark, d):
    """A5: COUNT(*) counts rows, COUNT(col) skips NULLs."""
    m = warehouse(spark, d).matches
    return m.groupBy("region").agg(F.count(F.lit(1)).alias("n_rows"),
                                   F.count("radiant_win").alias("n_radiant_known"))


@register("count_distinct", W(["players", "heroes"], """
SELECT h.localized_name, COUNT(DISTINCT p.match_id) AS n_matches
FROM players p LEFT JOIN heroes h ON p.hero_id = h.hero_id GROUP BY h.localized_name"""))
def q_count_distinct(spark, d):
    """COUNT(DISTINCT) per group (two-phase: group+value, then group)."""
    w = warehouse(spark, d)
    p = join_dim(w.players.select("match_id", "hero_id"), w.heroes, "hero_id", "left")
    return p.groupBy("localized_name").agg(F.count_distinct("match_id").alias("n_matches"))


@register("cond_sum", W(["matches"], """
SELECT region, CAST(SUM(CASE WHEN radiant_win THEN 1 ELSE 0 END) AS BIGINT) AS radiant_win_sum
FROM matches GROUP BY region"""))
def q_cond_sum(spark, d):
    """SUM(CASE WHEN b THEN 1 ELSE 0 END): NULL counts as 0."""
    m = warehouse(spark, d).matches
    return m.groupBy("region").agg(cond_sum("radiant_win").alias("radiant_win_sum"))


@register("bool_sum", W(["matches"], """
SELECT region, CAST(SUM(CAST(radiant_win AS INT)) AS BIGINT) AS radiant_wins
FROM matches GROUP BY region"""))
def q_bool_sum(spark, d):
    """SUM(b::int): NULL skipped, an all-NULL group gives NULL."""
    m = warehouse(spark, d).matches
    return m.groupBy("region").agg(bool_sum("radiant_win").alias("radiant_wins"))


@register("avg_exact", W(["players", "players_stat"], f"""
SELECT p.win, {avg2_sql("s.gold_per_min")} AS gold_per_min_mean,
       {avg2_sql(pm("s.tower_damage"))} AS tower_damage_mean
FROM players p LEFT JOIN players_stat s
  ON p.match_id = s.match_id AND p.player_slot = s.player_slot
GROUP BY p.win"""))
def q_avg_exact(spark, d):
    """A10: ROUND(AVG(x), 2) as an exact decimal (int and 2-place inputs)."""
    w = warehouse(spark, d)
    f = marts.player_stats(w.players, w.players_stat)
    return f.groupBy("win").agg(
        to_out(avg2("gold_per_min")).alias("gold_per_min_mean"),
        to_out(avg2(per_minute("tower_damage"))).alias("tower_damage_mean"))


@register("avg_pct", W(["matches"], f"""
SELECT region, {pct2_sql("SUM(CAST(radiant_win AS INT))", "COUNT(radiant_win)")}
       AS radiant_win_rate_pct
FROM matches GROUP BY region"""))
def q_avg_pct(spark, d):
    """ROUND(AVG(b::int) * 100, 2); NULLs left out of the denominator."""
    m = warehouse(spark, d).matches
    rw = bool_int("radiant_win")
    return m.groupBy("region").agg(
        to_out(pct2(F.sum(rw), F.count(rw))).alias("radiant_win_rate_pct"))


@register("ratio_pct", W(["matches"], f"""
SELECT {_BINS7_SQL.format(x=pm("duration"))} AS duration_category,
       {pct2_sql("SUM(CASE WHEN radiant_win THEN 1 ELSE 0 END)", "COUNT(match_id)")}
       AS win_share_radiant
FROM matches GROUP BY 1"""))
def q_ratio_pct(spark, d):
    """SUM / COUNT * 100 with every match in the denominator."""
    m = warehouse(spark, d).matches
    g = m.groupBy(duration_category(per_minute_hundredths("duration"))
                  .alias("duration_category"))
    return g.agg(to_out(pct2(cond_sum("radiant_win"), F.count("match_id")))
                 .alias("win_share_radiant"))


@register("median_rounded", W(["matches"], f"""
SELECT region, {r2(med("duration_min"))} AS duration_median
FROM ({_REGION_BASE}) t GROUP BY region"""))
def q_median_rounded(spark, d):
    """ROUND(percentile_cont(0.5), 2) per group, from value histograms."""
    m = warehouse(spark, d).matches.select("region", per_minute("duration").alias("duration_min"))
    med_df = grouped_quantiles(m, ["region"], ["duration_min"], 0.5)
    return med_df.select("region", to_out(round2("duration_min")).alias("duration_median"))


@register("median_raw", W(["matches", "players", "players_stat"], f"""
SELECT CASE WHEN p.steam_id IS NOT NULL AND p.personaname IS NOT NULL THEN 'named'
            ELSE 'unknown' END AS is_named,
       {med(pm("s.kills"))} AS median_kills_per_min,
       {med("s.gold_per_min")} AS median_gold_per_min
FROM matches m LEFT JOIN players p ON m.match_id = p.match_id
LEFT JOIN players_stat s ON p.match_id = s.match_id AND p.player_slot = s.player_slot
GROUP BY 1"""))
def q_median_raw(spark, d):
    """Unrounded percentile_cont(0.5) (PostgreSQL interpolation, bit-exact)."""
    w = warehouse(spark, d)
    f = marts.match_player_facts(w.matches, w.players, w.players_stat)
    named = F.col("steam_id").isNotNull() & F.col("personaname").isNotNull()
    x = f.select(F.when(named, F.lit("named")).otherwise(F.lit("unknown")).alias("is_named"),
                 per_minute("kills").alias("k"), F.col("gold_per_min").alias("g"))
    q = grouped_quantiles(x, ["is_named"], ["k", "g"], 0.5)
    groups = x.select("is_named").distinct()
    return groups.join(q, "is_named", "left").select(
        "is_named", F.col("k").alias("median_kills_per_min"),
        F.col("g").alias("median_gold_per_min"))


@register("quartile_threshold", W(["matches"], f"""
SELECT {med(pm("duration"), 0.75)} AS q75_duration_min,
       {med(pm("duration"), 0.25)} AS q25_duration_min
FROM matches"""))
def q_quartile_threshold(spark, d):
    """Global 0.75 and 0.25 quantiles (one histogram, two read-outs)."""
    m = warehouse(spark, d).matches.select(per_minute("duration").alias("v"))
    h = value_histogram(m, [], ["v"])
    q75 = quantile_from_histogram(h, [], 0.75).select(F.col("q").alias("q75_duration_min"),
                                                       "metric")
    q25 = quantile_from_histogram(h, [], 0.25).select(F.col("q").alias("q25_duration_min"),
                                                       "metric")
    return q75.join(q25, "metric").select("q75_duration_min", "q25_duration_min")


@register("dedup_full", """
SELECT DISTINCT l_orderkey AS match_id, l_linenumber AS player_slot, l_returnflag, l_linestatus
FROM lineitem""")
def q_dedup_full(spark, d):
    """Full-row de-duplication."""
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").alias("player_slot"),
        "l_returnflag", "l_linestatus")
    return distinct_rows(li)


@register("dedup_key", W(["line_one"], """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
       l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM line_one"""))
def q_dedup_key(spark, d):
    """One row per (order, line), the first by a total order (map-side combined)."""
    li = table(spark, d, "lineitem")
    return first_per_stored_key(li, ["l_orderkey", "l_linenumber"], LINE_ORDER)


@register("dup_keys", """
SELECT l_orderkey AS match_id, l_linenumber AS player_slot, COUNT(*) AS n_rows
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""")
def q_dup_keys(spark, d):
    """Q5: keys that occur more than once."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("match_id"),
                                            F.col("l_linenumber").alias("player_slot"))
    return duplicate_keys(li, ["match_id", "player_slot"])


# --------------------------------------------------------------------------- windows

@register("dense_rank_global", W(["players", "heroes"], f"""
WITH named AS (
  SELECT (SELECT max(localized_name) FROM heroes AS h WHERE h.hero_id = p.hero_id) AS hero, p.hero_id
  FROM players AS p),
shares AS (
  SELECT hero, {O.rate("count(hero_id)", "(SELECT count(hero_id) FROM named)")} AS share FROM named GROUP BY hero)
SELECT hero AS localized_name, CAST(share AS DOUBLE) AS pickup_rate,
       (SELECT 1 + count(DISTINCT coalesce(o.share, 1e9)) FROM shares AS o
        WHERE coalesce(o.share, 1e9) > coalesce(s.share, 1e9)) AS rank_pickup_rate
FROM shares AS s"""))
def q_dense_rank_global(spark, d):
    """DENSE_RANK over one row per hero (bounded by the dimension)."""
    w = warehouse(spark, d)
    p = join_dim(w.players.select("hero_id"), w.heroes, "hero_id", "left")
    per = p.groupBy("localized_name").agg(F.count("hero_id").alias("picks"))
    rate = pct2(F.col("picks"), F.sum("picks").over(Window.partitionBy()))
    per = per.select("localized_name", rate.alias("pickup_rate"))
    return per.select("localized_name", to_out("pickup_rate").alias("pickup_rate"),
                      F.dense_rank().over(Window.orderBy(F.col("pickup_rate").desc_nulls_first()))
                      .cast("bigint").alias("rank_pickup_rate"))


_TEAM_SQL = """
SELECT m.match_id, p.is_radiant, CAST(SUM(COALESCE(ps.gold_per_min, 0)) AS BIGINT) AS team_gpm
FROM matches m JOIN players p ON m.match_id = p.match_id
LEFT JOIN players_stat ps ON p.match_id = ps.match_id AND p.player_slot = ps.player_slot
GROUP BY m.match_id, p.is_radiant"""


@register("ntile_global", W(["matches", "players", "players_stat"], f"""
SELECT match_id, is_radiant, team_gpm,
       CAST(NTILE(10) OVER (ORDER BY team_gpm, match_id, is_radiant) AS BIGINT) AS gpm_decile
FROM ({_TEAM_SQL}) t"""))
def q_ntile_global(spark, d):
    """Global NTILE(10) over team rows (by cut values, no sort of the rows)."""
    w = warehouse(spark, d)
    t = marts.team_stats(w.matches, w.players, w.players_stat).select(
        "match_id", "is_radiant", "team_gpm")
    return ntile(written(t, "team-rows"), 10, ["team_gpm", "match_id", "is_radiant"], "gpm_decile")


@register("ntile_distributed", W(["players_stat"], """
SELECT match_id, player_slot, gold_per_min,
       CAST(NTILE(7) OVER (ORDER BY gold_per_min, match_id, player_slot) AS BIGINT) AS gpm_tile
FROM players_stat"""))
def q_ntile_distributed(spark, d):
    """R2: NTILE(7) over every stat row; 7 tiles leave a remainder to place."""
    s = warehouse(spark, d).players_stat.select("match_id", "player_slot", "gold_per_min")
    return ntile(s, 7, ["gold_per_min", "match_id", "player_slot"], "gpm_tile")


@register("median_histogram", W(["matches"], f"""
SELECT region, {med(pm("duration"))} AS duration_median,
       {med(pm("first_blood_time"))} AS first_blood_time_median
FROM matches GROUP BY region"""))
def q_median_histogram(spark, d):
    """Medians from mergeable histograms: one per result state, merged, read out."""
    m = warehouse(spark, d).matches.select(
        "region", "radiant_win", per_minute("duration").alias("duration_median"),
        per_minute("first_blood_time").alias("first_blood_time_median"))
    cols = ["duration_median", "first_blood_time_median"]
    won = value_histogram(m.where(F.col("radiant_win")), ["region"], cols)
    rest = value_histogram(m.where(~F.coalesce(F.col("radiant_win"), F.lit(False))),
                           ["region"], cols)
    q = quantile_from_histogram(merge_histograms(won, rest), ["region"], 0.5)
    return q.groupBy("region").pivot("metric", cols).agg(F.first("q"))


# --------------------------------------------------------------------------- integrity

@register("fk_matches_players", W(["matches", "players"], """
SELECT DISTINCT match_id FROM matches m
WHERE NOT EXISTS (SELECT 1 FROM players p WHERE p.match_id = m.match_id)"""))
def q_fk_matches_players(spark, d):
    """Matches without players."""
    w = warehouse(spark, d)
    return integrity.missing_keys(w.matches, w.players, ["match_id"])


@register("fk_players_matches", W(["matches", "players"], """
SELECT DISTINCT match_id FROM players p
WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.match_id = p.match_id AND radiant_win IS NOT NULL)"""))
def q_fk_players_matches(spark, d):
    """Q2: players whose match is missing; a match counts once its result is known."""
    w = warehouse(spark, d)
    return integrity.missing_keys(w.players, w.matches.where("radiant_win IS NOT NULL"), ["match_id"])


@register("fk_players_stat", W(["players", "players_stat"], """
SELECT DISTINCT match_id, player_slot FROM players p
WHERE NOT EXISTS (SELECT 1 FROM players_stat s
                  WHERE s.match_id = p.match_id AND s.player_slot = p.player_slot AND hero_healing > 0)"""))
def q_fk_players_stat(spark, d):
    """Composite-key set difference players − stat rows with any healing."""
    w = warehouse(spark, d)
    return integrity.missing_keys(w.players, w.players_stat.where("hero_healing > 0"), ["match_id", "player_slot"])


@register("fk_players_items", W(["players", "player_items_wide"], """
SELECT DISTINCT match_id, player_slot FROM players p
WHERE NOT EXISTS (SELECT 1 FROM player_items_wide i
                  WHERE i.match_id = p.match_id AND i.player_slot = p.player_slot AND item_0 <> 0)"""))
def q_fk_players_items(spark, d):
    """Q3: composite-key set difference players − items held in the first slot (long form)."""
    w = warehouse(spark, d)
    held = unpivot_items(w.player_items_wide).where("item_slot = '0' AND item_id IS NOT NULL")
    return integrity.missing_keys(w.players, held, ["match_id", "player_slot"])


@register("fk_hero", W(["players", "heroes"], """
SELECT DISTINCT hero_id FROM players p
WHERE hero_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM heroes h WHERE h.hero_id = p.hero_id)"""))
def q_fk_hero(spark, d):
    """Q4: hero ids with no hero (NULLs ignored)."""
    w = warehouse(spark, d)
    return integrity.missing_keys(w.players, w.heroes, ["hero_id"])


@register("fk_item", W(["players", "player_items_wide", "items"], f"""
WITH long AS ({_ITEMS_SQL})
SELECT DISTINCT item_id FROM long l
WHERE item_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM items i WHERE i.item_id = l.item_id)"""))
def q_fk_item(spark, d):
    """Q4: item ids with no item (0 was turned into NULL and is ignored)."""
    w = warehouse(spark, d)
    items_long = unpivot_items(_wide(w))
    return integrity.missing_keys(items_long, w.items.withColumn("item_id",
                                                                 F.col("item_id").cast("int")),
                                  ["item_id"])


_FK_SQL = """
SELECT 'matches_without_players' AS "check",
       (SELECT COUNT(DISTINCT match_id) FROM matches) AS child_keys,
       (SELECT COUNT(DISTINCT match_id) FROM players) AS parent_keys,
       (SELECT COUNT(*) FROM (SELECT DISTINCT match_id FROM matches m WHERE NOT EXISTS
          (SELECT 1 FROM players p WHERE p.match_id = m.match_id))) AS missing
UNION ALL
SELECT 'players_without_match',
       (SELECT COUNT(DISTINCT match_id) FROM players),
       (SELECT COUNT(DISTINCT match_id) FROM matches),
       (SELECT COUNT(*) FROM (SELECT DISTINCT match_id FROM players p WHERE NOT EXISTS
          (SELECT 1 FROM matches m WHERE m.match_id = p.match_id)))
UNION ALL
SELECT 'players_without_stat',
       (SELECT COUNT(*) FROM (SELECT DISTINCT match_id, player_slot FROM players)),
       (SELECT COUNT(*) FROM (SELECT DISTINCT match_id, player_slot FROM players_stat)),
       (SELECT COUNT(*) FROM (SELECT DISTINCT match_id, player_slot FROM players p WHERE NOT EXISTS
          (SELECT 1 FROM players_stat s WHERE s.match_id = p.match_id
             AND s.player_slot = p.player_slot)))
UNION ALL
SELECT 'players_without_items',
       (SELECT COUNT(*) FROM (SELECT DISTINCT match_id, player_slot FROM players)),
       (SELECT COUNT(*) FROM (SELECT DISTINCT match_id, player_slot FROM items_long)),
       (SELECT COUNT(*) FROM (SELECT DISTINCT match_id, player_slot FROM players p WHERE NOT EXISTS
          (SELECT 1 FROM items_long s WHERE s.match_id = p.match_id
             AND s.player_slot = p.player_slot)))
UNION ALL
SELECT 'hero_not_in_heroes',
       (SELECT COUNT(DISTINCT hero_id) FROM players),
       (SELECT COUNT(DISTINCT hero_id) FROM heroes),
       (SELECT COUNT(*) FROM (SELECT DISTINCT hero_id FROM players p WHERE hero_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM heroes h WHERE h.hero_id = p.hero_id)))
UNION ALL
SELECT 'item_not_in_items',
       (SELECT COUNT(DISTINCT item_id) FROM items_long),
       (SELECT COUNT(DISTINCT item_id) FROM items),
       (SELECT COUNT(*) FROM (SELECT DISTINCT item_id FROM items_long l WHERE item_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM items i WHERE i.item_id = l.item_id)))"""


@register("fk_report", W(["matches", "players", "players_stat", "player_items_wide", "heroes",
                          "items"], f"WITH items_long AS ({_ITEMS_SQL})\n{_FK_SQL}"))
def q_fk_report(spark, d):
    """One row per key check: distinct keys each side, missing count."""
    w = warehouse(spark, d)
    item_rows = w.player_items_wide.join(w.players.select("match_id", "player_slot"),
                                         ["match_id", "player_slot"], "left_semi")
    items_long = unpivot_items(item_rows)
    return integrity.fk_report({
        "matches": w.matches, "players": w.players, "players_stat": w.players_stat,
        "players_items": items_long, "heroes": w.heroes,
        "items": w.items.withColumn("item_id", F.col("item_id").cast("int")),
    })


@register("regions_stat_incremental", O.MARTS["regions_stat"])
def q_regions_stat_incremental(spark, d):
    """regions_stat maintained batch by batch (one batch per order year) from a
    mergeable histogram state; must equal the full recomputation."""
    from matchmart.plans import incremental
    w = warehouse(spark, d)
    root = _replay_yearly(spark, d, w.matches, "regions_stat")
    return incremental.mart_from_state(spark, root, "regions_stat")


def _replay_yearly(spark, d, matches, mart):
    """Feed ``matches`` to the incremental state one order year at a time."""
    from matchmart.plans import incremental
    year = table(spark, d, "orders").select(F.col("o_orderkey").alias("match_id"),
                                            F.year("o_orderdate").alias("batch"))
    m = matches.join(year, "match_id", "left")
    root = scratch_path(spark, "incremental")
    # one update per batch value: a handful of years, the daily-job loop
    batches = [r[0] for r in m.select("batch").distinct().orderBy("batch").collect()]
    for b in batches:
        part = m.where(F.col("batch").eqNullSafe(F.lit(b))).drop("batch")
        incremental.add_batch(spark, root, part, mart, batch=str(b))
    return root


@register("radiant_win_incremental", O.MARTS["radiant_win_by_duration"])
def q_radiant_win_incremental(spark, d):
    """Win share by match length maintained batch by batch from its state."""
    from matchmart.plans import incremental
    root = _replay_yearly(spark, d, warehouse(spark, d).matches, "radiant_win_by_duration")
    return incremental.mart_from_state(spark, root, "radiant_win_by_duration")


def _replay_late_players(spark, d, mart):
    """Three loads: the earlier matches, alone; the later ones with the earlier ones' players;
    the later ones' players and all statistics."""
    from matchmart.plans import incremental
    w = warehouse(spark, d)
    day = table(spark, d, "orders").select(F.col("o_orderkey").alias("match_id"), "o_orderdate")
    early = day.where("o_orderdate < TIMESTAMP '1998-01-01'").select("match_id")

    def part(df, how):
        return df.join(early, "match_id", how)

    m, p, s, never = w.matches, w.players, w.players_stat, F.lit(False)
    loads = [{"matches": part(m, "left_semi"), "players": p.where(never), "players_stat": s.where(never)},
             {"matches": part(m, "left_anti"), "players": part(p, "left_semi"), "players_stat": s.where(never)},
             {"matches": m.where(never), "players": part(p, "left_anti"), "players_stat": s}]
    root, stored = scratch_path(spark, "incremental"), None
    for k, load in enumerate(loads):
        with sized_for(spark, _given(d)):
            incremental.add_load(spark, root, mart, stored, load, batch=str(k))
        stored = load if stored is None else {n: stored[n].unionByName(load[n]) for n in stored}
    return root


@register("win_factors_incremental", O.MARTS["win_factors"])
def q_win_factors_incremental(spark, d):
    """Win factors maintained load by load, with players and statistics that come after
    their matches; must equal the full recomputation."""
    from matchmart.plans import incremental
    return incremental.mart_from_state(spark, _replay_late_players(spark, d, "win_factors"), "win_factors")


@register("unknown_players_incremental", O.MARTS["unknown_players"])
def q_unknown_players_incremental(spark, d):
    """Named and anonymous players maintained load by load, with late players and statistics."""
    from matchmart.plans import incremental
    return incremental.mart_from_state(spark, _replay_late_players(spark, d, "unknown_players"), "unknown_players")


# --------------------------------------------------------------------------- sources / sinks
# These write to (and read back from) fresh folders under the shared
# checkpoint dir, the way the feed's files are produced and consumed.


@register("json_id_list", "SELECT o_orderkey AS match_id FROM orders")
def q_json_id_list(spark, d):
    """Save ids as JSON arrays of bounded length, load them back as rows."""
    path = scratch_path(spark, "id-list")
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("match_id"))
    files.save_id_list(ids, path)
    return files.load_id_list(spark, path, "match_id")


@register("land_raw", W(["matches"], _MATCH_SQL))
def q_land_raw(spark, d):
    """Append raw documents to a landing folder (two appends of the same batch),
    then read the folder back: every match once."""
    path = scratch_path(spark, "landing")
    lines = _raw_lines(spark, d)
    with sized_for(spark, _given(d)):
        jsonl.land(lines, path)
        jsonl.land(jsonl.read_lines(spark, path), path)   # the batch as it landed, not computed again
    return jsonl.project_matches(jsonl.read_raw_matches(spark, path, fields=jsonl.MATCH_FIELDS))


def _hero_formulas() -> dict[str, str]:
    """Each numeric hero field from the nation key, in SQL that both engines read: distinct
    whole numbers, distinct quarters for fractions, gaps in one field."""
    out = {}
    for i, n in enumerate(HERO_NUMBERS):
        out[n] = (f"CAST(n_nationkey AS DOUBLE) / 4 + {i}" if n in HERO_FRACTIONS
                  else f"CAST(n_nationkey * {i + 2} + {i} AS BIGINT)")
    out["turn_rate"] = f"CASE WHEN n_nationkey % 3 <> 0 THEN {out['turn_rate']} END"
    return out


@register("json_array_rows", f"""
SELECT CAST(n_nationkey AS BIGINT) AS hero_id, n_name AS localized_name,
       CASE WHEN n_nationkey % 2 = 0 THEN 'Melee' ELSE 'Ranged' END AS attack_type,
       CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 'str' END AS primary_attr,
       CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE 'Carry,' || n_name END AS roles,
       {", ".join(f"{e} AS {n}" for n, e in _hero_formulas().items())}, n_nationkey % 2 = 1 AS cm_enabled
FROM nation""")
def q_json_array_rows(spark, d):
    """JSON arrays of hero objects (one document per region) → rows with all 30 fields."""
    n = table(spark, d, "nation")
    key = F.col("n_nationkey")
    roles = F.when(key % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Carry"), F.col("n_name")))
    hero = F.struct(
        key.alias("id"), F.col("n_name").alias("localized_name"),
        F.when(key % 2 == 0, "Melee").otherwise("Ranged").alias("attack_type"),
        F.when(key % 4 != 0, "str").alias("primary_attr"), roles.alias("roles"),
        *[F.expr(e).alias(c) for c, e in _hero_formulas().items()], (key % 2 == 1).alias("cm_enabled"))
    docs = n.groupBy("n_regionkey").agg(F.to_json(F.collect_list(hero)).alias("value"))
    rows = files.json_array_rows(docs, HERO_LIST_ITEM)
    return rename_keys(rows.withColumn("roles", F.array_join("roles", ",")), {"id": "hero_id"})


_ITEM_KEY_SQL = "replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR)"


def _item_documents(spark, d):
    """The item dictionary in documents of 50 parts: objects with other keys for other items,
    mixed types under one key, and nested values."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    number = F.when(k % 3 == 0, F.lit("false")).otherwise(k.cast("string"))
    extra = F.concat_ws(
        ",", F.concat(F.lit('"mc":'), number), F.concat(F.lit('"hc":"'), number, F.lit('"')),
        F.when(k % 4 != 0, F.concat(F.lit('"cd":'), (F.col("p_size") / 2).cast("string"))),
        F.when(k % 5 == 0, F.concat(F.lit('"charges":'), F.col("p_size").cast("string"), F.lit(".0"))),
        F.when(k % 2 == 0, F.when(k % 4 == 0, '"bkbpierce":" Yes"').otherwise('"bkbpierce":"No "')),
        F.when(k % 7 == 0, F.lit('"hint":[]')).otherwise(F.concat(F.lit('"hint":["'), F.col("p_type"), F.lit('"]'))),
        F.when(k % 6 == 1, F.concat(F.lit('"size of box":{"w":'), F.col("p_size").cast("string"), F.lit("}"))))
    plain = F.to_json(F.struct(k.alias("id"), F.col("p_name").alias("dname"),
                               F.when(k % 8 != 0, F.floor(F.col("p_retailprice"))).alias("cost"),
                               F.col("p_brand").alias("brand")))
    name = F.to_json(F.array(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), k.cast("string"))))
    entry = F.concat(F.expr("substring(name, 2, length(name) - 2)"), F.lit(":"),
                     F.expr("substring(plain, 1, length(plain) - 1)"), F.lit(","), F.col("extra"), F.lit("}"))
    entries = p.select("p_partkey", name.alias("name"), plain.alias("plain"), extra.alias("extra")).select(
        F.floor(k / 50).alias("doc"), entry.alias("entry"))
    listed = F.concat(F.lit("{"), F.array_join(F.collect_list("entry"), ","), F.lit("}"))  # 50 at most
    return entries.groupBy("doc").agg(listed.alias("value"))


@register("json_map_rows", f"""
SELECT {_ITEM_KEY_SQL} AS item_key, p_partkey AS id, p_name AS dname, p_brand AS brand,
       CASE WHEN p_partkey % 8 <> 0 THEN CAST(floor(p_retailprice) AS BIGINT) END AS "cost",
       CASE WHEN p_partkey % 3 = 0 THEN 'false' ELSE CAST(p_partkey AS VARCHAR) END AS mc,
       CASE WHEN p_partkey % 3 = 0 THEN 'false' ELSE CAST(p_partkey AS VARCHAR) END AS hc,
       CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS DOUBLE) / 2 END AS cd,
       CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size AS DOUBLE) END AS charges,
       CASE WHEN p_partkey % 4 = 0 THEN ' Yes' WHEN p_partkey % 2 = 0 THEN 'No ' END AS bkbpierce,
       CASE WHEN p_partkey % 7 = 0 THEN '[]' ELSE '["' || p_type || '"]' END AS hint,
       CASE WHEN p_partkey % 6 = 1 THEN '{{"w":' || CAST(p_size AS VARCHAR) || '}}' END AS size_of_box
FROM part""")
def q_json_map_rows(spark, d):
    """JSON objects keyed by item name → rows; every key that any item has is a column,
    its type merged over all items."""
    rows = files.entry_table(files.entry_rows(_item_documents(spark, d), "item_key"))
    return (rows.withColumnRenamed("size of box", "size_of_box")
            .withColumn("cd", F.col("cd").cast("double")).withColumn("charges", F.col("charges").cast("double")))


@register("clean_items", f"""
SELECT {_ITEM_KEY_SQL} AS item_key, p_partkey AS item_id, lower(trim(p_name)) AS dname,
       CASE WHEN p_partkey % 8 <> 0 THEN CAST(floor(p_retailprice) AS BIGINT) END AS "cost",
       CASE WHEN p_partkey % 3 <> 0 THEN p_partkey END AS mc,
       CASE WHEN p_partkey % 3 <> 0 THEN p_partkey END AS hc,
       CASE WHEN p_partkey % 4 <> 0 AND p_size % 2 = 0 THEN CAST(p_size // 2 AS BIGINT) END AS cd,
       CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size AS BIGINT) END AS charges,
       CASE WHEN p_partkey % 4 = 0 THEN true WHEN p_partkey % 2 = 0 THEN false END AS bkbpierce,
       CASE WHEN p_partkey % 7 <> 0 THEN '["' || lower(p_type) || '"]' END AS hint,
       CASE WHEN p_partkey % 6 = 1 THEN 'brand="' || p_brand || '";size of box={{"w":' || CAST(p_size AS VARCHAR) || '}}'
            ELSE 'brand="' || p_brand || '"' END AS other
FROM part""")
def q_clean_items(spark, d):
    """F8: the item dictionary with nullable integers, flags, hints; keys without a column in a map."""
    rows = clean_items(files.entry_table(files.entry_rows(_item_documents(spark, d), "item_key"), ITEM_MAP_VALUE))
    kept = F.transform(F.array_sort(F.map_entries("other")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.withColumn("other", F.array_join(kept, ";"))


_PLAYERS_CSV_SCHEMA = T.StructType([
    T.StructField("match_id", T.LongType()), T.StructField("player_slot", T.IntegerType()),
    T.StructField("steam_id", T.LongType()), T.StructField("personaname", T.StringType()),
    T.StructField("hero_id", T.LongType()), T.StructField("is_radiant", T.BooleanType()),
    T.StructField("win", T.BooleanType()),
])


@register("csv_roundtrip", W(["players"], "SELECT * FROM players"))
def q_csv_roundtrip(spark, d):
    """CSV with header, explicit schema on read, empty field = NULL."""
    path = scratch_path(spark, "csv")
    files.write_csv(warehouse(spark, d).players, path)
    return files.read_csv(spark, path, _PLAYERS_CSV_SCHEMA)


@register("bag_union", W(["players", "players_stat"], """
SELECT match_id, player_slot, steam_id, kills, gold_per_min FROM (
  SELECT match_id, player_slot, steam_id FROM players
  UNION ALL BY NAME SELECT match_id, player_slot, kills, gold_per_min FROM players_stat
  UNION ALL BY NAME SELECT match_id, player_slot, steam_id FROM players) u"""))
def q_bag_union(spark, d):
    """Rows of several frames, repeats kept, columns by name, missing ones NULL."""
    w = warehouse(spark, d)
    p = w.players.select("match_id", "player_slot", "steam_id")
    s = w.players_stat.select("match_id", "player_slot", "kills", "gold_per_min")
    return p.unionByName(s, allowMissingColumns=True).unionByName(p, allowMissingColumns=True)


@register("snapshot_merge", W(["players"], "SELECT * FROM players"))
def q_snapshot_merge(spark, d):
    """Old snapshot ∪ new download, key dedup keeping the old row, rewrite."""
    w = warehouse(spark, d)
    old = w.players.withColumn("_src", F.lit(0))
    new = normalize_text(w.players).withColumn("_src", F.lit(1))
    path = scratch_path(spark, "snapshot")
    with sized_for(spark, _given(d)):
        merged = first_per_stored_key(old.unionByName(new), KEYS["players"], ["_src", "steam_id", "personaname", "hero_id", "is_radiant", "win"])
        files.write_csv(merged.drop("_src"), path)
    return files.read_csv(spark, path, _PLAYERS_CSV_SCHEMA)


@register("insert_ignore", W(["matches"], "SELECT * FROM matches"))
def q_insert_ignore(spark, d):
    """Two overlapping loads of matches; the second inserts only new keys."""
    w = warehouse(spark, d)
    path = scratch_path(spark, "table") + "/matches"
    first = integrity.with_children(w.matches, w.players, "match_id")
    insert_ignore(spark, first, path, KEYS["matches"]).collect()
    insert_ignore(spark, w.matches, path, KEYS["matches"]).collect()
    return read_table(spark, path)


@register("mart_publish", O.MARTS["radiant_win_by_duration"])
def q_mart_publish(spark, d):
    """Materialise a mart as a new version and read the current version."""
    root = scratch_path(spark, "marts")
    w = warehouse(spark, d)
    publish.publish(spark, root, "radiant_win_by_duration",
                    marts.radiant_win_by_duration(w.matches))
    return publish.current(spark, root, "radiant_win_by_duration")


_REFRESH_SQL = W(["matches", "players", "players_stat", "heroes"], "\nUNION ALL\n".join(
    f"SELECT '{n}' AS mart, (SELECT count(*) FROM ({O.MART_BODIES[n].strip()}) t) AS rows, "
    f"'refreshed' AS status" for n in marts.MART_NAMES))


@register("mart_refresh", _REFRESH_SQL)
def q_mart_refresh(spark, d):
    """Refresh every mart; one status row each (failures do not stop the rest)."""
    from matchmart.plans.refresh import refresh_marts
    w = warehouse(spark, d)
    tables = {"matches": w.matches, "players": w.players, "players_stat": w.players_stat,
              "heroes": w.heroes}
    with sized_for(spark, _given(d)):
        status = refresh_marts(spark, scratch_path(spark, "marts"), tables)
    return status.select("mart", "rows", "status")


@register("daily_load", W(["matches", "players"], """
SELECT match_id, duration, first_blood_time, radiant_win, CAST(region AS BIGINT) AS region
FROM matches m WHERE EXISTS (SELECT 1 FROM players p WHERE p.match_id = m.match_id)"""))
def q_daily_load(spark, d):
    """Landed documents → four tables (FK-filtered, insert-ignore); the matches table."""
    root = scratch_path(spark, "warehouse")
    lines = _landed_lines(spark, d)
    with sized_for(spark, _given(d)):
        etl.load_batch(spark, lines, root).collect()
        etl.load_batch(spark, lines, root).collect()   # rerun adds nothing
    return read_table(spark, f"{root}/matches")


@register("stream_ingest", W(["matches", "players"], """
SELECT match_id, duration, first_blood_time, radiant_win, CAST(region AS BIGINT) AS region
FROM matches m WHERE EXISTS (SELECT 1 FROM players p WHERE p.match_id = m.match_id)"""))
def q_stream_ingest(spark, d):
    """Landed files processed once by a resumable availableNow stream."""
    from matchmart.streaming.ingest import run_ingest
    landing = _landing(spark, d)             # read only: the stream tracks files in ckpt
    root = scratch_path(spark, "warehouse")
    ckpt = scratch_path(spark, "stream-ckpt")
    with sized_for(spark, _given(d)):
        run_ingest(spark, landing, root, ckpt)
        run_ingest(spark, landing, root, ckpt)   # nothing new: no batch, no rows
    return read_table(spark, f"{root}/matches")
