"""Independent SQL formulations of the registered queries (DuckDB dialect).

The engine side is written with the DataFrame API; these texts restate the
same semantics in SQL so that the check compares two formulations, not one
text with itself. Portable forms keep the two engines bit-equal:

- rounding goes through ``DECIMAL(30,10)`` before ``round(…, 2)``,
- medians follow PostgreSQL's float8 interpolation, spelled out (see ``med``),
- ``DESC NULLS FIRST`` is spelled out (PostgreSQL's default),
- integer results are cast to BIGINT (DuckDB sums are HUGEINT).
"""

from __future__ import annotations

# Fixed values, written out here as SQL so that no table of the engine proves itself:
# minutes above, minutes up to, label; region code, name.
BINS_7 = """
(NULL, 25, '1 (<= 25)'), (25, 30, '2 (26-30)'), (30, 35, '3 (31-35)'), (35, 40, '4 (36-40)'),
(40, 45, '5 (41-45)'), (45, 50, '6 (46-50)'), (50, NULL, '7 (>50)')"""
BINS_9 = """
(NULL, 15, '<=15'), (15, 20, '16-20'), (20, 25, '21-25'), (25, 30, '26-30'), (30, 35, '31-35'),
(35, 40, '36-40'), (40, 45, '41-45'), (45, 50, '46-50'), (50, NULL, 'late(>50)')"""
REGIONS = """
(1, 'US West (Seattle)'), (2, 'US East (Sterling)'), (3, 'Europe West (Luxembourg)'),
(4, 'Brazil (São Paulo)'), (6, 'Singapore (SEA)'), (7, 'Australia (Sydney)'),
(8, 'Europe East (Moscow)'), (9, 'South Africa (Cape Town)'), (10, 'Japan (Tokyo)'),
(11, 'India (Chennai)'), (13, 'China (Beijing / Shanghai)'), (14, 'Chile (Santiago)'),
(15, 'Peru (Lima)'), (17, 'Russia (Moscow / East Europe)'), (18, 'Europe East 2'),
(19, 'China 2'), (20, 'Southeast Asia 2'), (25, 'US West 2'), (38, 'US East 2')"""

# --------------------------------------------------------------------------- role views

ROLE_SQL = {
    "matches": """
SELECT o_orderkey AS match_id, CAST(floor(o_totalprice / 125) AS BIGINT) AS duration,
       o_orderkey % 600 AS first_blood_time,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus = 'F' END AS radiant_win,
       c_nationkey AS region
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "line_one": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
   ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
            l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem) t WHERE rn = 1""",
    "players": """
SELECT l_orderkey AS match_id, l_linenumber AS player_slot,
       CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_suppkey END AS steam_id,
       CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE s_name END AS personaname,
       l_suppkey % 27 AS hero_id, l_linenumber <= 3 AS is_radiant, l_linestatus = 'F' AS win
FROM line_one JOIN supplier ON l_suppkey = s_suppkey""",
    "players_stat": """
SELECT l_orderkey AS match_id, l_linenumber AS player_slot,
       CAST(floor(l_quantity) AS INT) AS kills, CAST(l_partkey % 17 AS INT) AS deaths,
       CAST(l_partkey % 29 AS INT) AS assists, CAST(l_suppkey % 11 AS INT) AS denies,
       CAST(floor(l_quantity * 5) AS INT) AS last_hits,
       CAST(floor(l_extendedprice / 100) AS INT) AS gold_per_min,
       CAST(floor(l_extendedprice / 120) AS INT) AS xp_per_min,
       CAST(floor(l_extendedprice) AS BIGINT) AS hero_damage,
       CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS hero_healing,
       CAST(floor(l_extendedprice * l_tax) AS BIGINT) AS tower_damage
FROM line_one""",
    "player_items_wide": """
SELECT l_orderkey AS match_id, l_linenumber AS player_slot,
       """ + ", ".join(
        f"CAST(CASE WHEN (l_partkey + {k} * l_linenumber) % 8 = 0 THEN 0 "
        f"ELSE l_partkey + {k} * l_linenumber END AS INT) AS item_{k}" for k in range(6)) + """
FROM line_one""",
    "heroes": """
SELECT CAST(n_nationkey AS BIGINT) AS hero_id, n_name AS localized_name FROM nation""",
    "items": """
SELECT p_partkey AS item_id, p_name AS item_key FROM part""",
}

_DEPS = {"players": ["line_one"], "players_stat": ["line_one"],
         "player_items_wide": ["line_one"]}
_ORDER = ["matches", "line_one", "players", "players_stat", "player_items_wide", "heroes",
          "items"]


def with_roles(roles: list[str], body: str) -> str:
    """Prefix ``body`` with the role-view CTEs it uses (and their dependencies)."""
    need = set()
    for r in roles:
        need.add(r)
        need.update(_DEPS.get(r, []))
    ctes = [f"{r} AS ({ROLE_SQL[r]}\n)" for r in _ORDER if r in need]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


# --------------------------------------------------------------------------- portable forms

def r2(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(30,10)), 2) AS DOUBLE)"


def pm(x: str) -> str:
    return f"round(CAST(CAST({x} AS DECIMAL(20,6)) / 60 AS DECIMAL(30,10)), 2)"


def avg2(x: str) -> str:
    return r2(f"CAST(sum({x}) AS DECIMAL(24,2)) / nullif(count({x}), 0)")


def pct2(n: str, d: str) -> str:
    return r2(f"CAST({n} AS DECIMAL(20,0)) * 100 / nullif({d}, 0)")


def med(x: str, p: float = 0.5) -> str:
    """PostgreSQL ``percentile_cont(p)``: ``lo + frac * (hi - lo)`` on float8.

    Spelled out over the sorted non-NULL values because DuckDB's built-in
    ``quantile_cont`` evaluates ``lo * (1 - frac) + hi * frac`` with a fused
    multiply-add, which can differ from PostgreSQL in the last bit.
    """
    vals = f"list_sort(list(CAST({x} AS DOUBLE)) FILTER (WHERE {x} IS NOT NULL))"
    pos = f"(CAST({p} AS DOUBLE) * (count({x}) - 1))"
    lo = f"{vals}[CAST(floor({pos}) AS BIGINT) + 1]"
    hi = f"{vals}[CAST(ceil({pos}) AS BIGINT) + 1]"
    return f"({lo} + ({pos} - floor({pos})) * ({hi} - {lo}))"


def bin_of(minutes: str, scale: str) -> str:
    """The label of the bin that holds ``minutes``; an unknown length is in the last one."""
    return (f"(SELECT label FROM (VALUES {scale}) AS s(above, upto, label) "
            f"WHERE CASE WHEN {minutes} IS NULL THEN upto IS NULL "
            f"ELSE (above IS NULL OR {minutes} > above) AND (upto IS NULL OR {minutes} <= upto) END)")


def bins9(x: str) -> str:
    return bin_of(f"({x} / 60.0)", BINS_9)


def region_label(code: str) -> str:
    return (f"coalesce((SELECT name FROM (VALUES {REGIONS}) AS r(code, name) WHERE r.code = {code}), "
            f"'Unknown')")


def long_stats(rows: str, keys: list[str], values: list[str]) -> str:
    """Two CTEs: ``long`` (keys, what, amount) and ``told`` with mean and median of each.

    ``rows`` is a query with the keys and the values as columns.
    """
    k = ", ".join(keys)
    parts = "\n  UNION ALL ".join(
        f"SELECT {k}, '{v}' AS what, CAST({v} AS DECIMAL(24,2)) AS amount FROM wide" for v in values)
    return (f"wide AS ({rows}),\nlong AS (\n  {parts}),\n"
            f"told AS (SELECT {k}, what, {avg2('amount')} AS mean, {med('amount')} AS middle "
            f"FROM long GROUP BY {k}, what)")


def told(what: str, stat: str) -> str:
    """One statistic of ``told`` brought back into the row of its group."""
    return f"max({stat}) FILTER (WHERE what = '{what}')"


# --------------------------------------------------------------------------- marts
#
# Written from the marts' rules (grain, null rules, rounding), not from their
# definitions: bins and regions are value tables, means and medians come from a
# long table of (group, what, amount), heroes from one aggregate per hero, and
# the tile of a team row is computed from its place.

M1_ROLES = ["matches"]
M1_BODY = f"""
WITH won AS (
  SELECT {bin_of(pm("duration"), BINS_7)} AS duration_category,
         match_id, radiant_win IS NOT DISTINCT FROM TRUE AS hit
  FROM matches)
SELECT duration_category, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS radiant_win_sum,
       count(match_id) AS match_count,
       {pct2("count(*) FILTER (WHERE hit)", "count(match_id)")} AS win_share_radiant
FROM won GROUP BY duration_category"""
M1 = with_roles(M1_ROLES, M1_BODY)

M2_ROLES = ["matches"]
M2_BODY = f"""
WITH {long_stats(
    f"SELECT region, {pm('duration')} AS length, {pm('first_blood_time')} AS blood FROM matches",
    ["region"], ["length", "blood"])},
counted AS (
  SELECT region, count(DISTINCT match_id) AS match_count, count(radiant_win) AS judged,
         CASE WHEN count(radiant_win) > 0 THEN count(*) FILTER (WHERE radiant_win) END AS radiant_wins
  FROM matches GROUP BY region),
numbers AS (
  SELECT region, {told("length", "middle")} AS length_middle, {told("length", "mean")} AS length_mean,
         {told("blood", "middle")} AS blood_middle, {told("blood", "mean")} AS blood_mean
  FROM told GROUP BY region)
SELECT c.region, {region_label("c.region")} AS region_name, c.match_count,
       {r2("length_middle")} AS duration_median, length_mean AS duration_mean,
       {r2("blood_middle")} AS first_blood_time_median, blood_mean AS first_blood_time_mean,
       CAST(c.radiant_wins AS BIGINT) AS radiant_wins,
       {pct2("c.radiant_wins", "c.judged")} AS radiant_win_rate_pct
FROM counted c JOIN numbers n ON c.region IS NOT DISTINCT FROM n.region"""
M2 = with_roles(M2_ROLES, M2_BODY)

_M3_METRICS = ["tower_damage", "hero_damage", "gold_per_min", "xp_per_min", "last_hits",
               "assists", "kills", "deaths", "first_blood_time"]
#: every match with its players and their statistics, absent ones as NULL
_PLAYED = """(SELECT * FROM players LEFT JOIN players_stat USING (match_id, player_slot)) AS p
  RIGHT JOIN matches AS m USING (match_id)"""

M3_ROLES = ["matches", "players", "players_stat"]
M3_BODY = f"""
WITH {long_stats(f'''
  SELECT win, {", ".join(f"{pm(c) if c in ('tower_damage', 'hero_damage', 'first_blood_time') else c} AS {c}"
                         for c in _M3_METRICS)}
  FROM {_PLAYED}''', ["win"], _M3_METRICS)}
SELECT win, {", ".join(f"{told(c, 'mean')} AS {c}_mean, {r2(told(c, 'middle'))} AS {c}_median"
                       for c in _M3_METRICS)}
FROM told GROUP BY win"""
M3 = with_roles(M3_ROLES, M3_BODY)


def rate(n: str, d: str) -> str:
    """A percentage with two places, still a decimal."""
    return f"round(CAST(CAST({n} AS DECIMAL(20,0)) * 100 / nullif({d}, 0) AS DECIMAL(30,10)), 2)"


#: one row per hero name: rows, picks and wins in all, and matches and wins of long and short games
HERO_FACTS = f"""
SELECT (SELECT max(localized_name) FROM heroes AS h WHERE h.hero_id = p.hero_id) AS hero,
       p.hero_id AS picked, coalesce(p.win, FALSE) AS won, p.win IS NOT NULL AS judged, m.match_id AS game,
       coalesce(m.duration / CAST(60 AS DOUBLE) < (SELECT {med(pm("duration"), 0.75)} FROM matches), FALSE) AS short
FROM players AS p LEFT JOIN matches AS m USING (match_id)"""


def _side(condition: str) -> tuple[str, str, str]:
    """Games, wins and rows of the facts under a condition."""
    return (f"count(DISTINCT game) FILTER (WHERE {condition})",
            f"CASE WHEN count(*) FILTER (WHERE {condition} AND judged) > 0 "
            f"THEN count(*) FILTER (WHERE {condition} AND won) END",
            f"count(*) FILTER (WHERE {condition})")


_LONG, _SHORT, _ALL = _side("NOT short"), _side("short"), _side("TRUE")

M4_ROLES = ["matches", "players", "heroes"]
M4_BODY = f"""
WITH facts AS ({HERO_FACTS}),
hero AS (
  SELECT hero, {_LONG[0]} AS games_l, {_SHORT[0]} AS games_s,
         {rate(_LONG[1], _LONG[0])} AS rate_l, {rate(_SHORT[1], _SHORT[0])} AS rate_s,
         {rate("count(picked)", "(SELECT count(picked) FROM facts)")} AS share,
         {rate(_ALL[1], _ALL[2])} AS rate_all
  FROM facts GROUP BY hero),
limits AS (SELECT {med("rate_all", 0.75)} AS high, {med("share", 0.25)} AS low FROM hero),
shown AS (
  SELECT hero.* EXCLUDE (share, rate_all), CASE WHEN hero IS NOT NULL THEN share END AS share,
         CASE WHEN hero IS NOT NULL THEN rate_all END AS rate_all
  FROM hero)
SELECT hero AS localized_name, CAST(rate_l AS DOUBLE) AS winrate_late, CAST(rate_s AS DOUBLE) AS winrate_normal,
       CAST(games_l AS BIGINT) AS match_count_late, CAST(games_s AS BIGINT) AS match_count_normal,
       CAST(round(coalesce(rate_l, 0) - coalesce(rate_s, 0), 2) AS DOUBLE) AS winrate_diff_pct,
       CAST(share AS DOUBLE) AS pickup_rate,
       (SELECT 1 + count(DISTINCT coalesce(o.share, 1e9)) FROM shown AS o
        WHERE coalesce(o.share, 1e9) > coalesce(s.share, 1e9)) AS rank_pickup_rate,
       CAST(rate_all AS DOUBLE) AS winrate_overall,
       CASE WHEN rate_all > high THEN '1' ELSE '0' END AS winrate_best_flag,
       CASE WHEN share < low THEN '1' ELSE '0' END AS pickup_worst_flag
FROM shown AS s, limits
ORDER BY share DESC NULLS FIRST"""
M4 = with_roles(M4_ROLES, M4_BODY)

M5_ROLES = ["matches", "players", "players_stat"]
M5_BODY = f"""
WITH gold AS (
  SELECT match_id, is_radiant, CAST(sum(coalesce(gold_per_min, 0)) AS BIGINT) AS gold
  FROM players LEFT JOIN players_stat USING (match_id, player_slot)
  GROUP BY match_id, is_radiant),
placed AS (
  SELECT gold, duration, coalesce(is_radiant = radiant_win, FALSE) AS won,
         row_number() OVER (ORDER BY gold, match_id, is_radiant) - 1 AS place, count(*) OVER () AS teams
  FROM gold JOIN matches USING (match_id)),
tiled AS (
  -- the first (teams % 10) tiles hold one row more than the others
  SELECT gold, duration, won, 1 + CASE WHEN place < (teams % 10) * (teams // 10 + 1)
           THEN place // (teams // 10 + 1)
           ELSE teams % 10 + (place - (teams % 10) * (teams // 10 + 1)) // (teams // 10) END AS tile
  FROM placed)
SELECT {bins9("duration")} AS duration_bin_small, CAST(tile AS BIGINT) AS gpm_decile,
       {pct2("count(*) FILTER (WHERE won)", "count(*)")} AS winrate, count(*) AS team_rows,
       {avg2("gold")} AS avg_team_gpm,
       {r2("CAST(sum(duration) AS DECIMAL(24,0)) / nullif(count(duration) * 60, 0)")} AS avg_duration_min
FROM tiled GROUP BY 1, 2 ORDER BY gpm_decile DESC"""
M5 = with_roles(M5_ROLES, M5_BODY)

_M6_METRICS = ["kills_per_min", "deaths", "assists", "denies", "gold_per_min", "xp_per_min",
               "hero_damage_per_min", "hero_healing_per_min", "tower_damage_per_min"]
_M6_SIXTIETHS = {"kills_per_min": "kills", "hero_damage_per_min": "hero_damage",
                 "hero_healing_per_min": "hero_healing", "tower_damage_per_min": "tower_damage"}
_M6_KEYS = ["is_named", "duration_bin_small"]

M6_ROLES = ["matches", "players", "players_stat"]
M6_BODY = f"""
WITH {long_stats(f'''
  SELECT CASE WHEN steam_id IS NULL OR personaname IS NULL THEN 'unknown' ELSE 'named' END AS is_named,
         {bins9("duration")} AS duration_bin_small, win, duration // 60 AS whole,
         {", ".join(f"{pm(_M6_SIXTIETHS[c]) if c in _M6_SIXTIETHS else c} AS {c}" for c in _M6_METRICS)}
  FROM {_PLAYED}''', _M6_KEYS, ["whole", *_M6_METRICS])},
wins AS (
  SELECT is_named, duration_bin_small,
         {pct2("count(*) FILTER (WHERE win)", "count(win)")} AS avg_winrate
  FROM wide GROUP BY ALL)
SELECT is_named, duration_bin_small, {told("whole", "mean")} AS avg_duration,
       any_value(avg_winrate) AS avg_winrate,
       {", ".join(f"{told(c, 'middle')} AS median_{c}, {told(c, 'mean')} AS avg_{c}" for c in _M6_METRICS)}
FROM told JOIN wins USING (is_named, duration_bin_small)
GROUP BY is_named, duration_bin_small"""
M6 = with_roles(M6_ROLES, M6_BODY)

MART_BODIES = {
    "radiant_win_by_duration": M1_BODY,
    "regions_stat": M2_BODY,
    "win_factors": M3_BODY,
    "heroes_stat": M4_BODY,
    "gmp_winrate": M5_BODY,
    "unknown_players": M6_BODY,
}

MARTS = {
    "radiant_win_by_duration": M1,
    "regions_stat": M2,
    "win_factors": M3,
    "heroes_stat": M4,
    "gmp_winrate": M5,
    "unknown_players": M6,
}
