"""The six analytic marts, as DataFrame functions over warehouse tables.

Shared rules (see ``functions.numeric``): per-row values are rounded to two
places *before* averaging or taking medians, averages and ratios are exact
decimals rounded once, medians use PostgreSQL's ``percentile_cont``
interpolation, ``ORDER BY … DESC`` puts NULLs first, and an empty
denominator gives NULL. Outputs are cast to plain types (double for rounded
numbers, bigint for counts).

Scale notes: all groupings are few and possibly hot (``win`` has three
groups), so every aggregate is map-side combinable and medians come from
value histograms (``operators.quantiles``); the global NTILE goes by cut
values (``operators.ntile``); the hero dimension is broadcast by AQE if
it is small at run time; windows without PARTITION BY only ever run over one row per
hero (and, inside NTILE, over one row per partition).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchmart.functions.lookup import region_name
from matchmart.functions.numeric import (
    avg2, bool_sum, cond_sum, duration_bin_small, duration_category, hundredths,
    minutes_double, pct2, per_minute, per_minute_hundredths, round2, safe_div, to_out,
    whole_minutes,
)
from matchmart.operators.joins import join_dim, left_join_slots
from matchmart.operators.ntile import ntile
from matchmart.operators.quantiles import metric_stats, scalar_quantile
from matchmart.session import written

MART_NAMES = ("radiant_win_by_duration", "regions_stat", "win_factors", "heroes_stat",
              "gmp_winrate", "unknown_players")


# --------------------------------------------------------------------------- facts

def player_stats(players: DataFrame, players_stat: DataFrame) -> DataFrame:
    """``players ⟕ players_stat`` on the composite key (keys from the player side).

    The slot is compared by a difference, which is not a join key: both sides are then dealt
    by the match alone, as all that follows is (sums per match and side, the join with matches),
    so the joined rows, the widest there are, are not dealt again. A match meets at most a
    slot's domain of rows. Tables that are bucketed by match are not dealt at all.
    """
    return left_join_slots(players, players_stat)


HAS_PLAYER = "has_player"


def match_player_facts(matches: DataFrame, players: DataFrame,
                       players_stat: DataFrame) -> DataFrame:
    """``matches ⟕ players ⟕ players_stat``: a match without players keeps one row.

    A match has a handful of players by the key (match_id, player_slot), so no
    key is hot and each table is read once. ``has_player`` tells the joined rows
    (the inner join) from the match-only rows. This one fact table feeds win_factors, gmp_winrate and
    unknown_players (see ``plans.refresh``).
    """
    p = player_stats(players, players_stat).withColumn(HAS_PLAYER, F.lit(True))
    return (matches.join(p, "match_id", "left")
            .withColumn(HAS_PLAYER, F.coalesce(HAS_PLAYER, F.lit(False))))


def _mean(m: str):
    return to_out(F.col(f"{m}_avg2"))


def _median(m: str, rounded: bool):
    c = F.col(f"{m}_p50")
    return to_out(round2(c)) if rounded else c


# --------------------------------------------------------------------------- M1

def radiant_win_by_duration(matches: DataFrame) -> DataFrame:
    """Radiant win share per 7-bin match-length category (rounded minutes)."""
    d = matches.select("match_id", "radiant_win",
                       duration_category(per_minute_hundredths("duration"))
                       .alias("duration_category"))
    wins = cond_sum("radiant_win")
    return d.groupBy("duration_category").agg(
        wins.alias("radiant_win_sum"),
        F.count("match_id").alias("match_count"),
        to_out(pct2(wins, F.count("match_id"))).alias("win_share_radiant"),
    )


# --------------------------------------------------------------------------- M2

REGION_KEYS = ["region", "region_name"]
REGION_METRICS = ["duration_min", "first_blood_time", "rw"]


def region_rows(matches: DataFrame) -> DataFrame:
    """Per-match values of the regions mart, metrics as exact hundredths."""
    return matches.select(
        "match_id", "region", region_name("region").alias("region_name"),
        per_minute_hundredths("duration").alias("duration_min"),
        per_minute_hundredths("first_blood_time").alias("first_blood_time"),
        hundredths("radiant_win").alias("rw"),
    )


def regions_stat(matches: DataFrame) -> DataFrame:
    """Per region: match count, duration and first-blood medians/means, radiant wins."""
    d = region_rows(matches)
    keys = REGION_KEYS
    # matches is keyed by match_id (the load is insert-ignore on it): rows are matches
    stats = metric_stats(d, keys, REGION_METRICS, scaled=True)
    return regions_stat_from(stats.withColumnRenamed("rows", "match_count"))


def regions_stat_from(out: DataFrame) -> DataFrame:
    """Output columns of the regions mart from per-group statistics + match_count."""
    return out.select(
        "region", "region_name", "match_count",
        _median("duration_min", True).alias("duration_median"),
        _mean("duration_min").alias("duration_mean"),
        _median("first_blood_time", True).alias("first_blood_time_median"),
        _mean("first_blood_time").alias("first_blood_time_mean"),
        F.col("rw_sum").cast("bigint").alias("radiant_wins"),
        to_out(pct2(F.col("rw_sum"), F.col("rw_n"))).alias("radiant_win_rate_pct"),
    )


# --------------------------------------------------------------------------- M3

WIN_FACTOR_METRICS = ["tower_damage", "hero_damage", "gold_per_min", "xp_per_min",
                      "last_hits", "assists", "kills", "deaths", "first_blood_time"]


def win_factors(matches: DataFrame, players: DataFrame, players_stat: DataFrame) -> DataFrame:
    """Mean and median of player statistics for winners, losers and no-player matches."""
    return win_factors_from_facts(match_player_facts(matches, players, players_stat))


def win_factor_rows(facts: DataFrame, *more: str) -> DataFrame:
    """Per-row values of the win-factors mart, metrics as exact hundredths."""
    return facts.select(
        *more, "win",
        per_minute_hundredths("tower_damage").alias("tower_damage"),
        per_minute_hundredths("hero_damage").alias("hero_damage"),
        *[hundredths(c).alias(c) for c in ["gold_per_min", "xp_per_min", "last_hits",
                                            "assists", "kills", "deaths"]],
        per_minute_hundredths("first_blood_time").alias("first_blood_time"),
    )


def win_factors_from_facts(facts: DataFrame) -> DataFrame:
    return win_factors_from(metric_stats(win_factor_rows(facts), ["win"], WIN_FACTOR_METRICS, scaled=True))


def win_factors_from(stats: DataFrame) -> DataFrame:
    """Output columns of the win-factors mart from per-group statistics."""
    cols = ["win"]
    for c in WIN_FACTOR_METRICS:
        cols += [_mean(c).alias(f"{c}_mean"), _median(c, True).alias(f"{c}_median")]
    return stats.select(*cols)


# --------------------------------------------------------------------------- M4

def heroes_stat(matches: DataFrame, players: DataFrame, heroes: DataFrame) -> DataFrame:
    """Hero win rates in normal vs late games, pick rate, rank and outlier flags."""
    # 0.75 quantile of rounded match minutes: a scalar subquery, run once
    thr = scalar_quantile(matches, per_minute("duration"), 0.75).scalar()

    h = heroes.select("hero_id", "localized_name")
    p = join_dim(players.select("match_id", "hero_id", "win"), h, "hero_id", "left")
    m = matches.select(F.col("match_id").alias("m_match_id"), "duration")
    base = p.join(m, p["match_id"] == m["m_match_id"], "left").select(
        "localized_name", "hero_id", "m_match_id", "win",
        F.when(minutes_double("duration") < thr, F.lit("normal")).otherwise(F.lit("late"))
        .alias("duration_bin"))

    per_bin = base.groupBy("localized_name", "duration_bin").agg(
        F.count_distinct("m_match_id").alias("mc"),
        bool_sum("win").alias("wins"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count("hero_id").alias("picks"),
    ).withColumn("wr", pct2(F.col("wins"), F.col("mc")))

    late, normal = F.col("duration_bin") == "late", F.col("duration_bin") == "normal"
    per_hero = per_bin.groupBy("localized_name").agg(
        F.max(F.when(late, F.col("wr"))).alias("winrate_late"),
        F.max(F.when(normal, F.col("wr"))).alias("winrate_normal"),
        F.coalesce(F.max(F.when(late, F.col("mc"))), F.lit(0)).alias("match_count_late"),
        F.coalesce(F.max(F.when(normal, F.col("mc"))), F.lit(0)).alias("match_count_normal"),
        F.sum("picks").alias("picks"),
        F.sum("wins").alias("wins"),
        F.sum("n_rows").alias("n_rows"),
    )
    # Everything below runs over one row per hero (bounded by the dimension).
    everyone = Window.partitionBy()
    total_picks = F.sum("picks").over(everyone)
    per_hero = per_hero.select(
        "*",
        F.round(F.coalesce(F.col("winrate_late"), F.lit(0))
                - F.coalesce(F.col("winrate_normal"), F.lit(0)), 2).alias("winrate_diff_pct"),
        pct2(F.col("picks"), total_picks).alias("pickup_rate_all"),
        pct2(F.col("wins"), F.col("n_rows")).alias("winrate_overall_all"),
    )
    per_hero = per_hero.select(
        "*",
        F.percentile(F.col("winrate_overall_all").cast("double"), 0.75).over(everyone)
        .alias("best_thr"),
        F.percentile(F.col("pickup_rate_all").cast("double"), 0.25).over(everyone)
        .alias("worst_thr"),
    )
    named = F.col("localized_name").isNotNull()   # USING joins never match NULL
    pickup = F.when(named, F.col("pickup_rate_all"))
    overall = F.when(named, F.col("winrate_overall_all"))
    flag = lambda c: F.when(c, F.lit("1")).otherwise(F.lit("0"))
    out = per_hero.select(
        "localized_name",
        to_out(F.col("winrate_late")).alias("winrate_late"),
        to_out(F.col("winrate_normal")).alias("winrate_normal"),
        F.col("match_count_late").cast("bigint").alias("match_count_late"),
        F.col("match_count_normal").cast("bigint").alias("match_count_normal"),
        to_out(F.col("winrate_diff_pct")).alias("winrate_diff_pct"),
        to_out(pickup).alias("pickup_rate"),
        F.dense_rank().over(Window.orderBy(pickup.desc_nulls_first())).cast("bigint")
        .alias("rank_pickup_rate"),
        to_out(overall).alias("winrate_overall"),
        flag(overall > F.col("best_thr")).alias("winrate_best_flag"),
        flag(pickup < F.col("worst_thr")).alias("pickup_worst_flag"),
    )
    return out.orderBy(F.col("pickup_rate").desc_nulls_first())


# --------------------------------------------------------------------------- M5

def _team_win(df: DataFrame) -> DataFrame:
    side, rw = F.col("is_radiant"), F.col("radiant_win")
    win = (F.when((side == F.lit(True)) & (rw == F.lit(True)), F.lit(1))
           .when((side == F.lit(False)) & (rw == F.lit(False)), F.lit(1))
           .otherwise(F.lit(0)))
    return df.select("match_id", "is_radiant", "duration", "team_gpm", win.alias("win"))


def team_stats_from_facts(facts: DataFrame) -> DataFrame:
    """Team rows from the shared fact table: its joined rows are exactly
    ``matches ⋈ players ⟕ players_stat``, grouped as in the mart definition."""
    t = (facts.where(F.col(HAS_PLAYER))
         .groupBy("match_id", "is_radiant", "duration", "radiant_win")
         .agg(F.sum(F.coalesce(F.col("gold_per_min"), F.lit(0))).cast("bigint")
              .alias("team_gpm")))
    return _team_win(t)


def team_stats(matches: DataFrame, players: DataFrame, players_stat: DataFrame) -> DataFrame:
    """One row per (match, side): team gold per minute and whether that side won.

    Players are summed per (match, side) *before* joining matches, so the
    join sees at most two rows per match. This equals the mart's grouping by
    (match, side, duration, radiant_win) because ``matches`` is keyed by
    ``match_id`` (the load is insert-ignore on it).
    """
    team = (player_stats(players.select("match_id", "player_slot", "is_radiant"),
                         players_stat.select("match_id", "player_slot", "gold_per_min"))
            .groupBy("match_id", "is_radiant")
            .agg(F.sum(F.coalesce(F.col("gold_per_min"), F.lit(0))).cast("bigint")
                 .alias("team_gpm")))
    m = matches.select("match_id", "duration", "radiant_win")
    return _team_win(team.join(m, "match_id", "inner"))


def gmp_winrate(matches: DataFrame, players: DataFrame, players_stat: DataFrame,
                partitions: int | None = None) -> DataFrame:
    """Team win rate by match length bin and team-gold decile (global NTILE(10))."""
    return gmp_winrate_from_teams(team_stats(matches, players, players_stat), partitions)


def gmp_winrate_from_teams(t: DataFrame, partitions: int | None = None) -> DataFrame:
    # Two narrow rows a match, out of a join of the largest tables: written once, read by
    # the counts, the ties and the mart.
    t = ntile(written(t, "team-rows"), 10, ["team_gpm", "match_id", "is_radiant"], "gpm_decile", partitions)
    t = t.withColumn("duration_bin_small", duration_bin_small("duration"))
    n_dur = F.count("duration")
    out = t.groupBy("duration_bin_small", "gpm_decile").agg(
        to_out(pct2(F.sum("win"), F.count("win"))).alias("winrate"),
        F.count(F.lit(1)).alias("team_rows"),
        to_out(avg2("team_gpm")).alias("avg_team_gpm"),
        to_out(F.round(safe_div(F.sum("duration").cast("decimal(24,0)"), n_dur * F.lit(60)), 2))
        .alias("avg_duration_min"),
    )
    return out.select("winrate", "duration_bin_small", "gpm_decile", "team_rows",
                      "avg_team_gpm", "avg_duration_min").orderBy(F.col("gpm_decile").desc_nulls_first())


# --------------------------------------------------------------------------- M6

UNKNOWN_METRICS = ["kills_per_min", "deaths", "assists", "denies", "gold_per_min",
                   "xp_per_min", "hero_damage_per_min", "hero_healing_per_min",
                   "tower_damage_per_min"]


def unknown_players(matches: DataFrame, players: DataFrame, players_stat: DataFrame) -> DataFrame:
    """Named vs anonymous players per match-length bin: win rate, medians, means."""
    return unknown_players_from_facts(match_player_facts(matches, players, players_stat))


UNKNOWN_KEYS = ["is_named", "duration_bin_small"]


def unknown_player_rows(facts: DataFrame, *more: str) -> DataFrame:
    """Per-row values of the named-players mart, metrics as exact hundredths."""
    named = F.col("steam_id").isNotNull() & F.col("personaname").isNotNull()
    return facts.select(
        *more,
        F.when(named, F.lit("named")).otherwise(F.lit("unknown")).alias("is_named"),
        duration_bin_small("duration").alias("duration_bin_small"),
        hundredths("win").alias("win"),
        hundredths(whole_minutes("duration")).alias("duration_min"),
        per_minute_hundredths("kills").alias("kills_per_min"),
        *[hundredths(c).alias(c) for c in ["deaths", "assists", "denies", "gold_per_min",
                                            "xp_per_min"]],
        per_minute_hundredths("hero_damage").alias("hero_damage_per_min"),
        per_minute_hundredths("hero_healing").alias("hero_healing_per_min"),
        per_minute_hundredths("tower_damage").alias("tower_damage_per_min"),
    )


def unknown_players_from_facts(facts: DataFrame) -> DataFrame:
    return unknown_players_from(metric_stats(unknown_player_rows(facts), UNKNOWN_KEYS,
                                             ["duration_min", "win", *UNKNOWN_METRICS], scaled=True))


def unknown_players_from(stats: DataFrame) -> DataFrame:
    """Output columns of the named-players mart from per-group statistics."""
    m = UNKNOWN_METRICS
    return stats.select(
        *UNKNOWN_KEYS,
        _mean("duration_min").alias("avg_duration"),
        to_out(pct2(F.col("win_sum"), F.col("win_n"))).alias("avg_winrate"),
        *[_median(c, False).alias(f"median_{c}") for c in m],
        *[_mean(c).alias(f"avg_{c}") for c in m],
    )
