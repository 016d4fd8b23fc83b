"""Incremental maintenance of a mart from a mergeable histogram state.

A daily batch is tiny next to the history, so recomputing ``regions_stat``
from every match each day costs the whole table for a few new rows. Its
statistics - counts, exact sums and means, exact medians - are all read off
the per-(group, metric, value) histogram, and histograms of disjoint inputs
merge by adding counts. So the state is the histogram: each batch adds its
own histogram (``merge_histograms``: a union and a map-side combined sum,
sized by distinct values, not rows), the merged state is committed as the version
after the one it was read from, and the mart is read off the state. If another
writer was faster, the batch is merged again with what that one committed, so no
batch is lost.

The marts over players start from ``matches ⟕ players ⟕ players_stat``, whose rows
change when players or statistics come after their match: the match-only row gives way to
player rows, a row without statistics to one with them. ``add_load`` takes the touched matches'
rows of before back (negative counts) and adds their rows of after; only matches with
an id in the load are read from the stored tables.

``match_count`` (COUNT(DISTINCT match_id)) equals the state's row count
because the load is insert-ignore on ``match_id``: a match reaches the state
once, in the batch that first loaded it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchmart.functions.numeric import (
    duration_category, pct2, per_minute_hundredths, to_out,
)
from matchmart.operators.quantiles import merge_histograms, metric_histogram, stats_from_histogram
from matchmart.plans import marts, publish
from matchmart.session import written

def regions_histogram(matches: DataFrame) -> DataFrame:
    return metric_histogram(marts.region_rows(matches), marts.REGION_KEYS,
                            marts.REGION_METRICS, scaled=True)


def regions_stat_from_state(state: DataFrame) -> DataFrame:
    """The regions mart read off the histogram state."""
    stats = stats_from_histogram(state, marts.REGION_KEYS, marts.REGION_METRICS)
    return marts.regions_stat_from(stats.withColumn("match_count", F.col("rows")))


def radiant_histogram(matches: DataFrame) -> DataFrame:
    """State of the win-share mart: per category, matches won by radiant (NULL → 0)."""
    d = matches.select(
        duration_category(per_minute_hundredths("duration")).alias("duration_category"),
        F.when(F.col("radiant_win"), F.lit(100)).otherwise(F.lit(0)).cast("long").alias("rw"))
    return metric_histogram(d, ["duration_category"], ["rw"], scaled=True)


def radiant_win_from_state(state: DataFrame) -> DataFrame:
    """The win-share mart read off its state (COUNT(match_id) = rows: ids are keys)."""
    stats = stats_from_histogram(state, ["duration_category"], ["rw"], quantiles={})
    wins = F.col("rw_sum").cast("bigint")
    return stats.select("duration_category", wins.alias("radiant_win_sum"),
                        F.col("rows").alias("match_count"),
                        to_out(pct2(wins, F.col("rows"))).alias("win_share_radiant"))


_CHANGE = "_change"


def win_factors_histogram(facts: DataFrame) -> DataFrame:
    return metric_histogram(marts.win_factor_rows(facts, _CHANGE), ["win"], marts.WIN_FACTOR_METRICS,
                            scaled=True, weight=_CHANGE)


def win_factors_from_state(state: DataFrame) -> DataFrame:
    return marts.win_factors_from(stats_from_histogram(state, ["win"], marts.WIN_FACTOR_METRICS))


_UNKNOWN_METRICS = ["duration_min", "win", *marts.UNKNOWN_METRICS]


def unknown_players_histogram(facts: DataFrame) -> DataFrame:
    return metric_histogram(marts.unknown_player_rows(facts, _CHANGE), marts.UNKNOWN_KEYS, _UNKNOWN_METRICS,
                            scaled=True, weight=_CHANGE)


def unknown_players_from_state(state: DataFrame) -> DataFrame:
    return marts.unknown_players_from(stats_from_histogram(state, marts.UNKNOWN_KEYS, _UNKNOWN_METRICS))


def fact_changes(before: dict[str, DataFrame] | None, load: dict[str, DataFrame]) -> DataFrame:
    """Fact rows that a load takes back (``_change`` -1) and adds (1).

    ``before`` and ``load`` hold matches, players and players_stat; the load's keys are new.
    """
    touched = load["matches"].select("match_id")
    for name in ("players", "players_stat"):
        touched = touched.union(load[name].select("match_id"))
    touched = touched.distinct()

    def facts(tables: dict[str, DataFrame], change: int) -> DataFrame:
        some = {n: t.join(touched, "match_id", "left_semi") for n, t in tables.items()}
        rows = marts.match_player_facts(some["matches"], some["players"], some["players_stat"])
        return rows.withColumn(_CHANGE, F.lit(change).cast("long"))

    if before is None:
        return facts(load, 1)
    after = {n: before[n].unionByName(load[n]) for n in load}
    return facts(before, -1).unionByName(facts(after, 1))


# mart name → (histogram of fact changes, read-out of the merged state)
FACT_STATES = {
    "win_factors": (win_factors_histogram, win_factors_from_state),
    "unknown_players": (unknown_players_histogram, unknown_players_from_state),
}

# mart name → (histogram of new matches, read-out of the merged state)
STATES = {
    "regions_stat": (regions_histogram, regions_stat_from_state),
    "radiant_win_by_duration": (radiant_histogram, radiant_win_from_state),
}


def _state_name(mart: str) -> str:
    return f"{mart}_state"


def current_state(spark: SparkSession, root: str,
                  mart: str = "regions_stat") -> DataFrame | None:
    name = _state_name(mart)
    if publish.current_version(spark, root, name) is None:
        return None
    return publish.current(spark, root, name)


def add_batch(spark: SparkSession, root: str, new_matches: DataFrame,
              mart: str = "regions_stat", batch: str | None = None) -> DataFrame:
    """Merge the histogram of newly loaded matches into the state; returns the new state.

    ``batch`` names the batch. The names that a state holds are kept with its
    version, and a batch that is added again (a replay) changes nothing.
    """
    return _commit(spark, root, mart, lambda: STATES[mart][0](new_matches), batch)


def add_load(spark: SparkSession, root: str, mart: str, before: dict[str, DataFrame] | None,
             load: dict[str, DataFrame], batch: str | None = None) -> DataFrame:
    """Merge what a load changes in a mart over players into its state; returns the new state.

    ``before`` holds matches, players and players_stat as they were before the load (None:
    nothing), ``load`` the rows that it added to each; either may come first, a match or its players.
    """
    return _commit(spark, root, mart, lambda: FACT_STATES[mart][0](fact_changes(before, load)), batch)


def _commit(spark: SparkSession, root: str, mart: str, histogram: Callable[[], DataFrame],
            batch: str | None) -> DataFrame:
    name, hist = _state_name(mart), None
    while True:
        base = publish.current_version(spark, root, name) or 0
        held = publish.mark(spark, root, name, base) if base else {"note": "[]"}
        applied = json.loads(held["note"] or "[]")
        if batch is not None and batch in applied:
            return publish.version(spark, root, name, base)
        hist = written(histogram(), "batch-histogram") if hist is None else hist
        merged = merge_histograms(publish.version(spark, root, name, base), hist) if base else hist
        names = applied if batch is None else [*applied, batch]
        try:
            number = publish.publish(spark, root, name, merged, json.dumps(names), after=base, view=False)
        except publish.Conflict:
            continue
        publish.vacuum(spark, root, name)
        return publish.version(spark, root, name, number)


def mart_from_state(spark: SparkSession, root: str, mart: str) -> DataFrame:
    read = (STATES | FACT_STATES)[mart][1]
    return read(current_state(spark, root, mart))
