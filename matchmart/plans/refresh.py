"""Refresh of all six marts with the shared fact join computed once.

``win_factors``, ``gmp_winrate`` and ``unknown_players`` all start from
``matches ⟕ players ⟕ players_stat``. Refreshed one by one, that join (with
its shuffles of the two largest tables) runs three times; here it is written
once to a staging folder under the shared checkpoint dir and the three marts
read the staged copy. ``heroes_stat`` (players ⟕ matches, a different outer
side), ``radiant_win_by_duration`` and ``regions_stat`` (matches only) are
built from the tables directly. Each mart is still published on its own, and
one failure does not stop the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchmart.plans import marts, publish
from matchmart.session import scratch_path


def mart_builders(spark: SparkSession, tables: dict[str, DataFrame],
                  staging: str | None = None) -> dict[str, publish.MartFn]:
    """Name → zero-argument builder, sharing one staged fact table."""
    m, p, s, h = (tables["matches"], tables["players"], tables["players_stat"],
                  tables["heroes"])
    staging = staging or scratch_path(spark, "mart-facts")
    state: dict[str, DataFrame] = {}

    def facts() -> DataFrame:
        if "facts" not in state:
            marts.match_player_facts(m, p, s).write.mode("overwrite").option(
                "compression", "zstd").parquet(staging)
            state["facts"] = spark.read.parquet(staging)
        return state["facts"]

    return {
        "radiant_win_by_duration": lambda: marts.radiant_win_by_duration(m),
        "regions_stat": lambda: marts.regions_stat(m),
        "win_factors": lambda: marts.win_factors_from_facts(facts()),
        "heroes_stat": lambda: marts.heroes_stat(m, p, h),
        "gmp_winrate": lambda: marts.gmp_winrate_from_teams(
            marts.team_stats_from_facts(facts())),
        "unknown_players": lambda: marts.unknown_players_from_facts(facts()),
    }


def refresh_marts(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Recompute and publish all six marts; one status row per mart."""
    return publish.refresh_all(spark, root, mart_builders(spark, tables))
