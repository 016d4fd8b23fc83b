"""Key-integrity checks (set differences) and the foreign-key filter.

Every check is an anti join against the *distinct* keys of the other side
(de-duplicated map-side first), so no key set is ever built on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_keys(child: DataFrame, parent: DataFrame, keys: Sequence[str],
                 parent_keys: Sequence[str] | None = None, drop_null: bool = True) -> DataFrame:
    """Distinct ``keys`` of ``child`` with no match in ``parent`` (set A − B).

    ``drop_null`` ignores child rows whose key has a NULL (``dropna()``).
    """
    keys = list(keys)
    pk = list(parent_keys) if parent_keys else keys
    a = child.select(*keys)
    if drop_null:
        a = a.dropna()
    a = a.distinct()
    b = parent.select(*[F.col(p).alias(k) for p, k in zip(pk, keys)]).distinct()
    return a.join(b, keys, "left_anti")


def with_children(parent: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """Parent rows that have at least one child (``isin`` / semi join)."""
    return parent.join(child.select(key).distinct(), key, "left_semi")


def key_check(name: str, child: DataFrame, parent: DataFrame, keys: Sequence[str],
              parent_keys: Sequence[str] | None = None) -> DataFrame:
    """One row: distinct non-NULL keys in child and parent, and child keys missing in parent.

    Both key sets are de-duplicated map-side, then matched with one full
    outer join; the three counts come out of a single aggregate.
    """
    keys = list(keys)
    pk = list(parent_keys) if parent_keys else keys
    a = child.select(*keys).dropna().distinct().withColumn("_a", F.lit(1))
    b = (parent.select(*[F.col(p).alias(k) for p, k in zip(pk, keys)]).dropna().distinct()
         .withColumn("_b", F.lit(1)))
    j = a.join(b, keys, "full_outer")
    return j.agg(
        F.count("_a").alias("child_keys"),
        F.count("_b").alias("parent_keys"),
        F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNull(), F.lit(1)))
        .alias("missing"),
    ).select(F.lit(name).alias("check"), "child_keys", "parent_keys", "missing")


def fk_report(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per check: name, distinct keys on each side, missing count.

    ``tables`` holds matches, players, players_stat, players_items, heroes, items.
    All six checks run as one job: every key set is mapped onto a common
    ``(check, k1, k2)`` layout, the child sets and parent sets are each
    unioned and de-duplicated, then matched with a single full outer join and
    counted with a single aggregate grouped by check.
    """
    t = tables
    checks = [
        ("matches_without_players", t["matches"], t["players"], ["match_id"]),
        ("players_without_match", t["players"], t["matches"], ["match_id"]),
        ("players_without_stat", t["players"], t["players_stat"], ["match_id", "player_slot"]),
        ("players_without_items", t["players"], t["players_items"], ["match_id", "player_slot"]),
        ("hero_not_in_heroes", t["players"], t["heroes"], ["hero_id"]),
        ("item_not_in_items", t["players_items"], t["items"], ["item_id"]),
    ]

    def common(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
        k2 = F.col(keys[1]).cast("bigint") if len(keys) > 1 else F.lit(0).cast("bigint")
        return (df.select(*keys).dropna()
                .select(F.lit(name).alias("check"), F.col(keys[0]).cast("bigint").alias("k1"),
                        k2.alias("k2")))

    child = parent = None
    for name, c, p, keys in checks:
        a, b = common(c, name, keys), common(p, name, keys)
        child = a if child is None else child.unionByName(a)
        parent = b if parent is None else parent.unionByName(b)
    a = child.distinct().withColumn("_a", F.lit(1))
    b = parent.distinct().withColumn("_b", F.lit(1))
    j = a.join(b, ["check", "k1", "k2"], "full_outer")
    counts = j.groupBy("check").agg(
        F.count("_a").alias("child_keys"),
        F.count("_b").alias("parent_keys"),
        F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNull(), F.lit(1)))
        .alias("missing"),
    )
    # every check gets a row, even when both of its key sets are empty
    names = [F.lit(n) for n, *_ in checks]
    all_checks = child.sparkSession.range(1).select(F.explode(F.array(*names)).alias("check"))
    return (all_checks.join(counts, "check", "left")
            .select("check", *[F.coalesce(F.col(c), F.lit(0)).alias(c)
                               for c in ("child_keys", "parent_keys", "missing")]))
