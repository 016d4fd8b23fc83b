"""Join helpers that keep to Spark's skew and broadcast rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def join_dim(fact: DataFrame, dim: DataFrame, on, how: str = "left") -> DataFrame:
    """Fact ⟕ dimension. No hint: AQE broadcasts the dimension if its size at run time
    is under the session's limit, and otherwise shuffles and splits hot keys."""
    return fact.join(dim, on, how)


def left_join_children(parent: DataFrame, child: DataFrame, key: str,
                       flag: str | None = None) -> DataFrame:
    """``parent LEFT JOIN child USING (key)`` written so a hot key can be split.

    AQE can split a skewed partition only on the preserved side of an outer
    join, but here the rows pile up on the child side. So the join is
    ``parent ⋈ child`` (inner: AQE splits either side) plus the parents with
    no child, found with an anti join against the *distinct* child keys
    (de-duplicated map-side first, so a hot key shrinks before the shuffle).
    ``flag`` names an optional boolean column telling the two parts apart.
    """
    inner = parent.join(child, key, "inner")
    child_keys = child.select(key).where(F.col(key).isNotNull()).distinct()
    lonely = parent.join(child_keys, key, "left_anti")
    pad = [F.lit(None).cast(f.dataType).alias(f.name)
           for f in child.schema.fields if f.name != key]
    lonely = lonely.select("*", *pad)
    if flag:  # True where a child row was joined (the inner-join rows)
        inner, lonely = inner.withColumn(flag, F.lit(True)), lonely.withColumn(flag, F.lit(False))
    return inner.unionByName(lonely)


def join_on_group(left: DataFrame, right: DataFrame, keys: Sequence[str],
                  how: str = "left") -> DataFrame:
    """Join two per-group results on group keys that may be NULL (NULL = NULL here)."""
    keys = list(keys)
    if not keys:
        raise ValueError("join_on_group needs at least one group key")
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def left_join_slots(players: DataFrame, other: DataFrame) -> DataFrame:
    """``players ⟕ other`` by (match_id, player_slot), dealt by the match alone.

    The slot is compared by a difference, which is no join key, so what follows by match
    (a second table by slot, sums or lists per match) deals no row again.
    """
    own = other.withColumnsRenamed({"match_id": "_match", "player_slot": "_slot"})
    slot = (F.col("player_slot").cast("long") - F.col("_slot").cast("long")) == 0
    return players.join(own, (F.col("match_id") == F.col("_match")) & slot, "left").drop("_match", "_slot")
