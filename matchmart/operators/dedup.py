"""Duplicate removal.

``first_per_key`` is the distributed form of pandas ``drop_duplicates(subset,
keep='first')``. "First" has no meaning on a partitioned input, so callers
give a total order; the row kept is the minimum of that order. It is written
as ``min(struct(order...))`` per key, an aggregate that Spark combines on the
map side before the shuffle, so a key holding a third of all rows still
shuffles only one row per input partition (a window would move them all).

An aggregate with text or structs in its buffer sorts its input, and shuffles whole
rows. Where the rows are stored, ``first_per_stored_key`` does that for duplicated
keys alone: a hash aggregate over the key columns finds and writes these, and all other
rows pass by, neither sorted nor shuffled. With many duplicated keys, which no task can
hold, all rows are shuffled, once.
"""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchmart.session import written

#: duplicated keys that every task may hold in memory
MANY_KEYS = 500_000


def distinct_rows(df: DataFrame) -> DataFrame:
    """Full-row dedup (``drop_duplicates()`` with no subset)."""
    return df.dropDuplicates()


def first_per_key(df: DataFrame, keys: Sequence[str],
                  order: Sequence[str] | None = None) -> DataFrame:
    """Keep one row per key: the smallest by ``order`` (default: all other columns).

    The order is SQL's ``ORDER BY … ASC``: NULLs sort last, as in PostgreSQL
    (each order column enters the struct as ``(is NULL, value)``, because a
    struct on its own compares NULL fields first). Column order of the input
    is preserved.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    order = list(order) if order is not None else rest
    tail = [c for c in rest if c not in order]
    fields = []
    for i, c in enumerate(order):
        fields += [F.col(c).isNull().alias(f"_n{i}"), F.col(c)]
    fields += [F.col(c) for c in tail]
    packed = F.min(F.struct(*fields)).alias("_first")
    agg = df.groupBy(*keys).agg(packed)
    return agg.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c)
                        for c in df.columns])


def first_per_stored_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """The rows of ``first_per_key``, for frames that are cheap to read again: the keys are
    read first (at once), columns that the caller does not use only for duplicated keys."""
    names = [f"_key{i}" for i in range(len(keys))]
    again = written(duplicate_keys(df, keys).select(*[F.col(k).alias(n) for k, n in zip(keys, names)]),
                    "duplicate-keys")
    many = again.count()
    if many == 0:
        return df
    if many > MANY_KEYS:
        return first_per_key(df, keys, order)
    again = F.broadcast(again)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    first = first_per_key(df.join(again, same, "left_semi"), keys, order)
    return df.join(again, same, "left_anti").unionByName(first)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their multiplicity."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_rows") > 1))
