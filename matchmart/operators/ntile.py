"""Global ``NTILE(n) OVER (ORDER BY ...)`` by cut values.

Spark plans an un-partitioned window as ``Exchange SinglePartition``: the whole
input in one task. A range sort would spread it, but still moves every row. The
tiles only need n - 1 cuts, the last row of each tile but the last:

1. Rows are counted per value of the first order column (partial aggregation, so
   a value that a third of the rows have is one row per task). The counts are
   written in order, and cumulated over partitions; they give each cut's value and
   how far into that value's rows the cut lies.
2. Where a cut lies within a value's rows, the same is done for the remaining order
   columns over the rows of these values alone, which gives the cut row itself.
3. A row's tile is one more than the number of cuts before it: a comparison with
   n - 1 literals in generated code. The rows are neither moved nor copied.

The order is ascending with NULLs last, as in PostgreSQL. It must be a total order:
rows alike in all order columns that a cut parts fall in the lower tile.
The input is read up to three times; give it as stored rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from matchmart.session import written


def cut_ranks(total: int, n: int) -> list[int]:
    """The 1-based ranks of the last rows of all tiles that have rows after them.

    The first ``total mod n`` tiles have one row more than the others.
    """
    base, more = divmod(total, n)
    ends = (k * base + min(k, more) for k in range(1, n))
    return [r for r in ends if 0 < r < total]


def _ordered_counts(df: DataFrame, keys: list[str], partitions: int | None) -> DataFrame:
    """Distinct ``keys`` in order: ``_n`` rows each and ``_before`` rows ahead of them."""
    order = [F.col(k).asc_nulls_last() for k in keys]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    # The files fix which partition a row is in and its place there.
    counts = written(counts.withColumn("_id", F.monotonically_increasing_id()), "ntile-counts")
    counts = counts.withColumn("_part", F.shiftright("_id", 33))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("_part").agg(F.sum("_n").alias("_sum"))  # one row per partition
    sums = sums.select("_part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    own = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_ahead") + F.coalesce(F.sum("_n").over(own), F.lit(0))
    return counts.join(sums, "_part").select(*keys, "_n", before.alias("_before"))


def _holding(counts: DataFrame, ranks: list[int]) -> list[Row]:
    """The counted keys that hold one of the ranks (at most as many rows as ranks)."""
    held = [(F.col("_before") < r) & (F.col("_before") + F.col("_n") >= r) for r in ranks]
    return counts.where(reduce(Column.__or__, held)).collect()


def _same(c: Column, value) -> Column:
    return c.isNull() if value is None else c.eqNullSafe(F.lit(value))


def _behind(columns: list[Column], values: list) -> Column:
    """Whether a row's order columns come after the values, NULLs last; never NULL."""
    c, v = columns[0], values[0]
    after = F.lit(False) if v is None else F.coalesce(c > F.lit(v), F.lit(True))
    if len(values) == 1:
        return after
    return after | (_same(c, v) & _behind(columns[1:], values[1:]))


def cuts(df: DataFrame, n: int, keys: list[str], partitions: int | None = None) -> list[list]:
    """Values of the order columns at each cut: the first alone where all its rows lie before
    the cut, else all of them."""
    first, rest = keys[:1], keys[1:]
    counts = _ordered_counts(df.select(*keys), first, partitions)
    ranks = cut_ranks(counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0], n)
    if not ranks:
        return []
    values = {r: row for row in _holding(counts, ranks) for r in ranks
              if row["_before"] < r <= row["_before"] + row["_n"]}
    found = {r: [row[0]] for r, row in values.items() if r == row["_before"] + row["_n"]}
    parted = {r: row for r, row in values.items() if r not in found}
    if rest and parted:
        one = F.col(first[0])
        # The rows of these values, in order; a value's rows start where the smaller values' end.
        inside = {row[0]: (row["_n"], row["_before"]) for row in parted.values()}
        some = df.select(*keys).where(reduce(Column.__or__, [_same(one, v) for v in inside]))
        ties = _ordered_counts(some, keys, partitions)
        start, at = 0, {}
        for v, (size, before) in sorted(inside.items(), key=lambda x: x[1][1]):
            at[v] = start - before
            start += size
        wanted = {r: r + at[row[0]] for r, row in parted.items()}
        rows = _holding(ties, list(wanted.values()))
        for r, rank in wanted.items():
            row = next(x for x in rows if x["_before"] < rank <= x["_before"] + x["_n"])
            found[r] = list(row[:len(keys)])
    else:
        found.update((r, [row[0]]) for r, row in parted.items())
    return [found[r] for r in ranks]


def ntile(df: DataFrame, n: int, order: Sequence[str], out_col: str = "tile",
          partitions: int | None = None) -> DataFrame:
    """Adds ``out_col`` (bigint) = NTILE(n) over the columns ``order`` across the whole input."""
    keys = list(order)
    tile = F.lit(1).cast("long")
    for values in cuts(df, n, keys, partitions):
        tile = tile + _behind([F.col(k) for k in keys[:len(values)]], values).cast("long")
    return df.withColumn(out_col, tile)
