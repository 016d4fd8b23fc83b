"""Exact ``percentile_cont`` from mergeable value histograms.

A grouped exact percentile over raw rows sends every distinct value of a
group to one task; when a group holds a third of all rows (a mart grouped by
``win`` has three groups) that task holds a third of the data. Instead we

1. unpivot the metric columns (a narrow ``Expand``, no shuffle),
2. count rows per (group, metric, value): an aggregate with map-side combine
   whose shuffle is spread over *values*, not groups,
3. find the order statistics from cumulative counts per (group, metric);
   this touches one row per distinct value only.

Step 3 uses PostgreSQL's interpolation, ``lo + frac * (hi - lo)`` in double
precision, so results are bit-equal to its ``percentile_cont``. The
histogram (step 2) is also the refreshable state: adding new rows means
adding their counts (:func:`merge_histograms`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def value_histogram(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Long-form counts ``(keys..., metric, value, n)`` of non-NULL values (as double)."""
    keys = list(keys)
    cast = df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values])
    long = cast.unpivot(keys, list(values), "metric", "value")
    return (long.where(F.col("value").isNotNull())
            .groupBy(*keys, "metric", "value")
            .agg(F.count(F.lit(1)).alias("n")))


def merge_histograms(*hists: DataFrame) -> DataFrame:
    """Add the counts of several histograms with the same layout.

    Counts may be negative (retracted rows); a value whose counts cancel is gone.
    """
    first, *rest = hists
    u = first
    for h in rest:
        u = u.unionByName(h)
    keys = [c for c in first.columns if c != "n"]
    return u.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")


def quantile_from_histogram(hist: DataFrame, keys: Sequence[str], p: float,
                            weight: str = "n") -> DataFrame:
    """``(keys..., metric, q)``: percentile_cont(p) per (group, metric)."""
    part = [*keys, "metric"]
    cum = Window.partitionBy(*part).orderBy("value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    h = (hist.withColumn("_cum", F.sum(weight).over(cum))
         .withColumn("_tot", F.sum(weight).over(Window.partitionBy(*part))))
    pos = F.lit(float(p)) * (F.col("_tot") - F.lit(1)).cast("double")
    lo_i, hi_i = F.floor(pos), F.ceil(pos)
    picked = h.groupBy(*part).agg(
        F.min(F.when(F.col("_cum") > lo_i, F.col("value"))).alias("_lo"),
        F.min(F.when(F.col("_cum") > hi_i, F.col("value"))).alias("_hi"),
        F.first(pos - lo_i.cast("double")).alias("_frac"),
    )
    lo, hi, frac = F.col("_lo"), F.col("_hi"), F.col("_frac")
    q = F.when(frac == 0, lo).otherwise(lo + frac * (hi - lo))
    return picked.select(*part, q.alias("q"))


def grouped_quantiles(df: DataFrame, keys: Sequence[str], values: Sequence[str],
                      p: float = 0.5) -> DataFrame:
    """One row per group with a double column per metric (same names as ``values``).

    Groups in which a metric is all-NULL get NULL; a group whose metrics are
    all NULL is absent, so join the result to the group list with
    :func:`matchmart.operators.joins.join_on_group`.
    """
    hist = value_histogram(df, keys, values)
    q = quantile_from_histogram(hist, keys, p)
    return q.groupBy(*keys).pivot("metric", list(values)).agg(F.first("q"))


ROWS_METRIC = "_rows"


def _hundredths(df: DataFrame, name: str):
    """Exact value × 100 as bigint (integers and ≤2-place decimals only)."""
    dt = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return (c.cast("long") * F.lit(100)).alias(name)
    if isinstance(dt, T.BooleanType):
        return (c.cast("long") * F.lit(100)).alias(name)
    return (c.cast("decimal(20,2)") * F.lit(100)).cast("long").alias(name)


def metric_histogram(df: DataFrame, keys: Sequence[str], metrics: Sequence[str],
                     scaled: bool = False, weight: str | None = None) -> DataFrame:
    """``(keys..., metric, value, n)``: rows per exact value (hundredths, bigint).

    A row counts once, or as often as its ``weight`` column says (-1 takes it back).

    Includes the pseudo-metric ``_rows`` (value 100 per input row), so every
    group is present and COUNT(*) can be read back. Histograms of disjoint
    inputs merge by adding ``n`` (:func:`merge_histograms`).
    """
    keys, metrics = list(keys), list(metrics)
    scale = (lambda m: F.col(m).cast("long").alias(m)) if scaled else (
        lambda m: _hundredths(df, m))
    more = [] if weight is None else [weight]
    cast = df.select(*keys, *more, F.lit(100).cast("long").alias(ROWS_METRIC),
                     *[scale(m) for m in metrics])
    long = cast.unpivot([*keys, *more], [ROWS_METRIC, *metrics], "metric", "value")
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return long.where(F.col("value").isNotNull()).groupBy(*keys, "metric", "value").agg(n.alias("n"))


def stats_from_histogram(hist: DataFrame, keys: Sequence[str], metrics: Sequence[str],
                         quantiles: dict[str, float] | None = None) -> DataFrame:
    """Read counts, exact sums/means and percentiles off a metric histogram.

    Same output layout as :func:`metric_stats`.
    """
    keys, metrics = list(keys), list(metrics)
    quantiles = quantiles if quantiles is not None else {"p50": 0.5}
    part = [*keys, "metric"]
    # The histogram is dealt by (group, metric), so a hot group's metrics are read in
    # different tasks; only the one row per metric meets in the pivot.
    cum = Window.partitionBy(*part).orderBy("value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    h = (hist.withColumn("_cum", F.sum("n").over(cum))
         .withColumn("_tot", F.sum("n").over(Window.partitionBy(*part))))
    aggs = [F.first("_tot").alias("n"),
            F.sum(F.col("value") * F.col("n")).alias("total")]
    reads = []
    for name, p in quantiles.items():
        pos = F.lit(float(p)) * (F.col("_tot") - F.lit(1)).cast("double")
        lo_i, hi_i = F.floor(pos), F.ceil(pos)
        aggs += [F.min(F.when(F.col("_cum") > lo_i, F.col("value"))).alias(f"_lo_{name}"),
                 F.min(F.when(F.col("_cum") > hi_i, F.col("value"))).alias(f"_hi_{name}"),
                 F.first(pos - lo_i.cast("double")).alias(f"_fr_{name}")]
        reads.append(name)
    per = h.groupBy(*part).agg(*aggs)
    total = F.col("total").cast("decimal(20,0)")
    outs = [F.col("n"),
            (total / F.lit(100)).cast("decimal(22,2)").alias("total"),
            F.round(total / (F.col("n") * F.lit(100)).cast("decimal(20,0)"), 2).alias("avg2")]
    for name in reads:
        # hundredths / 100.0 is the double nearest the decimal value, as a cast would give
        lo = F.col(f"_lo_{name}").cast("double") / F.lit(100.0)
        hi = F.col(f"_hi_{name}").cast("double") / F.lit(100.0)
        fr = F.col(f"_fr_{name}")
        outs.append(F.when(fr == 0, lo).otherwise(lo + fr * (hi - lo)).alias(name))
    per = per.select(*part, *outs)
    stat_names = ["n", "total", "avg2", *reads]
    wide = per.groupBy(*keys).pivot("metric", [ROWS_METRIC, *metrics]).agg(
        *[F.first(s).alias(s) for s in stat_names])
    cols = [*keys, F.col(f"{ROWS_METRIC}_n").alias("rows")]
    for m in metrics:
        cols += [F.coalesce(F.col(f"{m}_n"), F.lit(0)).alias(f"{m}_n"),
                 F.col(f"{m}_total").alias(f"{m}_sum"),
                 F.col(f"{m}_avg2").alias(f"{m}_avg2"),
                 *[F.col(f"{m}_{r}").alias(f"{m}_{r}") for r in reads]]
    return wide.select(*cols)


def metric_stats(df: DataFrame, keys: Sequence[str], metrics: Sequence[str],
                 quantiles: dict[str, float] | None = None,
                 scaled: bool = False) -> DataFrame:
    """Per group, for every metric: count, exact sum, exact mean, percentiles.

    One pass over ``df``: the metrics are unpivoted and counted per value
    (map-side combined), and everything is read off that histogram, so the
    input is scanned and shuffled once whatever the number of statistics.
    Metric values must be integers or decimals with at most two places (the
    marts round per-row values to two places first); they are held as exact
    hundredths in a bigint, so hashing and sorting stay on primitive longs
    and sums/means are exact.

    Output columns: ``keys`` + ``rows`` (COUNT(*)) + for each metric ``m``:
    ``m_n`` (COUNT(m)), ``m_sum`` (SUM(m), decimal), ``m_avg2`` (ROUND(AVG(m), 2))
    and ``m_<name>`` for each entry of ``quantiles`` (double, percentile_cont).
    A group is present even when all its metrics are NULL. ``scaled=True``
    says the metric columns already hold hundredths (bigint).
    """
    hist = metric_histogram(df, keys, metrics, scaled)
    return stats_from_histogram(hist, keys, metrics, quantiles)


def scalar_quantile(df: DataFrame, value: Column | str, p: float) -> DataFrame:
    """One-row, one-column DataFrame ``q``: percentile_cont(p) over all rows."""
    v = F.col(value) if isinstance(value, str) else value
    hist = value_histogram(df.select(v.alias("v")), [], ["v"])
    return quantile_from_histogram(hist, [], p).select("q")
