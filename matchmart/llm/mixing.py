"""Mixing sources to target weights (native).

Aggregate words per source, derive each source's target and repetition rate,
then emit each document floor(rate) times plus one copy decided by a
hash-seeded coin whose probability is the fraction of the rate.

Targets: sources in code-point order, null last, get the weights 1, 2, 3,
1, 2, 3, ... and share the sum of all sizes in proportion; no target may exceed
``max_repeat`` times its source's size, what is over is shared again by weight.
That is a water level: with the sources sorted by cap/weight, the level after
the first j are capped is (total - caps) / (remaining weight), and the right
level is the largest of these values, so one pass over the per-source table
replaces the repeated resharing.

The only table that is not distributed is the one with a row per *source*.
Documents meet it in a join on the source; it is staged first, so Spark
broadcasts it only if its files are under the session's broadcast limit, and
otherwise sorts and merges, with AQE splitting a hot source's documents (each
document needs only its source's one row).

Defined cases: null text has size 0; a null source is a source of its own
(last); a source without words has target 0 and rate 1 (its documents stay
once); null ids toss a coin seeded by their text; repeated rows toss equal
coins; an empty table gives an empty table; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, col, fresh, load, stage, text_of

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Number of maximal runs without white space."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS,
                   max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, size) rows to one row per source: source, source_size, target."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.array(*[F.lit(float(x)) for x in weights])
    per = per.withColumn("nth", rank - 1).withColumn(
        "weight", F.get(w, (F.col("nth") % len(weights)).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("nth").asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything).cast("double")
             - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    per = per.withColumn("level", level)
    return per.select(
        "source", "source_size",
        F.least(F.col("cap"), F.max("level").over(everything) * F.col("weight")).alias("target"))


def coin(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id (the text, for null ids) and the seed."""
    key = F.coalesce(doc_id.cast("string"), F.md5(text.cast("binary")))
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), key).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def copies(rate: Column, toss: Column) -> Column:
    """floor(rate), and one more if the toss falls under the fraction."""
    whole = F.floor(rate)
    return (whole + F.when(toss < rate - whole, 1).otherwise(0)).cast("long")


def repetition(target: Column, source_size: Column) -> Column:
    return F.when(source_size > 0, target / source_size).otherwise(F.lit(1.0))


def mix_counts(docs: DataFrame, weights: Sequence[float] = WEIGHTS,
               max_repeat: float = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies."""
    text = text_of(docs)
    sized = stage(docs.select(
        col(docs, "doc_id").alias("doc_id"), col(docs, "source").alias("source"),
        n_words(text).alias("size"), coin(col(docs, "doc_id"), text, seed).alias("toss")),
        "mix-sizes")
    targets = stage(source_targets(sized.select("source", "size"), weights, max_repeat),
                    "mix-targets").withColumnRenamed("source", "of_source")
    rate = repetition(F.col("target"), F.col("source_size"))
    return (sized.join(targets, F.col("source").eqNullSafe(F.col("of_source")))
            .withColumn("rate", rate)
            .select("doc_id", "source", "size", "source_size", "target", "rate",
                    copies(F.col("rate"), F.col("toss")).alias("copies")))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS,
        max_repeat: float = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """The mixed corpus: every document as often as its source's rate says, same columns."""
    text = text_of(docs)
    names = docs.columns
    targets = stage(source_targets(
        docs.select(col(docs, "source").alias("source"), n_words(text).alias("size")),
        weights, max_repeat), "mix-targets")
    n, key = fresh(names, "copies"), fresh(names, "of_source")
    targets = targets.select(
        F.col("source").alias(key),
        repetition(F.col("target"), F.col("source_size")).alias(n))
    tossed = copies(F.col(n), coin(col(docs, "doc_id"), text, seed))
    joined = docs.join(targets, col(docs, "source").eqNullSafe(F.col(key)))
    out = joined.withColumn(n, tossed).where(F.col(n) > 0)
    again = fresh([*names, n, key], "nth_copy")
    out = out.withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
    return out.select(*[col(out, c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: per document its size, its source's size and target, and the words taken."""
    m = mix_counts(load(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target",
                    (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS body,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size,
         1.0 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(CAST(weight AS DOUBLE)) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per),
targets AS (
  SELECT source, source_size, least(3 * source_size, (SELECT max(level) FROM levels) * weight) AS target
  FROM levels),
tossed AS (
  SELECT s.doc_id, s.size, t.source_size, CAST(t.target AS DOUBLE) AS target,
         CASE WHEN t.source_size > 0 THEN CAST(t.target AS DOUBLE) / t.source_size ELSE 1.0 END AS rate,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), md5(s.body))), 1, 13)
              AS BIGINT) / 4503599627370496.0 AS toss
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (floor(rate) + CASE WHEN toss < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM tossed
"""
