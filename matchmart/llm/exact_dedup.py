"""Exact dedup against a persistent digest index (native).

A text's digest is the SHA-256 of the text without white space. The index is a
Parquet table bucketed and sorted by digest with one row per digest ever kept.
A batch is reduced to one row per digest with a partial aggregate (a group of
copies shrinks on the map side, however large it is), the new digests are found
with a sort-merge anti-join whose index side needs no exchange, and appended.

Of equal texts, the row with the most code points in its original text stays,
then the smallest doc_id; a text that an earlier batch holds keeps that batch's
row. Every index row names its batch: appending a batch a second time (a
retried job) adds nothing and gives the same answer.

Per-document answers join documents (id, digest, length: no texts) with the
batch's digests by an ordinary shuffled join, so that AQE can split a hot
digest's documents; the digest side has one row per digest.

Defined cases: null text is empty; empty and all-white texts are one group;
null ids come last among ties; rows that repeat an id, a text and so a length
are told apart only by ``survivors``, which keeps one of them; an empty table
gives an empty table; further columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchmart.session import scratch_path

from .common import SPACE, col, fresh, load, stage, text_of, unique_id

SCHEMA = "digest string, keep_id long, n_chars long, batch string"
BUCKETS = 64
#: ids lie in [-2^63, 2^63): a length and an id share one exact, orderable decimal
_SHIFT = "18446744073709551616"
_MAX_ID = "9223372036854775807"


def digest_of(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text without white space."""
    return F.sha2(F.regexp_replace(text, f"[{SPACE}]+", "").cast("binary"), 256)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_chars of every document."""
    text = text_of(docs)
    return docs.select(col(docs, "doc_id").cast("long").alias("doc_id"), digest_of(text).alias("digest"),
                       F.length(text).cast("long").alias("n_chars"))


def best_per_digest(prints: DataFrame) -> DataFrame:
    """digest, keep_id, n_chars, group_size: the row that stays in each group.

    Longest first, then smallest id, as one decimal maximum: length * 2^64 +
    (2^63 - 1 - id). A fixed-width buffer keeps this a hash aggregate.
    """
    shift, top = F.lit(_SHIFT).cast("decimal(20,0)"), F.lit(_MAX_ID).cast("decimal(20,0)")
    rank = (F.col("n_chars").cast("decimal(11,0)") * shift
            + F.coalesce(top - F.col("doc_id").cast("decimal(20,0)"), F.lit(-1).cast("decimal(20,0)")))
    per = prints.groupBy("digest").agg(
        F.max(rank.cast("decimal(38,0)")).alias("rank"),
        F.max("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("group_size"))
    rest = F.col("rank") - F.col("n_chars").cast("decimal(11,0)") * shift
    return per.select(
        "digest", F.when(rest >= 0, (top - rest).cast("long")).alias("keep_id"), "n_chars", "group_size")


class DigestIndex:
    """The table of kept digests at ``path``, in ``buckets`` sorted buckets.

    The bucket count is written beside the table when it is made, and read from
    there ever after; sessions only register the files under a name.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        about = f"{self.path}/about"
        jvm = spark.sparkContext._jvm
        hp = jvm.org.apache.hadoop.fs.Path(f"{about}/_SUCCESS")
        if not hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hp):
            spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").json(about)
        self.buckets = spark.read.schema("buckets int").json(about).first()[0]
        self.name = f"digest_index_{unique_id()}"
        spark.sql(f"CREATE TABLE {self.name} ({SCHEMA}) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
                  f"LOCATION '{self.path}/rows'")

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def unseen(self, digests: DataFrame) -> DataFrame:
        """Rows of ``digests`` whose digest the index lacks (sort-merge anti-join)."""
        return digests.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, digests: DataFrame, batch: str) -> None:
        """Add digest, keep_id, n_chars rows; those already there are skipped."""
        new = self.unseen(digests).select(
            "digest", "keep_id", "n_chars", F.lit(batch).alias("batch"))
        # The join leaves rows clustered by digest, so each bucket gets one sorted file.
        (new.repartition(self.buckets, "digest").write.mode("append").format("parquet")
         .bucketBy(self.buckets, "digest").sortBy("digest")
         .option("path", f"{self.path}/rows").saveAsTable(self.name))

    def compact(self, path: str) -> DigestIndex:
        """The same index at a new path with one file per bucket."""
        other = DigestIndex(self.spark, path, self.buckets)
        (self.rows().repartition(self.buckets, "digest").write.mode("append").format("parquet")
         .bucketBy(self.buckets, "digest").sortBy("digest")
         .option("path", f"{other.path}/rows").saveAsTable(other.name))
        return other


def dedup_groups(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """Fingerprints of the batch's documents with keep_id, keep_chars, group_size, kept.

    ``keep_id`` of a text that an earlier batch kept is that batch's row, and
    none of this batch's copies is kept. Appends the batch to the index.
    """
    prints = stage(fingerprints(docs), "digest-rows")
    best = stage(best_per_digest(prints), "digest-best")
    index.append(best, batch)
    held = index.rows().withColumnRenamed("n_chars", "keep_chars").hint("merge")
    group = best.select("digest", "group_size").join(held, "digest")
    group = stage(group.select("digest", "group_size", "keep_id", "keep_chars",
                               (F.col("batch") == batch).alias("own")), "digest-groups")
    same = (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")))
    return prints.join(group, "digest").withColumn("kept", F.col("own") & same)


def scratch_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    """An empty index in the shared checkpoint folder."""
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DigestIndex(spark, scratch_path(spark, "digest-index"), n)


def survivors(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The documents that stay, one row for each group, with their own columns."""
    index = index or scratch_index(docs.sparkSession)
    marked = dedup_groups(docs, index, batch or unique_id())
    best = marked.where("kept").select("doc_id", "digest", "n_chars").distinct()
    names = docs.columns
    d, n, i = (fresh(names, x) for x in ("stay_digest", "stay_chars", "stay_id"))
    best = best.select(F.col("doc_id").alias(f"{i}_"), F.col("digest").alias(f"{d}_"),
                       F.col("n_chars").alias(f"{n}_"))
    text = text_of(docs)
    full = docs.withColumns({d: digest_of(text), n: F.length(text).cast("long"),
                             i: col(docs, "doc_id").cast("long")})
    kept = full.join(best, (F.col(d) == F.col(f"{d}_")) & (F.col(n) == F.col(f"{n}_"))
                     & F.col(i).eqNullSafe(F.col(f"{i}_")), "left_semi")
    return kept.dropDuplicates([d, n, i]).select(*[col(kept, c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: what stays of every document's group, against an index that starts empty."""
    marked = dedup_groups(load(spark, sf_dir, "documents"), scratch_index(spark), "documents")
    return marked.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE = r"""
WITH prints AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
groups AS (
  SELECT text_sha256, count(*) AS group_size,
         first(doc_id ORDER BY n_chars DESC, doc_id ASC NULLS LAST) AS keep_id
  FROM prints GROUP BY text_sha256)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM prints JOIN groups USING (text_sha256)
"""
