"""Idempotent table load: ``INSERT … ON CONFLICT DO NOTHING`` on files.

Plain Parquet tables have no MERGE, so a load is: de-duplicate the batch on
the table key, anti join it against the keys already stored, append the rest
as new files. The anti join reads only the key columns of the target. A
rerun of the same batch appends nothing. Warehouse tables are partitioned by
a range bucket of ``match_id``, so a batch only reads the key columns of the
buckets it touches. Tables are loaded child-first and
``matches`` last, each against its *own* key, so a crash between tables is
repaired by the next run instead of losing the children for good.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchmart.operators.dedup import first_per_key
from matchmart.storage import exists as table_exists
from matchmart.storage import read_text as read_text_file
from matchmart.storage import write_text as write_text_file


SCHEMA_FILE = "_schema.json"


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A table folder read with its recorded schema (works when it holds no rows)."""
    text = read_text_file(spark, f"{path.rstrip('/')}/{SCHEMA_FILE}")
    if text is not None:
        return spark.read.schema(T.StructType.fromJson(json.loads(text))).parquet(path)
    if table_exists(spark, path):
        return spark.read.parquet(path)
    return None


BUCKET_COL = "_bucket"
BUCKET_WIDTH = 1_000_000
BOOKKEEPING = ("_load", BUCKET_COL)


def key_bucket(c, width: int = BUCKET_WIDTH):
    """Range bucket of a non-negative integer key: ``key div width`` (exact)."""
    x = F.col(c) if isinstance(c, str) else c
    x = x.cast("long")
    return ((x - x % F.lit(width)) / F.lit(width)).cast("long")



def new_rows(batch: DataFrame, target: DataFrame | None, keys: Sequence[str],
             bucketed: bool = False, unique: bool = False) -> DataFrame:
    """Rows of ``batch`` whose key is new: batch key-dedup, then anti join.

    ``unique`` says that the batch has a row per key already, so it is not shuffled for that.

    With ``bucketed`` the batch carries ``_bucket`` and the target is partitioned by
    it. The batch's distinct buckets (at most one per partition folder and million ids)
    are broadcast, and dynamic partition pruning makes the target scan read the key
    columns of exactly these partitions: a late id adds its own partition, not the
    range up to it.
    """
    keys = list(keys)
    b = batch if unique else first_per_key(batch, keys)
    if target is None:
        return b
    if not bucketed:
        return b.join(target.select(*keys), keys, "left_anti")
    # The comparison is what tells the planner that this side prunes; it holds for every bucket.
    touched = batch.select(BUCKET_COL).where(F.col(BUCKET_COL) > F.lit(-(1 << 62))).distinct()
    stored = target.select(BUCKET_COL, *keys).join(F.broadcast(touched), BUCKET_COL, "left_semi")
    return b.join(stored, [BUCKET_COL, *keys], "left_anti")


def insert_ignore(spark: SparkSession, batch: DataFrame, path: str,
                  keys: Sequence[str], bucket_of: str | None = None,
                  bucket_width: int = BUCKET_WIDTH, unique: bool = False) -> DataFrame:
    """Append the new rows of ``batch`` to the Parquet table at ``path``.

    ``bucket_of`` names an integer key column (e.g. ``match_id``) whose range
    bucket partitions the table on disk, ``unique`` a batch without duplicated keys
    (see :func:`new_rows`).

    Returns a one-row DataFrame ``(table, inserted)``; the rows are counted as they
    are written, the table is not listed or read again.
    """
    if bucket_of:
        batch = batch.withColumn(BUCKET_COL, key_bucket(bucket_of, bucket_width))
    target = _stored(spark, path)
    rows = new_rows(batch, target, keys, bucketed=bool(bucket_of), unique=unique)
    out = rows.withColumn("_load", F.lit(uuid.uuid4().hex))
    seen = Observation()
    w = out.observe(seen, F.count(F.lit(1)).alias("inserted")).write.mode("append")
    if bucket_of:
        w = w.partitionBy(BUCKET_COL)
    w.parquet(path)
    # the schema is recorded so that an empty (partitioned) table still reads back
    write_text_file(spark, f"{path.rstrip('/')}/{SCHEMA_FILE}", out.schema.json())
    return spark.createDataFrame([(path.rstrip("/").rsplit("/", 1)[-1], seen.get["inserted"])],
                                 "table string, inserted long")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A loaded table without the bookkeeping columns (empty tables included)."""
    df = _stored(spark, path)
    if df is None:
        raise FileNotFoundError(f"no table at {path}")
    return df.drop(*[c for c in BOOKKEEPING if c in df.columns])


#: catalogue database of tables that are stored side by side
_DATABASE = "matchmart_stored"


def by_match(df: DataFrame, path: str, buckets: int, key: str = "match_id") -> DataFrame:
    """``df`` as a catalogue table at ``path`` in ``buckets`` buckets of ``match_id``, a file each.

    ``key`` is the match's column; rows that come dealt by it in as many partitions are not dealt again.

    Tables with as many buckets join by match, and aggregate by it, without an exchange.
    Not for frames that are united first: a keep-first over a union of two such tables kept
    both rows of a key under Spark 4.1, seemingly as the union counts as dealt by the bucket column.
    """
    spark = df.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_DATABASE}")
    name = f"{_DATABASE}.t_{uuid.uuid4().hex}"
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
     .option("path", path).option("compression", "zstd").saveAsTable(name))
    return spark.table(name)
