"""Small helpers shared by the text operators: staging, fresh names, white space."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchmart.session import scratch_path

#: the white space that the contracts name: U+0020 and U+0009 to U+000D
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts lineage (a lost executor rereads files instead of recomputing) and
    gives the planner the true size of what follows. Once the files are written,
    the shuffle files behind them serve nobody: Spark removes them at the end of
    this write instead of when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(taken: Iterable[str], base: str) -> str:
    """A column name that no column in ``taken`` has (names are case-blind)."""
    low = {c.lower() for c in taken}
    if base.lower() not in low:
        return base
    n = 1
    while f"{base}_{n}".lower() in low:
        n += 1
    return f"{base}_{n}"


def col(df: DataFrame, name: str) -> Column:
    """The column called exactly ``name``, dots and odd characters included."""
    return df["`" + name.replace("`", "``") + "`"]


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text column, null read as empty."""
    return F.coalesce(col(df, name), F.lit(""))


_GAP = re.compile(rb"[\x20\x09-\x0D]")


def byte_blocks(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A UTF-8 text in blocks of about ``size`` bytes, cut before white space."""
    start = 0
    while start < len(data):
        gap = _GAP.search(data, start + size)
        end = gap.start() if gap else len(data)
        yield data[start:end]
        start = end


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, a list for each block that has any.

    bytes.split knows exactly the white space U+0020, U+0009 to U+000D.
    """
    return filter(None, map(bytes.split, byte_blocks(data, size)))


def byte_slices(texts: pa.Array, size: int) -> list[tuple[int, int]]:
    """(start, end) of runs of texts that begin within the same ``size`` bytes."""
    if not len(texts):
        return []
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    group = np.append(0, ends[:-1]) // size
    starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist()]
    return list(zip(starts, [*starts[1:], len(texts)]))


def unique_id() -> str:
    return uuid.uuid4().hex[:12]
