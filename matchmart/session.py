"""Session construction (tests, bench) and shared scratch storage.

Library code never creates its own session; callers pass one in. Scratch
data (checkpoints, landed test files, published mart versions) goes under the
cluster's ``spark.checkpoint.dir``; only when that is unset (unit tests on a
laptop) do we pick a private local folder.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "matchmart", checkpoint_dir: str | None = None) -> SparkSession:
    """A session with the settings the library is tuned for.

    AQE re-plans joins (broadcast when the runtime size is small, split
    skewed partitions) and coalesces small shuffle partitions; ANSI mode
    makes overflow and division by zero errors rather than silent values.
    """
    builder = SparkSession.builder
    if checkpoint_dir:  # a folder that the driver and all executors share
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = (
        builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder, from ``spark.checkpoint.dir``.

    Unset, a private folder serves a ``local`` master, where driver and executors
    are one machine; any other master has to name a shared one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="matchmart-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint dir."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/matchmart/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint dir: computed once, lineage cut."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Total size of the files under ``paths`` (file-system metadata only)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        if fs.exists(hp):
            total += fs.getContentSummary(hp).getLength()
    return total


def files_stamp(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the names, lengths and modification times of all files under ``paths``."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        if not fs.exists(hp):
            continue
        files = fs.listFiles(hp, True)
        while files.hasNext():
            f = files.next()
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()


@contextmanager
def sized_for(spark: SparkSession, paths: list[str], target_partition_bytes: int = 64 << 20,
              expansion: float = 8.0, split_bytes: int = 16 << 20):
    """Jobs within run in tasks whose memory does not grow with the files under ``paths``.

    At least as many shuffle partitions as set, more for larger input; a file is read in
    splits of ``split_bytes`` at most, as an aggregate that sorts holds a split, decoded. Small
    partitions are put together to ``split_bytes`` at most: a task that joins holds its
    partition decoded once per sort.
    """
    names = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(n) for n in names]
    wanted = int(-(-input_bytes(spark, paths) * expansion // target_partition_bytes))
    as_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    spark.conf.set(names[0], str(max(int(before[0]), wanted)))
    for name, value in zip(names[1:], before[1:]):
        spark.conf.set(name, str(min(as_bytes(value), split_bytes)))
    try:
        yield
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


@contextmanager
def broadcast_as_measured(spark: SparkSession):
    """Joins planned within broadcast a side by its rows as shuffled, not by the size of its files.

    Sorted ids take a byte each in a file and forty in the driver that broadcasts them, so a limit on files
    lets the driver's memory grow with the input. The same limit holds for what AQE has
    measured; sides that are marked by ``F.broadcast`` go out as before.
    """
    files, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    limit, own = spark.conf.get(files), spark.conf.get(measured, None)
    spark.conf.set(measured, limit if own is None else own)
    spark.conf.set(files, "-1")
    try:
        yield
    finally:
        spark.conf.set(files, limit)
        if own is None:
            spark.conf.unset(measured)
        else:
            spark.conf.set(measured, own)


def size_shuffle_partitions(spark: SparkSession, paths: list[str],
                            target_partition_bytes: int = 256 << 20,
                            expansion: float = 3.0, min_partitions: int = 8) -> int:
    """Set ``spark.sql.shuffle.partitions`` from the input size.

    Columnar Parquet expands when decoded and shuffled (``expansion``); the
    initial partition count aims at ``target_partition_bytes`` of shuffle data
    per task so the largest exchanges do not spill, and AQE coalesces the
    small ones back toward its advisory size. Returns the value set.
    """
    est = input_bytes(spark, paths) * expansion
    n = int(max(min_partitions, -(-est // target_partition_bytes)))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return n
