"""Resumable incremental ingest of the landing folder (Structured Streaming).

The file source remembers, in its checkpoint, which landed files it has
processed, so each run picks up only new files (``availableNow`` drains the
backlog and stops, the daily-job form). Every micro-batch goes through
:func:`matchmart.plans.etl.load_batch`, whose loads are insert-ignore on each
table's key: replaying a batch after a crash appends nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchmart import storage
from matchmart.plans.etl import load_batch


def landed_lines(spark: SparkSession, landing: str, max_files: int = 1000) -> DataFrame:
    """Streaming text lines of the landing folder, with their file name.

    The folder is created when absent, so the job can start before the
    first file lands.
    """
    storage.make_folder(spark, landing)
    return (spark.readStream.format("text").option("maxFilesPerTrigger", max_files)
            .load(landing)
            .select("value", F.col("_metadata.file_path").alias("source_file")))


def run_ingest(spark: SparkSession, landing: str, root: str, checkpoint: str,
               available_now: bool = True, max_files: int = 1000,
               on_batch: Callable[[DataFrame], None] | None = None):
    """Process every new landed file into the warehouse; returns the finished query.

    ``on_batch`` is given each micro-batch's status rows. The landing folder may hold
    files or folders by run date.

    ``max_files`` is the size of a micro-batch in files: it sets memory and
    latency, not what is read (``availableNow`` goes on until all are done).
    """

    def _batch(df: DataFrame, epoch_id: int) -> None:
        status = load_batch(df.sparkSession, df, root)
        if on_batch is not None:
            on_batch(status)

    w = (landed_lines(spark, landing, max_files).writeStream
         .foreachBatch(_batch)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q
