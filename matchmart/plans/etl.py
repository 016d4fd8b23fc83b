"""Batch ETL: landed raw documents → warehouse tables → marts.

Stages (each a DataFrame step; boundaries are shuffles and file commits):

1. parse + tolerant filter + batch de-duplication (``sources.jsonl``),
2. match rows and flattened players, cleaned and typed (``operators.reshape``),
3. split into players / players_stat / players_items,
4. foreign-key filter: only matches that have players,
5. idempotent load of each table on its own key (``operators.load``), children
   first and ``matches`` last,
6. refresh of the marts (``plans.publish``).

The lines and the exploded players are written once to a staging folder and read back,
so the three player tables do not re-parse the raw text and a lost executor
does not send the job back to the landing files. Typed documents are written only where
lines fell away, by their id known or duplicated; else they would be a second copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchmart import storage
from matchmart.operators.integrity import with_children
from matchmart.operators.load import insert_ignore, read_table
from matchmart.operators.reshape import (
    clean_heroes, clean_items, clean_matches, clean_players_checked, split_players, split_stat,
    unpivot_items,
)
from matchmart.schemas import KEYS  # noqa: F401  (re-exported)
from matchmart.session import broadcast_as_measured, scratch_path, size_shuffle_partitions
from matchmart.sources.jsonl import (
    dedup_batch, explode_players, parse_lines, project_matches,
)
from matchmart.sources.jsonl import rejects as reject_rows

LOAD_ORDER = ("players_stat", "players_items", "players", "matches")


def build_tables(docs: DataFrame, staging: str | None = None) -> dict[str, DataFrame]:
    """Accepted documents → the four fact tables (matches FK-filtered).

    With ``staging`` the player frame is written once and the three player tables and the FK
    filter read that copy, instead of parsing and exploding the documents once per table; if it
    has duplicated keys, the cleaned frame is written too.
    """
    matches = clean_matches(project_matches(docs))
    wide = explode_players(docs)
    if staging is not None:
        wide = _staged(wide, f"{staging}/players_wide")
    cleaned, repeated = clean_players_checked(wide)
    wide = _staged(cleaned, f"{staging}/players_clean") if staging is not None and repeated else cleaned
    players = split_players(wide)
    return {
        "matches": with_children(matches, players, "match_id"),
        "players": players,
        "players_stat": split_stat(wide),
        "players_items": unpivot_items(wide),
    }


def _staged(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load_batch(spark: SparkSession, lines: DataFrame, root: str,
               staging: str | None = None) -> DataFrame:
    """Load one batch of raw lines into the warehouse at ``root``; status rows.

    ``lines`` has a ``value`` column (and optionally ``source_file``). Staged frames go
    when the tables are written, unless ``staging`` names a folder of the caller's. Known
    ids and stored keys reach the driver, to be broadcast, only where they are measured to be few.
    """
    own = staging is None
    staging = staging or scratch_path(spark, "staging")
    with broadcast_as_measured(spark):
        status = _load(spark, lines, root, staging)
    if own:
        storage.remove(spark, staging)
    return status


def _load(spark: SparkSession, lines: DataFrame, root: str, staging: str) -> DataFrame:
    # The landing files are read once: lines with their key or reason, rejects apart.
    parsed = parse_lines(lines).drop("doc")
    (parsed.withColumn("rejected", F.col("reject").isNotNull())
     .write.mode("overwrite").option("compression", "zstd").partitionBy("rejected").parquet(f"{staging}/lines"))
    parsed = spark.read.schema(parsed.schema.add("rejected", "boolean")).parquet(f"{staging}/lines")
    # A known match is complete (matches are loaded last), so a second document of it
    # is skipped as a whole and adds no players.
    docs = dedup_batch(parsed.where("NOT rejected"), known_match_keys(spark, root), stored=True,
                       staging=f"{staging}/docs")
    # insert-ignore here too: a retried batch must not list its rejects twice
    insert_ignore(spark, reject_rows(parsed.where("rejected")), f"{root.rstrip('/')}/_rejects",
                  ["source_file", "value", "reject"]).collect()
    # each of them has one row per key: documents by match, players by slot, items by item slot
    tables = build_tables(docs, staging)
    status = None
    for name in LOAD_ORDER:
        s = insert_ignore(spark, tables[name], f"{root.rstrip('/')}/{name}", KEYS[name],
                          bucket_of="match_id", unique=True)
        status = s if status is None else status.unionByName(s)
    return status


def load_dimensions(spark: SparkSession, root: str, heroes: DataFrame | None = None,
                    items: DataFrame | None = None) -> DataFrame:
    """Clean and insert-ignore the hero and item dictionaries; status rows.

    ``heroes`` / ``items`` are raw rows, e.g. from ``files.json_array_rows``
    (hero list) and ``files.json_map_rows`` (item map keyed by name).
    """
    status = None
    for name, raw, clean in (("heroes", heroes, clean_heroes), ("items", items, clean_items)):
        if raw is None:
            continue
        s = insert_ignore(spark, clean(raw), f"{root.rstrip('/')}/{name}", KEYS[name])
        status = s if status is None else status.unionByName(s)
    return status


def warehouse_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {n: read_table(spark, f"{root.rstrip('/')}/{n}") for n in LOAD_ORDER}


def known_match_keys(spark: SparkSession, root: str) -> DataFrame:
    """``SELECT match_id FROM matches`` (empty when nothing is loaded yet)."""
    path = f"{root.rstrip('/')}/matches"
    if not storage.exists(spark, path):
        return spark.range(0).select(F.col("id").alias("match_id"))
    return read_table(spark, path).select("match_id")


def run_daily(spark: SparkSession, landing: str, root: str, marts_root: str,
              checkpoint: str | None = None) -> DataFrame:
    """The daily job: newly landed JSONL → warehouse tables (idempotent) → all marts.

    The file source's checkpoint (under ``root`` by default) knows which landed files are
    loaded, so a run reads the new ones only, whatever the size of the landing folder,
    and a run that stopped goes on where it was. Heroes must already be loaded under
    ``root/heroes`` (``load_dimensions``). Returns a row per table with the rows that
    this run added, and one status row per mart.
    """
    from matchmart.plans.refresh import refresh_marts
    from matchmart.streaming.ingest import run_ingest

    added = dict.fromkeys(LOAD_ORDER, 0)

    def count(status: DataFrame) -> None:
        for r in status.collect():  # a row per table
            added[r["table"]] += r["inserted"]

    run_ingest(spark, landing, root, checkpoint or f"{root.rstrip('/')}/_landed", on_batch=count)
    if not storage.exists(spark, f"{root.rstrip('/')}/matches"):  # nothing has landed so far
        load_batch(spark, spark.createDataFrame([], "value string, source_file string"), root)
    tables = warehouse_tables(spark, root)
    tables["heroes"] = read_table(spark, f"{root.rstrip('/')}/heroes")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    size_shuffle_partitions(spark, [f"{root.rstrip('/')}/{name}" for name in tables])
    try:
        marts = refresh_marts(spark, marts_root, tables)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    loaded = spark.createDataFrame(list(added.items()), "step string, rows long")
    return (loaded.withColumn("status", F.lit("loaded"))
            .unionByName(marts.select(F.col("mart").alias("step"), "rows", "status")))
