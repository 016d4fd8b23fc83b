"""Warehouse tables for the test data set.

The driver's test data is a TPC-H-like star schema, so each warehouse table
is a role mapping over it (the same mapping the oracle SQL uses):

- ``matches``            orders ⋈ customer: one row per order
- ``players``            one line item per (order, line number) ⋈ supplier
- ``players_stat``       same key, one row per line item
- ``player_items_wide``  six item slots per player, 0 meaning "no item"
- ``heroes``             nation as the hero dimension (ids 25, 26 have none)
- ``items``              part as the item dimension; item ids run past its keys

In a deployment the same names are plain Parquet tables
(:func:`load_tables`); all marts take these DataFrames as arguments and do
not care where they came from.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchmart.operators.dedup import MANY_KEYS, first_per_key, first_per_stored_key

LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
              "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                               "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = o.join(c, o["o_custkey"] == c["c_custkey"], "inner")
    status = F.col("o_orderstatus")
    return j.select(
        F.col("o_orderkey").alias("match_id"),
        F.floor(F.col("o_totalprice") / 125).cast("bigint").alias("duration"),
        (F.col("o_orderkey") % 600).alias("first_blood_time"),
        F.when(status == "P", F.lit(None).cast("boolean")).otherwise(status == "F")
        .alias("radiant_win"),
        F.col("c_nationkey").alias("region"),
    )


def line_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with (l_orderkey, l_linenumber) made unique, first by LINE_ORDER."""
    li = table(spark, sf_dir, "lineitem")
    return first_per_stored_key(li, ["l_orderkey", "l_linenumber"], LINE_ORDER)


def players_from_lines(lines: DataFrame, supplier: DataFrame) -> DataFrame:
    s = supplier.select("s_suppkey", "s_name")
    j = lines.join(s, lines["l_suppkey"] == s["s_suppkey"], "inner")
    sk = F.col("l_suppkey")
    return j.select(
        F.col("l_orderkey").alias("match_id"),
        F.col("l_linenumber").alias("player_slot"),
        F.when(F.col("l_returnflag") == "N", F.lit(None).cast("bigint")).otherwise(sk)
        .alias("steam_id"),
        F.when(sk % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("s_name"))
        .alias("personaname"),
        (sk % 27).alias("hero_id"),
        (F.col("l_linenumber") <= 3).alias("is_radiant"),
        (F.col("l_linestatus") == "F").alias("win"),
    )


def stat_from_lines(lines: DataFrame) -> DataFrame:
    price = F.col("l_extendedprice")
    return lines.select(
        F.col("l_orderkey").alias("match_id"),
        F.col("l_linenumber").alias("player_slot"),
        F.floor(F.col("l_quantity")).cast("int").alias("kills"),
        (F.col("l_partkey") % 17).cast("int").alias("deaths"),
        (F.col("l_partkey") % 29).cast("int").alias("assists"),
        (F.col("l_suppkey") % 11).cast("int").alias("denies"),
        F.floor(F.col("l_quantity") * 5).cast("int").alias("last_hits"),
        F.floor(price / 100).cast("int").alias("gold_per_min"),
        F.floor(price / 120).cast("int").alias("xp_per_min"),
        F.floor(price).cast("bigint").alias("hero_damage"),
        F.floor(price * F.col("l_discount")).cast("bigint").alias("hero_healing"),
        F.floor(price * F.col("l_tax")).cast("bigint").alias("tower_damage"),
    )


def items_wide_from_lines(lines: DataFrame) -> DataFrame:
    pk, ln = F.col("l_partkey"), F.col("l_linenumber")
    # an eighth of the slots are empty; the last parts' neighbours are in no dimension
    slots = [F.when((pk + k * ln) % 8 == 0, 0).otherwise(pk + k * ln).cast("int").alias(f"item_{k}")
             for k in range(6)]
    return lines.select(F.col("l_orderkey").alias("match_id"), ln.alias("player_slot"), *slots)


def heroes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("bigint").alias("hero_id"),
                    F.col("n_name").alias("localized_name"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item_key"))


@dataclass
class Warehouse:
    """The six warehouse tables as (lazy) DataFrames."""

    matches: DataFrame
    players: DataFrame
    players_stat: DataFrame
    player_items_wide: DataFrame
    heroes: DataFrame
    items: DataFrame


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """Role-mapped warehouse over the driver's test tables."""
    lines = line_one(spark, sf_dir)
    return Warehouse(
        matches=matches(spark, sf_dir),
        players=players_from_lines(lines, table(spark, sf_dir, "supplier")),
        players_stat=stat_from_lines(lines),
        player_items_wide=items_wide_from_lines(lines),
        heroes=heroes(spark, sf_dir),
        items=items(spark, sf_dir),
    )


TABLES = ("matches", "players", "players_stat", "players_items", "heroes", "items")


def load_tables(spark: SparkSession, root: str,
                names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """Deployment form: each warehouse table is Parquet under ``root/<name>``
    (as written by ``plans.etl``), without the load bookkeeping columns."""
    from matchmart.operators.load import read_table
    return {t: read_table(spark, f"{root.rstrip('/')}/{t}") for t in names}


# --------------------------------------------------------------------------- stored form

#: the given tables that the roles read
SOURCES = ("orders", "customer", "lineitem", "supplier", "nation", "part")

_STORED: dict[tuple[str, ...], tuple[str, StoredWarehouse]] = {}


class StoredWarehouse:
    """The warehouse tables below ``root``, each written when it is first asked for.

    A query pays for the tables it reads. Item slots are columns of the stored line
    items, so they are read from there and not written again.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, root: str):
        self._spark, self._dir, self._root = spark, sf_dir, root

    def _stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        from matchmart.session import sized_for
        path = f"{self._root}/{name}"
        with sized_for(self._spark, [f"{self._dir.rstrip('/')}/{t}.parquet" for t in SOURCES]):
            build().write.option("compression", "zstd").parquet(path)
        return self._spark.read.parquet(path)

    @cached_property
    def line_one(self) -> DataFrame:
        return self._stored("line_one", lambda: line_one(self._spark, self._dir))

    @cached_property
    def matches(self) -> DataFrame:
        return self._stored("matches", lambda: matches(self._spark, self._dir))

    @cached_property
    def players(self) -> DataFrame:
        lines, supplier = self.line_one, table(self._spark, self._dir, "supplier")
        return self._stored("players", lambda: players_from_lines(lines, supplier))

    @cached_property
    def players_stat(self) -> DataFrame:
        lines = self.line_one
        return self._stored("players_stat", lambda: stat_from_lines(lines))

    @cached_property
    def player_items_wide(self) -> DataFrame:
        return items_wide_from_lines(self.line_one)

    @cached_property
    def players_by_match(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """``players``, ``players_stat`` and ``player_items_wide`` over line items that are stored by match.

        The line items are shuffled once, by their order, which serves the dedup, the joins of these
        three tables and lists of a match's players; no table is written but the line items. Not
        for unions (see :func:`matchmart.operators.load.by_match`).
        """
        from matchmart.operators.load import by_match
        from matchmart.session import sized_for
        with sized_for(self._spark, [f"{self._dir.rstrip('/')}/{t}.parquet" for t in SOURCES]):
            n = int(self._spark.conf.get("spark.sql.shuffle.partitions"))
            dealt = table(self._spark, self._dir, "lineitem").repartition(n, "l_orderkey")
            lines = by_match(first_per_key(dealt, ["l_orderkey", "l_linenumber"], LINE_ORDER),
                             f"{self._root}/line_one_by_match", n, "l_orderkey")
        supplier = table(self._spark, self._dir, "supplier")
        if supplier.count() <= MANY_KEYS:
            supplier = F.broadcast(supplier)
        return players_from_lines(lines, supplier), stat_from_lines(lines), items_wide_from_lines(lines)

    @cached_property
    def heroes(self) -> DataFrame:
        return self._stored("heroes", lambda: heroes(self._spark, self._dir))

    @cached_property
    def items(self) -> DataFrame:
        return self._stored("items", lambda: items(self._spark, self._dir))


def stored_warehouse(spark: SparkSession, sf_dir: str, force: bool = False) -> StoredWarehouse:
    """The role-mapped warehouse written once as Parquet tables, then read back.

    Marts in production read stored warehouse tables, not views over raw
    tables; this gives the test data the same shape. The de-duplicated line
    items are written first and the three player tables derived from the
    stored copy, so the dedup runs once. Tables are written when a query first asks for
    them (:class:`StoredWarehouse`) and live in a fresh folder under
    the shared checkpoint dir and are reused while the given files stay as they
    are: names, lengths and modification times are part of the key.
    """
    from matchmart.operators.load import table_exists
    from matchmart.session import files_stamp, scratch_path

    paths = [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in SOURCES]
    key = (spark.sparkContext.applicationId, sf_dir, files_stamp(spark, paths))
    hit = _STORED.get(key)
    if hit and not force and table_exists(spark, f"{hit[0]}/_DONE"):
        return hit[1]
    root = scratch_path(spark, "warehouse-roles")
    spark.createDataFrame([("ok",)], "s string").write.text(f"{root}/_DONE")
    stored = StoredWarehouse(spark, sf_dir, root)
    _STORED[key] = (root, stored)
    return stored
