"""Cleaning and reshaping of the flattened player frame into warehouse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchmart.functions.text import coerce_int, normalize_text, null_if_empty_list, parse_bool
from matchmart.operators.dedup import distinct_rows, first_per_stored_key
from matchmart.operators.joins import left_join_slots
from matchmart.schemas import (
    ITEM_COLUMNS, ITEM_SLOTS, MATCH_COLUMNS, PLAYERS_COLUMNS, STAT_COLUMNS,
)


def clean_matches(matches: DataFrame) -> DataFrame:
    """Typed match rows, full-row de-duplicated."""
    m = matches.select(
        F.col("match_id").cast("bigint").alias("match_id"),
        F.col("duration").cast("bigint").alias("duration"),
        F.col("first_blood_time").cast("bigint").alias("first_blood_time"),
        F.col("radiant_win").cast("boolean").alias("radiant_win"),
        F.col("region").cast("bigint").alias("region"),
    )
    return distinct_rows(m).select(*MATCH_COLUMNS)


def cast_player_types(players_wide: DataFrame) -> DataFrame:
    """``steam_id`` as nullable bigint; ``win`` int → boolean (NULL stays NULL)."""
    return (players_wide.withColumn("steam_id", F.col("steam_id").cast("bigint"))
            .withColumn("win", F.col("win").cast("boolean")))


def clean_players(players_wide: DataFrame, null_text: str | None = None) -> DataFrame:
    """Text normalised, types cast, one row per (match_id, player_slot).

    The row kept for a duplicated key is the smallest by the remaining
    columns: deterministic on any partitioning. The frame is read three times (its keys,
    then single and duplicated rows); give it as stored rows.
    """
    return clean_players_checked(players_wide, null_text)[0]


def clean_players_checked(players_wide: DataFrame, null_text: str | None = None) -> tuple[DataFrame, bool]:
    """``clean_players``, and whether any key was duplicated."""
    p = cast_player_types(normalize_text(players_wide, null_text))
    one = first_per_stored_key(p, ["match_id", "player_slot"])
    return one, one is not p


def split_players(players_wide: DataFrame) -> DataFrame:
    return players_wide.select(*PLAYERS_COLUMNS)


def split_stat(players_wide: DataFrame) -> DataFrame:
    return players_wide.select(*STAT_COLUMNS)


def unpivot_items(players_wide: DataFrame) -> DataFrame:
    """Six item columns → (item_slot '0'..'5', item_id); item 0 means empty → NULL.

    ``unpivot`` is a narrow Expand: no shuffle, six output rows per input row.
    """
    w = players_wide.select("match_id", "player_slot", *ITEM_SLOTS)
    long = w.unpivot(["match_id", "player_slot"], ITEM_SLOTS, "slot_col", "item_id")
    return (long.withColumn("item_slot", F.substring("slot_col", -1, 1))
            .drop("slot_col")
            .withColumn("item_id", F.nullif(F.col("item_id"), F.lit(0)))
            .select(*ITEM_COLUMNS))


def rename_keys(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def players_wide_from_tables(players: DataFrame, players_stat: DataFrame,
                             items_wide: DataFrame) -> DataFrame:
    """Re-assemble the flattened player frame from the three player tables.

    The rows come out dealt by match, so lists of a match's players need no further exchange.
    """
    i = items_wide.select("match_id", "player_slot", *ITEM_SLOTS)
    j = left_join_slots(left_join_slots(players, players_stat), i)
    return j.select(
        "match_id", "player_slot", "steam_id", "personaname", "assists", "deaths", "denies",
        "gold_per_min", F.col("hero_id").cast("int").alias("hero_id"), *ITEM_SLOTS, "kills",
        "xp_per_min", "is_radiant", F.col("win").cast("int").alias("win"), "last_hits",
        "hero_damage", "hero_healing", "tower_damage")


# --------------------------------------------------------------------------- dimensions

ITEM_INT_COLUMNS = ("mc", "hc", "cd", "charges")


def clean_items(items: DataFrame) -> DataFrame:
    """Item dictionary as loaded: text normalised, ``id`` → ``item_id``,
    ``cost`` and the optional numbers (``mc``, ``hc``, ``cd``, ``charges``:
    'False'/false or unparsable → NULL) as nullable integers, ``bkbpierce``
    parsed as a boolean, and a ``hint`` of ``'[]'`` turned into NULL.
    Columns that are absent are skipped; unknown columns are kept.
    """
    df = normalize_text(items)
    if "id" in df.columns and "item_id" not in df.columns:
        df = df.withColumnRenamed("id", "item_id")
    if "item_id" in df.columns:
        df = df.withColumn("item_id", coerce_int("item_id"))
    if "cost" in df.columns:
        df = df.withColumn("cost", coerce_int("cost"))
    for c in ITEM_INT_COLUMNS:
        if c in df.columns:
            df = df.withColumn(c, coerce_int(c))
    if "bkbpierce" in df.columns:
        df = df.withColumn("bkbpierce", parse_bool("bkbpierce"))
    if "hint" in df.columns:
        df = df.withColumn("hint", null_if_empty_list(F.col("hint").cast("string")))
    return df


def clean_heroes(heroes: DataFrame) -> DataFrame:
    """Hero list as loaded: text normalised (role names lower-cased inside the
    array), ``id`` → ``hero_id``."""
    df = normalize_text(heroes)
    if "roles" in df.columns:
        df = df.withColumn("roles", F.transform("roles", lambda r: F.lower(F.trim(r))))
    if "id" in df.columns and "hero_id" not in df.columns:
        df = df.withColumnRenamed("id", "hero_id")
    return df
