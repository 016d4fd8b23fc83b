"""Explicit schemas for raw inputs and warehouse tables."""

from __future__ import annotations

from pyspark.sql import types as T

ITEM_SLOTS = [f"item_{k}" for k in range(6)]

RAW_PLAYER = T.StructType([
    T.StructField("player_slot", T.IntegerType()),
    T.StructField("account_id", T.LongType()),
    T.StructField("personaname", T.StringType()),
    T.StructField("assists", T.IntegerType()),
    T.StructField("deaths", T.IntegerType()),
    T.StructField("denies", T.IntegerType()),
    T.StructField("gold_per_min", T.IntegerType()),
    T.StructField("hero_id", T.IntegerType()),
    *[T.StructField(s, T.IntegerType()) for s in ITEM_SLOTS],
    T.StructField("kills", T.IntegerType()),
    T.StructField("xp_per_min", T.IntegerType()),
    T.StructField("isRadiant", T.BooleanType()),
    T.StructField("win", T.IntegerType()),
    T.StructField("last_hits", T.IntegerType()),
    T.StructField("hero_damage", T.LongType()),
    T.StructField("hero_healing", T.LongType()),
    T.StructField("tower_damage", T.LongType()),
])

# match_id is read as text: the raw feed may carry it as a number or a string
RAW_MATCH = T.StructType([
    T.StructField("match_id", T.StringType()),
    T.StructField("duration", T.LongType()),
    T.StructField("first_blood_time", T.LongType()),
    T.StructField("radiant_win", T.BooleanType()),
    T.StructField("region", T.LongType()),
    T.StructField("players", T.ArrayType(RAW_PLAYER)),
])

MATCH_COLUMNS = ["match_id", "duration", "first_blood_time", "radiant_win", "region"]

# flattened player frame: raw player fields with the two renames
PLAYER_WIDE_COLUMNS = [
    "match_id", "player_slot", "steam_id", "personaname", "assists", "deaths", "denies",
    "gold_per_min", "hero_id", *ITEM_SLOTS, "kills", "xp_per_min", "is_radiant", "win",
    "last_hits", "hero_damage", "hero_healing", "tower_damage",
]

PLAYERS_COLUMNS = ["match_id", "player_slot", "steam_id", "personaname", "hero_id",
                   "is_radiant", "win"]
STAT_COLUMNS = ["match_id", "player_slot", "kills", "deaths", "assists", "denies",
                "last_hits", "gold_per_min", "xp_per_min", "hero_damage", "hero_healing",
                "tower_damage"]
ITEM_COLUMNS = ["match_id", "player_slot", "item_slot", "item_id"]

KEYS = {
    "matches": ["match_id"],
    "players": ["match_id", "player_slot"],
    "players_stat": ["match_id", "player_slot"],
    "players_items": ["match_id", "player_slot", "item_slot"],
    "heroes": ["hero_id"],
    "items": ["item_id"],
}

# The hero list's and the item dictionary's fields: fixed values, the feed's names.
HERO_NUMBERS = [
    "base_health", "base_health_regen", "base_mana", "base_mana_regen", "base_armor", "base_mr",
    "base_attack_min", "base_attack_max", "base_str", "base_agi", "base_int", "str_gain",
    "agi_gain", "int_gain", "attack_range", "projectile_speed", "attack_rate",
    "base_attack_time", "attack_point", "move_speed", "turn_rate", "legs", "day_vision",
    "night_vision",
]
HERO_FRACTIONS = {"base_health_regen", "base_mana_regen", "base_armor", "str_gain", "agi_gain", "int_gain",
                  "attack_rate", "attack_point", "turn_rate"}
ITEM_NUMBERS = ["cost", "mc", "hc", "cd", "charges"]

HERO_LIST_ITEM = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("localized_name", T.StringType()),
    T.StructField("attack_type", T.StringType()),
    T.StructField("primary_attr", T.StringType()),
    T.StructField("roles", T.ArrayType(T.StringType())),
    *[T.StructField(n, T.DoubleType() if n in HERO_FRACTIONS else T.LongType()) for n in HERO_NUMBERS],
    T.StructField("cm_enabled", T.BooleanType()),
])

#: item fields that get a column; numbers and flags come as text, ``clean_items`` types them
ITEM_MAP_VALUE = T.StructType([
    T.StructField("id", T.LongType()),
    *[T.StructField(n, T.StringType()) for n in ["dname", *ITEM_NUMBERS, "bkbpierce", "hint"]],
])
