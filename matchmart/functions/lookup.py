"""Code → name lookups used by the marts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Game server region codes and their display names; any other
# code (and NULL) is shown as UNKNOWN_REGION.
REGION_NAMES = {
    1: "US West (Seattle)",
    2: "US East (Sterling)",
    3: "Europe West (Luxembourg)",
    4: "Brazil (São Paulo)",
    6: "Singapore (SEA)",
    7: "Australia (Sydney)",
    8: "Europe East (Moscow)",
    9: "South Africa (Cape Town)",
    10: "Japan (Tokyo)",
    11: "India (Chennai)",
    13: "China (Beijing / Shanghai)",
    14: "Chile (Santiago)",
    15: "Peru (Lima)",
    17: "Russia (Moscow / East Europe)",
    18: "Europe East 2",
    19: "China 2",
    20: "Southeast Asia 2",
    25: "US West 2",
    38: "US East 2",
}
UNKNOWN_REGION = "Unknown"


def region_name(code) -> Column:
    """Map literal lookup: evaluated in generated code, no join, no shuffle."""
    c = F.col(code) if isinstance(code, str) else code
    pairs = []
    for k, v in REGION_NAMES.items():
        pairs += [F.lit(k).cast("bigint"), F.lit(v)]
    lookup = F.create_map(*pairs)
    return F.coalesce(F.try_element_at(lookup, c.cast("bigint")), F.lit(UNKNOWN_REGION))
