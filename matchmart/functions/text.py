"""Text cleaning and tolerant type coercion, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unicode-aware edge whitespace (Python's str.strip set); Spark's trim only
# removes ASCII spaces.
_EDGE_WS = r"(?U)^\s+|\s+$"


def strip_lower(c) -> Column:
    """``str.strip().lower()`` with Unicode whitespace; NULL stays NULL."""
    x = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(x, _EDGE_WS, ""))


def normalize_text(df: DataFrame, null_text: str | None = None) -> DataFrame:
    """Lower-case and strip every string column, leaving other types alone.

    ``null_text`` reproduces the pandas ``astype(str)`` habit of turning a
    missing value into a literal word (``'none'``); the default keeps NULL.
    """
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            e = strip_lower(f.name)
            if null_text is not None:
                e = F.coalesce(e, F.lit(null_text))
            out.append(e.alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def null_if_empty_list(c) -> Column:
    """``'[]'`` (after trimming) becomes NULL; other values kept as they are."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(F.regexp_replace(x, _EDGE_WS, "") == "[]", F.lit(None).cast("string")).otherwise(x)


def coerce_int(c) -> Column:
    """``to_numeric(errors='coerce')`` then nullable integer.

    'False'/false → NULL; unparsable → NULL; integral doubles ('3.0') → 3;
    a fraction such as 0.5 has no integer value and becomes NULL.
    """
    x = F.col(c) if isinstance(c, str) else c
    s = F.trim(x.cast("string"))
    # Plain integers are read as such: beyond 2^53 a double would change them.
    d = F.when(F.lower(s) == "false", F.lit(None).cast("double")).otherwise(s.try_cast("double"))
    return F.coalesce(s.try_cast("bigint"), F.when(d == F.floor(d), d.try_cast("bigint")))


def parse_bool(c) -> Column:
    """Text → boolean: yes/true/1 → true, no/false/0 → false, else NULL."""
    x = F.col(c) if isinstance(c, str) else c
    s = strip_lower(x.cast("string"))
    return (F.when(s.isin("true", "yes", "1", "t", "y"), F.lit(True))
            .when(s.isin("false", "no", "0", "f", "n"), F.lit(False)))
