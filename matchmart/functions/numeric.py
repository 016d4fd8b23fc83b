"""Column expressions with PostgreSQL numeric semantics.

The marts were written for PostgreSQL, where ``x::numeric / 60`` is an exact
decimal, ``AVG(int)`` is numeric and ``ROUND`` rounds half away from zero. In
Spark a plain ``avg`` is a double and rounding a double can land on the wrong
side of ``.xx5``, so every helper here stays in DECIMAL until the final cast.
Division by zero (an empty group) yields NULL rather than an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def minutes(c) -> Column:
    """``x::numeric / 60`` as an exact decimal (unrounded)."""
    return _c(c).cast("decimal(20,0)") / F.lit(60)


def per_minute(c) -> Column:
    """``ROUND(x::numeric / 60, 2)``: decimal with two places."""
    return F.round(minutes(c), 2)


# Below this bound 10*|x|+3 is exactly representable as a double, so the
# integer quotient can be taken in plain long/double arithmetic.
_FAST_LIMIT = 900_000_000_000_000


def _exact_div(num: Column, d: int) -> Column:
    """``num div d`` for 0 <= num < 2**53: the numerator is made a multiple of d first."""
    return ((num - num % F.lit(d)) / F.lit(d)).cast("long")


def per_minute_hundredths(c) -> Column:
    """``ROUND(x::numeric / 60, 2) * 100`` as an exact bigint (half away from zero).

    The row path of the marts stays in primitive longs: ``x/60`` as a decimal
    needs 31 digits, which Spark evaluates with ``BigDecimal`` objects per
    row. round(|x|/60, 2) * 100 = floor((10|x| + 3) / 6); beyond the fast
    range the decimal form is used.
    """
    if isinstance(c, str):
        # same expression as below, sent as one SQL string: building it node by
        # node costs ~40 driver-to-JVM calls per use
        a = f"abs(CAST(`{c}` AS BIGINT))"
        n = f"({a} * 10 + 3)"
        fast = f"CAST(({n} - {n} % 6) / 6 AS BIGINT)"
        slow = f"CAST(round(CAST({a} AS DECIMAL(20,0)) / 60, 2) * 100 AS BIGINT)"
        h = f"(CASE WHEN {a} < {_FAST_LIMIT} THEN {fast} ELSE {slow} END)"
        return F.expr(f"CASE WHEN CAST(`{c}` AS BIGINT) < 0 THEN -{h} ELSE {h} END")
    x = _c(c).cast("long")
    a = F.abs(x)
    fast = _exact_div(a * F.lit(10) + F.lit(3), 6)
    slow = (F.round(minutes(a), 2) * F.lit(100)).cast("long")
    h = F.when(a < F.lit(_FAST_LIMIT), fast).otherwise(slow)
    return F.when(x < 0, -h).otherwise(h)


def hundredths(c) -> Column:
    """An integer (or boolean as 0/1) column scaled to hundredths."""
    return _c(c).cast("long") * F.lit(100)


def from_hundredths(h) -> Column:
    """Hundredths → double; equals casting the 2-place decimal to double."""
    return _c(h).cast("double") / F.lit(100.0)


def minutes_double(c) -> Column:
    """``x::numeric / 60`` compared with a float8 value: as double."""
    return _c(c).cast("double") / F.lit(60.0)


def whole_minutes(c) -> Column:
    """``duration / 60`` on an integer column: PostgreSQL truncates toward 0."""
    x = _c(c).cast("long")
    return ((x - x % F.lit(60)) / F.lit(60)).cast("long")


def round2(c) -> Column:
    """``ROUND(x::numeric, 2)`` for a double input (15 significant digits kept)."""
    return F.round(_c(c).cast("decimal(30,10)"), 2)


def to_out(c) -> Column:
    """Output form of a rounded numeric column."""
    return _c(c).cast("double")


def safe_div(num: Column, den: Column) -> Column:
    """Decimal division that yields NULL for a zero denominator."""
    return num / F.nullif(den, F.lit(0))


def avg2(c) -> Column:
    """``ROUND(AVG(x), 2)`` for an integer or 2-place decimal column, exact."""
    x = _c(c)
    return F.round(safe_div(F.sum(x).cast("decimal(24,2)"), F.count(x)), 2)


def pct2(num: Column, den: Column) -> Column:
    """``ROUND(num::numeric / den * 100, 2)``: multiply first, divide once."""
    return F.round(safe_div(num.cast("decimal(20,0)") * F.lit(100), den), 2)


def bool_int(c) -> Column:
    """``b::int``: true 1, false 0, NULL stays NULL."""
    return _c(c).cast("int")


def bool_sum(c) -> Column:
    """``SUM(b::int)``: NULLs skipped, all-NULL group gives NULL."""
    return F.sum(bool_int(c)).cast("bigint")


def cond_sum(c) -> Column:
    """``SUM(CASE WHEN b THEN 1 ELSE 0 END)``: NULL counts as 0."""
    return F.sum(F.when(_c(c), F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def bins(c, edges: list[tuple[float, str]], else_label: str) -> Column:
    """Searched CASE over ascending upper bounds ``value <= bound``.

    A NULL value fails every test and lands in ``else_label``, as in SQL.
    """
    x = _c(c)
    expr = None
    for bound, label in edges:
        cond = x <= F.lit(bound)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(else_label))


# The mart bin scales (upper bound in minutes, label).
DURATION_BINS_7 = [
    (25, "1 (<= 25)"),
    (30, "2 (26-30)"),
    (35, "3 (31-35)"),
    (40, "4 (36-40)"),
    (45, "5 (41-45)"),
    (50, "6 (46-50)"),
]
DURATION_BINS_7_ELSE = "7 (>50)"

DURATION_BINS_9 = [
    (15, "<=15"),
    (20, "16-20"),
    (25, "21-25"),
    (30, "26-30"),
    (35, "31-35"),
    (40, "36-40"),
    (45, "41-45"),
    (50, "46-50"),
]
DURATION_BINS_9_ELSE = "late(>50)"


def duration_category(duration_min_hundredths) -> Column:
    """7-bin scale over rounded minutes, given as hundredths (``per_minute_hundredths``)."""
    edges = [(bound * 100, label) for bound, label in DURATION_BINS_7]
    return bins(duration_min_hundredths, edges, DURATION_BINS_7_ELSE)


def duration_bin_small(duration) -> Column:
    """9-bin scale over unrounded minutes: ``x/60 <= k`` is exactly ``x <= 60k``."""
    edges = [(bound * 60, label) for bound, label in DURATION_BINS_9]
    return bins(_c(duration).cast("long"), edges, DURATION_BINS_9_ELSE)
