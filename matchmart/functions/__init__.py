"""Column-expression helpers (JVM-side, no UDFs)."""

from matchmart.functions.numeric import (  # noqa: F401
    avg2, bins, bool_int, bool_sum, cond_sum, duration_bin_small, duration_category,
    from_hundredths, hundredths, minutes, minutes_double, pct2, per_minute,
    per_minute_hundredths, round2, safe_div, to_out, whole_minutes,
)
from matchmart.functions.lookup import region_name  # noqa: F401
from matchmart.functions.text import (  # noqa: F401
    coerce_int, normalize_text, null_if_empty_list, parse_bool, strip_lower,
)
