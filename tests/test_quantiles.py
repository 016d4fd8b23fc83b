"""Histogram statistics against brute force."""

import math
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st

from matchmart.operators.quantiles import metric_stats, scalar_quantile


def pg_percentile_cont(values, p):
    """PostgreSQL's percentile_cont on float8: lo + frac * (hi - lo)."""
    v = sorted(float(x) for x in values if x is not None)
    if not v:
        return None
    pos = p * (len(v) - 1)
    lo, hi = math.floor(pos), math.ceil(pos)
    frac = pos - lo
    return v[lo] if frac == 0 else v[lo] + frac * (v[hi] - v[lo])


rows_strategy = st.lists(
    st.tuples(st.sampled_from(["a", "b", None]),
              st.one_of(st.none(), st.integers(-50, 50)),
              st.one_of(st.none(), st.decimals(min_value=-20, max_value=20, places=2,
                                               allow_nan=False, allow_infinity=False))),
    min_size=1, max_size=40)


@settings(max_examples=12, deadline=None)
@given(rows_strategy)
def test_metric_stats_equal_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "g string, x int, y decimal(10,2)")
    got = {r["g"]: r for r in metric_stats(df, ["g"], ["x", "y"],
                                           {"p50": 0.5, "p75": 0.75}).collect()}
    groups = {g for g, _, _ in rows}
    assert set(got) == groups
    for g in groups:
        xs = [x for gg, x, _ in rows if gg == g]
        ys = [y for gg, _, y in rows if gg == g]
        r = got[g]
        assert r["rows"] == len(xs)
        for name, vals in (("x", xs), ("y", ys)):
            present = [v for v in vals if v is not None]
            assert r[f"{name}_n"] == len(present)
            if present:
                total = sum(Decimal(v) for v in present)
                assert r[f"{name}_sum"] == total
                exact = (total / len(present)).quantize(Decimal("0.01"), rounding="ROUND_HALF_UP")
                assert r[f"{name}_avg2"] == exact
            else:
                assert r[f"{name}_sum"] is None and r[f"{name}_avg2"] is None
            assert r[f"{name}_p50"] == pg_percentile_cont(present, 0.5)
            assert r[f"{name}_p75"] == pg_percentile_cont(present, 0.75)


def test_scalar_quantile(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 10]], "v double")
    assert scalar_quantile(df, "v", 0.75).first()["q"] == 4.0
    assert scalar_quantile(df, "v", 0.3).first()["q"] == pg_percentile_cont([1, 2, 3, 4, 10], 0.3)


def test_hot_group_is_spread_by_value(spark):
    # one group holds every row: the histogram shuffle is keyed by (group, metric, value)
    df = spark.range(0, 5000).selectExpr("'hot' AS g", "CAST(id % 97 AS INT) AS x")
    r = metric_stats(df, ["g"], ["x"]).first()
    assert r["rows"] == 5000 and r["x_p50"] == pg_percentile_cont([i % 97 for i in range(5000)],
                                                                   0.5)
