"""Exact percentiles of any doubles."""

import sys

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gristmill.operators import exact
from gristmill.operators.exact import medians, quantiles

TINY = 5e-324
CASES = [
    [-1.5e308, 0.0, 1.0, 1.5e308], [-sys.float_info.max, sys.float_info.max], [1.0, 2.0, 5.0], [7.0], [3.0] * 9, [TINY, 2 * TINY, 3 * TINY, 4 * TINY],
    [0.0, TINY, 1e-310, 1.0, 1e300], [1.0, 1.0 + 2**-52, 1.0 + 2**-51], [-0.0, 0.0, 1.0], [1e308] * 3 + [-1e308] * 2, list(map(float, range(3000))),
]


@pytest.mark.parametrize("values", CASES)
def test_all_shares_of_any_values(spark, values):
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = quantiles(spark.createDataFrame([(v,) for v in values], "v double"), {"v": shares})["v"]
    own = np.sort(np.array(values, np.longdouble))
    at = np.array(shares, np.longdouble) * (len(own) - 1)
    lo, hi = np.floor(at).astype(int), np.ceil(at).astype(int)
    want = own[lo] + (own[hi] - own[lo]) * (at - lo)
    assert np.allclose(np.array(got, float), want.astype(float), rtol=1e-12, atol=0)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=40))
def test_medians_of_any_doubles(spark, values):
    got = medians(spark.createDataFrame([(v,) for v in values], "v double"), ["v"])["v"]
    assert min(values) <= got <= max(values) and sum(v <= got for v in values) * 2 >= len(values) <= 2 * sum(v >= got for v in values)


def test_columns_without_numbers(spark):
    df = spark.createDataFrame([(None, float("nan"), 1), (None, float("inf"), 2)], "a double, b double, c int")
    assert quantiles(df, {"a": [0.5], "b": [0.5], "c": [0.5]}) == {"a": [None], "b": [None], "c": [1.5]}
    assert medians(df.limit(0), ["c"]) == {"c": None}


def test_many_percentiles_of_many_columns_are_those_of_numpy(spark):
    r = np.random.default_rng(5)
    own = {"a": r.normal(size=3000), "b": r.integers(0, 40, 3000).astype(float), "c": np.exp(r.normal(0, 20, 3000))}
    df = spark.createDataFrame([tuple(map(float, v)) for v in zip(*own.values(), strict=True)], "a double, b double, c double")
    shares = [k / 32 for k in range(1, 32)]
    plans = []
    plain = exact.counted
    exact.counted = lambda own, spans: plans.append(len(spans)) or plain(own, spans)
    try:
        got = quantiles(df, {c: shares for c in own})
    finally:
        exact.counted = plain
    assert all(np.allclose(got[c], np.quantile(v, shares), rtol=1e-12) for c, v in own.items()) and len(plans) > 1
