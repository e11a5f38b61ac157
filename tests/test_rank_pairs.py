"""Rank correlations of columns with and without nulls against plain ranks."""

import numpy as np
import pandas as pd
import pytest

from gristmill.operators import correlate


def test_full_columns_are_ranked_once_and_others_by_pair(spark, monkeypatch):
    r = np.random.default_rng(0)
    f = pd.DataFrame({"a": r.integers(0, 5, 200), "b": r.normal(size=200), "c": r.integers(0, 9, 200), "d": r.normal(size=200)}).astype(float)
    f["b"] += f["a"]
    f.loc[::7, "d"] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in f.to_numpy()], "a double, b double, c double, d double")
    asked = []
    plain = correlate.pairs_by_rows
    monkeypatch.setattr(correlate, "pairs_by_rows", lambda df, both: asked.extend(both) or plain(df, both))
    got = {(v["a"], v["b"]): (v["n"], v["rho"]) for v in correlate.rank_pairs(df, list("abcd")).collect()}
    assert asked == [("a", "d"), ("b", "d"), ("c", "d")] and len(got) == 6
    for (a, b), (n, rho) in got.items():
        both = f[[a, b]].dropna()
        assert n == len(both) and rho == pytest.approx(both[a].rank().corr(both[b].rank()))
    assert correlate.rank_pairs(df.limit(0), list("abcd")).count() == 0
