"""The best pairs of a tournament: nothing lost, and few rows that meet."""

from itertools import combinations

import numpy as np

from gristmill.operators import match


def gain(a, b):
    whole = 2 * match.BETA2 + a[2] ** 2 + b[2] ** 2
    return (a[2] + b[2]) * np.sqrt(2 * match.BETA2 / whole) * np.exp(-((a[1] - b[1]) ** 2) / (2 * whole))


def brute(rows, k):
    every = [(-round(float(gain(a, b)), 9), a[0], b[0]) for a, b in combinations(sorted(rows), 2)]
    return [(i, j) for _, i, j in sorted(every)[:k]]


def test_best_pairs_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    cases = {
        "copies": [(i, float(i % 3), float(2 + i % 2)) for i in range(150)],
        "continuous": [(i, float(m), float(s)) for i, (m, s) in enumerate(zip(rng.normal(25, 8, 200), rng.uniform(0, 20, 200), strict=True))],
        "few": [(i, float(i), 3.0) for i in range(4)],
    }
    for name, rows in cases.items():
        got = match.best_pairs(spark.createDataFrame(rows, "m long, mu double, sigma double"), "m", 40, probe=30).collect()
        assert [(r["left_id"], r["right_id"]) for r in got] == brute(rows, 40), name


def test_rows_of_equal_gain_do_not_all_meet(spark):
    n = 3000
    rows = spark.range(n).selectExpr("id AS m", "cast(25 + (id % 1000) / 100 AS double) AS mu", "cast(2 + id % 7 AS double) AS sigma")
    own, bar, width = match.able(rows, "m", 40)
    assert match.meetings(own, "m", width).count() < 60 * n  # all pairs: 4 498 500
    same = spark.range(n).selectExpr("id AS m", "25d AS mu", "8d AS sigma")
    own, bar, width = match.able(same, "m", 40)
    assert own.count() == 41
