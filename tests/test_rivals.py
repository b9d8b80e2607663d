"""Counts of smaller rows against brute force: ties, nulls, hot keys, parts, plans."""

import random
from collections import Counter

import pytest

from souk.operators.rivals import count_below

SCHEMA = "id long, k long, v double"


def rows(seed, n):
    """Over a third of the rows has one key; values have ties, nulls, NaN and both zeros."""
    rnd = random.Random(seed)
    key = lambda: 1 if rnd.random() < 0.4 else rnd.choice([None, 2, 3, 4])
    return [(i, key(), rnd.choice([None, 0.0, -0.0, float("nan"), *map(float, range(-9, 9))])) for i in range(n)]


def place(v):
    return (1, 0.0) if v != v else (0, v)


def brute(left, right, inclusive):
    out = Counter()
    for i, k, v in left:
        n = None if k is None or v is None else sum(
            place(w) < place(v) or (inclusive and place(w) == place(v)) for _, j, w in right if j == k and w is not None)
        out[(i, k, n)] += 1
    return out


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("parts", [None, 1, 50])
def test_count_below(spark, inclusive, parts):
    left, right = rows(1, 300), rows(2, 250)
    got = count_below(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["k"], "v", "n", inclusive, parts)
    assert got.columns == ["id", "k", "v", "n"]
    assert Counter((r["id"], r["k"], r["n"]) for r in got.collect()) == brute(left, right, inclusive)


def test_count_below_empty_sides_copies_and_no_key(spark):
    a, b = rows(3, 40), rows(4, 30)
    for left, right in ((a, []), ([], b), ([], []), (a * 3, b * 2)):
        got = count_below(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["k"], "v", "n")
        assert Counter((r["id"], r["k"], r["n"]) for r in got.collect()) == brute(left, right, False)
    one = spark.range(100).selectExpr("id", "id % 10 AS v")
    assert count_below(one, one, [], "v", "n").where("n <> v * 10").count() == 0


def test_hot_key_is_dealt_by_ranges(spark):
    """All rows have one key: windows over rows are grouped by part as well, and no rows meet
    by a nested loop."""
    df = spark.range(20_000).selectExpr("id", "1L AS k", "id * 7 % 20000 AS v")
    got = count_below(df, df, ["k"], "v", "n", parts=16)
    assert got.where("n = v").count() == 20_000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Cross" not in plan
    windows = [x for x in plan.splitlines() if "Window [sum(" in x]
    assert len(windows) == 2 and sum("[__part#" in x.split("specifiedwindowframe")[-1] for x in windows) >= 1
    physical = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in physical
