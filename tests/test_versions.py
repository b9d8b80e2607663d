"""Two versions of a table: copies, nulls, empty sides, hot rows."""

import random
from collections import Counter

import pytest

from souk.operators.versions import reconcile, row_counts, surplus

SCHEMA = "k long, a string, b long"


def rows(seed, n):
    rnd = random.Random(seed)
    return [(rnd.choice([None, 1, 2, 3, 4, 5]), rnd.choice([None, "", "x"]), rnd.choice([None, 0])) for _ in range(n)] + [(9, "hot", 1)] * n


@pytest.mark.parametrize("old,new", [(rows(1, 30), rows(2, 25)), (rows(1, 30), []), ([], rows(1, 9)), ([], []), (rows(5, 20), rows(5, 20))])
def test_bags(spark, old, new):
    one, two = Counter(old), Counter(new)
    a, b = spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)
    counts = row_counts(a, b.select("b", "k", "a"))
    got = {(r["k"], r["a"], r["b"]): (r["in_old"], r["in_new"]) for r in counts.collect()}
    assert got == {x: (one[x], two[x]) for x in one | two}
    left = counts.select("k", "a", "b", surplus("in_old", "in_new").alias("n")).where("n > 0").collect()
    assert {tuple(r[:3]): r["n"] for r in left} == dict(one - two)
    assert Counter(map(tuple, a.exceptAll(b).collect())) == one - two


@pytest.mark.parametrize("seed", range(4))
def test_reconcile(spark, seed):
    old, new = rows(seed, 6 + seed), rows(seed + 10, 8)
    got = {r["k"]: tuple(r)[1:] for r in reconcile(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA), ["k"]).collect()}
    want = {}
    for k in {r[0] for r in old + new}:
        one, two = (Counter(r for r in side if r[0] == k) for side in (old, new))
        change = "added" if not one else "removed" if not two else "same" if one == two else "changed"
        want[k] = (change, one.total(), two.total())
    assert got == want


def test_reconcile_same_rows_in_other_numbers_are_a_change(spark):
    old = spark.createDataFrame([(1, "x", 1), (1, "x", 1), (2, None, None)], SCHEMA)
    new = spark.createDataFrame([(1, "x", 1), (2, None, None)], SCHEMA)
    assert sorted(map(tuple, reconcile(old, new, ["k"]).collect())) == [(1, "changed", 2, 1), (2, "same", 1, 1)]
