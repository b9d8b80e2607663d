"""Joins in time against brute force: ties, nulls, hot keys, cuts of slices, plans."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from souk.operators.temporal import asof_join, interval_join, overlap_join

LEFT, RIGHT = "id long, k long, ts long, found string", "k long, ts long, o long, v string"


def sides(seed, n=400, m=300, hot=True):
    """A third of the rows has one key; times have ties and nulls."""
    rnd = random.Random(seed)
    key = lambda: 1 if hot and rnd.random() < 0.35 else rnd.choice([None, 2, 3, 4, 5, 6])
    time = lambda: rnd.choice([None, *range(-30, 60)])
    return ([(i, key(), time(), "x") for i in range(n)],
            [(key(), time(), rnd.randint(0, 2), rnd.choice([None, "a", "b", f"v{i}"])) for i in range(m)])


def brute_asof(left, right, strict, forward, tolerance):
    out = []
    sign = -1 if forward else 1
    for i, k, t, x in left:
        best = None
        for rk, rt, o, v in right:
            if None in (k, t, rk, rt) or rk != k:
                continue
            gap = (t - rt) * sign
            if gap < 0 or (strict and gap == 0):
                continue
            rank = (-gap, o, v is not None, v or "")
            if best is None or rank > best[0]:
                best = (rank, v, gap)
        out.append((i, k, t, x, best[1] if best and (tolerance is None or best[2] <= tolerance) else None))
    return Counter(out)


@pytest.mark.parametrize("strict,forward,tolerance", [(False, False, None), (True, False, None), (False, True, None),
                                                      (True, True, 5), (False, False, 3)])
@pytest.mark.parametrize("width", [None, 1, 7, 10_000])
def test_asof(spark, strict, forward, tolerance, width):
    left, right = sides(hash((strict, forward)) % 7)
    got = asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), [("k", "k")], ("ts", "ts"), {"v": "v"},
                    strict=strict, forward=forward, tolerance=tolerance, order=["o"], width=width)
    assert got.columns == ["id", "k", "ts", "found", "v"]
    assert Counter(map(tuple, got.collect())) == brute_asof(left, right, strict, forward, tolerance)


def test_asof_empty_sides_and_copies(spark):
    left, right = sides(3, 60, 40)
    for a, b in ((left, []), ([], right), ([], []), (left * 3, right * 2)):
        got = asof_join(spark.createDataFrame(a, LEFT), spark.createDataFrame(b, RIGHT), [("k", "k")], ("ts", "ts"), {"v": "v"}, order=["o"])
        assert Counter(map(tuple, got.collect())) == brute_asof(a, b, False, False, None)


def test_asof_hot_key_is_dealt_by_slices(spark):
    """One key has all rows: the window's groups are slices, and only the starts of slices
    are ordered within the whole key."""
    left = spark.range(20_000).selectExpr("id", "1L AS k", "id AS ts", "'x' AS found")
    right = spark.range(0, 20_000, 50).selectExpr("1L AS k", "id AS ts", "0L AS o", "string(id) AS v")
    got = asof_join(left, right, [("k", "k")], ("ts", "ts"), {"v": "v"}, width=500)
    assert got.filter(F.col("v").cast("long") == F.col("id") - F.col("id") % 50).count() == 20_000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [last(" in x]
    assert len(windows) == 2 and sum("slice#" in x.split("specifiedwindowframe")[0] or "k0" in x for x in windows) == 2
    assert "CartesianProduct" not in plan and "Cross" not in plan


def spans(seed, n=250):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        a = rnd.choice([None, *range(-40, 200)])
        size = rnd.choice([0, 1, 1, 2, 3, 7, 8, 9, 64, 150, -4])
        out.append((i, rnd.choice([1, 1, 2, 3, None]), a, None if a is None or rnd.random() < 0.03 else a + size))
    return out


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("keyed", [False, True])
def test_interval(spark, closed, keyed):
    rnd = random.Random(9)
    points = [(i, rnd.choice([1, 1, 2, None]), rnd.choice([None, *range(-60, 260)])) for i in range(300)]
    ranges = spans(4)
    got = interval_join(spark.createDataFrame(points, "p long, pk long, start long"), spark.createDataFrame(ranges, "i long, ik long, a long, b long"),
                        "start", ("a", "b"), keys=[("pk", "ik")] if keyed else (), closed=closed)
    want = Counter((*p, *r) for p in points for r in ranges if None not in (p[2], r[2], r[3])
                   and r[2] <= p[2] < r[3] + closed and (not keyed or (p[1] is not None and p[1] == r[1])))
    assert Counter(map(tuple, got.collect())) == want


@pytest.mark.parametrize("keyed", [False, True])
def test_overlap(spark, keyed):
    one, two = spans(5, 120), spans(6, 120)
    got = overlap_join(spark.createDataFrame(one, "i long, ik long, a long, b long"), spark.createDataFrame(two, "j long, jk long, c long, d long"),
                       ("a", "b"), ("c", "d"), keys=[("ik", "jk")] if keyed else ())
    whole = lambda x: None not in (x[2], x[3]) and x[2] < x[3]
    want = Counter((*x, *y) for x in one for y in two if whole(x) and whole(y) and x[2] < y[3] and y[2] < x[3]
                   and (not keyed or (x[1] is not None and x[1] == y[1])))
    assert Counter(map(tuple, got.collect())) == want


def test_interval_of_dates_and_times(spark):
    points = spark.sql("SELECT 1 AS p, timestamp_ntz'1969-12-31 23:59:59.999999' AS t UNION ALL SELECT 2, timestamp_ntz'2024-02-29 12:00:00'")
    ranges = spark.sql("SELECT 7 AS i, timestamp_ntz'1969-01-01' AS a, timestamp_ntz'1970-01-01' AS b UNION ALL SELECT 8, timestamp_ntz'2024-02-29 12:00:00', timestamp_ntz'2024-02-29 12:00:00.000001'")
    assert sorted((r["p"], r["i"]) for r in interval_join(points, ranges, "t", ("a", "b")).collect()) == [(1, 7), (2, 8)]
    days = spark.sql("SELECT 1 AS p, date'2024-03-01' AS t")
    months = spark.sql("SELECT 7 AS i, date'2024-02-01' AS a, date'2024-02-29' AS b UNION ALL SELECT 8, date'2024-03-01', date'2024-04-01'")
    assert [r["i"] for r in interval_join(days, months, "t", ("a", "b")).collect()] == [8]
    with pytest.raises(TypeError):
        interval_join(days.withColumn("t", F.lit("x")), months, "t", ("a", "b"))


def test_interval_plan_is_an_equi_join_on_cells(spark):
    points, ranges = spark.range(1000).selectExpr("id AS p", "id AS t"), spark.range(1000).selectExpr("id AS i", "id AS a", "id + id % 90 AS b")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = interval_join(points, ranges, "t", ("a", "b"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    join = next(x for x in plan.splitlines() if "SortMergeJoin" in x)
    assert "place" in join and "cell" in join and "CartesianProduct" not in plan
