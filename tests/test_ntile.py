"""NTILE by cut rows equals the single-partition built-in."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from souk.functions.ntile import ntile_by_cuts


def _check(df, k, **sizes):
    got = ntile_by_cuts(df, k, "id", {"v": "tile"}, **sizes).select("id", "tile")
    want = df.select("id", F.ntile(k).over(Window.orderBy("v", "id")).cast("long").alias("tile"))
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("n", [0, *range(1, 13), 37, 39])
def test_matches_builtin(spark, n):
    rnd = random.Random(n * 31)
    # one hot value holds over a third of the rows
    rows = [(i, 1 if rnd.random() < 0.4 else rnd.randint(0, 20)) for i in range(n)]
    _check(spark.createDataFrame(rows, "id long, v long"), 3)


@pytest.mark.parametrize("k", [1, 2, 4, 10])
def test_other_numbers_of_tiles(spark, k):
    _check(spark.createDataFrame([(i, i * 7 % 11) for i in range(50)], "id long, v long"), k)


@pytest.mark.parametrize("share", [0.0, 0.5, 0.9, 1.0])
def test_narrowing_with_a_hot_value(spark, share):
    """Ranges are narrowed by pivots down to 20 rows; ids are strings."""
    rnd = random.Random(5)
    rows = [(f"{rnd.getrandbits(64):016x}", 7 if rnd.random() < share else rnd.randint(0, 10**6)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "id string, v long").checkpoint()
    _check(df, 3, small=20, pivots=8)


def test_nulls_sort_first(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 1), (4, None)], "id long, v long")
    got = dict(ntile_by_cuts(df, 2, "id", {"v": "t"}).select("id", "t").collect())
    assert got == {1: 1, 4: 1, 3: 2, 2: 2}
    _check(spark.createDataFrame([(i, None if i % 2 else i) for i in range(400)], "id long, v long"), 3, small=5, pivots=4)
