"""Sketches against exact figures, over the test data and over many values."""

import pytest
from pyspark.sql import functions as F

from souk.operators import sketches
from souk.operators.common import delivered_order_rows
from souk.sources.tpch import from_tpch

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def t(spark):
    return from_tpch(spark, SF)


@pytest.fixture(scope="module")
def sold(t):
    return sketches._sold(t).toPandas()


def test_people_by_state_and_period(t, sold):
    sold["quarter"] = sold.month.str[:4] + "-Q" + ((sold.month.str[5:].astype(int) + 2) // 3).astype(str)
    exact = {}
    for state, month, quarter, who in zip(sold.state, sold.month, sold.quarter, sold.who):
        for p in (month, quarter, month[:4], "all"):
            exact.setdefault((state, p), set()).add(who)
    got = {(r["state"], r["period"]): r["customers"] for r in sketches.sketch_active_customers(t).collect()}
    assert got.keys() == exact.keys()
    assert max(abs(got[k] - len(v)) / len(v) for k, v in exact.items()) <= 0.05


def test_errors_are_within_the_bound(t):
    rows = sketches.sketch_active_error(t).collect()
    assert rows and all(r["within"] for r in rows) and max(r["customers"] for r in rows) > 4096


def test_quantiles_by_rank(t, sold):
    for r in sketches.sketch_order_value(t).collect():
        mine = sold.paid[sold.state == r["state"]]
        assert r["orders"] == len(mine)
        for p in (50, 90, 99):
            assert abs((mine <= r[f"p{p}"]).mean() - p / 100) <= 0.03


def test_merged_sketches_of_many_people(spark):
    """Months share people: the union counts each once."""
    rows = spark.range(300_000).select((F.col("id") % 3).cast("string").alias("month"), (F.col("id") % 100_000).alias("who"))
    months = rows.groupBy("month").agg(F.hll_sketch_agg("who", sketches.LG_K).alias("people"))
    [r] = sketches.people(months).collect()
    assert abs(r["customers"] / 100_000 - 1) <= 0.05


def test_retention_of_a_month_without_a_next_one(t, sold):
    bought = sold.groupby("month").who.apply(set).to_dict()
    got = {r["month"]: tuple(r)[1:] for r in sketches.sketch_retention(t).collect()}
    assert got.keys() == bought.keys()
    for month, who in bought.items():
        year, m = map(int, month.split("-"))
        later = bought.get(f"{year + m // 12}-{m % 12 + 1:02d}", set())
        n, retained, lost = got[month]
        assert n == retained + lost == len(who) and retained == len(who & later)  # at most 4,096: exact


def test_empty(spark, empty_dir):
    from souk.sources.tables import load_tables
    t = load_tables(spark, empty_dir)
    for f in (sketches.sketch_active_customers, sketches.sketch_active_error, sketches.sketch_order_value, sketches.sketch_retention):
        assert f(t).count() == 0
    assert delivered_order_rows(t).count() == 0
