"""The driver contract: entry smoke check and the sf0.01 oracle gate."""

import os

import pytest

import __spark_entry__ as E
from compare import compare, duck
from souk.plans.activity_registry import ANALYSES, ESTIMATES, STREAMS
from souk.plans.registry import OPERATORS

SF001 = "/root/testdata/sf0.01"


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["category", "total_orders", "product_revenue", "average_item_price",
                          "revenue_share_pct"]


def test_every_query_has_oracle():
    assert set(OPERATORS) | set(ANALYSES) | set(STREAMS) == set(E.oracle_sql()) - set(E.LLM_ORACLE)
    assert set(E.queries()) == set(OPERATORS) | set(ANALYSES) | set(ESTIMATES) | set(STREAMS) | set(E.LLM_QUERIES)


def test_query_opens_only_its_tables_and_writes_nothing(spark, monkeypatch):
    from souk.sources import tpch
    opened = []
    read = tpch._read
    monkeypatch.setattr(tpch, "_read", lambda s, d, name: opened.append(name) or read(s, d, name))
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = sorted(os.listdir(folder)) if os.path.isdir(folder) else []
    E.queries()["dq_null_products"](spark, SF001).collect()
    assert opened == ["part"]
    assert (sorted(os.listdir(folder)) if os.path.isdir(folder) else []) == before


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF001):
        pytest.skip("test data not present")
    return duck(SF001)


@pytest.mark.parametrize("key", sorted([*OPERATORS, *ANALYSES, *STREAMS]))
def test_sf001_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF001)
    assert compare(df, con, E.oracle_sql()[key]) == []
