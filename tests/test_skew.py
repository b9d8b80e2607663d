"""Hot keys: one customer owns over a third of the orders, one order holds
over a third of the items, and one order id is stored in 200 copies. With broadcasts off and AQE's skew thresholds
lowered, the skew-join path really runs; results must still equal the DuckDB
statements."""

import tempfile
from datetime import datetime, timedelta
from decimal import Decimal as D

import duckdb
import pytest

from compare import compare
from souk.operators import common
from souk.plans.activity_oracle import STATEMENTS as ANALYSIS_STATEMENTS
from souk.plans.activity_registry import ANALYSES
from souk.plans.oracle import AS_OF, STATEMENTS
from souk.plans.registry import run
from souk.schema import SCHEMAS
from souk.sources.tables import load_tables

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1024",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}

KEYS = ["kpi_state_performance", "cust_top_cities", "cust_summary", "cust_top_ranked",
        "kpi_category_performance", "review_by_state", "delivery_by_state", "kpi_snapshot",
        "kpi_snapshot_order_grain", "dq_orphan_orders", "dq_scorecard", "dq_duplicate_orders",
        "cust_rfm_full", "review_by_category"]


def skewed_rows():
    t0 = datetime(2020, 1, 1)
    orders, items, reviews = [], [], []
    for oid in range(1, 601):
        cid = 1 if oid % 5 < 2 else 2 + oid % 40          # customer 1: 40 % of orders
        p = t0 + timedelta(hours=oid * 7)
        orders.append((oid, cid, "delivered" if oid % 7 else "shipped", p,
                       p + timedelta(days=3 + oid % 12), p + timedelta(days=9)))
        reviews.append((oid, oid, 1 + oid % 5))
        for j in range(1 + oid % 3):
            items.append((oid, 1 + (oid + j) % 9, 1 + j, D(f"{5 + oid % 50}.25"), D("1.10")))
    for j in range(900):                                   # order 8 (delivered): hot order
        items.append((8, 1 + j % 9, 1 + j % 4, D("2.50"), D("0.10")))
    orders.extend([orders[1]] * 200)                       # order 2: 201 stored copies
    customers = [(c, c - (c % 2 if c > 10 else 0), f"city{c % 5}", f"S{c % 3}") for c in range(1, 42)]
    products = [(p, f"cat{p % 4}" if p % 5 else None, 100, 10) for p in range(1, 10)]
    translation = [("cat1", "Cat One"), ("cat2", "Cat Two")]
    return {"orders": orders, "order_items": items, "order_payments": [],
            "order_reviews": reviews, "customers": customers, "sellers": [(1,), (2,)],
            "products": products, "category_translation": translation}


@pytest.fixture(scope="module")
def skew_env(spark):
    path = tempfile.mkdtemp(prefix="souk-skew-")
    for name, data in skewed_rows().items():
        spark.createDataFrame(data, SCHEMAS[name]).repartition(4).write.parquet(f"{path}/{name}")
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW m_{name} AS SELECT * FROM read_parquet('{path}/{name}/*.parquet')")
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield load_tables(spark, path), con
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.mark.parametrize("key", KEYS)
def test_hot_keys_match_oracle(skew_env, key):
    tables, con = skew_env
    df = run(key, tables, as_of=AS_OF)
    assert compare(df, con, STATEMENTS[key]) == []


@pytest.mark.parametrize("key", ["cube_sales", "json_order_facts", "json_seller_items"])
def test_hot_keys_of_analyses_match_oracle(skew_env, monkeypatch, key):
    monkeypatch.setattr(common, "ROWS_PER_TASK", 100)
    tables, con = skew_env
    assert compare(ANALYSES[key](tables, None), con, ANALYSIS_STATEMENTS[key]) == []


def test_skew_join_split_happens(skew_env):
    tables, _ = skew_env
    df = run("cust_summary", tables)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan
