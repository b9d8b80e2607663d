"""The snapshot over an order with thousands of sellers, and orders stored several times."""

from datetime import datetime
from decimal import Decimal as D

from souk.operators.kpis import kpi_snapshot, kpi_snapshot_order_grain
from souk.schema import SCHEMAS
from souk.sources.tables import Tables


def bundle(spark, **rows):
    return Tables(**{name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()})


def test_hot_order(spark):
    at = datetime(2020, 1, 1)
    orders = [(1, 1, "delivered", at, at, at)] * 3 + [(2, 1, "delivered", at, at, at), (2, 2, "delivered", at, at, at),
                                                      (3, None, "delivered", at, at, at), (4, 9, "shipped", at, at, at)]
    items = [(1, 1, i, D("2.00"), D("0.50")) for i in range(5000)] + [(1, 1, 7, D("1.00"), D("0.00"))]
    items += [(2, 1, 5000, D("10.00"), D("1.00")), (2, 1, None, None, None), (3, 1, None, D("4.00"), D("1.00")), (4, 1, 9999, D("9.00"), D("9.00"))]
    t = bundle(spark, orders=orders, order_items=items)
    goods, freight, n = 10001.0, 2500.0, 5001
    got = kpi_snapshot_order_grain(t).first()
    assert (got["total_orders"], got["unique_customers"], got["active_sellers"]) == (3, 2, 5001)
    assert got["product_revenue"] == 3 * goods + 2 * 10 + 4 and got["freight_revenue"] == 3 * freight + 2 + 1
    got = kpi_snapshot(t).first()
    assert got["product_revenue"] == 3 * n * goods + 2 * 2 * 10 + 4
    assert got["total_revenue"] == 3 * n * (goods + freight) + 2 * 2 * 11 + 5
    assert got["average_order_value"] == round(got["total_revenue"] / (3 * n + 2 * 2 + 1), 2)
    plan = kpi_snapshot(t)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
