"""Dashboard tables: the charts the dashboards show, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.expr import count_rows, share_of_total
from souk.functions.labels import DELIVERED
from souk.operators.common import PURCHASE_TS, order_totals_of
from souk.operators.customers import DEFAULT_AS_OF, cust_rfm_full
from souk.operators.delivery import dash_delivery_distribution
from souk.operators.kpis import kpi_category_performance
from souk.sources.tables import Tables

__all__ = ["dash_rfm_segments", "dash_top_categories", "dash_delivery_distribution",
           "dash_drilldown"]


def dash_rfm_segments(t: Tables, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """Customer count per RFM segment over the full RFM table."""
    g = cust_rfm_full(t, as_of).groupBy("rfm_segment").agg(count_rows().alias("customer_count"))
    return share_of_total(g, "customer_count", "pct_of_customers", 1).orderBy("rfm_segment")


def dash_top_categories(t: Tables, n: int = 10) -> DataFrame:
    return kpi_category_performance(t).limit(n)


def dash_drilldown(t: Tables, statuses: Sequence[str] = (DELIVERED,),
                   start: str | None = None, end: str | None = None) -> DataFrame:
    """Orders and revenue rolled up state -> city -> all (slicer filters as
    parameters: order statuses and a [start, end) purchase-date window).

    Orders are first reduced to one row per (state, city, order) so the
    rollup's Expand multiplies a de-duplicated, order-grain frame.
    """
    o = t.orders.where(F.col("order_status").isin(list(statuses)))
    if start is not None:
        o = o.where(F.col(PURCHASE_TS) >= F.to_timestamp_ntz(F.lit(start)))
    if end is not None:
        o = o.where(F.col(PURCHASE_TS) < F.to_timestamp_ntz(F.lit(end)))
    rows = (o.select("order_id", "customer_id")
            .join(order_totals_of(t).select("order_id", "order_total"), "order_id")
            .join(t.customers.select("customer_id", "customer_state", "customer_city"),
                  "customer_id"))
    per_order = rows.groupBy("customer_state", "customer_city", "order_id").agg(
        F.sum("order_total").alias("order_total"))
    figures = [F.countDistinct("order_id").alias("total_orders"),
               F.round(F.sum("order_total"), 2).cast("double").alias("revenue")]
    # The grand total is an aggregate of its own: it has a row on empty input too.
    levels = (per_order.rollup("customer_state", "customer_city")
              .agg(F.grouping_id().cast("long").alias("grouping_level"), *figures)
              .where(F.col("grouping_level") < 3))
    nothing = F.lit(None).cast("string")
    total = per_order.agg(*figures).select(
        nothing.alias("customer_state"), nothing.alias("customer_city"),
        F.lit(3).cast("long").alias("grouping_level"), "total_orders", "revenue")
    return levels.unionByName(total).orderBy("grouping_level", "customer_state", "customer_city")
