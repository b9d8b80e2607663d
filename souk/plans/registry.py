"""Name -> operator registry: every analytic result the library produces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from souk.operators import customers, dashboards, delivery, kpis, quality, reviews
from souk.sources.tables import Tables

Operator = Callable[..., DataFrame]

OPERATORS: dict[str, Operator] = {
    # data quality
    "dq_row_counts": quality.dq_row_counts,
    "dq_null_orders": quality.dq_null_orders,
    "dq_null_delivery_by_status": quality.dq_null_delivery_by_status,
    "dq_null_products": quality.dq_null_products,
    "dq_duplicate_orders": quality.dq_duplicate_orders,
    "dq_date_range": quality.dq_date_range,
    "dq_status_distribution": quality.dq_status_distribution,
    "dq_orphan_orders": quality.dq_orphan_orders,
    "dq_orphan_items_product": quality.dq_orphan_items_product,
    "dq_price_sanity": quality.dq_price_sanity,
    "dq_scorecard": quality.dq_scorecard,
    "dq_failing_rows": quality.dq_failing_rows,
    # business KPIs
    "kpi_snapshot": kpis.kpi_snapshot,
    "kpi_snapshot_order_grain": kpis.kpi_snapshot_order_grain,
    "kpi_monthly_trend": kpis.kpi_monthly_trend,
    "kpi_quarterly": kpis.kpi_quarterly,
    "kpi_orders_by_weekday": kpis.kpi_orders_by_weekday,
    "kpi_orders_by_hour": kpis.kpi_orders_by_hour,
    "kpi_category_performance": kpis.kpi_category_performance,
    "kpi_state_performance": kpis.kpi_state_performance,
    # customers
    "cust_repeat_segments": customers.cust_repeat_segments,
    "cust_top_cities": customers.cust_top_cities,
    "cust_rfm": customers.cust_rfm,
    "cust_rfm_full": customers.cust_rfm_full,
    "cust_clv": customers.cust_clv,
    "cust_summary": customers.cust_summary,
    "cust_top_ranked": customers.cust_top_ranked,
    # delivery
    "delivery_overall": delivery.delivery_overall,
    "delivery_on_time": delivery.delivery_on_time,
    "delivery_by_state": delivery.delivery_by_state,
    "delivery_speed_vs_review": delivery.delivery_speed_vs_review,
    # reviews
    "review_distribution": reviews.review_distribution,
    "review_satisfaction": reviews.review_satisfaction,
    "review_by_category": reviews.review_by_category,
    "review_by_state": reviews.review_by_state,
    # dashboards
    "dash_rfm_segments": dashboards.dash_rfm_segments,
    "dash_delivery_distribution": dashboards.dash_delivery_distribution,
    "dash_top_categories": dashboards.dash_top_categories,
    "dash_drilldown": dashboards.dash_drilldown,
}

# Operators that take the RFM reference date.
AS_OF_KEYS = {"cust_rfm", "cust_rfm_full", "dash_rfm_segments"}


def run(key: str, tables: Tables, as_of: str | None = None, **params) -> DataFrame:
    op = OPERATORS[key]
    if as_of is not None and key in AS_OF_KEYS:
        params["as_of"] = as_of
    return op(tables, **params)


def run_all(tables: Tables, as_of: str | None = None, keys=None,
            reuse: bool = True) -> dict[str, DataFrame]:
    """Several results at once. With ``reuse`` the shared building blocks
    (order totals, delivered order rows, per-person aggregates) are
    checkpointed once and read by every result instead of re-joined."""
    t = tables.with_reuse() if reuse else tables
    return {k: run(k, t, as_of) for k in (keys or OPERATORS)}
