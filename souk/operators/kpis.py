"""Business KPIs over delivered orders: snapshot, monthly trend, quarters,
weekday and hour profiles, category and state performance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.expr import as_double, avg_of, round_dp, share_of_total
from souk.functions.labels import QUARTERS, WEEKDAYS
from souk.operators.common import (
    PURCHASE_TS, delivered_order_rows, delivered_orders, product_categories,
)
from souk.sources.tables import Tables


def _money(c) -> F.Column:
    return F.round(c, 2).cast("double")


def _snapshot(t: Tables, weighted: bool) -> DataFrame:
    """Shared body of both snapshot forms.

    One pass over the items gives a row for each (order, seller) with sums and
    a count, so a hot order is one row for each of its sellers from there on.
    Joined with the delivered orders (one row for each order and customer, with
    their number), these rows are grouped by order and, beside it, by seller;
    both combine before their one shuffle.

    ``weighted`` reproduces the original query, which joins order totals back
    to the item rows so every order's totals count once per item: sums become
    sum(x * n_items) and the average is item-weighted. Same numbers, without
    the item-level fan-out join. Unweighted counts each order row once.
    """
    pairs = t.order_items.groupBy("order_id", "seller_id").agg(
        F.sum("price").alias("p"), F.sum("freight_value").alias("f"),
        F.sum(F.col("price") + F.col("freight_value")).alias("o"), F.count(F.lit(1)).alias("n"))
    orders = delivered_orders(t).groupBy("order_id", "customer_id").agg(F.count(F.lit(1)).alias("m"))
    rows = pairs.join(orders, "order_id")
    order = ["order_id", "customer_id", "m"]
    grouped = rows.groupingSets([order, ["seller_id"]], *order, "seller_id").agg(
        F.grouping("seller_id").alias("of_order"),
        *(F.sum(c).alias(c) for c in ("p", "f", "o", "n"))).where("of_order = 1 OR seller_id IS NOT NULL")
    of_order = F.col("of_order") == 1
    w = F.when(of_order, F.col("m") * F.col("n") if weighted else F.col("m"))
    return grouped.agg(
        F.countDistinct("order_id").alias("total_orders"),
        F.countDistinct("customer_id").alias("unique_customers"),
        F.count_if(~of_order).alias("active_sellers"),
        F.sum(F.col("p") * w).alias("sp"),
        F.sum(F.col("f") * w).alias("sf"),
        F.sum(F.col("o") * w).alias("st"),
        F.sum(F.when(F.col("o").isNotNull(), w)).alias("cnt")).select(
        "total_orders", "unique_customers", "active_sellers",
        _money(F.col("sp")).alias("product_revenue"),
        _money(F.col("sf")).alias("freight_revenue"),
        _money(F.col("st")).alias("total_revenue"),
        round_dp(F.try_divide(as_double("st"), F.col("cnt")), 2).alias("average_order_value"),
        round_dp(F.try_divide(as_double("sf"), as_double("sp")) * F.lit(100.0), 2)
        .alias("freight_share_pct"))


def kpi_snapshot(t: Tables) -> DataFrame:
    """Snapshot exactly as the original computes it (item fan-out weights)."""
    return _snapshot(t, weighted=True)


def kpi_snapshot_order_grain(t: Tables) -> DataFrame:
    """Snapshot with every order's totals counted once."""
    return _snapshot(t, weighted=False)


def kpi_monthly_trend(t: Tables) -> DataFrame:
    rows = delivered_order_rows(t).withColumn("month", F.date_format(PURCHASE_TS, "yyyy-MM"))
    monthly = rows.groupBy("month").agg(
        F.countDistinct("order_id").alias("total_orders"),
        F.countDistinct("customer_id").alias("total_customers"),
        F.sum("order_total").alias("rev"),
        avg_of("order_total").alias("aov"))
    # One row per month: a tiny, bounded input for the ordered LAG window.
    prev = F.lag(as_double("rev")).over(Window.orderBy("month"))
    growth = F.try_divide(as_double("rev") - prev, prev) * F.lit(100.0)
    return (monthly.select(
        "month", "total_orders", "total_customers",
        _money(F.col("rev")).alias("revenue"),
        round_dp("aov", 2).alias("average_order_value"),
        round_dp(growth, 2).alias("mom_growth_pct"))
        .orderBy("month"))


def kpi_quarterly(t: Tables) -> DataFrame:
    ts = F.col(PURCHASE_TS)
    # A row without a timestamp belongs to the last quarter, as in the original.
    quarter = F.element_at(F.array(*map(F.lit, QUARTERS)), F.coalesce(F.quarter(ts), F.lit(4)))
    rows = delivered_order_rows(t).select(
        F.date_format(ts, "yyyy").alias("year"), quarter.alias("quarter"),
        "order_id", "order_total")
    return (rows.groupBy("year", "quarter").agg(
        F.countDistinct("order_id").alias("total_orders"),
        _money(F.sum("order_total")).alias("revenue"),
        round_dp(avg_of("order_total"), 2).alias("average_order_value"))
        .orderBy("year", "quarter"))


def kpi_orders_by_weekday(t: Tables) -> DataFrame:
    dow = F.dayofweek(PURCHASE_TS) - 1  # 0 = Sunday
    name = None
    for i, label in enumerate(WEEKDAYS):
        name = F.when(dow == i, label) if name is None else name.when(dow == i, label)
    return (delivered_orders(t)
            .groupBy(dow.alias("dow"), name.alias("day_of_week"))
            .agg(F.countDistinct("order_id").alias("total_orders"))
            .orderBy("dow").select("day_of_week", "total_orders"))


def kpi_orders_by_hour(t: Tables) -> DataFrame:
    return (delivered_orders(t)
            .groupBy(F.hour(PURCHASE_TS).cast("long").alias("hour_of_day"))
            .agg(F.countDistinct("order_id").alias("total_orders"))
            .orderBy("hour_of_day"))


def category_sales(t: Tables) -> DataFrame:
    """Delivered item rows with their category (item grain)."""
    items = t.order_items.select("order_id", "product_id", "price")
    return (items.join(delivered_orders(t).select("order_id"), "order_id")
            .join(product_categories(t), "product_id"))


def kpi_category_performance(t: Tables) -> DataFrame:
    return t.shared("category_performance", lambda: _category_performance(t)).orderBy(
        F.desc("product_revenue"), "category")


def _category_performance(t: Tables) -> DataFrame:
    g = category_sales(t).groupBy("category").agg(
        F.countDistinct("order_id").alias("total_orders"),
        F.sum("price").alias("rev"),
        avg_of("price").alias("avg_price"))
    return (share_of_total(g, "rev", "revenue_share_pct", 2).select(
        "category", "total_orders", _money(F.col("rev")).alias("product_revenue"),
        round_dp("avg_price", 2).alias("average_item_price"), "revenue_share_pct"))


def kpi_state_performance(t: Tables) -> DataFrame:
    g = delivered_order_rows(t, with_customer=True).groupBy("customer_state").agg(
        F.countDistinct("order_id").alias("total_orders"),
        F.sum("order_total").alias("rev"),
        avg_of("order_total").alias("aov"))
    return (share_of_total(g, "rev", "revenue_share_pct", 2).select(
        "customer_state", "total_orders", _money(F.col("rev")).alias("revenue"),
        round_dp("aov", 2).alias("average_order_value"), "revenue_share_pct")
        .orderBy(F.desc("revenue"), "customer_state"))
