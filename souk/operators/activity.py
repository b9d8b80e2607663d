"""Analyses in time: the activity log (``events``: event_id, ts, user_id, event_type, value)
with the marketplace, and orders with each other.

A user of the log is a customer (``user_id`` = ``customer_id``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.expr import DAY_US, count_rows, trunc_days
from souk.operators.common import (
    DELIVERED_TS, ESTIMATED_TS, PURCHASE_TS, dealer, delivered_order_rows, delivered_orders, product_categories,
)
from souk.operators.temporal import asof_join, interval_join, overlap_join
from souk.session import materialize
from souk.sources.tables import Tables


def asof_event_order(t: Tables, events: DataFrame) -> DataFrame:
    """Each event with the state of its user's last order at that time."""
    orders = t.orders.select("customer_id", "order_id", "order_status", PURCHASE_TS)
    found = asof_join(events.select("event_id", "user_id", "event_type", "ts"), orders, [("user_id", "customer_id")], ("ts", PURCHASE_TS),
                      {"order_id": "order_id", "order_status": "order_status", PURCHASE_TS: "ordered"}, order=["order_id"])
    return found.select("event_id", "user_id", "event_type", "order_id", "order_status",
                        trunc_days("ordered", "ts").alias("days_since_order"))


def asof_last_touch(t: Tables, events: DataFrame, days: int = 3) -> DataFrame:
    """Purchases by the last click before them, of the same user and at most ``days`` days old:
    the click's id and age in whole seconds."""
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    clicks = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), "ts")
    found = asof_join(bought, clicks, [("user_id", "user_id")], ("ts", "ts"), {"click_id": "click_id", "ts": "clicked"},
                      strict=True, tolerance=days * DAY_US, order=["click_id"])
    seconds = F.floor(F.timestamp_diff("MICROSECOND", F.col("clicked"), F.col("ts")) / 1_000_000)
    return found.select("event_id", "user_id", "value", "click_id", seconds.cast("long").alias("seconds_after_click"))


def asof_price_moves(t: Tables, events: DataFrame | None = None) -> DataFrame:
    """For each product, how often it was sold for more, less or the same as at its sale
    before (of sales at one time, the dearest)."""
    sold = t.order_items.select("order_id", "product_id", "price").join(
        t.orders.select("order_id", PURCHASE_TS).dropDuplicates(["order_id"]), "order_id").drop("order_id")
    sold = materialize(sold)  # read several times
    found = asof_join(sold, sold, [("product_id", "product_id")], (PURCHASE_TS, PURCHASE_TS), {"price": "before"}, strict=True)
    return found.groupBy("product_id").agg(
        count_rows().alias("sales"), F.count("before").alias("with_earlier"),
        F.count_if(F.col("price") > F.col("before")).alias("dearer"),
        F.count_if(F.col("price") < F.col("before")).alias("cheaper"))


def interval_orders_during_delivery(t: Tables, events: DataFrame | None = None) -> DataFrame:
    """Orders that a customer placed while an earlier one was under way: how many were, and
    how many of these came late."""
    placed = t.orders.select(F.col("customer_id").alias("who"), F.col("order_id").alias("placed_id"), F.col(PURCHASE_TS).alias("placed"))
    under_way = delivered_orders(t).select("customer_id", "order_id", PURCHASE_TS, DELIVERED_TS, ESTIMATED_TS)
    pairs = interval_join(placed, under_way, "placed", (PURCHASE_TS, DELIVERED_TS), keys=[("who", "customer_id")])
    return (pairs.where("placed_id <> order_id").groupBy(F.col("placed_id").alias("order_id"))
            .agg(count_rows().alias("under_way"), F.count_if(F.col(DELIVERED_TS) > F.col(ESTIMATED_TS)).alias("came_late")))


def interval_purchases_after_error(t: Tables, events: DataFrame, hours: int = 24) -> DataFrame:
    """Each error with what its user bought in the next ``hours`` hours."""
    after = F.timestamp_add("HOUR", F.lit(hours), F.col("ts"))
    errors = events.where("event_type = 'error'").select(
        F.col("event_id").alias("error_id"), "user_id", F.col("ts").alias("failed"), after.alias("until"))
    bought = events.where("event_type = 'purchase'").select(F.col("user_id").alias("buyer"), F.col("ts").alias("bought"), F.col("value").cast("decimal(18,2)").alias("paid"))
    pairs = interval_join(bought, errors, "bought", ("failed", "until"), keys=[("buyer", "user_id")])
    sums = pairs.groupBy("error_id").agg(count_rows().alias("n"), F.sum("paid").alias("paid"))
    return errors.select("error_id", "user_id").join(sums, "error_id", "left").select(
        "error_id", "user_id", F.coalesce("n", F.lit(0)).cast("long").alias("purchases"),
        F.coalesce(F.col("paid").cast("double"), F.lit(0.0)).alias("paid"))


def interval_overlapping_deliveries(t: Tables, events: DataFrame | None = None) -> DataFrame:
    """For each customer, the pairs of deliveries that were under way at the same time."""
    rows = delivered_orders(t).where(F.col(DELIVERED_TS) > F.col(PURCHASE_TS)).select("customer_id", "order_id", PURCHASE_TS, DELIVERED_TS)
    side = lambda p: rows.toDF(f"{p}_who", f"{p}_id", f"{p}_start", f"{p}_end")
    pairs = overlap_join(side("a"), side("b"), ("a_start", "a_end"), ("b_start", "b_end"), keys=[("a_who", "b_who")])
    return pairs.where("a_id < b_id").groupBy(F.col("a_who").alias("customer_id")).agg(count_rows().alias("overlapping"))


def rolling_state_activity(t: Tables, events: DataFrame | None = None, days: int = 28) -> DataFrame:
    """For each state and day with a sale: revenue and different persons who bought in the
    ``days`` days up to it.

    Revenue is a moving sum over one row for each state and day. Persons aren't counted
    again for each day: a person joins the count on the first day of a run of purchases less
    than ``days`` days apart and leaves it ``days`` days after the last, so the count is a
    running sum of joins less leaves over the days of a state."""
    rows = delivered_order_rows(t, with_customer=True).where(F.col(PURCHASE_TS).isNotNull()).select(
        F.col("customer_state").alias("state"), F.col("customer_unique_id").alias("who"), "order_total",
        F.datediff(F.to_date(PURCHASE_TS), F.lit("1970-01-01").cast("date")).alias("day"))
    bought = rows.where("who IS NOT NULL").select("state", "who", "day").distinct()
    own = Window.partitionBy("state", "who").orderBy("day")
    runs = bought.select("state", "day", (F.coalesce(F.col("day") - F.lag("day").over(own), F.lit(days)) >= days).alias("joins"),
                         (F.coalesce(F.lead("day").over(own) - F.col("day"), F.lit(days)) >= days).alias("leaves"))
    moves = runs.select("state", F.explode(F.array(
        F.struct("day", F.col("joins").cast("long").alias("change")),
        F.struct((F.col("day") + days).alias("day"), (-F.col("leaves").cast("long")).alias("change")))).alias("m")).select(
        "state", "m.day", "m.change").groupBy("state", "day").agg(F.sum("change").alias("change"))
    sales = rows.groupBy("state", "day").agg(F.sum("order_total").alias("paid"), count_rows().alias("orders"))
    none = lambda kind: F.lit(None).cast(kind)
    # One row for each state and day from here on.
    daily = (sales.select("state", "day", "paid", "orders", none("long").alias("change"))
             .unionByName(moves.select("state", "day", none(sales.schema["paid"].dataType).alias("paid"), none("long").alias("orders"), "change"))
             .groupBy("state", "day").agg(F.sum("paid").alias("paid"), F.sum("orders").alias("orders"), F.sum("change").alias("change")))
    so_far = Window.partitionBy("state").orderBy("day")
    moving = so_far.rangeBetween(-(days - 1), 0)
    return daily.select(
        "state", "day", "orders", F.sum("paid").over(moving).alias("revenue"),
        F.sum(F.coalesce("change", F.lit(0))).over(so_far.rowsBetween(Window.unboundedPreceding, 0)).alias("active")).where(
        "orders IS NOT NULL").select(
        F.col("state"), F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")), "yyyy-MM-dd").alias("day"),
        F.round("revenue", 2).cast("double").alias("revenue"), F.col("active").alias("active_customers"))


def cube_sales(t: Tables, events: DataFrame | None = None) -> DataFrame:
    """Delivered orders (exact distinct counts) and revenue by category, state and month, at
    every level: ``level`` has a bit for each column that is summed over (category 4, state
    2, month 1). What the levels are made of is one row for each order and category; an
    order's rows are in one task, where each level takes them together, so the cells count
    rows and no order id travels on."""
    deal = dealer(t.order_items)
    paid = F.sum("paid").alias("paid")
    sold = deal(t.order_items.select("order_id", "product_id", (F.col("price") + F.col("freight_value")).alias("paid")), "order_id", "product_id")
    named = sold.groupBy("order_id", "product_id").agg(paid).join(product_categories(t), "product_id")
    items = deal(named.select("order_id", "category", "paid"), "order_id").groupBy("order_id", "category").agg(paid)
    orders = delivered_orders(t).select("order_id", "customer_id", F.date_format(PURCHASE_TS, "yyyy-MM").alias("month")).join(
        t.customers.select("customer_id", F.col("customer_state").alias("state")), "customer_id").select("order_id", "state", "month")
    rows = items.join(deal(orders, "order_id"), "order_id")
    columns = {"category": 4, "state": 2, "month": 1}
    cells = [F.struct(*(F.when(F.lit(not level & bit), F.col(c)).alias(c) for c, bit in columns.items()), F.lit(level).cast("long").alias("level"))
             for level in range(8)]
    taken = rows.select("order_id", "paid", F.explode(F.array(*cells)).alias("cell")).select("order_id", "paid", "cell.*")
    return taken.groupBy("order_id", *columns, "level").agg(paid).groupBy(*columns, "level").agg(
        F.count("order_id").alias("orders"), F.round(F.sum("paid"), 2).cast("double").alias("revenue"))
