"""Delivery performance over delivered orders that have a delivery date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.expr import (
    DAY_US, avg_days, avg_of, count_rows, micros_between, pct, round_dp, share_of_total, trunc_days,
)
from souk.functions.labels import (
    LATE, ON_TIME, SPEED_FAST, SPEED_NORMAL, SPEED_SLOW, SPEED_VERY_SLOW,
)
from souk.operators.common import DELIVERED_TS, ESTIMATED_TS, PURCHASE_TS, delivered_orders
from souk.sources.tables import Tables


def completed_deliveries(t: Tables) -> DataFrame:
    return delivered_orders(t).where(F.col(DELIVERED_TS).isNotNull())


def speed_bucket(days) -> F.Column:
    return (F.when(days <= 7, SPEED_FAST).when(days <= 14, SPEED_NORMAL)
            .when(days <= 21, SPEED_SLOW).otherwise(SPEED_VERY_SLOW))


def delivery_overall(t: Tables) -> DataFrame:
    d = completed_deliveries(t).select(
        micros_between(PURCHASE_TS, DELIVERED_TS).alias("us"),
        micros_between(PURCHASE_TS, ESTIMATED_TS).alias("est_us"))
    day = F.lit(float(DAY_US))
    return d.agg(
        count_rows().alias("delivered_orders"),
        round_dp(avg_days("us"), 1).alias("avg_delivery_days"),
        round_dp(F.min("us") / day, 1).alias("min_delivery_days"),
        round_dp(F.max("us") / day, 1).alias("max_delivery_days"),
        round_dp(avg_days("est_us"), 1).alias("avg_estimated_days"))


def delivery_on_time(t: Tables) -> DataFrame:
    d = completed_deliveries(t).where(F.col(ESTIMATED_TS).isNotNull())
    status = F.when(F.col(DELIVERED_TS) <= F.col(ESTIMATED_TS), ON_TIME).otherwise(LATE)
    g = (d.select(status.alias("delivery_status"),
                  micros_between(ESTIMATED_TS, DELIVERED_TS).alias("diff_us"))
         .groupBy("delivery_status")
         .agg(count_rows().alias("orders"), avg_days("diff_us").alias("diff")))
    return share_of_total(g, "orders", "pct", 1).select(
        "delivery_status", "orders", "pct", round_dp("diff", 1).alias("avg_days_diff"))


def delivery_by_state(t: Tables) -> DataFrame:
    d = completed_deliveries(t).select(
        "order_id", "customer_id",
        micros_between(PURCHASE_TS, DELIVERED_TS).alias("us"),
        (F.col(DELIVERED_TS) > F.col(ESTIMATED_TS)).alias("late"))
    g = (d.join(t.customers.select("customer_id", "customer_state"), "customer_id")
         .groupBy(F.col("customer_state").alias("state")).agg(
             F.countDistinct("order_id").alias("total_orders"),
             round_dp(avg_days("us"), 1).alias("avg_delivery_days"),
             F.count_if(F.col("late")).alias("late_orders"),
             count_rows().alias("n")))
    return (g.select("state", "total_orders", "avg_delivery_days", "late_orders",
                     pct("late_orders", "n", 1).alias("late_rate_pct"))
            .orderBy(F.desc("avg_delivery_days"), "state"))


def delivery_speed_vs_review(t: Tables) -> DataFrame:
    d = completed_deliveries(t).select(
        "order_id", trunc_days(PURCHASE_TS, DELIVERED_TS).alias("delivery_days"))
    rows = d.join(t.order_reviews.select("order_id", "review_score"), "order_id")
    return (rows.groupBy(speed_bucket(F.col("delivery_days")).alias("speed_bucket")).agg(
        count_rows().alias("orders"),
        round_dp(avg_of("review_score"), 2).alias("avg_review_score"))
        .orderBy("speed_bucket"))


def dash_delivery_distribution(t: Tables) -> DataFrame:
    """Order count per delivery-speed bucket (no review join)."""
    g = (completed_deliveries(t)
         .groupBy(speed_bucket(trunc_days(PURCHASE_TS, DELIVERED_TS)).alias("speed_bucket"))
         .agg(count_rows().alias("orders")))
    return share_of_total(g, "orders", "pct", 1).orderBy("speed_bucket")
