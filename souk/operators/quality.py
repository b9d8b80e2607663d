"""Data-quality checks: row counts, NULL profiles, duplicates, date range,
status mix, referential integrity, price sanity and a PASS/FAIL scorecard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.expr import avg_of, count_rows, days_between, pct, round_dp, share_of_total
from souk.functions.labels import (
    CANCELED, CHECK_DUPLICATE_ORDERS, CHECK_ORPHAN_ITEMS, CHECK_ZERO_PRICE, FAIL, PASS,
    ROW_COUNT_LABELS,
)
from souk.operators.common import DELIVERED_TS, PURCHASE_TS
from souk.sources.tables import Tables


def null_profile(df: DataFrame, checks: dict[str, str], total_alias: str) -> DataFrame:
    """One pass: COUNT(*) plus a NULL count per named column."""
    return df.agg(count_rows().alias(total_alias),
                  *[F.count_if(F.col(c).isNull()).alias(a) for a, c in checks.items()])


def duplicate_keys(df: DataFrame, keys: list[str], count_alias: str = "occurrences", limit: int | None = None) -> DataFrame:
    """Key groups seen more than once (partial aggregation absorbs hot keys); with ``limit``
    the most frequent ones, ties by key."""
    found = df.groupBy(*keys).agg(count_rows().alias(count_alias)).where(F.col(count_alias) > 1)
    return found if limit is None else found.orderBy(F.desc(count_alias), *keys).limit(limit)


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """The child rows whose ``key`` has no parent row (NULL keys count). The parent side is
    one row per key; a hot key of the child is on the side that a skewed join splits."""
    return child.join(parent.select(key).distinct(), key, "left_anti").select(child.columns)


def orphan_count(child: DataFrame, parent: DataFrame, key: str, alias: str) -> DataFrame:
    """Number of child rows whose ``key`` has no parent row (NULL keys count).

    Both sides are first reduced to one row per key (the child keeps its
    multiplicity) by map-side partial aggregation, so the anti join shuffles
    distinct keys only: a key copied into a third of either table cannot
    skew it, and AQE could not split a hot key on the anti join's right side.
    """
    per_key = child.groupBy(key).agg(count_rows().alias("__n"))
    missing = per_key.join(parent.select(key).distinct(), key, "left_anti")
    return missing.agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias(alias))


def check(name: str, failing_count: DataFrame, count_col: str) -> DataFrame:
    return failing_count.select(
        F.lit(name).alias("check_name"),
        F.when(F.col(count_col) == 0, F.lit(PASS)).otherwise(F.lit(FAIL)).alias("result"))


def dq_row_counts(t: Tables) -> DataFrame:
    parts = [getattr(t, table).agg(count_rows().alias("row_count"))
             .select(F.lit(label).alias("table_name"), "row_count")
             for label, table in ROW_COUNT_LABELS]
    return reduce(DataFrame.unionByName, parts)


def dq_null_orders(t: Tables) -> DataFrame:
    return null_profile(t.orders, {
        "null_order_id": "order_id",
        "null_customer_id": "customer_id",
        "null_status": "order_status",
        "null_purchase_date": PURCHASE_TS,
        "null_delivery_date": DELIVERED_TS,
    }, "total_orders")


def dq_null_delivery_by_status(t: Tables) -> DataFrame:
    return (t.orders.where(F.col(DELIVERED_TS).isNull())
            .groupBy("order_status").agg(count_rows().alias("orders_with_null_delivery"))
            .orderBy(F.desc("orders_with_null_delivery"), "order_status"))


def dq_null_products(t: Tables) -> DataFrame:
    prof = null_profile(t.products, {
        "null_category": "product_category_name",
        "null_weight": "product_weight_g",
        "null_length": "product_length_cm",
    }, "total_products")
    return prof.withColumn("pct_missing_category", pct("null_category", "total_products", 2))


def dq_duplicate_orders(t: Tables, limit: int = 10) -> DataFrame:
    return duplicate_keys(t.orders.select("order_id"), ["order_id"], limit=limit)


def dq_date_range(t: Tables) -> DataFrame:
    ts = F.col(PURCHASE_TS)
    day = F.to_date(ts)
    stats = t.orders.where(F.col("order_status") != CANCELED).agg(
        F.min(day).alias("d0"), F.max(day).alias("d1"),
        F.countDistinct(day).alias("active_days"),
        F.min(ts).alias("t0"), F.max(ts).alias("t1"))
    return stats.select(
        F.date_format("d0", "yyyy-MM-dd").alias("first_order_date"),
        F.date_format("d1", "yyyy-MM-dd").alias("last_order_date"),
        "active_days",
        round_dp(days_between("t0", "t1") / F.lit(30.0), 1).alias("span_months"))


def dq_status_distribution(t: Tables) -> DataFrame:
    g = t.orders.groupBy("order_status").agg(count_rows().alias("order_count"))
    return share_of_total(g, "order_count", "pct", 2).orderBy(F.desc("order_count"), "order_status")


def dq_orphan_orders(t: Tables) -> DataFrame:
    return orphan_count(t.orders.select("customer_id"), t.customers, "customer_id",
                        "orders_without_customer")


def dq_orphan_items_product(t: Tables) -> DataFrame:
    return orphan_count(t.order_items.select("product_id"), t.products, "product_id",
                        "items_without_product")


def dq_price_sanity(t: Tables) -> DataFrame:
    return t.order_items.agg(
        F.min("price").cast("double").alias("min_price"),
        F.max("price").cast("double").alias("max_price"),
        round_dp(avg_of("price"), 2).alias("avg_price"),
        round_dp(avg_of("freight_value"), 2).alias("avg_freight"),
        F.count_if(F.col("price") <= 0).alias("zero_or_neg_price"))


def dq_scorecard(t: Tables) -> DataFrame:
    dups = duplicate_keys(t.orders.select("order_id"), ["order_id"]).agg(count_rows().alias("n"))
    orphans = orphan_count(t.order_items.select("order_id"), t.orders, "order_id", "n")
    zero = t.order_items.where(F.col("price") <= 0).agg(count_rows().alias("n"))
    return (check(CHECK_DUPLICATE_ORDERS, dups, "n")
            .unionByName(check(CHECK_ORPHAN_ITEMS, orphans, "n"))
            .unionByName(check(CHECK_ZERO_PRICE, zero, "n")))


def dq_failing_rows(t: Tables) -> DataFrame:
    """What stands behind each FAIL of the scorecard: the order ids of the rows, and how many
    rows have them."""
    def rows(name: str, df: DataFrame) -> DataFrame:
        return df.groupBy("order_id").agg(count_rows().alias("rows")).select(F.lit(name).alias("check_name"), "order_id", "rows")
    items = t.order_items.select("order_id", "price")
    return (duplicate_keys(t.orders.select("order_id"), ["order_id"], "rows")
            .select(F.lit(CHECK_DUPLICATE_ORDERS).alias("check_name"), "order_id", "rows")
            .unionByName(rows(CHECK_ORPHAN_ITEMS, orphans(items.select("order_id"), t.orders, "order_id")))
            .unionByName(rows(CHECK_ZERO_PRICE, items.where(F.col("price") <= 0))))
