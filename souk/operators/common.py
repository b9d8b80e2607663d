"""Building blocks shared by several operators.

The original queries repeat these as CTEs; here they are DataFrame functions so the
same plan fragment is written once. The expensive pattern everywhere is
orders x items: items are always aggregated to order grain *before* they meet
orders (partial aggregation runs map-side, so one hot order id collapses to a
row per task before any shuffle), and the order-grain frame is what joins
customers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.labels import DELIVERED, UNKNOWN_CATEGORY
from souk.sources.tables import Tables

PURCHASE_TS = "order_purchase_timestamp"
DELIVERED_TS = "order_delivered_customer_date"
ESTIMATED_TS = "order_estimated_delivery_date"

# Input rows that a task gets where rows are dealt by their number: some tens of MB of sorts and groups.
ROWS_PER_TASK = 200_000


def dealer(*tables: DataFrame) -> Callable[..., DataFrame]:
    """deal(df, *keys): ``df`` dealt by ``keys`` to as many tasks as the rows of ``tables``
    ask for. What a task holds then stays the same as the input grows, where exchanges that
    are merged at runtime grow with it up to a size of compressed bytes. Parquet counts rows
    by its footers."""
    n = max(1, -(-sum(df.count() for df in tables) // ROWS_PER_TASK))
    return lambda df, *keys: df.repartition(n, *keys)


def delivered_orders(t: Tables) -> DataFrame:
    """Orders with status 'delivered' (the filter reaches the scan)."""
    return t.orders.where(F.col("order_status") == DELIVERED)


def order_totals(items: DataFrame) -> DataFrame:
    """order_id -> product_amount, freight_amount, order_total, n_items."""
    return items.groupBy("order_id").agg(
        F.sum("price").alias("product_amount"),
        F.sum("freight_value").alias("freight_amount"),
        F.sum(F.col("price") + F.col("freight_value")).alias("order_total"),
        F.count(F.lit(1)).alias("n_items"),
    )


def order_totals_of(t: Tables) -> DataFrame:
    """``order_totals`` of the bundle's items (shared between operators)."""
    return t.shared("order_totals", lambda: order_totals(t.order_items))


def product_categories(t: Tables) -> DataFrame:
    """product_id -> category = english name, else raw name, else 'Unknown'.

    products LEFT JOIN translation; the translation is a small dimension that
    AQE turns into a broadcast once its real size is measured.
    """
    return t.shared("product_categories", lambda: _product_categories(t))


def _product_categories(t: Tables) -> DataFrame:
    return (t.products.select("product_id", "product_category_name")
            .join(t.category_translation.select("product_category_name",
                                                "product_category_name_english"),
                  "product_category_name", "left")
            .select("product_id",
                    F.coalesce("product_category_name_english", "product_category_name",
                               F.lit(UNKNOWN_CATEGORY)).alias("category")))


def delivered_order_rows(t: Tables, with_customer: bool = False) -> DataFrame:
    """Delivered orders joined to their item totals: one row per order row.

    Orders without items drop out (inner join), as in the original queries.
    """
    rows = t.shared("delivered_rows", lambda: delivered_orders(t).select(
        "order_id", "customer_id", PURCHASE_TS).join(order_totals_of(t), "order_id"))
    if not with_customer:
        return rows
    return t.shared("delivered_customer_rows", lambda: rows.join(
        t.customers.select("customer_id", "customer_unique_id", "customer_city", "customer_state"),
        "customer_id"))


def person_orders(t: Tables) -> DataFrame:
    """Per person (customer_unique_id) over delivered orders with items.

    total_orders = distinct orders, spent = exact sum of price + freight,
    first/last purchase timestamps, first_customer_id = the least of the person's
    customer ids.
    """
    def build() -> DataFrame:
        rows = delivered_order_rows(t, with_customer=True)
        return rows.groupBy("customer_unique_id").agg(
            F.countDistinct("order_id").alias("total_orders"),
            F.round(F.sum("order_total"), 2).alias("total_spent"),
            F.min(PURCHASE_TS).alias("first_ts"),
            F.max(PURCHASE_TS).alias("last_ts"),
            F.min("customer_id").alias("first_customer_id"),
        )
    return t.shared("person_orders", build)
