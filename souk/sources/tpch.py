"""Marketplace views derived from the TPC-H-shaped test tables.

The driver data has no marketplace tables, so each one is a projection of a
TPC-H table (see FIXTURES.md section 2). All derivations are row-local
expressions except two: customers gets its state from ``nation`` and the
category translation is the distinct brand list of ``part``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.schema import MONEY
from souk.sources.tables import Tables

# Fixed values of the derivation (must equal the oracle's):
# status F -> delivered, O -> shipped, P -> canceled when key % 4 = 0 else processing;
# purchase second-of-day = key * 7919 % 86400; no delivery date when key % 200 = 0;
# delivery adds (key * 37 % 28) days and (key * 101 % 24) hours; estimate adds 12 + key % 14 days;
# reviews skip key % 10 = 0 and add a second review (id + 1000000000, score 6 - s) when key % 37 = 0;
# unique person id = custkey - 1 when custkey % 10 = 9; no category when p_size % 10 = 0;
# no length when partkey % 50 = 0; 'Brand#13' has no translation, others read 'EN ' || brand.
SECOND_REVIEW_ID_OFFSET = 1_000_000_000
# RFM reference date for this data (orders end 2001-08-01).
AS_OF = "2001-10-01"
UNTRANSLATED_BRAND = "Brand#13"


# Column types of the test tables (only the columns read here). Declaring
# them skips schema inference (a footer read per open) and prunes the scan.
RAW_SCHEMAS = {
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, "
              "o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE",
    "customer": "c_custkey BIGINT, c_nationkey INT, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING",
    "supplier": "s_suppkey BIGINT",
    "part": "p_partkey BIGINT, p_brand STRING, p_size INT",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _plus_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, ts)


def orders_view(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    second_of_day = (k * 7919) % 86400
    status = (F.when(F.col("o_orderstatus") == "F", "delivered")
              .when(F.col("o_orderstatus") == "O", "shipped")
              .when(F.col("o_orderstatus") == "P",
                    F.when(k % 4 == 0, "canceled").otherwise("processing")))
    delivered = F.when(
        (F.col("o_orderstatus") == "F") & (k % 200 != 0),
        _plus_seconds(F.col("o_orderdate"),
                      second_of_day + ((k * 37) % 28) * 86400 + ((k * 101) % 24) * 3600))
    return orders.select(
        k.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        status.alias("order_status"),
        _plus_seconds(F.col("o_orderdate"), second_of_day).alias("order_purchase_timestamp"),
        delivered.alias("order_delivered_customer_date"),
        F.timestamp_add("DAY", F.lit(12) + k % 14, F.col("o_orderdate"))
        .alias("order_estimated_delivery_date"),
    )


def order_items_view(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").cast(MONEY).alias("price"),
        F.col("l_quantity").cast(MONEY).alias("freight_value"),
    )


def order_payments_view(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_orderkey").alias("order_id"),
                         F.col("o_totalprice").cast(MONEY).alias("payment_value"))


def order_reviews_view(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    first = orders.where(k % 10 != 0).select(
        k.alias("review_id"), k.alias("order_id"), digit.alias("review_score"))
    second = orders.where(k % 37 == 0).select(
        (k + SECOND_REVIEW_ID_OFFSET).alias("review_id"), k.alias("order_id"),
        (F.lit(6) - digit).alias("review_score"))
    return first.unionByName(second)


def customers_view(customer: DataFrame, nation: DataFrame) -> DataFrame:
    # TPC-H fixes nation at 25 rows for every scale factor: a proven broadcast bound.
    nations = F.broadcast(nation.select("n_nationkey", "n_name"))
    c = F.col("c_custkey")
    return (customer.join(nations, customer.c_nationkey == nations.n_nationkey, "left")
            .select(c.alias("customer_id"),
                    F.when(c % 10 == 9, c - 1).otherwise(c).alias("customer_unique_id"),
                    F.concat(F.col("n_name"), F.lit("-"), F.col("c_mktsegment")).alias("customer_city"),
                    F.col("n_name").alias("customer_state")))


def sellers_view(supplier: DataFrame) -> DataFrame:
    return supplier.select(F.col("s_suppkey").alias("seller_id"))


def products_view(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_size") % 10 != 0, F.col("p_brand")).alias("product_category_name"),
        (F.col("p_size") * 100).alias("product_weight_g"),
        F.when(F.col("p_partkey") % 50 != 0, F.col("p_size")).alias("product_length_cm"),
    )


def category_translation_view(part: DataFrame) -> DataFrame:
    # distinct() runs as a partial + final aggregate: the brand domain is tiny,
    # so the shuffle carries a handful of rows per map task.
    return (part.where(F.col("p_brand") != UNTRANSLATED_BRAND)
            .select(F.col("p_brand").alias("product_category_name"))
            .distinct()
            .select("product_category_name",
                    F.concat(F.lit("EN "), F.col("product_category_name"))
                    .alias("product_category_name_english")))


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The activity log; its users are customers."""
    return _read(spark, sf_dir, "events")


def from_tpch(spark: SparkSession, sf_dir: str) -> Tables:
    """The eight marketplace DataFrames over one test-data folder (opened lazily)."""

    def raw(name: str) -> DataFrame:
        return _read(spark, sf_dir, name)

    return Tables(
        orders=lambda: orders_view(raw("orders")),
        order_items=lambda: order_items_view(raw("lineitem")),
        order_payments=lambda: order_payments_view(raw("orders")),
        order_reviews=lambda: order_reviews_view(raw("orders")),
        customers=lambda: customers_view(raw("customer"), raw("nation")),
        sellers=lambda: sellers_view(raw("supplier")),
        products=lambda: products_view(raw("part")),
        category_translation=lambda: category_translation_view(raw("part")),
    )

