"""Explicit schemas of the eight logical marketplace tables.

The types are chosen (no DDL exists upstream): money is DECIMAL(18,2) so sums are
exact, timestamps carry no zone. Ids are BIGINT here; a stored table may have ids of
another type, which is kept (see ``souk.sources.tables``).
"""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

ORDERS = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("order_status", T.StringType()),
    T.StructField("order_purchase_timestamp", T.TimestampNTZType()),
    T.StructField("order_delivered_customer_date", T.TimestampNTZType()),
    T.StructField("order_estimated_delivery_date", T.TimestampNTZType()),
])

ORDER_ITEMS = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("seller_id", T.LongType()),
    T.StructField("price", MONEY),
    T.StructField("freight_value", MONEY),
])

ORDER_PAYMENTS = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("payment_value", MONEY),
])

ORDER_REVIEWS = T.StructType([
    T.StructField("review_id", T.LongType()),
    T.StructField("order_id", T.LongType()),
    T.StructField("review_score", T.IntegerType()),
])

CUSTOMERS = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("customer_unique_id", T.LongType()),
    T.StructField("customer_city", T.StringType()),
    T.StructField("customer_state", T.StringType()),
])

SELLERS = T.StructType([
    T.StructField("seller_id", T.LongType()),
])

PRODUCTS = T.StructType([
    T.StructField("product_id", T.LongType()),
    T.StructField("product_category_name", T.StringType()),
    T.StructField("product_weight_g", T.IntegerType()),
    T.StructField("product_length_cm", T.IntegerType()),
])

CATEGORY_TRANSLATION = T.StructType([
    T.StructField("product_category_name", T.StringType()),
    T.StructField("product_category_name_english", T.StringType()),
])

SCHEMAS = {
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "order_payments": ORDER_PAYMENTS,
    "order_reviews": ORDER_REVIEWS,
    "customers": CUSTOMERS,
    "sellers": SELLERS,
    "products": PRODUCTS,
    "category_translation": CATEGORY_TRANSLATION,
}
