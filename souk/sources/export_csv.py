"""Reader for the public Brazilian marketplace CSV export (one file per table).

The files carry more columns than the analyses use and hash-like string ids;
``souk.sources.tables.typed`` picks columns by header name and casts them. Only
the reviews hold quoted line breaks, so only that file is read as a whole by one
task: convert it to Parquet once (``write_results``) where it is large. The other
files are split among tasks.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from souk.sources.tables import Tables, load_tables

# How the file names of the public export end; what stands before is
# the publisher's name.
FILES = {
    "orders": "*_orders_dataset.csv",
    "order_items": "*_order_items_dataset.csv",
    "order_payments": "*_order_payments_dataset.csv",
    "order_reviews": "*_order_reviews_dataset.csv",
    "customers": "*_customers_dataset.csv",
    "sellers": "*_sellers_dataset.csv",
    "products": "*_products_dataset.csv",
    "category_translation": "product_category_name_translation.csv",
}


def load_export_csv(spark: SparkSession, root: str) -> Tables:
    """The eight tables from a folder holding the public CSV files (lazily)."""
    return load_tables(spark, root, fmt="csv", names=FILES, escape='"',
                       options_of={"order_reviews": {"multiLine": "true"}})
