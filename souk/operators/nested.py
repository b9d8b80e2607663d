"""Orders as nested JSON documents: their items and reviews, written and read back.

An order is one document unless it has more than ``page`` different items and reviews; then
these are dealt to pages by their hash, each of about ``page`` parts, so no order makes an
array that grows with the data. Equal items (or reviews) of an order are one part with
``copies``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.operators.common import dealer
from souk.sources.tables import Tables

DOCUMENT = ("order_id BIGINT, page INT, items ARRAY<STRUCT<product_id: BIGINT, seller_id: BIGINT, price: DECIMAL(18,2), "
            "freight_value: DECIMAL(18,2), copies: BIGINT>>, reviews ARRAY<STRUCT<review_id: BIGINT, review_score: INT, copies: BIGINT>>, "
            "scores MAP<STRING, BIGINT>")


def _parts(t: Tables, deal: Callable[..., DataFrame]) -> DataFrame:
    """order_id, item, review: a row for each different item or review, the other one null.
    (order, product) and (order, review) deal the rows, so a hot order is in many tasks."""
    item = ["product_id", "seller_id", "price", "freight_value", "copies"]
    review = ["review_id", "review_score", "copies"]
    copies = F.count(F.lit(1)).alias("copies")
    items = deal(t.order_items, "order_id", "product_id").groupBy("order_id", *item[:-1]).agg(copies).select("order_id", F.struct(*item).alias("item"))
    reviews = deal(t.order_reviews, "order_id", "review_id").groupBy("order_id", *review[:-1]).agg(copies).select(
        "order_id", F.struct(*review).alias("review"))
    return items.unionByName(reviews, allowMissingColumns=True)


def order_documents(t: Tables, page: int = 1000) -> DataFrame:
    """order_id, page, document (JSON text): arrays in the order of their fields, ``scores``
    a map from review score to its number of reviews. A null order id is an order."""
    deal = dealer(t.order_items, t.order_reviews)
    parts = _parts(t, deal)
    # Only orders of more than a page; the rest need no number of pages.
    large = deal(parts.select(F.col("order_id").alias("large_id")), "large_id").groupBy("large_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > page)
    number = F.coalesce(F.pmod(F.xxhash64("item", "review"), F.ceil(F.col("n") / page)), F.lit(0)).cast("int")
    dealt = parts.join(large, F.col("order_id").eqNullSafe(F.col("large_id")), "left").withColumn("page", number)
    pages = deal(dealt.select("order_id", "page", "item", "review"), "order_id", "page").groupBy("order_id", "page").agg(
        F.array_sort(F.collect_list("item")).alias("items"), F.array_sort(F.collect_list("review")).alias("reviews"))
    scores = F.array_distinct(F.filter(F.col("reviews.review_score"), lambda s: s.isNotNull()))

    def copies_of(score: Column) -> Column:
        return F.aggregate(F.filter("reviews", lambda r: r["review_score"] == score), F.lit(0).cast("long"), lambda n, r: n + r["copies"])

    counted = F.map_from_entries(F.transform(scores, lambda s: F.struct(s.cast("string"), copies_of(s))))
    return pages.withColumn("scores", counted).select("order_id", "page", F.to_json(F.struct("order_id", "page", "items", "reviews", "scores")).alias("document"))


def read_documents(documents: DataFrame, column: str = "document") -> DataFrame:
    """The fields of the documents; a text that isn't such a document fails."""
    return documents.select(F.from_json(column, DOCUMENT, {"mode": "FAILFAST"}).alias("d")).select("d.*")


def items_of(documents: DataFrame) -> DataFrame:
    """The flat items, a row for each different one of an order, with its ``copies``."""
    return read_documents(documents).select("order_id", F.inline("items"))


def json_order_facts(t: Tables) -> DataFrame:
    """Facts of each order read from its documents: number of items, their price, the
    dearest, reviews, and those of score 1 or 2."""
    docs = read_documents(order_documents(t))
    none = F.lit(0).cast("long")
    score = lambda s: F.coalesce(F.try_element_at("scores", F.lit(s)), none)
    total = F.aggregate("items", F.lit(0).cast("decimal(38,2)"),
                        lambda s, i: (s + F.coalesce(i["price"], F.lit(0)) * i["copies"]).cast("decimal(38,2)"))
    facts = docs.select(
        "order_id", F.aggregate("items", none, lambda n, i: n + i["copies"]).alias("items"), total.alias("total"),
        F.array_max(F.col("items.price")).alias("dearest"),
        F.aggregate("reviews", none, lambda n, r: n + r["copies"]).alias("reviews"), (score("1") + score("2")).alias("low_reviews"))
    return facts.groupBy("order_id").agg(
        F.sum("items").alias("items"), F.sum("total").cast("double").alias("total"), F.max("dearest").cast("double").alias("dearest"),
        F.sum("reviews").alias("reviews"), F.sum("low_reviews").alias("low_reviews"))


def json_seller_items(t: Tables) -> DataFrame:
    """Sales of each seller from the items of the documents, as flat rows again."""
    paid = ((F.col("price") + F.col("freight_value")) * F.col("copies")).cast("decimal(38,2)")
    sold = items_of(order_documents(t)).select("seller_id", "order_id", "copies", paid.alias("paid"))
    # A row for each seller and order where their rows are dealt, so orders are counted as rows.
    each = dealer(t.order_items)(sold, "seller_id", "order_id").groupBy("seller_id", "order_id").agg(
        F.sum("copies").alias("copies"), F.sum("paid").alias("paid"))
    return each.groupBy("seller_id").agg(
        F.sum("copies").alias("items"), F.sum("paid").cast("double").alias("revenue"), F.count("order_id").alias("orders"))
