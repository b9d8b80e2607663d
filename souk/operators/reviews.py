"""Review analysis: score mix, satisfaction, scores by category and state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.expr import avg_of, count_rows, pct, round_dp, share_of_total
from souk.operators.common import dealer, delivered_orders, product_categories
from souk.sources.tables import Tables


def review_distribution(t: Tables) -> DataFrame:
    g = (t.order_reviews.groupBy(F.col("review_score").cast("long").alias("review_score"))
         .agg(count_rows().alias("reviews")))
    return share_of_total(g, "reviews", "pct", 1).orderBy("review_score")


def review_satisfaction(t: Tables) -> DataFrame:
    s = F.col("review_score")
    return t.order_reviews.agg(
        count_rows().alias("total_reviews"),
        round_dp(avg_of(s), 2).alias("avg_score"),
        pct(F.count_if(s >= 4), count_rows(), 1).alias("pct_positive"),
        pct(F.count_if(s <= 2), count_rows(), 1).alias("pct_negative"))


def order_categories(t: Tables, deal: Callable[..., DataFrame] | None = None) -> DataFrame:
    """Distinct (order_id, category) pairs of delivered orders.

    Copies of an item are dropped where (order, product) deals them, so a hot order is no
    more than its different products from there on. Items of other orders drop out next, so
    only what is kept meets the products.
    """
    deal = deal or dealer(t.order_items)
    pairs = deal(t.order_items.select("order_id", "product_id"), "order_id", "product_id").distinct()
    delivered = deal(delivered_orders(t).select("order_id"), "order_id").distinct()
    items = deal(pairs, "order_id").join(delivered, "order_id", "left_semi")
    return deal(items.join(product_categories(t), "product_id").select("order_id", "category"), "order_id").distinct()


def _delivered_reviews(t: Tables) -> DataFrame:
    return (t.order_reviews.select("review_id", "order_id", "review_score")
            .join(delivered_orders(t).select("order_id", "customer_id"), "order_id"))


def review_by_category(t: Tables, min_reviews: int = 50) -> DataFrame:
    s = F.col("review_score")
    deal = dealer(t.order_items)
    found = deal(t.order_reviews.select("review_id", "order_id", "review_score"), "order_id").join(
        deal(delivered_orders(t).select("order_id"), "order_id"), "order_id")
    g = (found.join(order_categories(t, deal), "order_id")
         .groupBy("category").agg(
             F.count("review_id").alias("review_count"),
             round_dp(avg_of(s), 2).alias("avg_score"),
             F.count_if(s == 5).alias("five_star"),
             F.count_if(s == 1).alias("one_star"),
             count_rows().alias("n"))
         .where(F.col("review_count") > min_reviews))
    return (g.select("category", "review_count", "avg_score", "five_star", "one_star",
                     pct("one_star", "n", 1).alias("pct_one_star"))
            .orderBy(F.desc("avg_score"), "category"))


def review_by_state(t: Tables) -> DataFrame:
    s = F.col("review_score")
    g = (_delivered_reviews(t)
         .join(t.customers.select("customer_id", "customer_state"), "customer_id")
         .groupBy(F.col("customer_state").alias("state")).agg(
             F.count("review_id").alias("reviews"),
             round_dp(avg_of(s), 2).alias("avg_score"),
             F.count_if(s >= 4).alias("pos"),
             count_rows().alias("n")))
    return (g.select("state", "reviews", "avg_score", pct("pos", "n", 1).alias("pct_positive"))
            .orderBy("avg_score", "state"))
