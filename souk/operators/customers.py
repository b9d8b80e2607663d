"""Customer segmentation: repeat buyers, top cities, RFM, lifetime value,
the per-person summary and the revenue ranking.

Person = customer_unique_id; every metric counts delivered orders that have
items, and money is price + freight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.expr import (
    as_double, avg_of, count_rows, round_dp, share_of_external_total, share_of_total, trunc_days,
)
from souk.functions.labels import (
    RFM_AT_RISK, RFM_CHAMPIONS, RFM_LOST, RFM_LOYAL, RFM_PROMISING, SEG_LOYAL, SEG_ONE_TIME,
    SEG_TWO,
)
from souk.functions.ntile import ntile_by_cuts
from souk.operators.common import delivered_order_rows, person_orders
from souk.session import materialize
from souk.sources.tables import Tables

DEFAULT_AS_OF = "2018-10-01"


def cust_repeat_segments(t: Tables) -> DataFrame:
    people = person_orders(t)
    n = F.col("total_orders")
    segment = F.when(n == 1, SEG_ONE_TIME).when(n == 2, SEG_TWO).otherwise(SEG_LOYAL)
    g = people.groupBy(segment.alias("segment")).agg(
        count_rows().alias("customer_count"), avg_of("total_spent").alias("spend"))
    return (share_of_total(g, "customer_count", "pct_of_customers", 1).select(
        "segment", "customer_count", "pct_of_customers",
        round_dp("spend", 2).alias("avg_lifetime_spend"))
        .orderBy("segment"))


def cust_top_cities(t: Tables, n: int = 10) -> DataFrame:
    rows = delivered_order_rows(t, with_customer=True)
    g = rows.groupBy(F.col("customer_city").alias("city"),
                     F.col("customer_state").alias("state")).agg(
        F.countDistinct("customer_unique_id").alias("unique_customers"),
        F.countDistinct("order_id").alias("total_orders"),
        F.sum("order_total").alias("rev"))
    return (g.select(
        "city", "state", "unique_customers", "total_orders",
        F.round("rev", 2).cast("double").alias("total_revenue"),
        round_dp(F.try_divide(as_double("rev"), F.col("total_orders")), 2).alias("avg_order_value"))
        .orderBy(F.desc("unique_customers"), "city", "state").limit(n))


def rfm_segment(r, f, total) -> F.Column:
    """Ordered rules: the first match wins."""
    return (F.when(total >= 8, RFM_CHAMPIONS)
            .when(total >= 6, RFM_LOYAL)
            .when((r >= 2) & (f == 1), RFM_PROMISING)
            .when((r == 1) & (f >= 2), RFM_AT_RISK)
            .otherwise(RFM_LOST))


def cust_rfm_full(t: Tables, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """RFM scores for every person.

    recency = whole days from the last purchase date to ``as_of``; scores are
    NTILE(3) over the whole population (recency inverted: 4 - tile), with the
    person id as tie-break so equal values split deterministically.

    The per-person frame is written when the table is built, and the rows at
    which each score changes are found in it; the scores are comparisons with
    these rows. When many results are produced together (``t.reusing``), the
    finished table is shared by every RFM result.
    """
    if t.reusing:
        return t.shared(f"rfm_full_{as_of}", lambda: _rfm_full(t, as_of))
    return _rfm_full(t, as_of)


def _rfm_full(t: Tables, as_of: str) -> DataFrame:
    people = person_orders(t)
    base = people.select(
        "customer_unique_id",
        F.datediff(F.to_date(F.lit(as_of)), F.to_date("last_ts")).cast("long").alias("recency_days"),
        F.col("total_orders").alias("frequency"),
        F.col("total_spent").alias("monetary"))
    scored = ntile_by_cuts(materialize(base), 3, "customer_unique_id", {
        "recency_days": "r_tile", "frequency": "f_score", "monetary": "m_score"})
    r = (F.lit(4) - F.col("r_tile")).cast("long")
    total = r + F.col("f_score") + F.col("m_score")
    return scored.select(
        "customer_unique_id", "recency_days", "frequency",
        F.col("monetary").cast("double").alias("monetary"),
        r.alias("r_score"), "f_score", "m_score",
        total.alias("rfm_total"),
        rfm_segment(r, F.col("f_score"), total).alias("rfm_segment"))


def cust_rfm(t: Tables, as_of: str = DEFAULT_AS_OF, n: int = 100) -> DataFrame:
    return (cust_rfm_full(t, as_of)
            .orderBy(F.desc("rfm_total"), "customer_unique_id").limit(n))


def cust_summary(t: Tables) -> DataFrame:
    return person_orders(t).select(
        "customer_unique_id", "total_orders",
        F.col("total_spent").cast("double").alias("total_spent"),
        F.date_format(F.to_date("first_ts"), "yyyy-MM-dd").alias("first_order"),
        F.date_format(F.to_date("last_ts"), "yyyy-MM-dd").alias("last_order"),
        trunc_days("first_ts", "last_ts").alias("active_days"))


def cust_clv(t: Tables) -> DataFrame:
    people = person_orders(t)
    return people.agg(
        round_dp(avg_of("total_spent"), 2).alias("avg_clv"),
        round_dp(avg_of("total_orders"), 2).alias("avg_orders_per_customer"),
        round_dp(F.avg(F.try_divide(as_double("total_spent"), F.col("total_orders"))), 2)
        .alias("avg_order_value"),
        F.max("total_spent").cast("double").alias("max_clv"),
        F.count_if(F.col("total_orders") > 1).alias("repeat_customers"),
        count_rows().alias("total_customers"))


def cust_top_ranked(t: Tables, n: int = 20) -> DataFrame:
    """Top-n people by spend with RANK() and share of all spend.

    The original ranks every person in one window and then keeps n rows.
    RANK of a row only depends on the rows above it, so taking the top n by
    (spend desc, id) first and ranking those few rows is equal and scales.
    City/state are those of the person's smallest customer_id, looked up for the
    top n only.

    The per-person frame feeds both the top-n and the grand total, so it is
    written once; a bundle that produces many results shares it with them.
    """
    people = person_orders(t) if t.reusing else materialize(
        person_orders(t).select("customer_unique_id", "first_customer_id", "total_orders", "total_spent"))
    total = people.agg(F.sum("total_spent").alias("total"))
    top = people.orderBy(F.desc("total_spent"), "customer_unique_id").limit(n)
    ranked = top.withColumn("rank", F.rank().over(Window.orderBy(F.desc("total_spent"))).cast("long"))
    ranked = share_of_external_total(ranked, "total_spent", "pct_of_revenue", 4, total, "total")
    # n rows at most on this side.
    found = (t.customers.join(F.broadcast(top.select(F.col("first_customer_id").alias("customer_id"))),
                              "customer_id", "left_semi")
             .groupBy(F.col("customer_id").alias("first_customer_id"))
             .agg(F.min(F.struct("customer_city", "customer_state")).alias("loc")))
    return (ranked.join(F.broadcast(found), "first_customer_id").select(
        "rank", "customer_unique_id",
        F.col("loc.customer_city").alias("customer_city"),
        F.col("loc.customer_state").alias("customer_state"),
        "total_orders", F.col("total_spent").cast("double").alias("total_spent"),
        "pct_of_revenue")
        .orderBy("rank", "customer_unique_id"))
