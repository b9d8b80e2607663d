"""Approximate counts and quantiles by sketches that are stored once by month and merged
for any longer period; a sketch has a fixed size, whatever it counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.operators.common import PURCHASE_TS, delivered_order_rows
from souk.session import materialize
from souk.sources.tables import Tables

LG_K = 12  # 4,096 slots: standard error 1.04 / 64 = 1.6 % (distinct counts)
KLL_K = 200  # rank error about 1.7 % (quantiles)


def _sold(t: Tables) -> DataFrame:
    return delivered_order_rows(t, with_customer=True).where(F.col(PURCHASE_TS).isNotNull()).select(
        F.col("customer_state").alias("state"), F.date_format(PURCHASE_TS, "yyyy-MM").alias("month"),
        F.col("customer_unique_id").alias("who"), F.col("order_total").cast("double").alias("paid"))


def monthly_sketches(t: Tables) -> DataFrame:
    """state, month -> ``people`` (HLL) of buyers, ``paid`` (KLL) of order totals."""
    return _sold(t).groupBy("state", "month").agg(
        F.hll_sketch_agg("who", LG_K).alias("people"), F.kll_sketch_agg_double("paid", KLL_K).alias("paid"))


def people(sketches: DataFrame, *by: str | Column) -> DataFrame:
    """Different buyers by any grouping of stored sketches, as estimated from their union."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("people")).alias("customers"))


def _periods(df: DataFrame) -> DataFrame:
    """One row for each period that holds the month: itself, its quarter, its year, all."""
    year = F.substring("month", 1, 4)
    quarter = F.concat(year, F.lit("-Q"), F.ceil(F.substring("month", 6, 2).cast("int") / 3).cast("string"))
    return df.withColumn("period", F.explode(F.array(F.col("month"), quarter, year, F.lit("all"))))


def sketch_active_customers(t: Tables) -> DataFrame:
    """Different buyers by state in each month, quarter, year and in all, from monthly
    sketches: an estimate."""
    return people(_periods(monthly_sketches(t)), "state", "period")


def sketch_active_error(t: Tables, bound: float = 0.05) -> DataFrame:
    """The estimates of all states together against exact counts: whether each is within
    ``bound`` (three standard errors)."""
    guess = people(_periods(monthly_sketches(t)), "period").withColumnRenamed("customers", "estimate")
    exact = _periods(_sold(t).select("month", "who").distinct()).groupBy("period").agg(F.countDistinct("who").alias("customers"))
    return exact.join(guess, "period").select(
        "period", "customers", (F.abs(F.col("estimate") - F.col("customers")) <= bound * F.col("customers")).alias("within"))


def sketch_order_value(t: Tables) -> DataFrame:
    """Estimated quantiles of order totals by state, from monthly sketches."""
    at = lambda p: F.kll_sketch_get_quantile_double("merged", F.lit(p))
    merged = monthly_sketches(t).groupBy("state").agg(F.kll_merge_agg_double("paid").alias("merged"))
    return merged.select("state", F.kll_sketch_get_n_double("merged").alias("orders"),
                         at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"))


def sketch_retention(t: Tables) -> DataFrame:
    """For each month: its buyers, those who bought in the next calendar month as well, and
    those who didn't, from theta sketches and their intersection and difference. Exact while
    a month has no more than 4,096 buyers, else an estimate."""
    months = materialize(_sold(t).groupBy("month").agg(F.theta_sketch_agg("who", LG_K).alias("people")))
    # One row a month.
    order = Window.orderBy("month")
    follows = F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), 1), "yyyy-MM")
    rows = months.withColumn("later", F.when(F.lead("month").over(order) == follows, F.lead("people").over(order)))
    stay = F.theta_sketch_estimate(F.theta_intersection("people", "later"))
    gone = F.theta_sketch_estimate(F.theta_difference("people", "later"))
    customers = F.theta_sketch_estimate("people")
    return rows.select("month", customers.alias("customers"),
                       F.when(F.col("later").isNull(), 0).otherwise(stay).cast("long").alias("retained"),
                       F.when(F.col("later").isNull(), customers).otherwise(gone).cast("long").alias("lost"))
