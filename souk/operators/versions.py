"""Differences between two versions of a table, copies and nulls included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.operators.common import DELIVERED_TS, ESTIMATED_TS, PURCHASE_TS, order_totals_of
from souk.sources.tables import Tables


def row_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Each different row of either with how often both hold it (``in_old``, ``in_new``).

    Nulls are equal, columns are matched by name. One grouping over both, summed before the
    shuffle, so a row that fills a third of a table is a row from each task."""
    both = old.select("*", F.lit(1).alias("in_old"), F.lit(0).alias("in_new")).unionByName(
        new.select("*", F.lit(0).alias("in_old"), F.lit(1).alias("in_new")))
    return both.groupBy(*old.columns).agg(F.sum("in_old").alias("in_old"), F.sum("in_new").alias("in_new"))


def surplus(kept: str, taken: str) -> Column:
    """EXCEPT ALL as a count: copies in ``kept`` beyond those in ``taken``."""
    return F.greatest(F.col(kept) - F.col(taken), F.lit(0).cast("long"))


def reconcile(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each key of either version: ``change`` (added, removed, changed, same) and
    its rows in both (``rows_before``, ``rows_after``). A null key is a key; a key with
    several rows is the same if both versions hold equal rows equally often."""
    common = F.sum(F.least("in_old", "in_new"))
    found = row_counts(old, new).groupBy(*keys).agg(
        F.sum("in_old").alias("rows_before"), F.sum("in_new").alias("rows_after"), common.alias("__common"))
    change = (F.when(F.col("rows_before") == 0, "added").when(F.col("rows_after") == 0, "removed")
              .when((F.col("__common") == F.col("rows_before")) & (F.col("__common") == F.col("rows_after")), "same").otherwise("changed"))
    return found.select(*keys, change.alias("change"), "rows_before", "rows_after")


def open_orders(t: Tables, at: str) -> DataFrame:
    """Orders placed and not delivered by the time ``at``, and whether they are late then."""
    now = F.lit(at).cast("timestamp_ntz")
    waiting = (F.col(PURCHASE_TS) <= now) & (F.col(DELIVERED_TS).isNull() | (F.col(DELIVERED_TS) > now))
    return t.orders.where(waiting).select("order_id", (F.col(ESTIMATED_TS) < now).alias("late"))


def recon_open_orders(t: Tables, before: str = "1998-01-01", after: str = "1998-02-01") -> DataFrame:
    """Open orders at two times: those that came, went, got late in between or stayed."""
    return reconcile(open_orders(t, before), open_orders(t, after), ["order_id"])


def recon_order_amounts(t: Tables) -> DataFrame:
    """What each order's items cost against what was paid, orders on one side only included."""
    billed = order_totals_of(t).select(F.col("order_id").alias("b_id"), F.col("order_total").alias("billed"))
    paid = t.order_payments.groupBy(F.col("order_id").alias("p_id")).agg(F.sum("payment_value").alias("paid"))
    both = billed.join(paid, F.col("b_id").eqNullSafe(F.col("p_id")), "full")
    state = (F.when(F.col("paid").isNull(), "unpaid").when(F.col("billed").isNull(), "no items")
             .when(F.col("paid") == F.col("billed"), "equal").when(F.col("paid") > F.col("billed"), "overpaid").otherwise("underpaid"))
    return both.select(F.coalesce("b_id", "p_id").alias("order_id"), F.col("billed").cast("double").alias("billed"),
                       F.col("paid").cast("double").alias("paid"), state.alias("state"))


def recon_log_orders(t: Tables, events: DataFrame) -> DataFrame:
    """Purchases of the activity log against orders, as bags of (customer, weekday; Sunday is
    1): copies on both sides (INTERSECT ALL) and on one only (EXCEPT ALL)."""
    log = events.where("event_type = 'purchase'").select(F.col("user_id").alias("customer_id"), F.dayofweek("ts").alias("weekday"))
    orders = t.orders.select("customer_id", F.dayofweek(PURCHASE_TS).alias("weekday"))
    return row_counts(log, orders).select(
        "customer_id", "weekday", F.least("in_old", "in_new").alias("in_both"),
        surplus("in_old", "in_new").alias("log_only"), surplus("in_new", "in_old").alias("orders_only"))
