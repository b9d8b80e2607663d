"""How many rows are smaller: a join by ``<`` whose answer is a count, without its pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.expr import as_double, count_rows
from souk.operators.common import product_categories
from souk.session import materialize
from souk.sources.tables import Tables


def count_below(left: DataFrame, right: DataFrame, keys: list[str], value: str, out: str,
                inclusive: bool = False, parts: int | None = None) -> DataFrame:
    """``left`` with ``out``: the rows of ``right`` with the same ``keys`` and a smaller
    ``value`` (``inclusive``: or an equal one). Null where a key or the value is null.

    Equal (keys, value) become one counted row on both sides. These rows are dealt by ranges
    of (keys, value), so a hot key lies in many parts; a part begins with what the parts
    before it hold of the key, and counts on from there. Work grows with rows, not pairs."""
    names = [f"__k{i}" for i in range(len(keys))]
    parts = parts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def points(df: DataFrame) -> DataFrame:
        rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).alias("__v"))
        return rows.where(" AND ".join(f"{c} IS NOT NULL" for c in rows.columns))  # dropna() would drop NaN, too

    counted = points(right).groupBy(*names, "__v").agg(count_rows().alias("__n"))
    asked = points(left).distinct().withColumn("__n", F.lit(0).cast("long"))
    merged = counted.unionByName(asked).groupBy(*names, "__v").agg(F.sum("__n").alias("__n"))
    dealt = materialize(merged.repartitionByRange(parts, *names, "__v").withColumn("__part", F.spark_partition_id()))
    before = Window.partitionBy(*names).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each key and part.
    starts = (dealt.groupBy("__part", *names).agg(F.sum("__n").alias("__n"))
              .select("__part", *names, F.sum("__n").over(before).alias("__n")).where("__n > 0")
              .withColumn("__v", F.lit(None).cast(merged.schema["__v"].dataType)))
    own = (Window.partitionBy("__part", *names).orderBy(F.col("__v").asc_nulls_first())
           .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    below = dealt.unionByName(starts).select(*names, "__v", F.coalesce(F.sum("__n").over(own), F.lit(0)).alias(out)).where("__v IS NOT NULL")
    on = [F.col(k) == F.col(n) for k, n in zip(keys, names)] + [F.col(value) == F.col("__v")]
    return left.join(below, on, "left").select(*left.columns, out)


def theta_cheaper_rivals(t: Tables) -> DataFrame:
    """Each sold product at its least price: products of its category that cost less and more."""
    least = t.order_items.groupBy("product_id").agg(F.min("price").alias("price"))
    rows = materialize(least.join(product_categories(t), "product_id"))
    both = count_below(count_below(rows, rows, ["category"], "price", "cheaper"), rows, ["category"], "price", "no_dearer", inclusive=True)
    sizes = rows.groupBy("category").agg(F.count("price").alias("products"))
    return both.join(sizes, "category").select(
        "product_id", "category", as_double("price").alias("price"), "cheaper", (F.col("products") - F.col("no_dearer")).alias("dearer"))


def theta_undercut_sellers(t: Tables) -> DataFrame:
    """For each seller: items sold, those that another seller sold for less at any time, and
    the number of such sales."""
    sold = materialize(t.order_items.select("product_id", "seller_id", "price"))
    by_all = count_below(sold, sold, ["product_id"], "price", "below")
    others = count_below(by_all, sold, ["product_id", "seller_id"], "price", "own").withColumn("offers", F.col("below") - F.col("own"))
    return others.groupBy("seller_id").agg(
        count_rows().alias("items"), F.count_if(F.col("offers") > 0).alias("undercut"),
        F.coalesce(F.sum("offers"), F.lit(0)).alias("cheaper_offers"))
