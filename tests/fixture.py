"""Hand-made marketplace edge fixture (FIXTURES.md section 3).

has at least one row here. ``build(spark)`` returns Tables; ``write`` stores
the same tables as parquet for the DuckDB side of the oracle tests.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal as D

from pyspark.sql import SparkSession

from souk.schema import SCHEMAS
from souk.sources.tables import Tables

T0 = datetime(2020, 1, 5, 10, 0, 0)


def ts(s: str | None) -> datetime | None:
    return None if s is None else datetime.fromisoformat(s)


def days(start: datetime | None, d: float) -> datetime | None:
    return None if start is None else start + timedelta(days=d)


def rows() -> dict[str, list[tuple]]:
    orders, items, reviews = [], [], []

    def order(oid, cid, status, purchase, delivered_after=None, estimate_after=None,
              delivered_at=None, estimate_at=None):
        p = ts(purchase) if isinstance(purchase, str) else purchase
        d = delivered_at if delivered_at is not None else (
            days(p, delivered_after) if delivered_after is not None else None)
        e = estimate_at if estimate_at is not None else (
            days(p, estimate_after) if estimate_after is not None else None)
        orders.append((oid, cid, status, p, d, e))

    # elapsed 7.0 days, on time
    order(1, 1, "delivered", "2020-01-05 10:00:00", 7.0, 15)
    # elapsed 7.9 days, delivered exactly at the estimate (counts as on time)
    p2 = ts("2020-01-06 08:00:00")
    order(2, 2, "delivered", p2, 7.9, estimate_at=days(p2, 7.9))
    # elapsed 8.0 days, no estimate
    order(3, 3, "delivered", "2020-01-07 00:00:00", 8.0, None)
    # month gap (no February delivery); 14.9 days, late
    order(4, 3, "delivered", "2020-03-01 12:00:00", 14.9, 10)
    order(5, 4, "delivered", "2020-03-02 23:59:59", 21.9, 30)
    order(6, 4, "delivered", "2020-04-03 06:30:00", 22.0, 5)
    # delivered without a delivery date
    order(7, 5, "delivered", "2020-04-10 13:00:00", None, 10)
    # the only delivered order of May 2021 has zero revenue; June 2021 is empty,
    # so July compares with May and divides by 0
    order(8, 5, "delivered", "2021-05-01 09:00:00", 3, 10)
    order(9, 6, "delivered", "2021-07-01 18:00:00", 2, 10)
    order(10, 1, "canceled", "2019-12-31 23:00:00")
    order(11, 2, "shipped", "2020-02-10 11:00:00")
    order(12, 3, None, "2020-02-11 11:00:00")
    # NULL purchase timestamp
    order(13, 4, "delivered", None, delivered_at=ts("2020-02-01 00:00:00"),
          estimate_at=ts("2020-02-05 00:00:00"))
    # orphan customer, NULL customer
    order(14, 999, "delivered", "2020-06-02 10:00:00", 5, 10)
    order(15, None, "processing", "2020-06-03 10:00:00")
    # order 16 stored three times (fan-out everywhere)
    for _ in range(3):
        order(16, 5, "delivered", "2020-06-04 10:00:00", 6, 10)
    # twelve ids stored twice each: tied duplicate counts
    for oid in range(201, 213):
        for _ in range(2):
            order(oid, 6, "processing", "2020-07-01 10:00:00")

    def item(oid, pid, sid, price, freight):
        items.append((oid, pid, sid, None if price is None else D(price),
                      None if freight is None else D(freight)))

    item(1, 1, 1, "10.00", "1.00")
    item(1, 2, 2, "20.00", "2.00")          # 2 items, 2 sellers, 2 categories
    item(2, 3, 1, "30.00", "3.00")          # NULL category
    item(3, 1, 1, "15.50", "0.50")
    item(4, 1, 2, "12.25", "1.25")
    item(4, 1, 2, "12.25", "1.25")          # same product twice
    item(5, 2, 3, "40.00", "4.00")
    item(6, 4, 1, "5.00", "0.50")           # unknown product
    item(7, 1, 1, "9.99", "0.01")
    item(8, 1, 1, "0.00", "0.00")           # zero price
    item(9, 2, 2, "100.00", "10.00")
    item(9, 3, 3, "-5.00", "0.00")          # negative price
    item(13, 1, 1, "7.00", "1.00")
    item(14, 1, 1, "8.00", "1.00")
    item(16, 2, 1, "50.00", "5.00")
    item(16, 1, 2, None, "2.00")            # NULL price
    item(999, 1, 1, "1.00", "0.10")         # orphan item

    def review(rid, oid, score):
        reviews.append((rid, oid, score))

    review(1, 1, 5)
    review(2, 2, 4)
    review(3, 2, 2)                         # second review of one order
    review(4, 3, None)                      # NULL score
    review(5, 4, 1)
    review(6, 5, 3)
    review(7, 6, 1)
    review(8, 9, 5)
    review(9, 16, 4)
    review(10, 999, 3)                      # review of an unknown order

    # Population for RFM / ranking: people 20..39 with 1-4 orders each and
    # tied spends; the orders also give category 5 exactly 51 reviews and
    # category 6 exactly 50 (HAVING > 50 keeps only the first).
    oid, rid = 1000, 1000
    for n_review, pid in ((51, 5), (50, 6)):
        for i in range(n_review):
            cid = 20 + (oid % 20)
            start = T0 + timedelta(days=(oid * 7) % 300, hours=oid % 24)
            order(oid, cid, "delivered", start, 4 + oid % 20, 12)
            item(oid, pid, 1 + oid % 3, f"{10 + (oid % 7) * 5}.00", "1.50")
            review(rid, oid, 1 + (oid * 3) % 5)
            oid += 1
            rid += 1

    customers = [
        (1, 100, "city_a", "S1"),
        (2, 100, "city_b", "S2"),           # second id of person 100, other city
        (3, 300, "city_a", "S1"),
        (4, 400, "city_c", "S2"),
        (5, 500, "city_c", "S2"),
        (6, 600, "city_d", "S3"),
        (7, 700, "city_d", "S3"),           # customer without orders
    ] + [(c, c, f"city_{c % 3}", f"S{c % 4}") for c in range(20, 40)]

    products = [
        (1, "cat_a", 500, 20),
        (2, "cat_b", 700, 30),              # no translation
        (3, None, 100, 10),                 # NULL category
        (5, "cat_c", None, None),           # NULL weight and length
        (6, "cat_d", 200, None),
        (7, "cat_a", 300, 15),              # never sold
    ]
    translation = [("cat_a", "Cat A"), ("cat_c", "Cat C"), ("cat_d", "Cat D"), ("cat_z", "Cat Z")]
    payments = [(1, D("33.00")), (2, D("33.00")), (999, D("1.10"))]
    sellers = [(1,), (2,), (3,), (4,)]
    return {
        "orders": orders, "order_items": items, "order_payments": payments,
        "order_reviews": reviews, "customers": customers, "sellers": sellers,
        "products": products, "category_translation": translation,
    }


def build(spark: SparkSession, empty: bool = False) -> Tables:
    data = rows()
    return Tables(**{name: spark.createDataFrame([] if empty else data[name], SCHEMAS[name])
                     for name in SCHEMAS})


def write(spark: SparkSession, out_dir: str, empty: bool = False) -> str:
    for name, df in build(spark, empty).items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/{name}")
    return out_dir
