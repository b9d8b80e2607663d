"""Order documents: round trip to the flat tables, pages, copies, nulls, bad texts."""

import json
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from souk.operators import nested
from souk.sources.tables import Tables

ITEMS = "order_id long, product_id long, seller_id long, price decimal(18,2), freight_value decimal(18,2)"
REVIEWS = "review_id long, order_id long, review_score int"


def bundle(spark, items, reviews):
    none = lambda: None
    return Tables(orders=none, order_items=lambda: spark.createDataFrame(items, ITEMS), order_payments=none,
                  order_reviews=lambda: spark.createDataFrame(reviews, REVIEWS), customers=none, sellers=none,
                  products=none, category_translation=none)


def flat(docs):
    out = Counter()
    for r in nested.items_of(docs).collect():
        out[tuple(r)[:-1]] += r["copies"]
    return out


D = Decimal
ROWS = [(1, 5, 7, D("10.10"), D("0.00")), (1, 5, 7, D("10.10"), D("0.00")), (1, 6, None, None, D("-3.05")), (2, 1, 1, D("9999999999999999.99"), D("0.01")),
        (None, 1, 1, D("1.00"), None)]


def test_round_trip(spark):
    docs = nested.order_documents(bundle(spark, ROWS, [(1, 1, 5), (1, 1, 5), (2, 1, 1), (3, 8, None), (4, 8, 2)]))
    assert docs.columns == ["order_id", "page", "document"] and docs.count() == 4
    assert flat(docs) == Counter(ROWS)
    one = json.loads(docs.where("order_id = 1").first()["document"])
    assert one["scores"] == {"5": 2, "1": 1} and [i["copies"] for i in one["items"]] == [2, 1]
    [r] = nested.read_documents(docs.where("order_id = 8")).collect()
    assert r["items"] == [] and r["scores"] == {"2": 1} and len(r["reviews"]) == 2


@pytest.mark.parametrize("page", [1, 7, 100])
def test_pages_of_a_hot_order(spark, page):
    """One order has most items, two thirds of them copies of one."""
    rows = [(1, i, i % 5, D(i), D(0)) for i in range(300)] + [(1, 0, 0, D(0), D(0))] * 600 + [(2, 1, 1, D(1), D(1))]
    t = bundle(spark, rows, [(i, 1, i % 5 + 1) for i in range(200)])
    docs = nested.order_documents(t, page=page)
    assert flat(docs) == Counter(rows)
    sizes = [len(r["items"]) + len(r["reviews"]) for r in nested.read_documents(docs).collect()]
    assert sum(sizes) == 501 and max(sizes) <= 3 * page + 12
    assert docs.where("order_id = 2").count() == 1
    facts = nested.json_order_facts(t).where("order_id = 1").first()
    assert (facts["items"], facts["reviews"], facts["low_reviews"], facts["dearest"]) == (900, 200, 80, 299.0)


def test_bad_document_fails(spark):
    bad = spark.createDataFrame([('{"order_id": "x"',)], "document string")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        nested.read_documents(bad).collect()


def test_empty(spark):
    docs = nested.order_documents(bundle(spark, [], []))
    assert docs.count() == 0 and nested.items_of(docs).agg(F.sum("copies")).first()[0] is None
