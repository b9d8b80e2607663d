"""Randomized marketplaces (duplicates, NULLs, orphans, negative delivery
times, shared person ids, untranslated categories) against the DuckDB
statements, for every operator."""

import random
import tempfile
from datetime import datetime, timedelta
from decimal import Decimal as D

import duckdb
import pytest

from compare import compare
from souk.plans.oracle import AS_OF, STATEMENTS
from souk.plans.registry import OPERATORS, run
from souk.schema import SCHEMAS
from souk.sources.tables import load_tables

STATUSES = ["delivered"] * 6 + ["shipped", "canceled", "processing", None]


def maybe(rnd, p, value):
    return None if rnd.random() < p else value


def random_rows(seed: int) -> dict[str, list[tuple]]:
    rnd = random.Random(seed)
    t0 = datetime(2019, 1, 1)
    n_orders, n_customers, n_products = 300, 60, 25
    orders, items, reviews = [], [], []
    for oid in range(1, n_orders + 1):
        copies = 2 if rnd.random() < 0.03 else 1
        cid = maybe(rnd, 0.02, rnd.randint(1, n_customers + 3))      # a few orphans / NULL
        p = maybe(rnd, 0.02, t0 + timedelta(seconds=rnd.randint(0, 600 * 86400)))
        d = None if p is None or rnd.random() < 0.15 else p + timedelta(
            seconds=rnd.randint(-86400, 30 * 86400))
        e = maybe(rnd, 0.1, None if p is None else p + timedelta(days=rnd.randint(5, 25)))
        status = rnd.choice(STATUSES)
        for _ in range(copies):
            orders.append((oid, cid, status, p, d, e))
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 5])):
            price = maybe(rnd, 0.03, D(rnd.choice(["0.00", "-1.50"]) if rnd.random() < 0.03
                                       else f"{rnd.randint(1, 500)}.{rnd.randint(0, 99):02d}"))
            items.append((oid, rnd.randint(1, n_products + 2), rnd.randint(1, 6), price,
                          maybe(rnd, 0.02, D(f"{rnd.randint(0, 40)}.{rnd.randint(0, 99):02d}"))))
        for r in range(rnd.choice([0, 1, 1, 1, 2])):
            reviews.append((oid * 10 + r, oid, maybe(rnd, 0.05, rnd.randint(1, 5))))
    customers = [(c, c - c % 3, f"city{rnd.randint(1, 8)}", f"S{rnd.randint(1, 4)}")
                 for c in range(1, n_customers + 1)]
    products = [(p, maybe(rnd, 0.2, f"cat{rnd.randint(1, 6)}"), maybe(rnd, 0.1, rnd.randint(1, 900)),
                 maybe(rnd, 0.1, rnd.randint(1, 90))) for p in range(1, n_products + 1)]
    translation = [(f"cat{i}", f"Category {i}") for i in range(1, 6) if i != 3]
    return {"orders": orders, "order_items": items, "order_payments": [(1, D("1.00"))],
            "order_reviews": reviews, "customers": customers, "sellers": [(s,) for s in range(1, 7)],
            "products": products, "category_translation": translation}


@pytest.fixture(scope="module", params=[11, 22, 33])
def env(request, spark):
    path = tempfile.mkdtemp(prefix=f"souk-random-{request.param}-")
    for name, rows in random_rows(request.param).items():
        spark.createDataFrame(rows, SCHEMAS[name]).repartition(3).write.parquet(f"{path}/{name}")
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW m_{name} AS SELECT * FROM read_parquet('{path}/{name}/*.parquet')")
    return load_tables(spark, path), con


@pytest.mark.parametrize("key", sorted(OPERATORS))
def test_random_matches_oracle(env, key):
    tables, con = env
    # review_by_category keeps categories with > 50 reviews; random data is
    # smaller, so the statement's HAVING empties both sides alike.
    assert compare(run(key, tables, as_of=AS_OF), con, STATEMENTS[key]) == []
