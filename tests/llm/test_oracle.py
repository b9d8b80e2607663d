"""Queries that SQL can express against DuckDB: test data, awkward tables, learned cutoffs."""

import duckdb
import pytest

import messy
from souk.llm.oracle import ORACLE
from souk.llm.queries import QUERIES
from test_order_ops import conversations

TABLES = ("documents", "labels", "conversations", "benchmark")


def compare(spark, folder, key):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        import os
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    want = con.sql(ORACLE[key])
    got = QUERIES[key](spark, folder)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert {c: {"string": "VARCHAR", "int": "INTEGER"}.get(t, t.upper()) for c, t in got.dtypes} == {
        c: str(t) for c, t in zip(want.columns, want.types)}
    rows = [tuple(r) for r in got.select(*cols).collect()]
    assert sorted(rows, key=str) == sorted(want.select(*cols).fetchall(), key=str)
    return got


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_test_data(spark, key):
    compare(spark, "/root/testdata/sf0.01", key)


def write(spark, folder, docs, labels):
    messy.docs(spark, docs, extra=False).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    messy.labels(spark, labels).coalesce(1).write.parquet(f"{folder}/labels.parquet")
    rows = [(c, t, r, x) for i, (c, t, r, x) in enumerate(conversations(5, 40, 12)) if c is not None or i % 2]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([(1, messy.PASSAGE), (2, None)], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("key", sorted(set(ORACLE) - {"op7_exact_dedup", "op8_secret_scan"}))
def test_awkward_tables(spark, tmp_path, key):
    """Without repeated and null ids, which the statements' joins by id don't tell apart."""
    seen, rows = set(), []
    for r in messy.ROWS:
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            rows.append(r)
    compare(spark, write(spark, tmp_path, rows, messy.LABELS), key)


def test_learned_cutoffs(spark, tmp_path):
    clean = [(i, messy.words(60 + i % 9, 20 + i % 5), "en", "s", 1) for i in range(6000)]
    noisy = [(10_000 + i, " ".join(f"{w} #$" for w in messy.words(60, 30 + i % 7).split()), "en", "s", 1) for i in range(300)]
    other = [(20_000 + i, noisy[i][1], "de", "s", 1) for i in range(5)]
    labels = [(d, int(d < 10_000), 0) for d, *_ in clean + noisy] + [(3, 0, 0)]
    got = compare(spark, write(spark, tmp_path, clean + noisy + other, labels), "op6_quality_rules")
    assert got.filter("NOT kept").count() == 300
