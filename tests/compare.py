"""Spark-vs-DuckDB result comparison used by the oracle tests and by hand.

Mirrors the driver's gate: same row count, same column names and
types, and the same multiset of rows (columns sorted by name, rows sorted).
"""

from __future__ import annotations

import math
import sys

import duckdb

RAW_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


# DuckDB's names of the types that Spark results have.
DUCK_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
              "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark_df, con, sql: str) -> list[str]:
    problems = []
    s_rows = [tuple(r) for r in spark_df.collect()]
    s_cols = spark_df.columns
    s_types = {f.name: DUCK_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString())
               for f in spark_df.schema.fields}
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    d_rows = rel.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns differ: spark={s_cols} duck={d_cols}")
        return problems
    for c in s_cols:
        if s_types[c] != d_types[c]:
            problems.append(f"type of {c}: spark={s_types[c]} duck={d_types[c]}")
    if len(s_rows) != len(d_rows):
        problems.append(f"row count: spark={len(s_rows)} duck={len(d_rows)}")
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        problems.append(f"values differ, first: {diff}")
    return problems


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    from souk.session import build_session

    sf = "/root/testdata/sf0.01"
    only = sys.argv[1:]
    spark = build_session()
    con = duck(sf)
    oracle = E.oracle_sql()
    bad = 0
    for key, q in E.queries().items():
        if only and key not in only:
            continue
        if key not in oracle:
            print(f"{key:30s} NO ORACLE")
            continue
        try:
            probs = compare(q(spark, sf), con, oracle[key])
        except Exception as e:  # noqa: BLE001
            probs = [f"error {type(e).__name__}: {str(e)[:300]}"]
        bad += bool(probs)
        print(f"{key:30s} {'OK' if not probs else 'FAIL'} {' | '.join(probs)}")
    print("mismatches:", bad)
