"""Every operator on the hand-made edge fixture (and on empty tables) against
the DuckDB statements, which read the fixture's marketplace tables directly."""

import duckdb
import pytest

from compare import compare
from souk.plans.oracle import AS_OF, STATEMENTS
from souk.plans.registry import OPERATORS, run
from souk.schema import SCHEMAS
from souk.sources.tables import load_tables


def _duck(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW m_{name} AS SELECT * FROM read_parquet('{path}/{name}/*.parquet')")
    return con


@pytest.fixture(scope="module")
def duck_fixture(fixture_dir):
    return _duck(fixture_dir)


@pytest.fixture(scope="module")
def duck_empty(empty_dir):
    return _duck(empty_dir)


def test_every_operator_has_a_statement():
    assert set(OPERATORS) == set(STATEMENTS)


@pytest.mark.parametrize("key", sorted(OPERATORS))
def test_fixture_matches_oracle(spark, tables, duck_fixture, key):
    df = run(key, tables, as_of=AS_OF)
    assert compare(df, duck_fixture, STATEMENTS[key]) == []


@pytest.mark.parametrize("key", sorted(OPERATORS))
def test_empty_tables_match_oracle(spark, empty_dir, duck_empty, key):
    df = run(key, load_tables(spark, empty_dir), as_of=AS_OF)
    assert compare(df, duck_empty, STATEMENTS[key]) == []
