"""Producing many results together: shared building blocks are checkpointed
once and every result is unchanged."""

from souk.plans.oracle import AS_OF
from souk.plans.registry import OPERATORS, run, run_all


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_reuse_gives_identical_results(tables):
    shared = run_all(tables, as_of=AS_OF, reuse=True)
    assert set(shared) == set(OPERATORS)
    for key, df in shared.items():
        assert _rows(df) == _rows(run(key, tables, as_of=AS_OF)), key


def test_reuse_reads_checkpointed_building_block(tables):
    t = tables.with_reuse()
    plan = run("kpi_state_performance", t)._jdf.queryExecution().executedPlan().toString()
    assert "order_items" not in plan          # item totals come from the checkpoint
    assert "Scan ExistingRDD" in plan or "LogicalRDD" in plan or "ExistingRDD" in plan
