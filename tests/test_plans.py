"""Physical-plan properties that matter at scale."""

import re

import pytest

from souk.operators import activity, common, customers, kpis, nested, quality, reviews


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rfm_has_no_whole_population_window(tables):
    plan = _plan(customers.cust_rfm_full(tables, as_of="2021-01-01"))
    assert "ntile" not in plan.lower()


def test_top_ranked_ranks_after_limit(tables):
    lines = _plan(customers.cust_top_ranked(tables, n=20)).splitlines()
    window = next(i for i, line in enumerate(lines) if "Window [rank(" in line)
    # the rank window reads the top-n directly: it sees at most n rows
    assert "TakeOrderedAndProject(limit=20" in lines[window + 1]


def test_top_ranked_looks_up_places_for_the_top_only(spark, tables):
    lines = _plan(customers.cust_top_ranked(tables, n=20))
    assert "SortAggregate" not in _plan(common.person_orders(tables))
    assert "Scan ExistingRDD" in lines or "ExistingRDD" in lines or "FileScan parquet" in lines


def test_snapshot_scans_items_once(spark, fixture_dir):
    from souk.sources.tables import load_tables
    plan = _plan(kpis.kpi_snapshot(load_tables(spark, fixture_dir)))
    scans = [x for x in plan.splitlines() if "FileScan parquet" in x and "freight_value" in x]
    assert len(scans) == 1
    assert sum("order_items" in x for x in plan.splitlines() if "FileScan" in x) == 1


def test_review_by_category_drops_undelivered_items_first(tables):
    """The semi-join with delivered orders stands below the join with products."""
    plan = reviews.order_categories(tables)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda text: min(len(x) - len(x.lstrip(" :+-")) for x in plan if text in x)
    assert depth("Join LeftSemi") > depth("Join Inner")


def test_orphans_use_anti_join(tables):
    assert "LeftAnti" in _plan(quality.dq_orphan_orders(tables))
    assert "LeftAnti" in _plan(quality.dq_scorecard(tables))


def test_share_of_total_does_not_recompute(tables):
    plan = _plan(kpis.kpi_state_performance(tables))
    assert "BroadcastNestedLoopJoin" not in plan
    assert "CartesianProduct" not in plan


def test_scan_is_pruned(tables):
    df = kpis.kpi_orders_by_hour(tables)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "order_estimated_delivery_date" not in text.split("ReadSchema:")[-1]


def test_no_cartesian_products_when_planned_for_large_data(spark, tables):
    from souk.plans.oracle import AS_OF
    from souk.plans.registry import OPERATORS, run

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for key in OPERATORS:
            plan = _plan(run(key, tables, as_of=AS_OF))
            assert "CartesianProduct" not in plan, key
            assert "ntile(" not in plan.lower(), key
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@pytest.mark.parametrize("build", [reviews.review_by_category, activity.cube_sales, nested.json_order_facts, nested.json_seller_items])
def test_tasks_follow_the_rows(tables, monkeypatch, build):
    """Orders are dealt to as many tasks as the rows ask for, so a task's memory stays."""
    monkeypatch.setattr(common, "ROWS_PER_TASK", 7)
    rows = tables.order_items.count() + (tables.order_reviews.count() if "json" in build.__name__ else 0)
    dealt = re.findall(r"hashpartitioning\((\w+)#[^()]*, (\d+)\), REPARTITION_BY_NUM", _plan(build(tables)))
    assert len(dealt) > 2 and {int(n) for _, n in dealt} <= {-(-rows // 7), -(-tables.order_items.count() // 7)}
    assert any(key in ("order_id", "large_id") for key, _ in dealt)


def test_cube_counts_orders_without_their_ids(tables, monkeypatch):
    """An order's levels are taken in one task: no id is behind the last exchange."""
    monkeypatch.setattr(common, "ROWS_PER_TASK", 7)
    first = next(x for x in _plan(activity.cube_sales(tables)).splitlines() if "Exchange" in x)
    assert "level" in first and "order_id" not in first


def test_seller_orders_are_counted_as_rows(tables, monkeypatch):
    monkeypatch.setattr(common, "ROWS_PER_TASK", 7)
    first = next(x for x in _plan(nested.json_seller_items(tables)).splitlines() if "Exchange" in x)
    assert "hashpartitioning(seller_id" in first and "order_id" not in first
