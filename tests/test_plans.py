"""Shape of the physical plans: what is pruned, pushed down, broadcast and shuffled."""

from __future__ import annotations

import re

import pytest

from changeflow.functions.ranges import TimeRange
from changeflow.operators import filters, listing, route, stats
from changeflow.sinks.monitor_tables import append_monitor
from changeflow.sources.monitor_tables import read_monitor
from changeflow.targets import TargetConfig, target_tables
from checks.queries import QUERIES
from checks.views import view

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("monitor"))
    append_monitor(view(spark, SF, "sync_events").drop("id", "k"), root, "sync_events")
    append_monitor(view(spark, SF, "sync_errors"), root, "sync_errors")
    return root


def test_ranges_prune_months_and_reach_the_scan(spark, saved):
    rng = TimeRange.of("2024-01-10", "2024-01-20")
    events = filters.events_filtered(read_monitor(spark, saved, "sync_events"), target="ClickHouse:replica", rng=rng)
    text = plan(stats.event_stats_by_type(events, rng))
    assert re.search(r"PartitionFilters: \[[^\]]*yyyymm#\d+ >= 202401", text)
    assert "GreaterThanOrEqual(timestamp" in text and "EqualTo(target_name,ClickHouse:replica)" in text
    schema = re.search(r"ReadSchema: (\S+)", text).group(1)
    assert "event_type" in schema and "error_msg" not in schema and "binlog" not in schema


def test_pages_keep_only_the_page_per_task(spark, saved):
    assert "TakeOrderedAndProject(limit=40, offset=20" in plan(listing.page(read_monitor(spark, saved, "sync_events"), 2, 20))


def test_included_tables_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "orders")], "seq bigint, table_name string").write.parquet(f"{tmp_path}/log")
    df = route.included_changes(spark.read.parquet(f"{tmp_path}/log"), [TargetConfig("a", ("orders", "items"))])
    assert "In(table_name, [items,orders])" in plan(df)


def test_targets_are_broadcast_only_while_small(spark):
    changes = view(spark, SF, "change_log")
    targets = target_tables(spark, [TargetConfig("a", ("orders",)), TargetConfig("b", ("orders",))])
    small = route.route_changes(changes, targets)
    assert "BroadcastHashJoin" in plan(small)
    expected = small.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = route.route_changes(changes, targets)
        assert "SortMergeJoin" in plan(large) and large.count() == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("streamed_", "fan_out_"))])
def test_no_product_and_no_python_in_any_plan(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert operator not in text


@pytest.mark.parametrize("name", ["live_status", "health", "metrics_24h", "service_status", "target_status", "current_position", "target_error_totals", "latency_stats"])
def test_newest_records_are_found_without_sorting_all(spark, name):
    assert "SortAggregate" not in plan(QUERIES[name](spark, SF))
