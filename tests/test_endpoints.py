"""The read endpoints over stored tables give what the plain queries give over the views."""

from __future__ import annotations

import pytest

from changeflow.plans.endpoints import MonitorEndpoints
from changeflow.sinks.monitor_tables import append_monitor
from checks.queries import EVENT_COLUMNS
from checks.views import LIVE_AS_OF, STARTED, TARGETS, view
from tests.conftest import at

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("endpoints"))
    append_monitor(view(spark, SF, "sync_events").select(*EVENT_COLUMNS), folder, "sync_events")
    for table in ("sync_errors", "sync_positions", "sync_metrics"):
        append_monitor(view(spark, SF, table), folder, table)
    return folder


@pytest.fixture(scope="module")
def api(spark, root):
    return MonitorEndpoints(spark, root, TARGETS, STARTED)


def test_status_and_metrics(api):
    rows = api.status(LIVE_AS_OF).collect()
    assert {r.name for r in rows} == {t.qualified_name for t in TARGETS}
    assert {(r.service_status, r.uptime) for r in rows} == {("running", 19 * 86400)}
    day = api.metrics(LIVE_AS_OF).first()
    assert day.total_insert + day.total_update + day.total_delete > 0
    assert {r.overall for r in api.health(LIVE_AS_OF).collect()} <= {"healthy", "degraded", "unhealthy"}


def test_switches_show_until_the_next_success(spark, root):
    newest = view(spark, SF, "sync_events").selectExpr("max(seq)").first()[0]
    rows = [(newest + 1, at("2024-01-30 23:59:59"), TARGETS[0].qualified_name, "disabled")]
    switches = spark.createDataFrame(rows, "seq bigint, timestamp timestamp, target_name string, status string")
    api = MonitorEndpoints(spark, root, TARGETS, STARTED, switches)
    assert {r.name: r.status for r in api.status(LIVE_AS_OF).collect()} == {
        TARGETS[0].qualified_name: "disabled",
        TARGETS[1].qualified_name: "connected",
    }


def test_lists_and_totals(api):
    page, total = api.events(event_type="insert", page=2, size=10)
    everything, _ = api.events(event_type="insert", size=100_000)
    rows = everything.collect()
    assert total.first().total == len(rows) > 20
    assert [r.seq for r in page.collect()] == [r.seq for r in rows[10:20]]
    page, total = api.errors(level="ERROR", keyword="removed")
    assert all("removed" in r.message for r in page.collect()) and total.first().total > 0


def test_default_ranges(api):
    week = api.events_stats(LIVE_AS_OF).first()
    assert week == api.events_stats("2030-01-01", start="2024-01-13", end=LIVE_AS_OF).first()
    breakdown, totals = api.errors_stats(LIVE_AS_OF)
    by_level = {r.key: r.n for r in breakdown.where("dimension = 'level'").collect()}
    assert totals.first().total_errors == by_level["ERROR"]
    hour = api.latency_history(LIVE_AS_OF).collect()
    assert all(at("2024-01-19 23:00:00") <= r.timestamp <= at(LIVE_AS_OF) for r in hour)
    assert api.latency(LIVE_AS_OF, start="2024-01-01").first().p99_delay > 0
    assert api.latency(LIVE_AS_OF, "other", start="2024-01-01").first().max_delay == 0
    assert len(api.position_history(LIVE_AS_OF, start="2024-01-01").collect()) > 0
    assert len(api.metrics_history("qps", LIVE_AS_OF, start="2024-01-01").collect()) > 0
    assert [r.target_name for r in api.position().collect()] == ["main"]


def test_targets_fall_back_to_names_in_events(spark, root, api):
    listed = {r.name: r.total_events for r in api.targets(LIVE_AS_OF).collect()}
    found = {r.name: r.total_events for r in MonitorEndpoints(spark, root, (), STARTED).targets(LIVE_AS_OF).collect()}
    assert listed == found and sum(found.values()) > 0
