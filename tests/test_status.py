from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from changeflow.operators.stats import order_number
from changeflow.plans import status
from tests.conftest import at

LIVE = "status string, binlog_file string, binlog_pos bigint, delay_seconds bigint, uptime bigint"
TARGET = "name string, type string, status string, is_enabled boolean"


def _live(spark, state="running", delay=0):
    return spark.createDataFrame([(state, "f.1", 4, delay, 10)], LIVE)


def _targets(spark, *states):
    return spark.createDataFrame([(f"T:{n}", "clickhouse", s, True) for n, s in enumerate(states)], TARGET)


@pytest.mark.parametrize(
    ("state", "delay", "targets", "overall", "checks"),
    [
        ("running", 60, ["connected"], "healthy", ["ok", "ok", "ok"]),
        ("running", 61, ["connected"], "degraded", ["ok", "warning", "ok"]),
        ("running", 300, ["connected"], "degraded", ["ok", "warning", "ok"]),
        ("running", 301, ["connected"], "unhealthy", ["ok", "error", "ok"]),
        ("starting", 0, ["connected"], "unhealthy", ["error", "ok", "ok"]),
        ("running", 0, ["connected", "error"], "unhealthy", ["ok", "ok", "error"]),
        ("running", 61, ["disconnected"], "unhealthy", ["ok", "warning", "error"]),
        ("running", 0, ["disabled"], "healthy", ["ok", "ok", "ok"]),
        ("running", 0, [], "healthy", ["ok", "ok", "ok"]),
    ],
)
def test_health(spark, state, delay, targets, overall, checks):
    rows = status.health(_live(spark, state, delay), _targets(spark, *targets)).collect()
    assert {r.overall for r in rows} == {overall}
    assert [(r.check_name, r.check_status) for r in rows] == list(zip(["service", "latency", "targets"], checks))
    assert rows[0].message == state


def test_status_without_sequence_numbers_goes_by_time(spark):
    schema = "seq bigint, timestamp timestamp, binlog_file string, binlog_pos bigint, delay_seconds bigint"
    rows = [(None, at("2024-01-01 00:00:05"), "f.2", 9, 900), (7, at("2024-01-01 00:00:01"), "f.1", 4, 0), (None, at("2024-01-01 00:00:02"), "f.1", 5, 1)]
    live = status.live_status(spark.createDataFrame(rows, schema), "2024-01-01", "2024-01-01 00:01:00")
    assert (live.first().binlog_file, live.first().delay_seconds) == ("f.2", 900)
    assert {r.overall for r in status.health(live, _targets(spark, "connected")).collect()} == {"unhealthy"}
    changes = spark.createDataFrame(
        [(None, at("2024-01-01 00:00:05"), "T:0", "error"), (9, at("2024-01-01 00:00:01"), "T:0", "connected")],
        "seq bigint, timestamp timestamp, target_name string, status string",
    )
    row = status.target_status(_targets(spark, "connected").drop("status"), changes).first()
    assert (row.status, row.last_sync_time) == ("error", at("2024-01-01 00:00:05"))


def test_live_status_without_positions(spark):
    empty = spark.createDataFrame([], "seq bigint, timestamp timestamp, binlog_file string, binlog_pos bigint, delay_seconds bigint")
    row = status.live_status(empty, "2024-01-01", "2024-01-01 00:01:30.9").first()
    assert tuple(row) == ("running", "", 0, 0, 90)


def test_status_falls_back_to_the_recent_rate_only_when_idle(spark):
    events = spark.createDataFrame([(at("2024-01-01"), "insert")] * 3, "timestamp timestamp, event_type string")
    for qps, tps, shown in ((0.0, 0.0, 0.01), (0.0, 2.0, 0.0), (5.0, 2.0, 5.0)):
        live = _live(spark).withColumns({"qps": F.lit(qps), "tps": F.lit(tps)})
        rows = status.service_status(live, events, _targets(spark, "connected", "error"), "2024-01-01 00:04:00").collect()
        assert [r.qps for r in rows] == [shown, shown]
        assert {r.service_status for r in rows} == {"running"}


def test_target_status_takes_the_last_change(spark):
    registered = spark.createDataFrame([("a", "clickhouse", True), ("b", "clickhouse", True)], "name string, type string, is_enabled boolean")
    rows = [(1, at("2024-01-01"), "a", "connected"), (3, at("2024-01-03"), "a", "connected"), (2, at("2024-01-02"), "a", "disabled"), (4, at("2024-01-03"), "z", "error")]
    changes = spark.createDataFrame(rows, "seq bigint, timestamp timestamp, target_name string, status string")
    got = {r.name: (r.status, r.last_sync_time) for r in status.target_status(registered, changes).collect()}
    assert got == {"a": ("connected", at("2024-01-03")), "b": ("connected", None)}


def test_live_rates_are_those_of_the_last_full_second(spark):
    rates = spark.createDataFrame([(at("2024-01-01 00:00:09"), 7, 5), (at("2024-01-01 00:00:10"), 1, 0)], "second timestamp, qps bigint, tps bigint")
    live = spark.createDataFrame([("running",)], "status string")
    got = [tuple(status.with_live_rates(live, rates, f"2024-01-01 00:00:{s}").select("qps", "tps").first()) for s in (10, 11, 12)]
    assert got == [(7.0, 5.0), (1.0, 0.0), (0.0, 0.0)]


def test_places_in_time_compare_like_time_and_number(spark):
    rows = [(None, None), (5, None), (None, at("2024-01-01")), (0, at("2024-01-01")), (2**62, at("2024-01-01")), (0, at("2024-01-01 00:00:01"))]
    df = spark.createDataFrame(rows, "seq bigint, timestamp timestamp").withColumn("place", order_number())
    places = [r.place for r in df.collect()]
    assert places == sorted(places) and len(set(places)) == len(places)
