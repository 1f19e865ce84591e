"""Summaries by partition equal the whole table, whatever was appended, merged or cleaned, and read only what is new."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from changeflow.functions.ranges import TimeRange
from changeflow.operators import stats
from changeflow.plans.endpoints import MonitorEndpoints
from changeflow.plans.summaries import MonitorSummaries
from changeflow.sinks.monitor_tables import append_monitor, cleanup_table, create_monitor_tables, discard_batch, merge_month
from changeflow.sources.monitor_tables import read_monitor
from checks.views import TARGETS
from tests.conftest import at

POSITION = "seq bigint, timestamp timestamp, target_name string, binlog_file string, binlog_pos bigint, gtid string, delay_seconds bigint"


def positions(spark, *rows):
    return spark.createDataFrame([(seq, t and at(t), target, "f", seq, "", delay) for seq, t, target, delay in rows], POSITION)


@pytest.fixture
def kept(spark, folder):
    create_monitor_tables(spark, f"{folder}/monitor")
    return f"{folder}/monitor", MonitorSummaries(spark, f"{folder}/monitor", f"{folder}/summaries")


def same(spark, root, summaries, rng=TimeRange()):
    rows = read_monitor(spark, root, "sync_positions")
    order = lambda df: sorted(df.collect(), key=repr)
    assert order(stats.current_position(summaries.newest("sync_positions"))) == order(stats.current_position(rows))
    assert order(summaries.delays().drop("batch")) == order(stats.delay_histogram(rows))
    assert stats.latency_from_histogram(summaries.delays(rng), rows, rng).first() == stats.latency_stats(rows, rng).first()


def test_late_rows_merging_cleaning_and_lost_batches(spark, kept):
    root, summaries = kept
    same(spark, root, summaries)
    append_monitor(positions(spark, (5, "2024-01-05 10:00:00", "a", 5), (6, "2024-02-05 10:30:00", "b", None)), root, "sync_positions")
    summaries.refresh()
    assert summaries.uncovered("sync_positions") == []
    append_monitor(positions(spark, (9, "2024-01-09 00:00:00", "b", 7), (4, None, "a", 3)), root, "sync_positions", "x-1")
    assert {f.split("/")[0][-6:] for f in summaries.uncovered("sync_positions")} >= {"202401"}
    same(spark, root, summaries)
    summaries.refresh()
    same(spark, root, summaries)
    merge_month(spark, root, "sync_positions", "202401")
    same(spark, root, summaries)
    summaries.refresh()
    append_monitor(positions(spark, (1, "2024-01-01 00:00:00", "c", 1)), root, "sync_positions", "x-2")
    summaries.refresh()
    discard_batch(spark, root, "sync_positions", "x-2")
    assert "c" not in {r.target_name for r in summaries.newest("sync_positions").collect()}
    cleanup_table(spark, root, "sync_positions", at("2024-02-01"))
    same(spark, root, summaries)
    assert "2024-01" not in {str(r.timestamp)[:7] for r in summaries.newest("sync_positions").collect()}


def test_covered_files_are_not_read(spark, kept):
    root, summaries = kept
    append_monitor(positions(spark, (1, "2024-01-05 10:00:00", "a", 5)), root, "sync_positions")
    summaries.refresh()
    append_monitor(positions(spark, (2, "2024-02-05 10:00:00", "a", 6)), root, "sync_positions")
    read = summaries.newest("sync_positions").inputFiles()
    assert not [f for f in read if "yyyymm=202401" in f] and [f for f in read if "yyyymm=202402" in f]
    before = summaries._kept["sync_positions"]._parts()
    summaries.refresh()
    after = summaries._kept["sync_positions"]._parts()
    assert after[1]["202401"] == before[1]["202401"]
    summaries.refresh()
    assert summaries._kept["sync_positions"]._parts() == after


@pytest.mark.parametrize(
    ("start", "end"),
    [
        (None, None), ("2024-01-01 00:00:00", "2024-01-01 05:00:00"), ("2024-01-01 00:59:59", "2024-01-01 02:00:00"),
        ("2024-01-01 01:10:00", "2024-01-01 01:50:00"), (None, "2024-01-01 03:30:00"), ("2024-01-01 01:00:00", None),
        ("2024-01-01 01:00:00", "2024-01-01 01:00:00"), ("2023-01-01 00:00:00", "2023-02-01 00:00:00"),
    ],
)
def test_ranges_that_cut_hours(spark, kept, start, end):
    root, summaries = kept
    times = spark.range(40).select(
        "id", (F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 599)).alias("timestamp"), ((F.col("id") * 7) % 11).alias("delay")
    )
    rows = times.selectExpr("id AS seq", "timestamp", "'a' AS target_name", "'f' AS binlog_file", "id AS binlog_pos", "'' AS gtid", "delay AS delay_seconds")
    append_monitor(rows, root, "sync_positions")
    summaries.refresh()
    same(spark, root, summaries, TimeRange.of(start, end))


def test_endpoints_give_the_same_with_summaries(spark, folder):
    from checks.queries import EVENT_COLUMNS
    from checks.views import LIVE_AS_OF, RANGE_END, RANGE_START, STARTED, view

    sf, root = "/root/testdata/sf0.001", f"{folder}/monitor"
    append_monitor(view(spark, sf, "sync_events").select(*EVENT_COLUMNS), root, "sync_events")
    for table in ("sync_errors", "sync_positions"):
        append_monitor(view(spark, sf, table), root, table)
    summaries = MonitorSummaries(spark, root, f"{folder}/summaries")
    summaries.refresh()
    plain, fast = MonitorEndpoints(spark, root, TARGETS, STARTED), MonitorEndpoints(spark, root, TARGETS, STARTED, summaries=summaries)
    for call in (
        lambda api: api.status(LIVE_AS_OF),
        lambda api: api.health(LIVE_AS_OF),
        lambda api: api.position(),
        lambda api: api.targets(LIVE_AS_OF),
        lambda api: api.latency(LIVE_AS_OF, start=RANGE_START, end=RANGE_END),
    ):
        assert sorted(call(fast).collect(), key=repr) == sorted(call(plain).collect(), key=repr)
    named = MonitorEndpoints(spark, root, (), STARTED)
    named_fast = MonitorEndpoints(spark, root, (), STARTED, summaries=summaries)
    assert sorted(named.targets(LIVE_AS_OF).collect()) == sorted(named_fast.targets(LIVE_AS_OF).collect())
