from __future__ import annotations

import math
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from changeflow.functions.ranges import TimeRange
from changeflow.operators import filters, listing, series, stats
from tests.conftest import at

DAY = TimeRange.of("2024-01-01", "2024-01-02")
EVENTS = (
    "seq bigint, timestamp timestamp, event_type string, target_name string, table_name string, "
    "rows_count bigint, duration_ms bigint, success int"
)
ERRORS = "seq bigint, timestamp timestamp, level string, target_name string, table_name string, message string"
POSITIONS = "seq bigint, timestamp timestamp, target_name string, binlog_file string, binlog_pos bigint, gtid string, delay_seconds bigint"


def _event(seq, when, kind="insert", target="T:a", table="t", rows=1, ms=10, success=1):
    return (seq, at(when), kind, target, table, rows, ms, success)


def _positions(spark, delays):
    start = at("2024-01-01")
    rows = [(n, start + timedelta(seconds=n), "main", "f.1", n, "", d) for n, d in enumerate(delays)]
    return spark.createDataFrame(rows, POSITIONS)


def _rank(delays, p):
    return sorted(delays)[max(1, math.floor(len(delays) * p)) - 1]


@pytest.mark.parametrize("seed", range(6))
def test_percentiles_equal_sort_and_offset(spark, seed):
    rng = random.Random(seed)
    top = rng.choice([3, 100, 200_000, 5_000_000_000])
    delays = [rng.randrange(top) for _ in range(rng.choice([1, 2, 19, 100, 101, 700]))]
    got = stats.latency_stats(_positions(spark, delays), DAY).first()
    assert (got.p95_delay, got.p99_delay) == (_rank(delays, 0.95), _rank(delays, 0.99))
    assert (got.max_delay, got.min_delay, got.current_delay) == (max(delays), min(delays), delays[-1])
    assert got.avg_delay == pytest.approx(sum(delays) / len(delays))


def test_empty_ranges_give_zeros(spark):
    never = TimeRange.of("2030-01-01", "2030-01-02")
    latency = stats.latency_stats(_positions(spark, [5]), never).first()
    assert set(latency.asDict().values()) == {0}
    events = spark.createDataFrame([_event(1, "2024-01-01")], EVENTS)
    errors = spark.createDataFrame([], ERRORS)
    assert set(stats.event_stats(events, errors, never).first().asDict().values()) == {0}
    assert stats.error_totals(errors, never).first().asDict() == {"total_errors": 0, "total_warnings": 0}
    assert stats.recent_throughput(events, never).first().qps == 0.0
    assert stats.error_stats(errors, never).collect() == []


def test_event_stats(spark):
    rows = [
        _event(1, "2024-01-01", "INSERT", rows=3, ms=10),
        _event(2, "2024-01-01", "insert", rows=1, ms=21),
        _event(3, "2024-01-02", "Update", rows=2, ms=5),
        _event(4, "2024-01-01", "truncate", rows=7, ms=1),
        _event(5, "2024-01-03", "delete"),
    ]
    errors = spark.createDataFrame([(1, at("2024-01-01"), "WARNING", "T:a", "t", "m"), (2, at("2024-01-05"), "ERROR", "T:a", "t", "m")], ERRORS)
    events = spark.createDataFrame(rows, EVENTS)
    assert stats.event_stats(events, errors, DAY).first().asDict() == {
        "total_insert": 2, "total_update": 1, "total_delete": 0, "total_rows": 13, "total_errors": 1,
        "avg_duration": 9, "max_duration": 21, "min_duration": 1,
    }
    by_type = {r.event_type: (r.event_count, r.total_rows, r.avg_duration) for r in stats.event_stats_by_type(events, DAY).collect()}
    assert by_type == {"INSERT": (2, 4, 15.5), "UPDATE": (1, 2, 5.0), "TRUNCATE": (1, 7, 1.0)}
    share = {r.event_type: r.share for r in stats.event_type_share(events, DAY).collect()}
    assert share == {"INSERT": 0.5, "UPDATE": 0.25, "TRUNCATE": 0.25}


def test_error_stats_count_exact_levels(spark):
    rows = [(n, at("2024-01-01"), level, target, "t", "m") for n, (level, target) in enumerate([("ERROR", "a"), ("error", "a"), ("WARNING", "b")])]
    errors = spark.createDataFrame(rows, ERRORS)
    got = {(r.dimension, r.key): r.n for r in stats.error_stats(errors, DAY).collect()}
    assert got == {("level", "ERROR"): 1, ("level", "error"): 1, ("level", "WARNING"): 1, ("target", "a"): 2, ("target", "b"): 1, ("table", "t"): 3}
    assert stats.error_totals(errors, DAY).first().asDict() == {"total_errors": 1, "total_warnings": 1}


def test_target_stats_use_every_alias(spark):
    names = ["ClickHouse:clickhouse-main", "clickhouse-main", "clickhouse-primary", "ClickHouse:replica", ""]
    events = spark.createDataFrame(
        [_event(n, "2024-01-01", target=t) for n, t in enumerate(names)] + [_event(9, "2024-02-01", target="replica")], EVENTS
    )
    errors = spark.createDataFrame([(1, at("2024-01-01"), "ERROR", "clickhouse-primary", "t", "m")], ERRORS)
    asked = spark.createDataFrame([("ClickHouse:clickhouse-main",), ("ClickHouse:replica",), ("ClickHouse:new",)], "name string")
    got = {r.name: (r.total_events, r.total_errors, r.last_sync_time) for r in stats.target_stats(events, errors, asked, DAY).collect()}
    assert got == {
        "ClickHouse:clickhouse-main": (3, 1, at("2024-01-01")),
        "ClickHouse:replica": (1, 0, at("2024-02-01")),
        "ClickHouse:new": (0, 0, None),
    }
    assert [r.target_name for r in stats.known_targets(events).collect()] == sorted([*names[:4], "replica"])


def test_last_error_and_registered_targets_only(spark):
    rows = [(1, at("2024-01-02"), "ERROR", "T:a", "t", "new"), (2, at("2024-01-01"), "ERROR", "T:a", "t", "old"), (3, at("2024-01-01"), "ERROR", "T:x", "t", "m")]
    registered = spark.createDataFrame([("T:a",), ("T:b",)], "name string")
    got = stats.target_error_totals(spark.createDataFrame(rows, ERRORS), registered).collect()
    assert [tuple(r) for r in got] == [("T:a", 2, "new")]


def test_current_position(spark):
    got = stats.current_position(_positions(spark, [3, 1, 2]), "main").first()
    assert (got.binlog_pos, got.delay_seconds, got.timestamp) == (2, 2, at("2024-01-01 00:00:02"))
    assert stats.current_position(_positions(spark, [3]), "other").collect() == []


def test_partial_rollups_merge_to_the_whole(spark):
    rng = random.Random(5)
    rows = [
        _event(n, f"2024-01-01 {rng.randrange(3):02d}:{rng.randrange(60):02d}:00", rng.choice(["insert", "update"]), ms=rng.randrange(100), success=rng.randrange(2))
        for n in range(80)
    ]
    parts = [spark.createDataFrame(p, EVENTS) for p in (rows[:30], rows[30:])]
    whole = stats.events_hourly(parts[0].union(parts[1]))
    merged = stats.merge_events_hourly(stats.events_hourly(parts[0]).unionByName(stats.events_hourly(parts[1])))
    key = lambda r: tuple(sorted(r.asDict().items()))
    assert sorted(map(key, whole.collect())) == sorted(map(key, merged.collect()))
    assert stats.read_events_hourly(whole).where("abs(avg_duration - sum_duration / event_count) > 1e-9").count() == 0

    latencies = [_positions(spark, d) for d in ([1, 5], [9, 3, 4])]
    merged = stats.merge_latency_hourly(stats.latency_hourly(latencies[0]).unionByName(stats.latency_hourly(latencies[1])))
    row = stats.read_latency_hourly(merged).first()
    assert (row.samples, row.sum_delay, row.max_delay, row.min_delay, row.avg_delay) == (5, 22, 9, 1, 4.4)


def test_series_fills_empty_seconds(spark):
    rows = [_event(1, "2024-01-01 00:00:01"), _event(2, "2024-01-01 00:00:01", "heartbeat"), _event(3, "2024-01-01 00:00:03", "DELETE")]
    got = series.throughput_series(spark.createDataFrame(rows, EVENTS), TimeRange.of("2024-01-01 00:00:00", "2024-01-01 00:00:03"))
    assert [(r.second.second, r.qps, r.tps) for r in got.orderBy("second").collect()] == [(0, 0, 0), (1, 2, 1), (2, 0, 0), (3, 1, 1)]


def test_filters(spark):
    events = spark.createDataFrame(
        [_event(1, "2024-01-01", "insert"), _event(2, "2024-01-01", "INSERT", success=0), _event(3, "2024-01-05", target="T:b", table="u")], EVENTS
    )

    def seqs(df):
        return sorted(r.seq for r in df.collect())

    assert seqs(filters.events_filtered(events)) == [1, 2, 3]
    assert seqs(filters.events_filtered(events, event_type="Insert", rng=DAY)) == [1, 2]
    assert seqs(filters.events_filtered(events, success=False)) == [2]
    assert seqs(filters.events_filtered(events, target="T:b", table="u")) == [3]
    errors = spark.createDataFrame(
        [(1, at("2024-01-01"), "ERROR", "a", "t", "disk full"), (2, at("2024-01-01"), "error", "a", "u", "50% full")], ERRORS
    )
    assert seqs(filters.errors_filtered(errors, level="ERROR")) == [1]
    assert seqs(filters.errors_filtered(errors, keyword="full")) == [1, 2]
    assert seqs(filters.errors_filtered(errors, keyword="0%")) == [2]
    assert seqs(filters.errors_filtered(errors, table="u", target="a")) == [2]


@pytest.fixture
def many(spark):
    rng = random.Random(9)
    rows = [(n, at("2024-01-01") + timedelta(seconds=rng.randrange(40) * 977)) for n in range(3_000)]
    order = sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)
    return spark.createDataFrame(rows, "seq bigint, timestamp timestamp").repartition(6), [r[0] for r in order]


@pytest.mark.parametrize(("number", "size"), [(1, 20), (3, 20), (0, 0), (-1, 7), (40, 50), (3, 1000), (2, 2_999), (61, 50), (9, 400)])
def test_pages(many, number, size):
    df, order = many
    n, s = max(number, 1), size if size > 0 else 20
    assert [r.seq for r in listing.page(df, number, size).collect()] == order[(n - 1) * s : n * s]


def test_rows_without_a_time_come_last_at_any_size(spark):
    rows = [(n, at("2024-01-01") + timedelta(seconds=n) if n % 2 else None) for n in range(3_000)]
    df = spark.createDataFrame(rows, "seq bigint, timestamp timestamp").repartition(5)
    order = [n for n in range(2_999, -1, -1) if n % 2] + [n for n in range(2_999, -1, -1) if n % 2 == 0]
    for n in (900, 1_000, 2_000, 3_000):
        assert [r.seq for r in listing.last_n(df, n).collect()] == order[:n][::-1]
    assert [r.seq for r in listing.page(df, 2, 1_400).collect()] == order[1_400:2_800]
    nothing = df.withColumn("timestamp", F.lit(None).cast("timestamp"))
    assert [r.seq for r in listing.last_n(nothing, 1_500).collect()] == list(range(1_500, 3_000))


def test_a_page_starts_no_job(spark, many, monkeypatch):
    for action in ("first", "collect", "count", "take"):
        monkeypatch.setattr(type(many[0]), action, lambda *a, **k: pytest.fail("an action while the page is built"))
    listing.page(many[0], 40, 50)
    listing.last_n(many[0], 2_000)


def test_pages_by_key_join_to_the_whole_list(many):
    df, order = many
    rows = listing.all_pages(df, 700).collect()
    assert [r.seq for r in rows] == order and [r.page for r in rows] == [1 + k // 700 for k in range(len(order))]
    assert listing.all_pages(df.limit(0), 10).count() == 0 and listing.page_end(df.limit(0)) is None


@pytest.mark.parametrize("size", [1, 4, 7])
def test_pages_lose_no_row_that_shares_its_key(spark, size):
    """Two targets with the same times and numbers, missing numbers and times, and rows that are equal."""
    day = at("2024-01-01")
    rows = [(n // 2, day + timedelta(seconds=n // 12), f"T:{n % 2}", "m") for n in range(24)]
    rows += [(None, day, "T:a", f"m{n}") for n in range(6)] + [(None, day, None, None)] * 5 + [(None, None, "T:a", "x")] * 9 + [(7, None, None, "y")]
    df = spark.createDataFrame(rows, "seq bigint, timestamp timestamp, target_name string, message string").repartition(4)
    got = [tuple(r)[:4] for r in listing.all_pages(df, size).collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)
    assert got == [tuple(r) for r in listing.page(df, 1, 100).collect()]


@pytest.fixture
def odd_list(spark):
    """Rows that share times and numbers, equal rows, nulls, and columns of several types."""
    made = random.Random(3)
    rows = []
    for n in range(1_200):
        when = at("2024-01-01") + timedelta(hours=made.randrange(3), microseconds=made.randrange(2)) if n % 9 else None
        seq = made.randrange(4) if n % 5 else None
        rows.append((seq, when, made.choice([float("nan"), -1.5, 2.0, None]), bytes([n % 3]), (n % 2, when), [n % 4, None], when))
    rows += [(7, at("2024-01-01"), 1.0, b"x", None, [], None)] * 150 + [(None,) * 7] * 200
    schema = "seq bigint, timestamp timestamp, value double, raw binary, part struct<a: int, b: timestamp>, list array<int>, local timestamp_ntz"
    return spark.createDataFrame(rows, schema).repartition(5)


def _few_kept(monkeypatch, n):
    monkeypatch.setattr(listing, "KEPT", n, raising=False)
    monkeypatch.setattr(listing, "DRAWN", n, raising=False)


@pytest.mark.parametrize(("number", "size"), [(1, 300), (2, 500), (7, 100), (1, 1_550), (3, 700), (1, 9_000), (2, 9_000)])
def test_large_pages_hold_the_same_rows(spark, monkeypatch, odd_list, number, size):
    order = [repr(r) for r in listing.newest(odd_list, 0, 2_000).collect()]
    _few_kept(monkeypatch, 60)
    rows = listing.page(odd_list, number, size)
    assert "TakeOrdered" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [repr(r) for r in rows.collect()] == order[(number - 1) * size : number * size]


@pytest.mark.parametrize("size", [400, 5_000])
def test_large_pages_stay_off_the_driver(monkeypatch, odd_list, size):
    order = [repr(tuple(r)) for r in listing.newest(odd_list, 0, 2_000).collect()]
    _few_kept(monkeypatch, 60)
    brought, collect = [], type(odd_list).collect
    monkeypatch.setattr(type(odd_list), "collect", lambda df: brought.append(collect(df)) or brought[-1])
    pages = listing.all_pages(odd_list, size)
    assert max(map(len, brought)) <= 60
    rows = collect(pages)
    assert [repr(tuple(r)[:-1]) for r in rows] == order
    assert [r.page for r in rows] == [1 + k // size for k in range(len(order))]


def test_later_pages_reach_the_scan(spark, many, tmp_path):
    many[0].write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = listing.page_after(df, listing.page_end(listing.page(df, 1, 20)), 20)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(timestamp" in plan and "TakeOrderedAndProject" in plan


def test_copies_without_a_number_are_told_by_content(spark):
    rows = [(1, "T:a", "x")] * 3 + [(1, "T:b", "x")] + [(None, "T:a", f"m{n}") for n in range(5)] * 2 + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "seq bigint, target_name string, message string").repartition(3)
    assert sorted(map(tuple, series.deduplicated_events(df).collect()), key=repr) == sorted(set(rows), key=repr)


def test_last_n_is_oldest_first(many):
    df, order = many
    for n in (10, 2_000, 10_000):
        assert [r.seq for r in listing.last_n(df, n).collect()] == order[:n][::-1]
    assert listing.last_n(df.where("seq < 0"), 5_000).collect() == []
    assert listing.total(df).first().total == 3_000
