from __future__ import annotations

from contextlib import contextmanager
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import types as T

from changeflow.functions.ranges import timestamp
from changeflow.schemas import CHANGE_LOG
from changeflow.sinks.registry import current_tables, table_sink
from changeflow.sources.change_log import read_changes
from changeflow.sources.monitor_tables import read_monitor
from changeflow.streaming.apply import ApplyJob, start_apply
from changeflow.streaming.rates import (
    deduplicated_stream,
    late_rows,
    merge_days,
    position_stream,
    read_latest,
    read_updates,
    start_push,
    start_updates,
    throughput_stream,
    write_updates,
)
from changeflow.targets import TargetConfig
from tests.conftest import at

IMAGE = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])
SCHEMAS = {"t": IMAGE, "u": IMAGE}
TARGETS = (TargetConfig("main", ("t", "u")), TargetConfig("copy", ("t",)))
NOW = at("2024-01-01 01:00:00")


@contextmanager
def open_file(parent, name):
    Path(parent).mkdir(parents=True, exist_ok=True)
    Path(parent, name).write_text("in the way")
    yield
    Path(parent, name).unlink()


def _row(seq, table, action, key, value, pos=None):
    image = None if value == "bad" else f'{{"id": {key}, "v": "{value}"}}'
    text = "{bad" if value == "bad" else image
    return (seq, "f.000001", pos or seq * 10, 0, at("2024-01-01"), "row", "s", table, action, None, text, None)


def _control(seq, kind, ddl=None):
    return (seq, "f.000001", seq * 10, 0, at("2024-01-01"), kind, None, None, None, None, None, ddl)


BATCHES = [
    [_control(1, "rotate"), _row(2, "t", "insert", 1, "a"), _row(3, "u", "insert", 1, "x"), _control(4, "xid")],
    [_row(5, "t", "update", 1, "A"), _row(6, "t", "insert", 2, "b"), _row(7, "other", "insert", 1, "z"), _control(8, "xid")],
    [_row(9, "t", "delete", 2, "b"), _row(10, "u", "insert", 9, "bad"), _row(11, "t", "insert", 3, "c")],
]


def _write(spark, folder, n):
    spark.createDataFrame(BATCHES[n], CHANGE_LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")


def _job(folder, **kwargs):
    return ApplyJob(TARGETS, SCHEMAS, f"{folder}/tables", f"{folder}/monitor", recorded_at=timestamp(NOW), **kwargs)


def _run(spark, folder, job):
    changes = read_changes(spark, f"{folder}/log", streaming=True, max_files_per_trigger=1)
    start_apply(changes, job, f"{folder}/checkpoint", available_now=True).awaitTermination()


def _state(spark, job, target):
    tables = current_tables(spark, target, SCHEMAS, job.root)
    return {name: sorted((r.id, r.v) for r in table.current().collect()) for name, table in tables.items()}


def test_apply_resumes_from_its_checkpoint(spark, folder):
    for n in range(2):
        _write(spark, folder, n)
        _run(spark, folder, _job(folder))
    _write(spark, folder, 2)
    job = _job(folder)
    _run(spark, folder, job)
    assert _state(spark, job, TARGETS[0]) == {"t": [(1, "A"), (3, "c")], "u": [(1, "x")]}
    assert _state(spark, job, TARGETS[1]) == {"t": [(1, "A"), (3, "c")]}

    quarantined = spark.read.parquet(f"{job.root}/main/u/quarantine")
    assert [r.seq for r in quarantined.collect()] == [10]

    events = read_monitor(spark, job.monitor_root, "sync_events").where("target_name = 'ClickHouse:copy'").orderBy("seq")
    assert [(r.seq, r.binlog_file, r.binlog_pos, r.rows_count, r.success) for r in events.collect()] == [
        (2, "f.000001", 10, 1, 1), (5, "f.000001", 40, 2, 1), (6, "f.000001", 40, 1, 1), (9, "f.000001", 80, 1, 1), (11, "f.000001", 80, 1, 1),
    ]
    errors = read_monitor(spark, job.monitor_root, "sync_errors").collect()
    assert [(e.target_name, e.table_name) for e in errors] == [("ClickHouse:main", "u")]
    positions = read_monitor(spark, job.monitor_root, "sync_positions").orderBy("seq").collect()
    assert [(p.seq, p.delay_seconds) for p in positions] == [(1, 3600), (4, 3600), (8, 3600)]


def test_a_failing_target_stops_no_other_and_catches_up(spark, folder):
    good = table_sink(TARGETS[1], SCHEMAS, f"{folder}/tables")
    refused = []

    def flaky(changes, batch_id):
        if batch_id == 1 and not refused:
            refused.append(batch_id)
            raise ConnectionError("copy is down\nwith details")
        good(changes, batch_id)

    sinks = {TARGETS[0].qualified_name: table_sink(TARGETS[0], SCHEMAS, f"{folder}/tables"), TARGETS[1].qualified_name: flaky}
    job = _job(folder, sinks=sinks)
    for n in range(2):
        _write(spark, folder, n)
        _run(spark, folder, job)
    assert _state(spark, job, TARGETS[0])["t"] == [(1, "A"), (2, "b")]
    assert _state(spark, job, TARGETS[1])["t"] == [(1, "a")]
    errors = read_monitor(spark, job.monitor_root, "sync_errors").collect()
    assert [(e.level, e.target_name, e.table_name, e.message) for e in errors] == [("ERROR", "ClickHouse:copy", "t", "copy is down\nwith details")]
    outcome = read_monitor(spark, job.monitor_root, "sync_events").where("seq = 5").collect()
    assert sorted((o.target_name, o.success, o.error_msg) for o in outcome) == [("ClickHouse:copy", 0, "copy is down\nwith details"), ("ClickHouse:main", 1, "")]

    _write(spark, folder, 2)
    _run(spark, folder, job)
    assert _state(spark, job, TARGETS[1])["t"] == [(1, "A"), (3, "c")]
    assert job.pending(spark, TARGETS[1]) == []


def test_a_batch_that_keeps_failing_does_not_block_later_ones(spark, folder):
    good = table_sink(TARGETS[1], SCHEMAS, f"{folder}/tables")

    def poisoned(changes, batch_id):
        if batch_id == 0:
            raise ValueError("never")
        good(changes, batch_id)

    job = ApplyJob(TARGETS[1:], SCHEMAS, f"{folder}/tables", sinks={TARGETS[1].qualified_name: poisoned})
    for n, rows in enumerate(BATCHES):
        job(spark.createDataFrame(rows, CHANGE_LOG), n)
    assert _state(spark, job, TARGETS[1])["t"] == [(1, "A"), (3, "c")]
    assert job.pending(spark, TARGETS[1]) == [0]


def test_a_batch_that_failed_once_is_retried_past_one_that_always_fails(spark, folder):
    good = table_sink(TARGETS[1], SCHEMAS, f"{folder}/tables")
    tried = []

    def poisoned(changes, batch_id):
        tried.append(batch_id)
        if batch_id == 0 or (batch_id == 1 and tried.count(1) == 1):
            raise ValueError("not now")
        good(changes, batch_id)

    job = ApplyJob(TARGETS[1:], SCHEMAS, f"{folder}/tables", sinks={TARGETS[1].qualified_name: poisoned})
    for n, rows in enumerate(BATCHES):
        job(spark.createDataFrame(rows, CHANGE_LOG), n)
    assert job.pending(spark, TARGETS[1]) == [0]
    assert _state(spark, job, TARGETS[1])["t"] == [(1, "A"), (3, "c")]


def test_a_failing_table_stops_no_other_table(spark, folder):
    job = _job(folder)
    blocked = f"{folder}/tables/main/u"
    with open_file(f"{folder}/tables/main", "u"):  # a file where the table's folder should be
        job(spark.createDataFrame(BATCHES[0], CHANGE_LOG), 0)
    outcome = read_monitor(spark, job.monitor_root, "sync_events").where("target_name = 'ClickHouse:main'").collect()
    assert sorted((o.table_name, o.success) for o in outcome) == [("t", 1), ("u", 0)]
    errors = read_monitor(spark, job.monitor_root, "sync_errors").collect()
    assert [(e.target_name, e.table_name) for e in errors] == [("ClickHouse:main", "u")] and blocked.split("/")[-1] == "u"
    assert job.pending(spark, TARGETS[0]) == [0]
    job(spark.createDataFrame(BATCHES[1], CHANGE_LOG), 1)
    assert job.pending(spark, TARGETS[0]) == []
    assert _state(spark, job, TARGETS[0]) == {"t": [(1, "A"), (2, "b")], "u": [(1, "x")]}


def test_rows_set_aside_leave_an_error_record(spark, folder):
    job = _job(folder)
    for n, rows in enumerate(BATCHES):
        job(spark.createDataFrame(rows, CHANGE_LOG), n)
    errors = read_monitor(spark, job.monitor_root, "sync_errors").collect()
    assert [(e.target_name, e.table_name, e.message.split(" ")[0]) for e in errors] == [("ClickHouse:main", "u", "1")]


def test_unreadable_rows_are_kept_and_recorded(spark, folder):
    rows = spark.createDataFrame(BATCHES[0], CHANGE_LOG).toJSON().collect()
    Path(f"{folder}/log").mkdir()
    Path(f"{folder}/log/0.json").write_text("\n".join([*rows, rows[1][: len(rows[1]) // 2]]) + "\n")
    job = _job(folder)
    changes = read_changes(spark, f"{folder}/log", streaming=True, fmt="json")
    start_apply(changes, job, f"{folder}/checkpoint", available_now=True).awaitTermination()
    assert _state(spark, job, TARGETS[0]) == {"t": [(1, "a")], "u": [(1, "x")]}
    kept = [r[0] for r in spark.read.parquet(f"{job.root}/_unreadable").select("_corrupt_record").collect()]
    assert kept == [rows[1][: len(rows[1]) // 2]]
    errors = read_monitor(spark, job.monitor_root, "sync_errors").collect()
    assert [(e.message, e.raw_data) for e in errors] == [("unreadable change", kept[0])]


def test_files_that_take_turns_keep_their_positions(spark, folder):
    def in_file(row, name, pos):
        return (row[0], name, pos, *row[3:])

    job = _job(folder)
    first = [in_file(_control(1, "rotate"), "f.000001", 11), in_file(_control(2, "rotate"), "f.000002", 22)]
    second = [in_file(_row(3, "t", "insert", 1, "a"), "f.000001", 30), in_file(_row(4, "t", "insert", 2, "b"), "f.000002", 40)]
    for n, rows in enumerate([first, second]):
        job(spark.createDataFrame(rows, CHANGE_LOG), n)
    got = read_monitor(spark, job.monitor_root, "sync_events").where("target_name = 'ClickHouse:main'").collect()
    assert sorted((r.seq, r.binlog_file, r.binlog_pos) for r in got) == [(3, "f.000001", 11), (4, "f.000002", 22)]


def test_a_repeated_batch_changes_nothing(spark, folder):
    job = _job(folder)
    for _ in range(2):
        for n, rows in enumerate(BATCHES):
            job(spark.createDataFrame(rows, CHANGE_LOG), n)
    assert _state(spark, job, TARGETS[0]) == {"t": [(1, "A"), (3, "c")], "u": [(1, "x")]}
    assert read_monitor(spark, job.monitor_root, "sync_events").count() == 12
    assert read_monitor(spark, job.monitor_root, "sync_positions").count() == 3


def test_a_log_without_seq_is_monitored_by_position(spark, folder):
    job = _job(folder)
    for n, rows in enumerate(BATCHES):
        job(spark.createDataFrame([(None, *r[1:]) for r in rows], CHANGE_LOG), n)
    events = read_monitor(spark, job.monitor_root, "sync_events").where("target_name = 'ClickHouse:copy'")
    assert [r.binlog_pos for r in events.orderBy("seq").collect()] == [10, 40, 40, 80, 80]


def test_monitoring_can_be_switched_off(spark, folder):
    job = _job(folder, monitor_enabled=False)
    job(spark.createDataFrame(BATCHES[0], CHANGE_LOG), 0)
    assert _state(spark, job, TARGETS[1]) == {"t": [(1, "a")]}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_monitor(spark, f"{folder}/monitor", "sync_events").collect()


def test_disabled_targets_receive_nothing(spark, folder):
    targets = (TARGETS[0], TargetConfig("copy", ("t",), enabled=False))
    job = ApplyJob(targets, SCHEMAS, f"{folder}/tables")
    job(spark.createDataFrame(BATCHES[0], CHANGE_LOG), 0)
    assert _state(spark, job, targets[1]) == {"t": []}


EVENTS = "seq bigint, timestamp timestamp_ntz, event_type string, target_name string"


def _stream(spark, folder, *batches):
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/events")
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")


def _event(seq, minute, kind="insert", target="a"):
    return (seq, at(f"2024-01-01 00:{minute:02d}:00"), kind, target)


def test_closed_seconds_are_appended_once(spark, folder):
    batches = [_event(1, 0), _event(2, 0, "heartbeat")], [_event(3, 30)], [_event(6, 31)], [_event(4, 0), _event(5, 59)]
    events = _stream(spark, folder, *batches)
    query = start_push(throughput_stream(events), f"{folder}/out", f"{folder}/cp", mode="append", available_now=True)
    query.awaitTermination()
    got = spark.read.parquet(f"{folder}/out").orderBy("second").collect()
    # event 4 came too late, minute 59 is still open
    assert [(r.second.minute, r.qps, r.tps) for r in got] == [(0, 2, 1), (30, 1, 1), (31, 1, 1)]
    assert late_rows(query.recentProgress) == 1


def test_complete_results_replace_each_other(spark, folder):
    events = _stream(spark, folder, [_event(1, 0)], [_event(2, 30)], [_event(3, 0)])
    query = start_push(throughput_stream(events, lateness=None), f"{folder}/out", f"{folder}/cp", available_now=True)
    query.awaitTermination()
    assert sorted((r.second.minute, r.qps) for r in read_latest(spark, f"{folder}/out").collect()) == [(0, 2), (30, 1)]
    with pytest.raises(FileNotFoundError):
        read_latest(spark, f"{folder}/nothing")


def test_newest_position_as_a_stream(spark, folder):
    schema = "seq bigint, timestamp timestamp, target_name string, binlog_file string, binlog_pos bigint, gtid string, delay_seconds bigint"
    for n in range(3):
        rows = [(n, at(f"2024-01-01 00:0{n}:00"), "main", "f.1", n * 100, "", n)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{folder}/pos")
    positions = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/pos")
    start_push(position_stream(positions), f"{folder}/out", f"{folder}/cp", available_now=True).awaitTermination()
    assert [(r.target_name, r.binlog_pos, r.delay_seconds) for r in read_latest(spark, f"{folder}/out").collect()] == [("main", 200, 2)]


@pytest.mark.parametrize("salts", [1, 3])
def test_copies_within_the_watermark_are_dropped(spark, folder, salts):
    events = _stream(spark, folder, [_event(1, 0), _event(1, 0), _event(1, 0, target="b")], [_event(1, 0), _event(2, 5)])
    once = deduplicated_stream(events, salts=salts)
    start_push(once, f"{folder}/out", f"{folder}/cp", mode="append", available_now=True).awaitTermination()
    got = spark.read.parquet(f"{folder}/out").select("seq", "target_name").collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (1, "b"), (2, "a")]


def _refusing(spark, folder, target, refused):
    """A sink for a target that refuses some batches for as long as they are in ``refused``."""
    good = table_sink(target, SCHEMAS, f"{folder}/tables")

    def write(changes, batch_id):
        if batch_id in refused:
            raise ConnectionError(f"down {refused[batch_id]}")
        return good(changes, batch_id)

    return write


def _outcomes(spark, job, target):
    rows = read_monitor(spark, job.monitor_root, "sync_events").where(f"target_name = '{target.qualified_name}'").collect()
    return sorted((r.seq, r.table_name, r.success, r.error_msg) for r in rows)


def _messages(spark, job):
    return sorted(r.message for r in read_monitor(spark, job.monitor_root, "sync_errors").collect() if r.raw_data == "")


def test_a_late_success_puts_the_records_right(spark, folder):
    for n in range(3):
        _write(spark, folder, n)
    refused = {0: "at first", 2: "at first"}
    sinks = {t.qualified_name: table_sink(t, SCHEMAS, f"{folder}/tables") for t in TARGETS}
    job = _job(folder, sinks={**sinks, TARGETS[0].qualified_name: _refusing(spark, folder, TARGETS[0], refused)})
    _run(spark, folder, job)
    want = [(2, "t", 0, "down at first"), (3, "u", 0, "down at first"), (5, "t", 1, ""), (6, "t", 1, ""), (9, "t", 0, "down at first")]
    want += [(10, "u", 0, "down at first"), (11, "t", 0, "down at first")]
    assert _outcomes(spark, job, TARGETS[0]) == want
    first = _messages(spark, job)
    assert first.count("down at first") == 4 + 2  # two tables in each batch, and batch 0 again with each later batch
    refused[0] = "again"
    del refused[2]
    job.retry(spark, TARGETS[0])
    assert job.pending(spark, TARGETS[0]) == [0]
    assert _outcomes(spark, job, TARGETS[0]) == [w if w[0] < 9 else (*w[:2], 1, "") for w in want]
    messages = _messages(spark, job)
    assert messages.count("down again") == 2 and messages.count("down at first") == 4  # the last try replaces the one before
    assert messages.count("1 rows do not fit the table and are in its quarantine") == 1
    refused.clear()
    job.retry(spark, TARGETS[0])
    job.retry(spark, TARGETS[0])
    assert job.pending(spark, TARGETS[0]) == [] and {o[2] for o in _outcomes(spark, job, TARGETS[0])} == {1}
    assert len(_outcomes(spark, job, TARGETS[0])) == len(want) and len(_outcomes(spark, job, TARGETS[1])) == 5


def test_a_stop_before_the_records_are_right_leads_to_another_try(spark, folder, monkeypatch):
    _write(spark, folder, 0)
    refused = {0: "once"}
    sinks = {t.qualified_name: table_sink(t, SCHEMAS, f"{folder}/tables") for t in TARGETS}
    job = _job(folder, sinks={**sinks, TARGETS[0].qualified_name: _refusing(spark, folder, TARGETS[0], refused)})
    _run(spark, folder, job)
    refused.clear()
    monkeypatch.setattr("changeflow.rewritable.RewritableTable.discard", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        job.retry(spark, TARGETS[0])
    monkeypatch.undo()
    job.retry(spark, TARGETS[0])
    assert [o[2] for o in _outcomes(spark, job, TARGETS[0])] == [1, 1]


def test_a_repeated_batch_skips_what_a_target_has_taken(spark, folder):
    """The stream stops after its targets were written; the next start repeats the batch."""
    _write(spark, folder, 0)
    calls, broken = [], [True]
    sinks = {t.qualified_name: table_sink(t, SCHEMAS, f"{folder}/tables") for t in TARGETS}

    def counted(changes, batch_id):
        calls.append(batch_id)
        return sinks[TARGETS[0].qualified_name](changes, batch_id)

    class Stopping(ApplyJob):
        def _write_events(self, *args):
            if broken:
                raise OSError("stopped")
            super()._write_events(*args)

    parts = dict(recorded_at=timestamp(NOW), sinks={**sinks, TARGETS[0].qualified_name: counted})
    job = Stopping(TARGETS, SCHEMAS, f"{folder}/tables", f"{folder}/monitor", **parts)
    with pytest.raises(Exception, match="stopped"):
        _run(spark, folder, job)
    broken.clear()
    _run(spark, folder, job)
    assert calls == [0]
    assert [o[:3] for o in _outcomes(spark, job, TARGETS[0])] == [(2, "t", 1), (3, "u", 1)]
    changes = read_changes(spark, f"{folder}/log", streaming=True, max_files_per_trigger=1)
    start_apply(changes, job, f"{folder}/other", available_now=True).awaitTermination()
    assert calls == [0, 0]  # another stream


RATE_EVENT = "seq bigint, timestamp timestamp, event_type string, target_name string"


def _rates(spark, folder, rows, lateness="10 seconds"):
    spark.createDataFrame(rows, RATE_EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    events = spark.readStream.schema(RATE_EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    rates = throughput_stream(events, lateness)
    query = start_updates(rates, f"{folder}/out", f"{folder}/checkpoint", "second", available_now=True)
    query.awaitTermination()
    return query, rates.schema


def _second_event(k, second):
    return (k, at("2024-01-01 23:58:00") + timedelta(seconds=second), "insert", "T:a")


def test_updates_keep_bounded_state_and_every_second(spark, folder):
    totals, states = {}, []
    for batch in range(6):
        rows = [_second_event(batch * 100 + k, batch * 40 + k % 50) for k in range(100)]  # the last ten seconds come again
        for r in rows:
            totals[r[1]] = totals.get(r[1], 0) + 1
        query, schema = _rates(spark, folder, rows)
        states.append(query.recentProgress[-1].stateOperators[0].numRowsTotal)
    assert max(states[1:]) <= 60 < len(totals)
    got = {r.second: r.qps for r in read_updates(spark, f"{folder}/out", schema, ["second"]).collect()}
    assert got == totals
    merge_days(spark, f"{folder}/out", schema, ["second"], "2024-01-02")
    _rates(spark, folder, [_second_event(9_000, 239)])  # a second of the last batch once more
    totals[at("2024-01-01 23:58:00") + timedelta(seconds=239)] += 1
    rows = read_updates(spark, f"{folder}/out", schema, ["second"])
    assert {r.second: r.qps for r in rows.collect()} == totals
    plan = rows.where("day = date'2024-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_a_repeated_update_replaces_itself(spark, folder):
    schema = "second timestamp, qps bigint"
    write = write_updates(f"{folder}/out", "second")
    write(spark.createDataFrame([(at("2024-01-01"), 1), (at("2024-01-02"), 1)], schema), 0)
    write(spark.createDataFrame([(at("2024-01-01"), 5)], schema), 1)
    write(spark.createDataFrame([(at("2024-01-01"), 7)], schema), 1)
    rows = read_updates(spark, f"{folder}/out", spark.createDataFrame([], schema).schema, ["second"]).collect()
    assert sorted((r.second, r.qps) for r in rows) == [(at("2024-01-01"), 7), (at("2024-01-02"), 1)]
    assert spark.read.parquet(f"{folder}/out").count() == 3
