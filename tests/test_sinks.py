from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow import storage
from changeflow.schemas import MONITOR_TABLES
from changeflow.sinks import monitor_tables as mt
from changeflow.sinks import registry
from changeflow.sinks.current_table import CurrentTable, compact_tables
from changeflow.sources.monitor_tables import read_monitor
from changeflow.functions.ranges import TimeRange
from changeflow.targets import TargetConfig
from tests.conftest import at

COLUMNS = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])
ROW = "id bigint, v string, _version bigint, _deleted boolean"


def _table(spark, folder):
    return CurrentTable(spark, f"{folder}/t", COLUMNS)


def _append(table, batch, *rows):
    table.append(table.spark.createDataFrame(list(rows), ROW), batch)


def _state(table):
    return sorted((r.id, r.v) for r in table.current().collect())


def test_a_repeated_batch_replaces_itself(spark, folder):
    table = _table(spark, folder)
    assert _state(table) == []
    _append(table, 0, (1, "a", 1, False), (2, "b", 2, False))
    _append(table, 1, (1, "A", 3, False))
    _append(table, 1, (1, "A", 3, False))
    assert table.log().count() == 3
    assert _state(table) == [(1, "A"), (2, "b")]


def _bucketed(spark, folder, n=8):
    return CurrentTable(spark, f"{folder}/t", COLUMNS, buckets=n)


def _bucket_of(spark, key, n=8):
    return spark.range(key, key + 1).select(F.pmod(F.hash("id"), F.lit(n))).first()[0]


def test_untouched_buckets_are_neither_shuffled_nor_rewritten(spark, folder):
    table = _bucketed(spark, folder)
    _append(table, 0, *[(i, "a", i, False) for i in range(100)])
    table.compact()
    before = table.manifest().held
    assert set(before) == set(range(8))
    _append(table, 1, (7, "A", 200, False), (1_007, "new", 201, False))
    touched = {_bucket_of(spark, 7), _bucket_of(spark, 1_007)}
    assert table.touched([1]) == touched
    text = table.current()._jdf.queryExecution().executedPlan().toString()
    kept, merged = text.split("SortMergeJoin")
    assert kept.count("FileScan") == 1 or "Exchange" not in kept.split("FileScan")[0]
    assert {int(b) for b in re.findall(r"/bucket=(\d+)", merged)} <= touched
    assert not {int(b) for b in re.findall(r"/bucket=(\d+)", kept)} & touched
    assert table.compact() == 1
    after = table.manifest().held
    assert {b for b in after if after[b] != before[b]} == touched
    assert set(storage.partition_values(spark, f"{folder}/t/snapshot/v=1", "bucket")) == {str(b) for b in touched}
    want = {i: "a" for i in range(100)} | {7: "A", 1_007: "new"}
    assert dict(_state(table)) == want
    table.vacuum()
    assert dict(_state(table)) == want
    assert set(storage.partition_values(spark, f"{folder}/t/snapshot/v=0", "bucket")) == {str(b) for b in range(8) if b not in touched}


def test_a_bucket_has_few_files(spark, folder):
    table = _bucketed(spark, folder, 4)
    _append(table, 0, *[(i, "a", i, False) for i in range(400)])
    table.compact()
    _append(table, 1, *[(i, "b", 1_000 + i, False) for i in range(400)])
    table.compact()
    for bucket in range(4):
        assert len(storage.files(spark, f"{folder}/t/snapshot/v=1/bucket={bucket}")) == 1


def test_the_number_of_buckets_may_change(spark, folder):
    _append(_bucketed(spark, folder, 4), 0, *[(i, "a", i, False) for i in range(50)])
    _bucketed(spark, folder, 4).compact()
    table = _bucketed(spark, folder, 6)
    _append(table, 1, (3, "A", 100, False))
    want = {i: "a" for i in range(50)} | {3: "A"}
    assert dict(_state(table)) == want
    table.compact()
    assert dict(_state(table)) == want and set(table.manifest().held.values()) == {1} and table.manifest().of == 6
    _append(_bucketed(spark, folder, 4), 2, (4, "B", 101, False))  # another writer notes other buckets
    assert dict(_state(table)) == want | {4: "B"}
    table.compact()
    assert dict(_state(table)) == want | {4: "B"}


def test_a_compaction_that_stops_changes_nothing(spark, folder, monkeypatch):
    table = _bucketed(spark, folder)
    _append(table, 0, (1, "a", 1, False))
    table.compact()
    _append(table, 1, (1, "A", 2, False), (2, "b", 3, False))
    monkeypatch.setattr("changeflow.storage.move", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        table.compact()
    monkeypatch.undo()
    assert table.snapshot_version() == 0 and _state(table) == [(1, "A"), (2, "b")]
    table.vacuum()
    assert table.compact() == 1 and _state(table) == [(1, "A"), (2, "b")]


def test_a_batch_without_a_note_is_looked_through(spark, folder):
    table = _bucketed(spark, folder)
    _append(table, 0, *[(i, "a", i, False) for i in range(20)])
    table.compact()
    _append(table, 1, (5, "A", 100, False))
    storage.delete(spark, f"{folder}/t/touched/1.json")
    assert table.touched([1]) == {_bucket_of(spark, 5)} and dict(_state(table))[5] == "A"


def test_compaction_keeps_the_state(spark, folder):
    table = _table(spark, folder)
    assert table.compact() is None
    _append(table, 0, (1, "a", 1, False), (2, "b", 2, False), (3, "c", 3, False))
    _append(table, 1, (2, "b", 5, True))
    assert table.compact() == 0
    assert table.compact() == 0
    assert _state(table) == [(1, "a"), (3, "c")]
    _append(table, 2, (2, "late", 4, False), (3, "C", 6, False), (4, "d", 7, False))
    assert _state(table) == [(1, "a"), (3, "C"), (4, "d")]
    assert table.compact() == 1
    assert _state(table) == [(1, "a"), (3, "C"), (4, "d")]
    table.vacuum()
    assert table.batches() == [] and table.snapshot_version() == 1
    assert _state(table) == [(1, "a"), (3, "C"), (4, "d")]
    _append(table, 3, (1, "a", 9, True))
    assert _state(table) == [(3, "C"), (4, "d")]
    table.compact(forget_before=8)
    assert table.snapshot_version() == 2
    assert sorted((r.id, r._deleted) for r in table.snapshot().collect()) == [(1, True), (3, False), (4, False)]


def test_a_batch_taken_after_a_compaction_is_seen(spark, folder):
    table = _table(spark, folder)
    _append(table, 0, (1, "a", 1, False))
    _append(table, 2, (2, "b", 5, False))
    table.compact()
    table.vacuum()
    _append(table, 1, (1, "A", 3, False), (2, "old", 4, False))
    assert _state(table) == [(1, "A"), (2, "b")]
    table.compact()
    table.vacuum()
    _append(table, 0, (1, "a", 1, False))  # a repeated batch, already in the snapshot before
    assert _state(table) == [(1, "A"), (2, "b")]
    table.compact()
    assert _state(table) == [(1, "A"), (2, "b")]


def test_an_unfinished_folder_does_not_count(spark, folder):
    table = _table(spark, folder)
    _append(table, 0, (1, "a", 1, False))
    for unfinished in ("log/batch=1", "snapshot/v=9"):
        spark.createDataFrame([(1, "x", 99, False)], ROW).write.parquet(f"{folder}/t/{unfinished}")
        storage.delete(spark, f"{folder}/t/{unfinished}/_SUCCESS")
    assert table.batches() == [0] and table.snapshot_version() is None
    assert _state(table) == [(1, "a")]


def test_rows_must_have_the_columns_of_the_table(spark, folder):
    with pytest.raises(ValueError, match="lack"):
        _table(spark, folder).append(spark.createDataFrame([(1, 1, False)], "id bigint, _version bigint, _deleted boolean"), 0)


def test_one_failing_compaction_does_not_stop_the_others(spark, folder):
    good, bad = CurrentTable(spark, f"{folder}/good", COLUMNS), CurrentTable(spark, f"{folder}/bad", COLUMNS)
    _append(good, 0, (1, "a", 1, False))
    bad.compact = lambda: (_ for _ in ()).throw(OSError("disk"))
    assert compact_tables({"bad": bad, "good": good}) == {"bad": "disk"}
    assert good.snapshot_version() == 0


def _events(spark, *times):
    rows = [(n, at(t), "insert", "T:a", "t", 1, "f.1", n, 5, True, "") for n, t in enumerate(times)]
    schema = (
        "seq bigint, timestamp timestamp, event_type string, target_name string, table_name string, rows_count int, "
        "binlog_file string, binlog_pos bigint, duration_ms int, success boolean, error_msg string"
    )
    return spark.createDataFrame(rows, schema)


def test_events_are_stored_in_whole_seconds_by_month(spark, folder):
    mt.append_monitor(_events(spark, "2024-01-31 23:59:59.9", "2024-02-01 00:00:00.1"), folder, "sync_events")
    rows = read_monitor(spark, folder, "sync_events").orderBy("seq").collect()
    assert [(r.timestamp, r.yyyymm, r.success) for r in rows] == [
        (at("2024-01-31 23:59:59"), 202401, 1), (at("2024-02-01 00:00:00"), 202402, 1),
    ]


def test_unknown_or_missing_columns_are_refused(spark, folder):
    events = _events(spark, "2024-01-01")
    with pytest.raises(ValueError, match="missing columns \\['error_msg'\\]"):
        mt.append_monitor(events.drop("error_msg"), folder, "sync_events")
    with pytest.raises(ValueError, match="unknown columns \\['note'\\]"):
        mt.append_monitor(events.withColumn("note", F.lit(1)), folder, "sync_events")
    with pytest.raises(ValueError, match="unknown monitoring table"):
        mt.append_monitor(events, folder, "sync_other")


def test_a_labelled_append_can_be_repeated(spark, folder):
    mt.append_monitor(_events(spark, "2024-01-01", "2024-02-01"), folder, "sync_events", "b-1")
    mt.append_monitor(_events(spark, "2024-03-01"), folder, "sync_events", "b-1")
    mt.append_monitor(_events(spark, "2024-03-01"), folder, "sync_events")
    mt.append_monitor(_events(spark, "2024-03-01"), folder, "sync_events")
    months = read_monitor(spark, folder, "sync_events").groupBy("yyyymm", "batch").count().collect()
    assert sorted(map(tuple, months)) == [(202403, "b-1", 1), (202403, "direct", 2)]


def test_empty_tables_can_be_read(spark, folder):
    mt.create_monitor_tables(spark, folder)
    mt.create_monitor_tables(spark, folder)
    for table in MONITOR_TABLES:
        assert read_monitor(spark, folder, table, TimeRange.of("2024-01-01", "2024-02-01")).collect() == []
    mt.append_monitor(_events(spark, "2024-01-01", "2024-02-01"), folder, "sync_events")
    assert read_monitor(spark, folder, "sync_events").count() == 2
    assert read_monitor(spark, folder, "sync_events", TimeRange.of("2024-01-31", None)).count() == 1


TIMES = ("2023-11-30", "2023-12-31 23:59:59", "2024-01-10", "2024-01-10 00:00:01", "2024-02-01")


@pytest.mark.parametrize(("before", "left"), [("2024-01-10", 3), ("2024-01-10 00:00:01", 2), ("2024-01-20", 1), ("2024-01-01", 3), ("2023-01-01", 5), ("2025-01-01", 0)])
def test_cleanup(spark, folder, before, left):
    mt.append_monitor(_events(spark, *TIMES), folder, "sync_events", "a")
    mt.create_monitor_tables(spark, folder)
    mt.cleanup(spark, folder, before)
    mt.cleanup(spark, folder, before)
    rows = read_monitor(spark, folder, "sync_events").collect()
    assert sorted(r.timestamp for r in rows) == [at(t) for t in TIMES if at(t) >= at(before)]
    assert len(rows) == left


def test_cleanup_goes_on_after_an_interruption(spark, folder, monkeypatch):
    mt.append_monitor(_events(spark, *TIMES), folder, "sync_events")
    monkeypatch.setattr("changeflow.storage.move", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        mt.cleanup(spark, folder, "2024-01-10 00:00:01")
    monkeypatch.undo()
    mt.cleanup(spark, folder, "2024-01-10 00:00:01")
    assert read_monitor(spark, folder, "sync_events").count() == 2


def test_a_rewriting_keeps_what_is_appended_meanwhile(spark, folder, monkeypatch):
    mt.append_monitor(_events(spark, *TIMES), folder, "sync_events")
    seen = []

    def between(*args, commit=storage.commit_text):  # the month is rewritten, and not yet exchanged
        seen.append(read_monitor(spark, folder, "sync_events").count())
        mt.append_monitor(_events(spark, *TIMES), folder, "sync_events")
        seen.append(read_monitor(spark, folder, "sync_events").count())
        commit(*args)

    reader = read_monitor(spark, folder, "sync_events")
    monkeypatch.setattr("changeflow.storage.commit_text", between)
    mt.cleanup_table(spark, folder, "sync_events", "2024-01-10 00:00:01")
    monkeypatch.undo()
    assert seen == [5, 10]
    rows = read_monitor(spark, folder, "sync_events")
    assert rows.count() == 2 + 5  # old rows that were appended meanwhile are for the next clean-up
    assert reader.count() == 5  # a reader from before the exchange
    mt.cleanup_table(spark, folder, "sync_events", "2024-01-10 00:00:01")
    assert sorted(r.timestamp for r in read_monitor(spark, folder, "sync_events").collect()) == sorted([at(t) for t in TIMES[3:]] * 2)


def test_a_merge_keeps_what_is_appended_meanwhile(spark, folder, monkeypatch):
    mt.append_monitor(_events(spark, *TIMES), folder, "sync_events", "a")

    def between(*args, commit=storage.commit_text):
        mt.append_monitor(_events(spark, *TIMES), folder, "sync_events", "b")
        commit(*args)

    monkeypatch.setattr("changeflow.storage.commit_text", between)
    mt.merge_month(spark, folder, "sync_events", "202401")
    monkeypatch.undo()
    rows = read_monitor(spark, folder, "sync_events")
    assert rows.count() == 10 and {(r.yyyymm, r.batch) for r in rows.collect() if r.yyyymm == 202401} == {(202401, "merged"), (202401, "b")}
    mt.monitor_table(spark, folder, "sync_events").purge()
    assert read_monitor(spark, folder, "sync_events").count() == 10


def test_a_label_can_be_repeated_after_a_rewriting(spark, folder):
    for label in ("a", "b"):
        mt.append_monitor(_events(spark, *TIMES), folder, "sync_events", label)
    mt.cleanup_table(spark, folder, "sync_events", "2024-01-10 00:00:01")
    mt.append_monitor(_events(spark, "2024-01-20"), folder, "sync_events", "a")
    counts = read_monitor(spark, folder, "sync_events").groupBy("batch").count().collect()
    assert sorted(map(tuple, counts)) == [("a", 1), ("b", 2)]
    mt.monitor_table(spark, folder, "sync_events").purge()
    assert read_monitor(spark, folder, "sync_events").count() == 3


def test_two_rewritings_at_once_do_not_overwrite_each_other(spark, folder, monkeypatch):
    mt.append_monitor(_events(spark, *TIMES), folder, "sync_events")
    inner = []

    def between(*args, commit=storage.commit_text):
        if not inner:
            inner.append(True)
            mt.merge_month(spark, folder, "sync_events", "202401")
        commit(*args)

    monkeypatch.setattr("changeflow.storage.commit_text", between)
    with pytest.raises(FileExistsError):
        mt.cleanup_table(spark, folder, "sync_events", "2024-01-10 00:00:01")
    monkeypatch.undo()
    assert read_monitor(spark, folder, "sync_events").count() == 5
    mt.cleanup_table(spark, folder, "sync_events", "2024-01-10 00:00:01")
    assert read_monitor(spark, folder, "sync_events").count() == 2


def test_rewritten_months_are_pruned(spark, folder):
    mt.append_monitor(_events(spark, *TIMES), folder, "sync_events")
    mt.merge_month(spark, folder, "sync_events", "202401")
    rows = read_monitor(spark, folder, "sync_events", TimeRange.of("2024-01-05", "2024-01-20"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("yyyymm#") and "PartitionFilters: [isnotnull(yyyymm" in plan and rows.count() == 2


def test_time_to_live(spark, folder):
    mt.append_monitor(_events(spark, *TIMES), folder, "sync_events")
    as_of = "2024-02-09 00:00:00"  # 30 days after 2024-01-10 00:00:00, which is then expired
    kept = mt.within_ttl(read_monitor(spark, folder, "sync_events"), as_of)
    assert sorted(r.seq for r in kept.collect()) == [3, 4]
    mt.expire(spark, folder, as_of)
    assert sorted(r.seq for r in read_monitor(spark, folder, "sync_events").collect()) == [3, 4]


def test_sinks_are_checked_before_anything_runs(folder):
    def resolve(target):
        return registry.resolve_sinks([target], {"t": COLUMNS}, folder)

    assert list(resolve(TargetConfig("a", ("t",)))) == ["ClickHouse:a"]
    for kind in ("elasticsearch", "mysql"):
        with pytest.raises(ValueError, match="not implemented"):
            resolve(TargetConfig("a", ("t",), kind=kind))
    with pytest.raises(ValueError, match="unknown target type"):
        resolve(TargetConfig("a", ("t",), kind="other"))
    with pytest.raises(ValueError, match="missing"):
        resolve(TargetConfig("a", ("t",), options=None))
    with pytest.raises(ValueError, match="no schema"):
        resolve(TargetConfig("a", ("t", "u")))


def test_a_sink_of_your_own(spark, folder):
    seen = []
    registry.register_sink("collecting", lambda target, schemas, root: lambda df, batch: seen.append((target.name, df.count(), batch)))
    sinks = registry.resolve_sinks([TargetConfig("mine", ("t",), kind="collecting")], {}, folder)
    sinks["ClickHouse:mine"](spark.range(3), 7)
    assert seen == [("mine", 3, 7)]


def test_merging_a_month_keeps_its_rows(spark, folder, monkeypatch):
    for n in range(3):
        mt.append_monitor(_events(spark, *TIMES), folder, "sync_events", f"b-{n}")
    before = sorted(map(tuple, read_monitor(spark, folder, "sync_events").drop("batch").collect()))
    monkeypatch.setattr("changeflow.storage.move", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        mt.merge_month(spark, folder, "sync_events", "202401")
    monkeypatch.undo()
    mt.merge_month(spark, folder, "sync_events", "202401")
    after = read_monitor(spark, folder, "sync_events")
    assert sorted(map(tuple, after.drop("batch").collect())) == before
    assert {r.batch for r in after.where("yyyymm = 202401").select("batch").collect()} == {"merged"}


LOG = "seq bigint, binlog_file string, binlog_pos bigint, row_idx int, kind string, table_name string, action string, before string, after string, ddl_query string"


def _change(seq, pos, action, after, before=None, row=0):
    text = [i and f'{{"id": {i[0]}, "v": "{i[1]}"}}' for i in (before, after)]
    return (seq, "f.000001", pos, row, "row", "t", action, *text, None)


def _sink_state(spark, folder, options, *rows):
    target = TargetConfig("a", ("t",), options=options)
    registry.table_sink(target, {"t": COLUMNS}, folder)(spark.createDataFrame(list(rows), LOG), 0)
    table = registry.current_tables(spark, target, {"t": COLUMNS}, folder)["t"]
    return sorted((r.id, r.v) for r in table.current().collect()), table


def test_a_changed_key_moves_only_when_asked(spark, folder):
    rows = _change(1, 4, "insert", (1, "a")), _change(2, 8, "update", (2, "a"), (1, "a")), _change(3, 9, "update", (2, "b"), (2, "a"))
    assert _sink_state(spark, f"{folder}/keep", {}, *rows)[0] == [(1, "a"), (2, "b")]
    assert _sink_state(spark, f"{folder}/move", {"key_change": "move"}, *rows)[0] == [(2, "b")]


def test_a_change_without_seq_is_refused_by_default(spark, folder):
    target = TargetConfig("main", ("t",))
    rows = spark.createDataFrame([_change(None, 4, "insert", (1, "a"))], LOG)
    outcome = registry.table_sink(target, {"t": COLUMNS}, folder)(rows, 0)
    assert "version=position" in outcome["t"].error


def test_a_log_without_seq_is_ordered_by_position(spark, folder):
    rows = (
        _change(None, 4, "insert", (1, "first")),
        _change(None, 100, "update", (1, "last"), row=3),
        _change(None, 100, "update", (1, "middle"), row=1),
    )
    state, table = _sink_state(spark, folder, {"version": "position", "files_per_batch": "1"}, *rows)
    assert state == [(1, "last")]
    table.compact()
    assert [(r.id, r.v) for r in table.current().collect()] == [(1, "last")]
    files = list((Path(folder) / "a/t/log/batch=0").glob("*.parquet"))
    assert len(files) == 1
