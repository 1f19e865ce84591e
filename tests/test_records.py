from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from changeflow.functions.ranges import timestamp
from changeflow.operators import records
from changeflow.targets import TargetConfig, target_tables
from tests.conftest import at

LOG = "seq bigint, binlog_file string, binlog_pos bigint, kind string"


def _log(n, files, seed):
    rng = random.Random(seed)
    bounds = sorted(rng.sample(range(1, n), files - 1))
    rows = []
    for seq in range(n):
        number = sum(seq >= b for b in bounds)
        kind = "row" if rng.random() < 0.8 else rng.choice(["rotate", "xid", "ddl"])
        rows.append((seq, f"bin.{number:06d}", seq * 10 + 4, kind))
    return rows


def _expected(rows):
    last, out = {}, []
    for seq, file, pos, kind in rows:
        if kind == "row":
            out.append((seq, last.get(file)))
        else:
            last[file] = pos
    return out


@pytest.mark.parametrize("chunk", [1, 3, 16, 1 << 20])
def test_positions_do_not_depend_on_the_chunks(spark, chunk):
    rows = _log(300, 4, 1)
    got = records.event_positions(spark.createDataFrame(rows, LOG), chunk=chunk)
    assert sorted((r.seq, r.last_pos) for r in got.collect()) == _expected(rows)


def test_positions_carried_between_batches(spark):
    rows = _log(120, 2, 3)
    got, carry = [], None
    for start in range(0, 120, 25):
        batch = spark.createDataFrame(rows[start : start + 25], LOG)
        got += [(r.seq, r.last_pos) for r in records.event_positions(batch, chunk=8, carry=carry).collect()]
        control = records.last_control(batch)
        control = control if carry is None else control.unionByName(carry)
        carry = spark.createDataFrame(control.orderBy(F.col("seq").desc()).limit(1).collect(), control.schema)
    assert sorted(got) == _expected(rows)


@pytest.mark.parametrize(
    ("header", "delay"),
    [
        ("2024-01-01 00:00:00", 3600),
        ("2024-01-01 00:59:59.5", 0),
        ("2024-01-01 00:59:58.5", 1),
        ("2024-01-01 02:00:00", 0),
        ("1970-01-01 00:00:00", 0),
        (None, 0),
    ],
)
def test_delay(spark, header, delay):
    df = spark.createDataFrame([(header and at(header),)], "header_ts timestamp")
    assert df.select(records.delay_seconds("header_ts", timestamp(at("2024-01-01 01:00:00")))).first()[0] == delay


def test_position_records_leave_out_ddl(spark):
    rows = [(n, "f.1", n, kind, at("2024-01-01")) for n, kind in enumerate(["rotate", "row", "xid", "ddl"])]
    log = spark.createDataFrame(rows, LOG + ", header_ts timestamp")
    got = records.position_records(log, timestamp(at("2024-01-01 00:01:00"))).collect()
    assert [(r.seq, r.target_name, r.gtid, r.delay_seconds) for r in got] == [(0, "main", "", 60), (2, "main", "", 60)]


def test_event_records(spark):
    targets = (TargetConfig("a", ("t",)), TargetConfig("b", ("t", "u")))
    rows = [(1, "f.1", 10, "update", "s", "t", 4), (2, "f.1", 20, "delete", "s", "u", None), (3, "f.1", 30, "insert", "s", "x", 4)]
    schema = "seq bigint, binlog_file string, binlog_pos bigint, action string, schema_name string, table_name string, last_pos bigint"
    df = spark.createDataFrame(rows, schema)
    now = timestamp(at("2024-01-01"))
    error = F.when(F.col("target_name") == "ClickHouse:b", F.lit("down"))
    got = records.event_records(df, now, routes=target_tables(spark, targets), error=error).orderBy("seq", "target_name")
    assert [(r.seq, r.target_name, r.rows_count, r.binlog_file, r.binlog_pos, r.success, r.error_msg) for r in got.collect()] == [
        (1, "ClickHouse:a", 2, "f.1", 4, 1, ""), (1, "ClickHouse:b", 2, "f.1", 4, 0, "down"), (2, "ClickHouse:b", 1, "", 0, 0, "down"),
    ]
    primary = records.event_records(df, now, primary=targets[0], error=error).collect()
    assert {(r.target_name, r.success) for r in primary} == {("ClickHouse:a", 1)} and len(primary) == 3
    with pytest.raises(ValueError):
        records.event_records(df, now)


def test_rows_of_one_event_collapse(spark):
    rows = [(1, "f", 5, "s", "t", "update"), (2, "f", 5, "s", "t", "update"), (3, "f", 9, "s", "t", "insert")]
    df = spark.createDataFrame(rows, "seq bigint, binlog_file string, binlog_pos bigint, schema_name string, table_name string, action string")
    got = records.collapse_rows(df).orderBy("seq").collect()
    assert [(r.seq, r.rows_count) for r in got] == [(1, 4), (3, 1)]
