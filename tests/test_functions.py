from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from changeflow.functions import labels, names
from changeflow.functions.ranges import LAST_HOUR, TimeRange, moment
from tests.conftest import at


@pytest.mark.parametrize(
    ("name", "aliases"),
    [
        ("ClickHouse:clickhouse-main", ["ClickHouse:clickhouse-main", "clickhouse-main", "clickhouse-primary"]),
        ("ClickHouse:replica", ["ClickHouse:replica", "replica"]),
        (":clickhouse-main", [":clickhouse-main"]),
        ("clickhouse-main", ["clickhouse-main"]),
        ("a:b:c", ["a:b:c", "b:c"]),
        ("x:clickhouse-primary", ["x:clickhouse-primary", "clickhouse-primary"]),
        ("x:", ["x:", ""]),
    ],
)
def test_target_aliases(spark, name, aliases):
    df = spark.createDataFrame([(name,)], "name string")
    assert df.select(names.target_aliases("name")).first()[0] == aliases


def test_versions_follow_the_log_not_the_text(spark):
    rows = [("bin.999999", 4_000_000_000, 7), ("bin.1000000", 4, 0), ("bin.1000000", 4, 1), ("bin.1000000", 5, 0)]
    df = spark.createDataFrame(rows, "binlog_file string, binlog_pos bigint, row_idx int")
    versions = [r[0] for r in df.select(names.log_version(df.columns).alias("v")).collect()]
    assert versions == sorted(versions) and len(set(versions)) == 4
    with_seq = df.withColumn("seq", F.lit(5))
    assert with_seq.select(names.log_version(with_seq.columns)).first()[0] == 5


def test_key_column(spark):
    assert names.key_column(spark.createDataFrame([(1, 2)], "a int, id int")) == "id"
    assert names.key_column(spark.createDataFrame([(1, 2)], "a int, b int")) == "a"


def test_range_defaults():
    as_of = "2024-01-20 00:00:00"
    assert TimeRange.resolve(as_of, LAST_HOUR) == TimeRange(at("2024-01-19 23:00:00"), at(as_of))
    assert TimeRange.resolve(as_of, LAST_HOUR, end=at("2024-01-02")).start == at("2024-01-01 23:00:00")
    assert TimeRange.resolve(as_of, LAST_HOUR, start=0, end="") == TimeRange.resolve(as_of, LAST_HOUR)
    assert TimeRange.today("2024-02-28 12:34:56") == TimeRange(at("2024-02-28"), at("2024-02-29 23:59:59"))
    assert moment(1_704_067_200) == at("2024-01-01")
    assert TimeRange.resolve(as_of, timedelta(minutes=5)).seconds == 300


def test_range_ends_are_included(spark):
    times = ["2024-01-01 00:00:00", "2024-01-01 00:00:01", "2024-01-02 00:00:00", "2024-01-02 00:00:01"]
    df = spark.createDataFrame([(at(t),) for t in times], "timestamp timestamp")
    kept = TimeRange.of("2024-01-01 00:00:01", "2024-01-02 00:00:00").apply(df)
    assert [r[0] for r in kept.collect()] == [at(times[1]), at(times[2])]
    assert TimeRange().apply(df).count() == 4


def test_labels(spark):
    df = spark.createDataFrame(
        [("f.1", 4, "", "m" * 50, 0), ("f.1", 4, "g-1", "m" * 51, 93_784)],
        "binlog_file string, binlog_pos bigint, gtid string, message string, up bigint",
    )
    rows = df.select(labels.position_label(gtid="gtid"), labels.message_label(), labels.uptime_label("up")).collect()
    assert tuple(rows[0]) == ("f.1:4", "m" * 50, "0天 0时 0分")
    assert tuple(rows[1]) == ("GTID: g-1", "m" * 50 + "...", "1天 2时 3分")
