from __future__ import annotations

import pytest
from pyspark.sql import Observation
from pyspark.sql import types as T

from changeflow.operators import decode, route
from changeflow.schemas import CHANGE_LOG
from changeflow.targets import Schedule, TargetConfig, included_tables, target_tables

EVENTS = "seq bigint, action string, table_name string, rows array<struct<id bigint, v string>>"
TARGETS = (TargetConfig("a", ("orders", "items", "orders")), TargetConfig("b", ("orders",), enabled=False))


@pytest.fixture
def events(spark):
    rows = [
        (1, "insert", "t", [(1, "a"), (2, "b")]),
        (2, "update", "t", [(1, "a"), (1, "A"), (2, "b"), (9, "B")]),
        (3, "update", "t", [(1, "A"), (1, "AA"), (2, "B")]),
        (4, "delete", "t", [(1, "A")]),
        (5, "truncate", "t", [(1, "A")]),
        (6, "update", "t", []),
        (7, "insert", "t", None),
    ]
    return spark.createDataFrame(rows, EVENTS)


def test_decode_takes_after_images(events):
    got = [tuple(r) for r in decode.decode_changes(events).select("seq", "row_idx", "id", "v").orderBy("seq", "row_idx").collect()]
    assert got == [(1, 0, 1, "a"), (1, 1, 2, "b"), (2, 1, 1, "A"), (2, 3, 9, "B"), (4, 0, 1, "A")]


def test_decode_with_before_images(events):
    rows = decode.decode_changes(events, keep_before=True).orderBy("seq", "row_idx").collect()
    assert [(r.seq, r.row_idx, r.id, r.before and r.before.id) for r in rows] == [
        (1, 0, 1, None), (1, 1, 2, None), (2, 1, 1, 1), (2, 3, 9, 2), (4, 0, 1, None),
    ]


def test_malformed_events_go_to_quarantine(events):
    assert [r.seq for r in decode.malformed_events(events).orderBy("seq").collect()] == [3, 7]


def test_key_moves(events):
    changes = decode.decode_changes(events, keep_before=True)
    moved = decode.versioned(decode.key_moves(changes)).collect()
    assert [(r.seq, r.id, r.v, r._deleted) for r in moved] == [(2, 2, "b", True)]


def test_images_that_do_not_fit(spark):
    texts = ['{"id": 1, "v": 2.5}', '{"id": "x", "v": 1.0}', "not json", None]
    rows = [(i, "f", i, 0, None, "row", "s", "t", "insert", None, text, None) for i, text in enumerate(texts)]
    rows.append((9, "f", 9, 0, None, "row", "s", "t", "delete", '{"id": 7, "v": 1.0}', None, None))
    image = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.DoubleType())])
    counted = Observation()
    good, bad = decode.parse_images(spark.createDataFrame(rows, CHANGE_LOG), image, counted)
    assert sorted((r.seq, r.id, r.v) for r in good.collect()) == [(0, 1, 2.5), (9, 7, 1.0)]
    assert counted.get["bad"] == 3
    assert sorted(r.seq for r in bad.collect()) == [1, 2, 3]
    assert bad.columns == CHANGE_LOG.names


def test_images_whose_columns_changed_go_to_quarantine(spark):
    texts = ['{"id": 1, "v": "a", "newcol": "x"}', '{"v": "b"}', '{"id": 3}', '{"ID": 4, "V": "z"}', '{"id": null, "v": "n"}', '{"v": null, "id": 6}']
    rows = [(i, "f", i, 0, None, "row", "s", "t", "insert", None, text, None) for i, text in enumerate(texts)]
    image = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])
    good, bad = decode.parse_images(spark.createDataFrame(rows, CHANGE_LOG), image)
    assert [(r.seq, r.id, r.v) for r in good.collect()] == [(5, 6, None)]
    assert sorted(r.seq for r in bad.collect()) == [0, 1, 2, 3, 4]


def test_targets(spark):
    rows = target_tables(spark, TARGETS).collect()
    assert [(r.target_name, r.table_name, r.enabled) for r in rows] == [
        ("ClickHouse:a", "orders", True), ("ClickHouse:a", "items", True), ("ClickHouse:b", "orders", False),
    ]
    assert included_tables(TARGETS) == ["orders", "items"]
    with pytest.raises(ValueError, match="differ"):
        target_tables(spark, [TARGETS[0], TARGETS[0]])
    assert Schedule().minutes is None
    assert Schedule(True, 0).minutes == 1440
    assert Schedule(True, 5).minutes == 5


def test_routing_is_exact_and_skips_disabled_targets(spark):
    changes = spark.createDataFrame([(1, "orders"), (2, "orders_archive"), (3, "items")], "seq bigint, table_name string")
    routed = route.route_changes(changes, target_tables(spark, TARGETS))
    assert sorted((r.seq, r.target_name) for r in routed.collect()) == [(1, "ClickHouse:a"), (3, "ClickHouse:a")]


@pytest.mark.parametrize(("whole_word", "seqs"), [(False, [1, 2, 4]), (True, [1, 4])])
def test_ddl_mentions(spark, whole_word, seqs):
    rows = [
        (1, "ddl", "ALTER TABLE orders JOIN items"),
        (2, "ddl", "ALTER TABLE orders_archive ADD c INT"),
        (3, "ddl", "DROP TABLE customers"),
        (4, "ddl", "TRUNCATE `items`"),
        (5, "row", "orders"),
        (6, "ddl", None),
    ]
    log = spark.createDataFrame(rows, "seq bigint, kind string, ddl_query string")
    routed = route.route_ddl(log, TARGETS, whole_word).collect()
    assert sorted(r.seq for r in routed) == seqs
    assert {r.target_name for r in routed} == {"ClickHouse:a"}
    assert route.route_ddl(log, []).collect() == []
