from __future__ import annotations

import json

import pytest

from changeflow.sources import change_log as cl
from tests.conftest import at

LOG = "seq bigint, binlog_file string, binlog_pos bigint"


def test_json_log_keeps_unreadable_lines_apart(spark, tmp_path):
    lines = [json.dumps({"seq": 1, "kind": "row", "header_ts": "2024-01-01T00:00:00Z"}), "{broken", json.dumps({"seq": "x"})]
    (tmp_path / "log.json").write_text("\n".join(lines))
    good, bad = cl.split_corrupt(cl.read_changes(spark, str(tmp_path), fmt="json").cache())
    assert [(r.seq, r.kind, r.header_ts) for r in good.collect()] == [(1, "row", at("2024-01-01"))]
    assert sorted(r[0] for r in bad.collect()) == sorted(lines[1:])
    after = cl.read_changes(spark, str(tmp_path), fmt="json", start=cl.Position(seq=1)).cache()
    assert after.where("_corrupt_record IS NULL").collect() == []


def test_messages(spark):
    values = [(b'{"seq": 3, "table_name": "t"}',), (b"nope",)]
    good, bad = cl.split_corrupt(cl.parse_messages(spark.createDataFrame(values, "value binary")))
    assert [(r.seq, r.table_name) for r in good.collect()] == [(3, "t")]
    assert [r[0] for r in bad.collect()] == ["nope"]


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown change log format"):
        cl.read_changes(spark, str(tmp_path), fmt="xml")


def test_start_positions(spark):
    rows = [(1, "b.000999", 10), (2, "b.000999", 500), (3, "b.001000", 4), (4, "b.10000", 4)]
    df = spark.createDataFrame(rows, LOG)

    def after(position):
        return sorted(r.seq for r in cl.from_position(df, position).collect())

    assert after(None) == [1, 2, 3, 4]
    assert after(cl.Position(seq=2)) == [3, 4]
    assert after(cl.Position(binlog_file="b.000999", binlog_pos=10)) == [2, 3, 4]
    assert after(cl.Position(binlog_file="b.001000", binlog_pos=4)) == [4]
    newest = cl.newest_position(df)
    assert newest.seq == 4 and after(newest) == []
    assert cl.newest_position(df.where("seq < 0")).seq == -1
