from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from changeflow.operators import state

SCHEMA = "table_name string, id bigint, payload double, _version bigint, _deleted boolean"
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

changes = st.lists(st.tuples(st.sampled_from("ab"), st.integers(1, 4), st.booleans()), min_size=1, max_size=40)


def _rows(log):
    return [(table, key, float(n), n, deleted) for n, (table, key, deleted) in enumerate(log)]


def _expected(rows):
    newest = {}
    for row in sorted(rows, key=lambda r: r[3]):
        newest[row[:2]] = row
    return sorted(r[:4] for r in newest.values() if not r[4])


def _got(df):
    return sorted(tuple(r) for r in df.select("table_name", "id", "payload", "_version").collect())


@SETTINGS
@given(log=changes)
def test_state_equals_the_last_write_per_key(spark, log):
    rows = _rows(log)
    random.Random(len(rows)).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert _got(state.current_state(df)) == _expected(rows)
    assert _got(state.state_by_anti_join(df)) == _expected(rows)


@SETTINGS
@given(log=changes, cut=st.integers(0, 40), late=st.booleans())
def test_merge_and_patch_equal_the_whole_log(spark, log, cut, late):
    rows = _rows(log)
    first, second = rows[:cut], rows[cut:]
    if late:
        first, second = second, first
    snapshot = state.latest_per_key(spark.createDataFrame(first, SCHEMA))
    pending = spark.createDataFrame(second, SCHEMA)
    for merge in (state.merge_onto, state.patch_onto):
        assert _got(state.without_deleted(merge(snapshot, pending))) == _expected(rows)


@pytest.mark.parametrize("merge", [state.merge_onto, state.patch_onto])
def test_delete_then_insert_again(spark, merge):
    rows = [("a", 1, 0.0, 1, False), ("a", 1, 0.0, 2, True), ("a", 1, 5.0, 3, False), ("a", 2, 1.0, 4, True)]
    whole = spark.createDataFrame(rows, SCHEMA)
    assert _got(state.current_state(whole)) == [("a", 1, 5.0, 3)]
    parts = state.latest_per_key(spark.createDataFrame(rows[:2], SCHEMA)), spark.createDataFrame(rows[2:], SCHEMA)
    assert _got(state.without_deleted(merge(*parts))) == [("a", 1, 5.0, 3)]


def test_a_hot_key_is_limited_before_the_shuffle(spark):
    df = spark.range(0, 30_000, 1, 6).selectExpr(
        "'a' AS table_name", "if(id % 3 = 0, 7, id) AS id", "double(id) AS payload", "id AS _version", "false AS _deleted"
    )
    latest = state.latest_per_key(df)
    plan = latest._jdf.queryExecution().executedPlan().toString()
    after, before = plan.split("Exchange hashpartitioning", 1)
    assert "WindowGroupLimit" in after and "WindowGroupLimit" in before
    hot = latest.where("id = 7").collect()
    assert [r._version for r in hot] == [29_997]
    assert latest.count() == df.select("id").distinct().count()
