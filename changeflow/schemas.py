"""Schemas of the change log and of the monitoring tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model.
ACTIONS = ("insert", "update", "delete")
CONTROL_KINDS = ("rotate", "xid", "ddl")
POSITION_KINDS = ("rotate", "xid")
POSITION_TARGET = "main"
VERSION = "_version"
DELETED = "_deleted"
CORRUPT = "_corrupt_record"
MONTH = "yyyymm"
BATCH = "batch"


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _L, _I, _D, _TS = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.TimestampType(),
)

CHANGE_LOG = _struct(
    ("seq", _L),
    ("binlog_file", _S),
    ("binlog_pos", _L),
    ("row_idx", _I),
    ("header_ts", _TS),
    ("kind", _S),
    ("schema_name", _S),
    ("table_name", _S),
    ("action", _S),
    ("before", _S),
    ("after", _S),
    ("ddl_query", _S),
)

SYNC_EVENTS = _struct(
    ("timestamp", _TS),
    ("event_type", _S),
    ("target_name", _S),
    ("table_name", _S),
    ("rows_count", _L),
    ("binlog_file", _S),
    ("binlog_pos", _L),
    ("duration_ms", _L),
    ("success", _I),
    ("error_msg", _S),
)

SYNC_ERRORS = _struct(
    ("timestamp", _TS),
    ("level", _S),
    ("target_name", _S),
    ("table_name", _S),
    ("message", _S),
    ("stack_trace", _S),
    ("raw_data", _S),
)

SYNC_POSITIONS = _struct(
    ("timestamp", _TS),
    ("target_name", _S),
    ("binlog_file", _S),
    ("binlog_pos", _L),
    ("gtid", _S),
    ("delay_seconds", _L),
)

SYNC_METRICS = _struct(
    ("timestamp", _TS),
    ("metric_name", _S),
    ("metric_value", _D),
    ("target_name", _S),
    ("table_name", _S),
    ("tags", T.MapType(_S, _S)),
)

MONITOR_TABLES = {
    "sync_events": SYNC_EVENTS,
    "sync_errors": SYNC_ERRORS,
    "sync_positions": SYNC_POSITIONS,
    "sync_metrics": SYNC_METRICS,
}

# Order of the rows inside a file, so row-group statistics narrow time ranges.
MONITOR_SORT = {
    "sync_events": ("timestamp", "target_name", "table_name"),
    "sync_errors": ("timestamp", "level"),
    "sync_positions": ("timestamp", "target_name"),
    "sync_metrics": ("timestamp", "metric_name"),
}

# Columns looked up by equality, written with a Parquet bloom filter.
MONITOR_BLOOM = {
    "sync_events": ("target_name", "table_name"),
    "sync_errors": ("target_name",),
    "sync_positions": ("target_name",),
    "sync_metrics": (),
}
