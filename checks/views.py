"""Change log and monitoring tables derived from the given tables (see FIXTURES.md).

The text of every view runs unchanged on Spark and on DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from changeflow.targets import TargetConfig

# Times used by the queries, all UTC.
AS_OF = "2024-01-31 00:00:00"
LIVE_AS_OF = "2024-01-20 00:00:00"
STARTED = "2024-01-01 00:00:00"
RANGE_START = "2024-01-10 00:00:00"
RANGE_END = "2024-01-20 00:00:00"
CUT_START = "2024-01-03 04:25:17"
CUT_END = "2024-01-27 21:40:09"
CLEAN_BEFORE = "2023-11-20 12:00:00"
DAY_START = "2024-01-15 00:00:00"
DAY_END = "2024-01-15 12:00:00"

TARGETS = (
    TargetConfig("clickhouse-main", ("orders", "customer")),
    TargetConfig("replica", ("orders",)),
)

VIEWS = {
    "change_log": """
        SELECT event_id AS seq,
               concat('mysql-bin.', lpad(cast(cast(floor(event_id / 1000) AS bigint) AS string), 6, '0')) AS binlog_file,
               (event_id % 1000) * 100 + 4 AS binlog_pos,
               cast(ts AS timestamp) AS header_ts,
               'shop' AS schema_name,
               CASE WHEN user_id % 3 = 0 THEN 'orders' WHEN user_id % 3 = 1 THEN 'customer' ELSE 'orders_archive' END AS table_name,
               CASE WHEN event_type = 'signup' THEN 'insert' WHEN event_type = 'error' THEN 'delete' ELSE 'update' END AS action,
               user_id * 10 + cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) % 10 AS id,
               value AS payload,
               cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k
        FROM events""",
    "log_ops": """
        SELECT seq, binlog_file, binlog_pos, header_ts, schema_name, table_name, action, id, payload, k,
               CASE WHEN seq % 1000 = 0 THEN 'rotate' WHEN seq % 500 = 499 THEN 'ddl' WHEN seq % 4 = 3 THEN 'xid' ELSE 'row' END AS kind,
               CASE WHEN seq % 500 = 499 THEN concat('ALTER TABLE ', table_name, ' ADD COLUMN c', cast(seq AS string), ' INT') END AS ddl_query
        FROM change_log""",
    "targets": """
        SELECT * FROM (VALUES
          ('clickhouse-main', 'ClickHouse:clickhouse-main', 'clickhouse', 0, 'orders', 0),
          ('clickhouse-main', 'ClickHouse:clickhouse-main', 'clickhouse', 0, 'customer', 1),
          ('replica', 'ClickHouse:replica', 'clickhouse', 1, 'orders', 0))
          AS t(target, target_name, target_type, target_ord, table_name, table_ord)""",
    "sync_events": """
        SELECT seq, cast(date_trunc('second', header_ts) AS timestamp) AS timestamp, action AS event_type,
               concat('ClickHouse:', CASE WHEN seq % 4 = 0 THEN 'clickhouse-main' ELSE 'replica' END) AS target_name,
               table_name,
               cast(CASE WHEN action = 'update' THEN 2 ELSE 1 END AS bigint) AS rows_count,
               binlog_file, binlog_pos,
               cast(floor(payload) AS bigint) AS duration_ms,
               CASE WHEN k % 10 = 0 THEN 0 ELSE 1 END AS success,
               CASE WHEN k % 10 = 0 THEN 'write failed' ELSE '' END AS error_msg,
               id, k
        FROM change_log""",
    "sync_errors": """
        SELECT seq, timestamp, CASE WHEN k % 20 = 0 THEN 'WARNING' ELSE 'ERROR' END AS level, target_name, table_name,
               concat('write failed for id ', cast(id AS string), ' at ', binlog_file,
                      CASE WHEN event_type = 'delete' THEN ' while the row was being removed' ELSE '' END) AS message,
               '' AS stack_trace, '' AS raw_data
        FROM sync_events WHERE success = 0""",
    "sync_positions": """
        SELECT seq, cast(date_trunc('second', header_ts) AS timestamp) AS timestamp, 'main' AS target_name,
               binlog_file, binlog_pos, '' AS gtid, cast(floor(payload) AS bigint) AS delay_seconds
        FROM log_ops WHERE kind IN ('rotate', 'xid')""",
    "sync_metrics": """
        SELECT seq, cast(date_trunc('second', header_ts) AS timestamp) AS timestamp,
               CASE WHEN k % 2 = 0 THEN 'qps' ELSE 'tps' END AS metric_name,
               payload AS metric_value, 'main' AS target_name, table_name
        FROM change_log""",
    "status_changes": """
        SELECT seq, timestamp, target_name, CASE WHEN success = 1 THEN 'connected' ELSE 'error' END AS status
        FROM sync_events""",
    "order_base": """
        SELECT o_orderkey AS id, o_totalprice AS payload, o_orderstatus AS status, cast(0 AS bigint) AS _version, false AS _deleted
        FROM orders""",
    "order_changes": """
        SELECT l_orderkey AS id, l_extendedprice AS payload, l_linestatus AS status,
               cast(l_linenumber AS bigint) * 1000000000000000000 + l_partkey * 1000000000000
                   + cast(floor(l_extendedprice * 100) AS bigint) * 10000 + l_suppkey AS _version,
               l_returnflag = 'R' AS _deleted
        FROM lineitem""",
}

# Tables, and views, each view reads.
READS = {
    "change_log": ("events",),
    "log_ops": ("change_log",),
    "targets": (),
    "sync_events": ("change_log",),
    "sync_errors": ("sync_events",),
    "sync_positions": ("log_ops",),
    "sync_metrics": ("change_log",),
    "status_changes": ("sync_events",),
    "order_base": ("orders",),
    "order_changes": ("lineitem",),
}

# Schemas of the given tables, so reading them needs no inference.
TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
                 o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,
                   l_extendedprice double, l_discount double, l_tax double, l_returnflag string,
                   l_linestatus string, l_shipdate timestamp_ntz""",
}


def needed(names: tuple[str, ...]) -> list[str]:
    """Names with everything they read, each after what it reads."""
    order: list[str] = []
    for name in names:
        for part in [*needed(READS.get(name, ())), name]:
            if part not in order:
                order.append(part)
    return order


def with_views(*names: str, tables: bool = False) -> str:
    """``WITH`` clause defining the views. With ``tables``, the tables they read are
    defined too, as ``{name}`` to be filled in; else they exist already."""
    parts = []
    for name in needed(names):
        if name in VIEWS:
            parts.append(f"{name} AS ({VIEWS[name]})")
        elif tables:
            parts.append(f"{name} AS (SELECT * FROM {{{name}}})")
    return "WITH " + ",\n".join(parts)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = {
        table: spark.read.schema(TABLES[table]).parquet(f"{sf_dir}/{table}.parquet")
        for table in needed((name,))
        if table in TABLES
    }
    return spark.sql(f"{with_views(name, tables=True)}\nSELECT * FROM {name}", **read)
