"""SQL twin of each query, for DuckDB on the given tables."""

from __future__ import annotations

from checks import views
from checks.views import with_views

_RANGE = f"timestamp >= timestamp '{views.RANGE_START}' AND timestamp <= timestamp '{views.RANGE_END}'"
_AS_OF = f"timestamp '{views.AS_OF}'"
_LIVE = f"timestamp '{views.LIVE_AS_OF}'"


def _last(span: str, column: str = "timestamp") -> str:
    return f"{column} >= {_LIVE} - INTERVAL {span} AND {column} <= {_LIVE}"


_LOG = "seq, binlog_file, binlog_pos, header_ts, schema_name, table_name, action, id, payload, k"
_EVENT = (
    "seq, timestamp, event_type, target_name, table_name, rows_count, binlog_file, binlog_pos, "
    "duration_ms, success, error_msg"
)

_VERSIONED = "SELECT *, seq AS _version, action = 'delete' AS _deleted FROM change_log"
_STATE = """
    SELECT table_name, id, payload, k, seq AS _version FROM (
        SELECT *, row_number() OVER (PARTITION BY table_name, id ORDER BY seq DESC) AS r FROM change_log)
    WHERE r = 1 AND action != 'delete'"""
_ORDERS_STATE = """
    SELECT id, payload, status, _version FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY _version DESC) AS r
        FROM (SELECT * FROM order_base UNION ALL SELECT * FROM order_changes))
    WHERE r = 1 AND NOT _deleted"""

# last control position of the same file before each row, without a window frame
_POSITIONED = """
    SELECT o.*, (SELECT max(c.binlog_pos) FROM log_ops c
                 WHERE c.binlog_file = o.binlog_file AND c.kind != 'row' AND c.seq < o.seq) AS last_pos
    FROM log_ops o WHERE o.kind = 'row'"""

_DELAY = f"""CASE WHEN header_ts IS NULL THEN 0
    ELSE greatest(0, datesub('second', header_ts, {_AS_OF})) END"""


def _record(target: str, ok: str = "k % 10 != 0", source: str = "p") -> str:
    return f"""
        SELECT seq, {_AS_OF} AS timestamp, action AS event_type, {target} AS target_name, {source}.table_name,
               cast(CASE WHEN action = 'update' THEN 2 ELSE 1 END AS bigint) AS rows_count,
               CASE WHEN last_pos IS NULL THEN '' ELSE binlog_file END AS binlog_file,
               coalesce(last_pos, 0) AS binlog_pos, cast(floor(payload) AS bigint) AS duration_ms,
               CASE WHEN {ok} THEN 1 ELSE 0 END AS success,
               CASE WHEN {ok} THEN '' ELSE 'write failed' END AS error_msg"""


def _event_stats(where: str, errors_where: str) -> str:
    return f"""
        SELECT count(*) FILTER (upper(event_type) = 'INSERT') AS total_insert,
               count(*) FILTER (upper(event_type) = 'UPDATE') AS total_update,
               count(*) FILTER (upper(event_type) = 'DELETE') AS total_delete,
               cast(coalesce(sum(rows_count), 0) AS bigint) AS total_rows,
               (SELECT count(*) FROM sync_errors WHERE {errors_where}) AS total_errors,
               cast(coalesce(floor(avg(duration_ms)), 0) AS bigint) AS avg_duration,
               coalesce(max(duration_ms), 0) AS max_duration, coalesce(min(duration_ms), 0) AS min_duration
        FROM sync_events WHERE {where}"""


_LIVE_STATUS = f"""
    SELECT 'running' AS status, binlog_file, binlog_pos, delay_seconds,
           cast(datesub('second', timestamp '{views.STARTED}', {_AS_OF}) AS bigint) AS uptime
    FROM sync_positions ORDER BY seq DESC LIMIT 1"""

_REGISTERED = "SELECT DISTINCT target_name AS name, target_type AS type, true AS is_enabled FROM targets"

_TARGET_STATUS = f"""
    SELECT name, type, coalesce(c.status, 'connected') AS status, is_enabled, c.timestamp AS last_sync_time
    FROM ({_REGISTERED}) r LEFT JOIN (
        SELECT * FROM status_changes QUALIFY row_number() OVER (PARTITION BY target_name ORDER BY seq DESC) = 1) c
      ON c.target_name = r.name"""

_RECENT = f"""
    SELECT count(*) FILTER (upper(event_type) IN ('INSERT', 'UPDATE', 'DELETE')) / cast(300.0 AS double) AS qps
    FROM sync_events WHERE {_last("5 MINUTES")}"""

_SERVICE = f"""
    SELECT t.*, l.status AS service_status, l.binlog_file, l.binlog_pos, l.delay_seconds, l.uptime, q.qps, q.qps AS tps
    FROM ({_TARGET_STATUS}) t CROSS JOIN ({_LIVE_STATUS}) l CROSS JOIN ({_RECENT}) q"""

# alias names written out: itself, the part after the first colon, the family name
_ALIASES = """
    SELECT DISTINCT name, unnest([name,
        CASE WHEN position(':' IN name) > 1 THEN substr(name, position(':' IN name) + 1) END,
        CASE WHEN position(':' IN name) > 1 AND starts_with(substr(name, position(':' IN name) + 1), 'clickhouse-')
             THEN 'clickhouse-primary' END]) AS alias
    FROM names"""


def _target_stats(events_where: str, errors_where: str) -> str:
    return f"""
        SELECT n.name,
               (SELECT count(*) FROM sync_events e WHERE {events_where}
                   AND e.target_name IN (SELECT alias FROM aliases a WHERE a.name = n.name)) AS total_events,
               (SELECT count(*) FROM sync_errors e WHERE {errors_where}
                   AND e.target_name IN (SELECT alias FROM aliases a WHERE a.name = n.name)) AS total_errors,
               (SELECT max(timestamp) FROM sync_events e
                   WHERE e.target_name IN (SELECT alias FROM aliases a WHERE a.name = n.name)) AS last_sync_time
        FROM names n"""


_NAMES_FROM_TARGETS = "names AS (SELECT DISTINCT target_name AS name FROM targets)"
_NAMES_FROM_EVENTS = "names AS (SELECT DISTINCT target_name AS name FROM sync_events WHERE target_name != '')"


def _listing(names: str) -> str:
    week = _last("7 DAYS", "e.timestamp")
    return f""",
        {names},
        aliases AS (SELECT * FROM ({_ALIASES}) WHERE alias IS NOT NULL),
        stats AS ({_target_stats(week, week)})
        SELECT name, 'clickhouse' AS type, 'connected' AS status, true AS is_enabled,
               total_events, total_errors, last_sync_time
        FROM stats"""


def _latency(p: str) -> str:
    return f"cast(greatest(1, floor(count(*) * cast({p} AS double))) AS bigint)"


def _sql(*names: str, body: str) -> str:
    return f"{with_views(*names)}{'' if body.startswith(',') else ' '}{body}"


def _latency_stats(where: str) -> str:
    return _sql(
        "sync_positions",
        body=f""",
            p AS (SELECT * FROM sync_positions WHERE {where}),
            sorted AS (SELECT delay_seconds, row_number() OVER (ORDER BY delay_seconds) AS r FROM p),
            ranks AS (SELECT {_latency('0.95')} AS r95, {_latency('0.99')} AS r99 FROM p)
            SELECT coalesce(avg(delay_seconds), 0) AS avg_delay, coalesce(max(delay_seconds), 0) AS max_delay,
                   coalesce(min(delay_seconds), 0) AS min_delay,
                   coalesce((SELECT delay_seconds FROM p ORDER BY timestamp DESC, seq DESC LIMIT 1), 0) AS current_delay,
                   coalesce((SELECT delay_seconds FROM sorted, ranks WHERE r = r95), 0) AS p95_delay,
                   coalesce((SELECT delay_seconds FROM sorted, ranks WHERE r = r99), 0) AS p99_delay
            FROM p""",
    )


_STATE_PER_TARGET = """
    SELECT target_name, table_name, id, payload, k, seq AS _version FROM (
        SELECT t.target_name, o.*, row_number() OVER (PARTITION BY t.target_name, o.table_name, id ORDER BY seq DESC) AS r
        FROM log_ops o JOIN targets t ON t.table_name = o.table_name WHERE o.kind = 'row')
    WHERE r = 1 AND action != 'delete'"""

_EVENTS_HOURLY = """
    SELECT date_trunc('hour', timestamp) AS hour, target_name, table_name, event_type,
           count(*) AS event_count, cast(sum(rows_count) AS bigint) AS total_rows,
           cast(sum(duration_ms) AS bigint) AS sum_duration, max(duration_ms) AS max_duration,
           cast(sum(success) AS bigint) AS success_count, avg(duration_ms) AS avg_duration
    FROM sync_events GROUP BY 1, 2, 3, 4"""
_LATENCY_HOURLY = """
    SELECT date_trunc('hour', timestamp) AS hour, target_name, count(*) AS samples,
           cast(sum(delay_seconds) AS bigint) AS sum_delay, max(delay_seconds) AS max_delay,
           min(delay_seconds) AS min_delay, avg(delay_seconds) AS avg_delay
    FROM sync_positions GROUP BY 1, 2"""

def _pages(view: str, columns: str) -> str:
    """Rows of a view with ties, by page: six pages in the order of time, number and all other columns."""
    others = [c for c in columns.split(", ") if c not in ("seq", "timestamp")]
    order = ", ".join(f"{c} DESC NULLS LAST" for c in ("timestamp", "seq", *others))
    changed = """CASE WHEN seq % 11 != 0 THEN date_trunc('hour', timestamp) END AS timestamp,
        CASE WHEN seq % 7 != 0 THEN cast(floor(seq / 3) AS bigint) END AS seq, unnest([target_name, 'T:other']) AS target_name"""
    return f"""
        SELECT {columns}, cast(1 + floor((row_number() OVER (ORDER BY {order}) - 1) / (floor(count(*) OVER () / 6) + 1)) AS integer) AS page
        FROM (SELECT * EXCLUDE (seq, timestamp, target_name), {changed} FROM {view})"""


_SHIFTED = "(SELECT seq, timestamp - to_days(cast(seq % 4 * 31 AS integer)) AS timestamp FROM sync_events)"
_BATCH_OF = "cast(floor(seq / (floor((SELECT max(seq) FROM log_ops) / 4) + 1)) AS bigint)"
_SLICE_OF = "cast(floor(seq / (floor((SELECT max(seq) FROM sync_events) / 4) + 1)) AS bigint)"
_ERROR = "seq, timestamp, level, target_name, table_name, message, stack_trace, raw_data"

ORACLES: dict[str, str] = {
    "change_log_scan": _sql(
        "log_ops", body="SELECT seq, binlog_file, binlog_pos, kind, table_name, action, ddl_query FROM log_ops"
    ),
    "change_log_from_position": _sql(
        "change_log",
        body=f"""SELECT {_LOG} FROM change_log
            WHERE cast(split_part(binlog_file, '.', 2) AS bigint) * 10000000000 + binlog_pos > 2 * 10000000000 + 50004""",
    ),
    "included_changes": _sql(
        "change_log", "targets", body=f"SELECT {_LOG} FROM change_log WHERE table_name IN (SELECT table_name FROM targets)"
    ),
    "decoded_changes": _sql("change_log", body=f"SELECT {_LOG} FROM change_log"),
    "versioned_changes": _sql(
        "change_log", body=f"SELECT table_name, id, payload, k, _version, _deleted FROM ({_VERSIONED})"
    ),
    "keyed_changes": _sql("change_log", body="SELECT seq, table_name, action, id AS key_value FROM change_log"),
    "key_moves": _sql(
        "change_log",
        body="""SELECT table_name, id + 1 AS id, seq AS _version, true AS _deleted
            FROM change_log WHERE action = 'update' AND k % 2 = 0""",
    ),
    "routed_changes": _sql(
        "change_log",
        "targets",
        body="""SELECT seq, target_name, c.table_name, action, id
            FROM change_log c JOIN targets t ON c.table_name = t.table_name""",
    ),
    "routed_counts": _sql(
        "change_log",
        "targets",
        body="""SELECT target_name, c.table_name, action, count(*) AS changes
            FROM change_log c JOIN targets t ON c.table_name = t.table_name GROUP BY ALL""",
    ),
    "routed_enabled": _sql(
        "change_log",
        "targets",
        body="""SELECT target_name, c.table_name, action, count(*) AS changes
            FROM change_log c JOIN targets t ON c.table_name = t.table_name
            WHERE target != 'replica' GROUP BY ALL""",
    ),
    "ddl_routed": _sql(
        "log_ops",
        "targets",
        body="""SELECT DISTINCT seq, target_name, ddl_query
            FROM log_ops o JOIN targets t ON contains(o.ddl_query, t.table_name) WHERE kind = 'ddl'""",
    ),
    "current_state": _sql("change_log", body=_STATE),
    "state_by_anti_join": _sql("change_log", body=_STATE),
    "compacted_state": _sql("change_log", body=_STATE),
    "orders_current_state": _sql("order_base", "order_changes", body=_ORDERS_STATE),
    "orders_merged_state": _sql("order_base", "order_changes", body=_ORDERS_STATE),
    "orders_patched_state": _sql("order_base", "order_changes", body=_ORDERS_STATE),
    "applied_images": _sql(
        "change_log", body=f"SELECT table_name, id, payload, k, _version, _deleted FROM ({_VERSIONED})"
    ),
    "replication_delay": _sql("log_ops", body=f"SELECT seq, kind, cast({_DELAY} AS bigint) AS delay_seconds FROM log_ops"),
    "position_records": _sql(
        "log_ops",
        body=f"""SELECT seq, {_AS_OF} AS timestamp, 'main' AS target_name, binlog_file, binlog_pos, '' AS gtid,
            cast({_DELAY} AS bigint) AS delay_seconds FROM log_ops WHERE kind IN ('rotate', 'xid')""",
    ),
    "event_positions": _sql(
        "log_ops", body=f"SELECT seq, binlog_file, binlog_pos, last_pos FROM ({_POSITIONED})"
    ),
    "sync_event_records": _sql(
        "log_ops",
        "targets",
        body=f"{_record('t.target_name')} FROM ({_POSITIONED}) p JOIN targets t ON t.table_name = p.table_name",
    ),
    "sync_event_records_primary": _sql(
        "log_ops", body=f"{_record(repr('ClickHouse:clickhouse-main'), 'true')} FROM ({_POSITIONED}) p"
    ),
    "sync_event_records_alt": _sql(
        "change_log",
        body="""SELECT seq, date_trunc('second', header_ts) AS timestamp, action AS event_type,
            schema_name AS target_name, table_name,
            cast(CASE WHEN action = 'update' THEN 2 ELSE 1 END AS bigint) AS rows_count,
            '' AS binlog_file, cast(0 AS bigint) AS binlog_pos, cast(floor(payload) AS bigint) AS duration_ms,
            CASE WHEN k % 10 = 0 THEN 0 ELSE 1 END AS success,
            CASE WHEN k % 10 = 0 THEN 'write failed' ELSE '' END AS error_msg FROM change_log""",
    ),
    "saved_events": _sql(
        "sync_events", body=f"SELECT {_EVENT}, cast(strftime(timestamp, '%Y%m') AS int) AS yyyymm FROM sync_events"
    ),
    "saved_errors": _sql(
        "sync_errors", body="SELECT *, cast(strftime(timestamp, '%Y%m') AS int) AS yyyymm FROM sync_errors"
    ),
    "saved_positions": _sql(
        "sync_positions", body="SELECT *, cast(strftime(timestamp, '%Y%m') AS int) AS yyyymm FROM sync_positions"
    ),
    "saved_metrics": _sql(
        "sync_metrics",
        body="""SELECT *, cast(strftime(timestamp, '%Y%m') AS int) AS yyyymm, table_name AS table_tag
            FROM sync_metrics""",
    ),
    "events_by_month": _sql(
        "sync_events",
        body="""SELECT cast(strftime(timestamp, '%Y%m') AS int) AS yyyymm, count(*) AS events,
            cast(sum(rows_count) AS bigint) AS total_rows FROM sync_events GROUP BY 1""",
    ),
    "merged_months": _sql(
        "sync_events",
        body=f"SELECT {_EVENT}, cast(strftime(timestamp, '%Y%m') AS int) AS yyyymm, 'merged' AS batch FROM sync_events",
    ),
    "events_after_cleanup": _sql(
        "sync_events",
        "sync_errors",
        "sync_positions",
        "sync_metrics",
        body=" UNION ALL ".join(
            f"""SELECT '{t}' AS "table", seq, timestamp FROM {t} WHERE timestamp >= timestamp '{views.RANGE_START}'"""
            for t in ("sync_events", "sync_errors", "sync_positions", "sync_metrics")
        ),
    ),
    "events_within_ttl": _sql(
        "sync_events",
        body=f"SELECT seq, timestamp, target_name, table_name FROM sync_events WHERE timestamp + INTERVAL 15 DAYS > {_AS_OF}",
    ),
    "events_filtered": _sql(
        "sync_events",
        body=f"""SELECT {_EVENT} FROM sync_events WHERE target_name = 'ClickHouse:replica' AND table_name = 'orders'
            AND lower(event_type) = 'update' AND success = 1 AND {_RANGE}""",
    ),
    "errors_filtered": _sql(
        "sync_errors",
        body=f"""SELECT * FROM sync_errors WHERE level = 'ERROR' AND target_name = 'ClickHouse:replica'
            AND table_name = 'customer' AND message LIKE '%at mysql-bin%' AND {_RANGE}""",
    ),
    "events_total": _sql(
        "sync_events", body=f"SELECT count(*) AS total FROM sync_events WHERE lower(event_type) = 'insert' AND {_RANGE}"
    ),
    "errors_total": _sql(
        "sync_errors", body=f"SELECT count(*) AS total FROM sync_errors WHERE level = 'WARNING' AND {_RANGE}"
    ),
    "events_page": _sql(
        "sync_events",
        body=f"""SELECT {_EVENT} FROM sync_events WHERE lower(event_type) = 'update'
            ORDER BY timestamp DESC, seq DESC LIMIT 20 OFFSET 40""",
    ),
    "events_deep_page": _sql(
        "sync_events", body=f"SELECT {_EVENT} FROM sync_events ORDER BY timestamp DESC, seq DESC LIMIT 50 OFFSET 1950"
    ),
    "errors_page": _sql(
        "sync_errors",
        body="SELECT * FROM sync_errors WHERE level = 'ERROR' ORDER BY timestamp DESC, seq DESC LIMIT 20 OFFSET 20",
    ),
    "last_events": _sql(
        "sync_events", body=f"SELECT {_EVENT} FROM sync_events ORDER BY timestamp DESC, seq DESC LIMIT 10000"
    ),
    "last_errors": _sql("sync_errors", body="SELECT * FROM sync_errors ORDER BY timestamp DESC, seq DESC LIMIT 1000"),
    "last_events_1000": _sql(
        "sync_events", body=f"SELECT {_EVENT} FROM sync_events ORDER BY timestamp DESC, seq DESC LIMIT 1000"
    ),
    "last_errors_100": _sql("sync_errors", body="SELECT * FROM sync_errors ORDER BY timestamp DESC, seq DESC LIMIT 100"),
    "position_history": _sql(
        "sync_positions",
        body=f"""SELECT timestamp, binlog_file, binlog_pos, delay_seconds FROM sync_positions
            WHERE target_name = 'main' AND {_RANGE}""",
    ),
    "metric_history": _sql(
        "sync_metrics",
        body=f"SELECT timestamp, metric_name, metric_value FROM sync_metrics WHERE metric_name = 'qps' AND {_RANGE}",
    ),
    "latency_history": _sql(
        "sync_positions",
        body=f"""SELECT timestamp, 'latency' AS metric_name, cast(delay_seconds AS double) AS metric_value
            FROM sync_positions WHERE {_RANGE}""",
    ),
    "event_stats": _sql("sync_events", "sync_errors", body=_event_stats(_RANGE, _RANGE)),
    "event_stats_by_type": _sql(
        "sync_events",
        body=f"""SELECT upper(event_type) AS event_type, count(*) AS event_count,
            cast(sum(rows_count) AS bigint) AS total_rows, avg(duration_ms) AS avg_duration,
            max(duration_ms) AS max_duration FROM sync_events WHERE {_RANGE} GROUP BY 1""",
    ),
    "event_type_share": _sql(
        "sync_events",
        body=f"""SELECT upper(event_type) AS event_type, count(*) AS n,
            count(*) / cast((SELECT count(*) FROM sync_events WHERE {_RANGE}) AS double) AS share
            FROM sync_events WHERE {_RANGE} GROUP BY 1""",
    ),
    "latency_stats": _latency_stats(_RANGE),
    "summarised_latency": _latency_stats(f"timestamp >= timestamp '{views.CUT_START}' AND timestamp <= timestamp '{views.CUT_END}'"),
    "error_stats": _sql(
        "sync_errors",
        body=" UNION ALL ".join(
            f"SELECT '{d}' AS dimension, {c} AS key, count(*) AS n FROM sync_errors WHERE {_RANGE} GROUP BY 2"
            for d, c in (("level", "level"), ("target", "target_name"), ("table", "table_name"))
        ),
    ),
    "error_totals": _sql(
        "sync_errors",
        body=f"""SELECT count(*) FILTER (level = 'ERROR') AS total_errors,
            count(*) FILTER (level = 'WARNING') AS total_warnings FROM sync_errors WHERE {_RANGE}""",
    ),
    "known_targets": _sql(
        "sync_events", body="SELECT DISTINCT target_name FROM sync_events WHERE target_name != '' ORDER BY 1"
    ),
    "target_aliases_of_events": _sql(
        "sync_events",
        body=f", {_NAMES_FROM_EVENTS} SELECT name, alias FROM ({_ALIASES}) WHERE alias IS NOT NULL",
    ),
    "target_stats": _sql(
        "sync_events",
        "sync_errors",
        "targets",
        body=f""", {_NAMES_FROM_TARGETS}, aliases AS (SELECT * FROM ({_ALIASES}) WHERE alias IS NOT NULL)
            {_target_stats(_RANGE, _RANGE)}""",
    ),
    "target_error_totals": _sql(
        "sync_errors",
        "targets",
        body="""SELECT target_name AS name, count(*) AS total_errors, arg_max(message, seq) AS last_error
            FROM sync_errors WHERE target_name IN (SELECT target_name FROM targets) GROUP BY 1""",
    ),
    "summarised_positions": _sql(
        "sync_positions",
        body="""SELECT concat('main-', seq % 12) AS target_name, timestamp, binlog_file, binlog_pos, gtid, delay_seconds
            FROM sync_positions QUALIFY row_number() OVER (PARTITION BY seq % 12 ORDER BY timestamp DESC, seq DESC) = 1""",
    ),
    "recent_throughput": _sql("sync_events", body=f"SELECT qps, qps AS tps FROM ({_RECENT})"),
    "current_position": _sql(
        "sync_positions",
        body="""SELECT target_name, timestamp, binlog_file, binlog_pos, gtid, delay_seconds FROM sync_positions
            QUALIFY row_number() OVER (PARTITION BY target_name ORDER BY timestamp DESC, seq DESC) = 1""",
    ),
    "events_hourly": _sql("sync_events", body=_EVENTS_HOURLY),
    "latency_hourly": _sql("sync_positions", body=_LATENCY_HOURLY),
    "streamed_events_hourly": _sql("sync_events", body=_EVENTS_HOURLY),
    "streamed_latency_hourly": _sql("sync_positions", body=_LATENCY_HOURLY),
    "throughput_per_second": _sql(
        "sync_events",
        body="""SELECT timestamp AS second, count(*) AS qps,
            count(*) FILTER (event_type IN ('insert', 'update', 'delete')) AS tps FROM sync_events GROUP BY 1""",
    ),
    "throughput_series": _sql(
        "sync_events",
        body=f""",
            seconds AS (SELECT unnest(generate_series(timestamp '{views.DAY_START}', timestamp '{views.DAY_END}',
                                                      INTERVAL 1 SECOND)) AS second)
            SELECT second, count(seq) AS qps, count(seq) FILTER (event_type IN ('insert', 'update', 'delete')) AS tps
            FROM seconds LEFT JOIN sync_events ON timestamp = second GROUP BY 1""",
    ),
    "deduplicated_events": _sql("sync_events", body=f"SELECT {_EVENT} FROM sync_events"),
    "event_labels_of_events": _sql(
        "sync_events",
        body="""SELECT seq, target_name || '.' || table_name AS table_label,
            binlog_file || ':' || cast(binlog_pos AS varchar) AS position_label,
            strftime(timestamp, '%H:%M:%S') AS clock, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS date_clock,
            upper(event_type) AS type_label, success = 1 AS succeeded FROM sync_events""",
    ),
    "error_labels_of_errors": _sql(
        "sync_errors",
        body="""SELECT seq, level, target_name || '.' || table_name AS table_label,
            strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS date_clock,
            CASE WHEN length(message) > 50 THEN left(message, 50) || '...' ELSE message END AS message_label
            FROM sync_errors""",
    ),
    "live_status": _sql("sync_positions", body=_LIVE_STATUS),
    "target_status": _sql("status_changes", "targets", body=_TARGET_STATUS),
    "target_status_from_events": _sql(
        "sync_events",
        "targets",
        body=f"""SELECT name, type, 'connected' AS status, is_enabled,
            (SELECT arg_max(timestamp, seq) FROM sync_events WHERE success = 1 AND target_name = name) AS last_sync_time
            FROM ({_REGISTERED})""",
    ),
    "service_status": _sql("status_changes", "targets", "sync_positions", "sync_events", body=_SERVICE),
    "health": _sql(
        "status_changes",
        "targets",
        "sync_positions",
        body=f""",
            live AS ({_LIVE_STATUS}), states AS ({_TARGET_STATUS}),
            checks AS (
                SELECT 'service' AS check_name, CASE WHEN status = 'running' THEN 'ok' ELSE 'error' END AS check_status,
                       status AS message FROM live
                UNION ALL
                SELECT 'latency', CASE WHEN delay_seconds > 300 THEN 'error' WHEN delay_seconds > 60 THEN 'warning'
                                       ELSE 'ok' END, '延迟正常' FROM live
                UNION ALL
                SELECT 'targets', CASE WHEN count(*) FILTER (status IN ('error', 'disconnected')) > 0 THEN 'error'
                                       ELSE 'ok' END, '所有目标正常' FROM states)
            SELECT (SELECT CASE WHEN count(*) FILTER (check_status = 'error') > 0 THEN 'unhealthy'
                                WHEN count(*) FILTER (check_status = 'warning') > 0 THEN 'degraded'
                                ELSE 'healthy' END FROM checks) AS overall, *
            FROM checks""",
    ),
    "metrics_24h": _sql(
        "status_changes",
        "targets",
        "sync_positions",
        "sync_events",
        "sync_errors",
        body=f"""SELECT * FROM ({_SERVICE}) CROSS JOIN ({_event_stats(_last("24 HOURS"), _last("24 HOURS"))})""",
    ),
    "target_listing": _sql("sync_events", "sync_errors", "targets", body=_listing(_NAMES_FROM_TARGETS)),
    "target_listing_from_events": _sql("sync_events", "sync_errors", body=_listing(_NAMES_FROM_EVENTS)),
    "streamed_state": _sql("log_ops", "targets", body=_STATE_PER_TARGET),
    "streamed_drift": _sql("log_ops", "targets", body=_STATE_PER_TARGET.replace("'row')", "'row' AND o.seq % 20 != 5)")),
    "streamed_unreadable": _sql(
        "log_ops",
        "targets",
        body=f"""SELECT what, n FROM (
            SELECT 'lines kept' AS what, count(*) AS n FROM log_ops WHERE seq % 20 = 6
            UNION ALL SELECT 'error records', count(*) FROM log_ops WHERE seq % 20 = 6
            UNION ALL SELECT 'current rows', count(*) FROM ({_STATE_PER_TARGET.replace("'row')", "'row' AND o.seq % 20 != 6)")}))""",
    ),
    "fan_out_with_failure": _sql("log_ops", "targets", body=_STATE_PER_TARGET),
    "streamed_events": _sql(
        "log_ops",
        "targets",
        body=f"""SELECT * EXCLUDE (duration_ms) FROM (
            {_record('t.target_name', 'true')} FROM ({_POSITIONED}) p JOIN targets t ON t.table_name = p.table_name)""",
    ),
    "streamed_positions": _sql(
        "log_ops",
        body=f"""SELECT seq, {_AS_OF} AS timestamp, 'main' AS target_name, binlog_file, binlog_pos, '' AS gtid,
            cast({_DELAY} AS bigint) AS delay_seconds FROM log_ops WHERE kind IN ('rotate', 'xid')""",
    ),
    "streamed_throughput": _sql(
        "sync_events",
        body="""SELECT timestamp AS second, count(*) AS qps,
            count(*) FILTER (event_type IN ('insert', 'update', 'delete')) AS tps FROM sync_events GROUP BY 1""",
    ),
    "streamed_deduplicated_events": _sql("sync_events", body=f"SELECT {_EVENT} FROM sync_events"),
    "events_pages_by_key": _sql("sync_events", body=_pages("sync_events", _EVENT)),
    "errors_pages_by_key": _sql("sync_errors", body=_pages("sync_errors", _ERROR)),
    "deduplicated_without_seq": _sql(
        "sync_events",
        body=f"SELECT DISTINCT {_EVENT} FROM (SELECT * REPLACE (CASE WHEN seq % 3 != 1 THEN seq END AS seq) FROM sync_events)",
    ),
    "events_cleaned_over_months": _sql(
        "sync_events",
        body=f"""SELECT seq, timestamp, cast(strftime(timestamp, '%Y%m') AS integer) AS yyyymm FROM (
            SELECT * FROM {_SHIFTED} WHERE timestamp >= timestamp '{views.CLEAN_BEFORE}'
            UNION ALL SELECT * FROM {_SHIFTED} WHERE timestamp >= timestamp '{views.CLEAN_BEFORE}' AND seq % 10 = 0
            UNION ALL SELECT * FROM {_SHIFTED} WHERE seq % 10 = 5)""",
    ),
    "retried_outcomes": _sql(
        "log_ops",
        "targets",
        body=f"""SELECT 'event' AS record, seq, {_AS_OF} AS timestamp, target_name, o.table_name,
                CASE WHEN target = 'replica' AND {_BATCH_OF} = 2 THEN 0 ELSE 1 END AS success,
                CASE WHEN target = 'replica' AND {_BATCH_OF} = 2 THEN 'replica refused the batch' ELSE '' END AS message
            FROM log_ops o JOIN targets t ON t.table_name = o.table_name WHERE o.kind = 'row'
            UNION ALL SELECT 'error', NULL, {_AS_OF}, 'ClickHouse:replica', 'orders', 0, 'replica refused the batch'
            FROM generate_series(1, 4)""",
    ),
    "late_events": _sql(
        "sync_events",
        body=f""", ends AS (SELECT max(timestamp) FILTER ({_SLICE_OF} = 2) - INTERVAL 10 DAY AS second, max(timestamp) - INTERVAL 10 DAY AS first
                FROM sync_events),
            late AS (SELECT count(*) AS late FROM sync_events CROSS JOIN ends
                WHERE ({_SLICE_OF} = 1 AND timestamp <= second) OR ({_SLICE_OF} = 0 AND timestamp <= first))
            SELECT (SELECT count(*) FROM sync_events) - late AS kept, late FROM late""",
    ),
    "buffered_events": _sql(
        "sync_events",
        body=f"SELECT {_EVENT} FROM sync_events ORDER BY timestamp DESC, seq DESC LIMIT 500",
    ),
    "buffered_events_resized": _sql(
        "sync_events",
        body="""SELECT seq, timestamp, (SELECT least(70, count(*)) FROM sync_events WHERE timestamp >= timestamp '2024-01-30 20:00:00') AS n_records,
                70 AS capacity
            FROM sync_events WHERE timestamp >= timestamp '2024-01-30 20:00:00' ORDER BY timestamp DESC, seq DESC LIMIT 50""",
    ),
    "streamed_event_totals": _sql(
        "sync_events",
        body="""SELECT target_name, table_name, upper(event_type) AS event_type, count(*) AS total_events,
            cast(sum(rows_count) AS bigint) AS total_rows, count(*) FILTER (success = 0) AS failed_events FROM sync_events GROUP BY ALL""",
    ),
    "streamed_error_totals": _sql(
        "sync_errors",
        body="SELECT target_name, count(*) AS total_errors, arg_max(message, seq) AS last_error FROM sync_errors GROUP BY 1",
    ),
    "status_with_live_rates": _sql(
        "sync_events",
        "sync_positions",
        "targets",
        body=f""", newest AS (SELECT max(timestamp) AS at FROM sync_events)
            SELECT name, type, 'connected' AS status, is_enabled,
                (SELECT max(timestamp) FROM sync_events WHERE success = 1 AND target_name = name) AS last_sync_time,
                'running' AS service_status, p.binlog_file, p.binlog_pos, p.delay_seconds,
                cast(datesub('second', timestamp '{views.STARTED}', newest.at + INTERVAL 1 SECOND) AS bigint) AS uptime,
                (SELECT cast(count(*) AS double) FROM sync_events WHERE timestamp = newest.at) AS qps,
                (SELECT cast(count(*) AS double) FROM sync_events WHERE timestamp = newest.at AND event_type IN ('insert', 'update', 'delete')) AS tps
            FROM ({_REGISTERED}) CROSS JOIN newest CROSS JOIN (SELECT * FROM sync_positions ORDER BY seq DESC LIMIT 1) p""".replace(" AS at ", " AS newest_at ").replace("newest.at", "newest_at"),
    ),
}

ORACLES |= {
    "summarised_target_stats": ORACLES["target_stats"],
    "summarised_target_status": ORACLES["target_status_from_events"],
    "summarised_error_totals": ORACLES["target_error_totals"],
}
