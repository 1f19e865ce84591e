"""Monitoring records derived from the log: positions, delays, one event record per event and target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeflow.schemas import POSITION_KINDS, POSITION_TARGET
from changeflow.targets import TargetConfig

# Log rows that one window task sorts. Files are cut into chunks of this many, so a
# file may be of any size.
CHUNK = 1 << 20


def delay_seconds(header_ts: Column | str, as_of: Column) -> Column:
    """Whole seconds from the header time to ``as_of``, never negative, 0 without a header time."""
    header_ts = F.col(header_ts) if isinstance(header_ts, str) else header_ts
    passed = F.timestamp_diff("SECOND", header_ts, as_of)
    known = F.unix_timestamp(header_ts) > 0
    return F.when(known, F.greatest(F.lit(0), passed)).otherwise(F.lit(0)).cast("bigint")


def replication_delay(log: DataFrame, as_of: Column) -> DataFrame:
    return log.select("seq", "kind", delay_seconds("header_ts", as_of).alias("delay_seconds"))


def position_records(log: DataFrame, as_of: Column) -> DataFrame:
    """One record per rotate and commit."""
    at = log.where(F.col("kind").isin(*POSITION_KINDS))
    return at.select(
        "seq",
        as_of.alias("timestamp"),
        F.lit(POSITION_TARGET).alias("target_name"),
        "binlog_file",
        "binlog_pos",
        F.lit("").alias("gtid"),
        delay_seconds("header_ts", as_of).alias("delay_seconds"),
    )


def event_positions(log: DataFrame, chunk: int = CHUNK, carry: DataFrame | None = None) -> DataFrame:
    """Row events with ``last_pos``: the position of the last rotate, DDL or commit before them.

    Each file is cut into chunks of ``chunk`` log positions. Within a chunk a
    window finds the last control position; what a chunk inherits is the last
    control position of the file's earlier chunks, computed from one row per
    chunk. ``carry`` adds control rows (``binlog_file``, ``seq``, ``binlog_pos``)
    of earlier batches.
    """
    chunk_of = F.floor(F.col("seq") / chunk).cast("bigint")
    control_pos = F.when(F.col("kind") != "row", F.col("binlog_pos"))
    control_seq = F.when(F.col("kind") != "row", F.col("seq"))

    chunked = log.withColumn("_chunk", chunk_of)
    before = Window.partitionBy("binlog_file", "_chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    within = chunked.withColumn("_pos", F.last(control_pos, ignorenulls=True).over(before)).where("kind = 'row'")

    # every chunk gives a row, also those without control rows: they inherit too
    ends = chunked.groupBy("binlog_file", "_chunk").agg(F.max_by(control_pos, control_seq).alias("_end"))
    if carry is not None:
        carried = carry.groupBy("binlog_file").agg(F.max_by("binlog_pos", "seq").alias("_end"))
        ends = ends.unionByName(carried.select("binlog_file", F.lit(-1).cast("bigint").alias("_chunk"), "_end"))
    earlier = Window.partitionBy("binlog_file").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    inherited = ends.select("binlog_file", "_chunk", F.last("_end", ignorenulls=True).over(earlier).alias("_start"))

    joined = within.join(inherited, ["binlog_file", "_chunk"], "left")
    return joined.select(*log.columns, F.coalesce("_pos", "_start").alias("last_pos"))


def last_control(log: DataFrame) -> DataFrame:
    """The last control row of each file, to be carried into the next batch."""
    control = log.where(F.col("kind") != "row")
    return control.groupBy("binlog_file").agg(
        F.max("seq").alias("seq"), F.max_by("binlog_pos", "seq").alias("binlog_pos")
    )


def collapse_rows(changes: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One row per event from one row per changed row; an update counts both images."""
    images = F.sum(F.when(F.col("action") == "update", 2).otherwise(1))
    group = ["binlog_file", "binlog_pos", "schema_name", "table_name", "action", *extra]
    return changes.groupBy(*group).agg(F.min("seq").alias("seq"), images.cast("bigint").alias("rows_count"))


def _rows_count(df: DataFrame) -> Column:
    if "rows_count" in df.columns:
        return F.col("rows_count")
    return F.when(F.col("action") == "update", 2).otherwise(1).cast("bigint")


def event_records(
    positioned: DataFrame,
    recorded_at: Column,
    *,
    routes: DataFrame | None = None,
    primary: TargetConfig | None = None,
    duration_ms: Column | None = None,
    error: Column | None = None,
) -> DataFrame:
    """Event records of row events that carry ``last_pos``.

    With ``routes`` (one row per target and table): a record per event and
    target, successful when ``error`` is null; ``routes`` may carry the outcome as
    ``duration_ms`` and ``error``. With ``primary``: one record per event under the
    first target's name, always successful.
    """
    if (routes is None) == (primary is None):
        raise ValueError("give either routes or primary")
    if routes is not None:
        carried = [c for c in ("target_name", "table_name", "duration_ms", "error") if c in routes.columns]
        wanted = routes.where("enabled").select(*carried)
        events = positioned.join(wanted, "table_name")
    else:
        events = positioned.withColumn("target_name", F.lit(primary.qualified_name))
        error = None
    error = F.lit(None).cast("string") if error is None else error
    return events.select(
        "seq",
        recorded_at.alias("timestamp"),
        F.col("action").alias("event_type"),
        "target_name",
        "table_name",
        _rows_count(positioned).alias("rows_count"),
        F.when(F.col("last_pos").isNotNull(), F.col("binlog_file")).otherwise("").alias("binlog_file"),
        F.coalesce("last_pos", F.lit(0)).cast("bigint").alias("binlog_pos"),
        (F.lit(0) if duration_ms is None else duration_ms).cast("bigint").alias("duration_ms"),
        F.when(error.isNull(), 1).otherwise(0).alias("success"),
        F.coalesce(error, F.lit("")).alias("error_msg"),
    )


def event_records_by_schema(changes: DataFrame, recorded_at: Column, duration_ms: Column, error: Column) -> DataFrame:
    """Event records without a target: the schema stands for it, and no position is known."""
    return changes.select(
        "seq",
        recorded_at.alias("timestamp"),
        F.col("action").alias("event_type"),
        F.col("schema_name").alias("target_name"),
        "table_name",
        _rows_count(changes).alias("rows_count"),
        F.lit("").alias("binlog_file"),
        F.lit(0).cast("bigint").alias("binlog_pos"),
        duration_ms.cast("bigint").alias("duration_ms"),
        F.when(error.isNull(), 1).otherwise(0).alias("success"),
        F.coalesce(error, F.lit("")).alias("error_msg"),
    )


def error_records(failures: DataFrame, recorded_at: Column, raw_data: Column | None = None) -> DataFrame:
    """Error records of failed writes (``target_name``, ``table_name``, ``message``), with the whole message."""
    return failures.select(
        recorded_at.alias("timestamp"),
        F.lit("ERROR").alias("level"),
        "target_name",
        "table_name",
        "message",
        F.lit("").alias("stack_trace"),
        (F.lit("") if raw_data is None else raw_data).alias("raw_data"),
    )
