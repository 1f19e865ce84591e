"""Streams over monitoring records: rates, rollups, newest positions, duplicates."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryProgress

from changeflow import storage
from changeflow.operators.series import COPY_KEY, is_row_change, with_content_key
from changeflow.operators.stats import (
    HOURLY_EVENTS_KEYS,
    HOURLY_LATENCY_KEYS,
    POSITION_COLUMNS,
    delay_sums,
    event_sums,
    order_number,
)
from changeflow.rewritable import RewritableTable
from changeflow.schemas import BATCH

# Late records up to this much behind the newest one still count.
LATENESS = "10 minutes"
DAY = "day"


def _event_time(df: DataFrame, lateness: str | None) -> DataFrame:
    df = df.withColumn("timestamp", F.col("timestamp").cast("timestamp"))  # watermarks need a zoned timestamp
    return df if lateness is None else df.withWatermark("timestamp", lateness)


def throughput_stream(events: DataFrame, lateness: str | None = LATENESS) -> DataFrame:
    """Events and row changes per second, in append or complete mode."""
    windows = _event_time(events, lateness).groupBy(F.window("timestamp", "1 second").alias("w"))
    rates = windows.agg(F.count(F.lit(1)).alias("qps"), F.count_if(is_row_change()).alias("tps"))
    return rates.select(F.col("w.start").alias("second"), "qps", "tps")


def _hourly(df: DataFrame, keys: Sequence[str], figures: list[Column], lateness: str | None) -> DataFrame:
    hours = _event_time(df, lateness).groupBy(F.window("timestamp", "1 hour").alias("w"), *keys).agg(*figures)
    return hours.select(F.col("w.start").alias("hour"), *[c for c in hours.columns if c != "w"])


def events_hourly_stream(events: DataFrame, lateness: str | None = LATENESS) -> DataFrame:
    """The hourly event rollup, kept up to date from a stream."""
    return _hourly(events, HOURLY_EVENTS_KEYS[1:], event_sums(), lateness)


def latency_hourly_stream(positions: DataFrame, lateness: str | None = LATENESS) -> DataFrame:
    """The hourly delay rollup, kept up to date from a stream."""
    return _hourly(positions, HOURLY_LATENCY_KEYS[1:], delay_sums(), lateness)


def position_stream(positions: DataFrame) -> DataFrame:
    """Newest position of each target, for complete or update mode; the state is one row for each target."""
    columns = [c for c in POSITION_COLUMNS if c in positions.columns]
    last = F.max_by(F.struct(*columns), order_number()).alias("last")
    return positions.groupBy("target_name").agg(last).select("target_name", "last.*")


def error_totals_stream(errors: DataFrame) -> DataFrame:
    """Running totals of errors: count and last message of each target, for complete or update mode; the state is one row for
    each target."""
    last = F.max_by("message", F.struct(order_number().alias("place"), "message"))
    return errors.groupBy("target_name").agg(F.count(F.lit(1)).alias("total_errors"), last.alias("last_error"))


def event_totals_stream(events: DataFrame) -> DataFrame:
    """Running totals of events: events, rows and failures of each target, table and type, for complete or update mode."""
    return events.groupBy("target_name", "table_name", F.upper("event_type").alias("event_type")).agg(
        F.count(F.lit(1)).alias("total_events"),
        F.sum("rows_count").alias("total_rows"),
        F.count_if(F.col("success") == 0).alias("failed_events"),
    )


def deduplicated_stream(events: DataFrame, lateness: str = LATENESS, salts: int = 1) -> DataFrame:
    """Each event once per target; copies may be ``lateness`` apart. Events without ``seq`` are copies of each other only if
    all their columns are equal.

    Where one event may make up much of the stream, ``salts`` first removes copies in
    that many groups of input tasks, so its copies do not all go to one task.
    """
    key = list(COPY_KEY)
    timed = _event_time(with_content_key(events), lateness)
    if salts > 1:
        salted = timed.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        timed = salted.dropDuplicatesWithinWatermark([*key, "_salt"]).drop("_salt")
    return timed.dropDuplicatesWithinWatermark(key).drop("_content")


def late_rows(progress: Iterable[StreamingQueryProgress]) -> int:
    """Rows that came after their second was closed, over the given progress reports."""
    return sum(state.numRowsDroppedByWatermark for report in progress for state in report.stateOperators)


def _updates_table(spark: SparkSession, path: str, schema: T.StructType) -> RewritableTable:
    fields = [T.StructField(f.name, f.dataType) for f in schema.fields]
    return RewritableTable(spark, path, DAY, T.StructType([*fields, T.StructField(DAY, T.DateType()), T.StructField(BATCH, T.StringType())]))


def write_updates(path: str, time_column: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer for update mode that adds the changed rows below ``path``, by day of ``time_column``.

    A repeated batch replaces its rows. What a batch costs depends on what it changes, not on what there is."""

    def write(changed: DataFrame, batch_id: int) -> None:
        label = f"{batch_id:012d}"
        _updates_table(changed.sparkSession, path, changed.schema).discard(label)
        rows = changed.withColumn(DAY, F.to_date(time_column)).withColumn(BATCH, F.lit(label))
        rows.write.mode("append").partitionBy(DAY, BATCH).parquet(path)

    return write


def _newest_of(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    last = Window.partitionBy(DAY, *keys).orderBy(F.col(BATCH).desc())
    return rows.withColumn("_last", F.row_number().over(last)).where("_last = 1").drop("_last")


def read_updates(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The newest row of each of ``keys`` below ``path``, with its ``day``, by which a condition prunes."""
    return _newest_of(_updates_table(spark, path, schema).read(), keys).drop(BATCH)


def merge_days(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], before: str) -> None:
    """Leave one row of each of ``keys`` in the days before ``before`` (ISO date). Rows that come meanwhile, or later, count."""
    table = _updates_table(spark, path, schema)

    def merged(rows: DataFrame) -> DataFrame:
        label = rows.agg(F.max(BATCH)).first()[0]
        return _newest_of(rows, keys).withColumn(BATCH, F.lit(label))

    days = [day for day in table.values() if day < before]
    if days:
        table.rewrite(dict.fromkeys(days, merged))


def start_updates(
    result: DataFrame, path: str, checkpoint: str, time_column: str, *, interval: str = "1 second", available_now: bool = False
) -> StreamingQuery:
    """Keep a table of rates or rollups up to date with the rows that each micro-batch changes. The result needs a watermark,
    which bounds its state; ``read_updates`` reads the table, ``merge_days`` keeps it small."""
    writer = result.writeStream.foreachBatch(write_updates(path, time_column)).outputMode("update")
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def write_latest(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer that keeps the newest complete result below ``path``.

    Each result is a folder of its own, so a reader, or a failed write, never meets
    a half-written table.
    """

    def write(result: DataFrame, batch_id: int) -> None:
        result.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")
        for old in storage.finished(result.sparkSession, path, BATCH):
            if old < batch_id - 1:
                storage.delete(result.sparkSession, f"{path}/{BATCH}={old}")

    return write


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished result of ``write_latest``."""
    done = storage.finished(spark, path, BATCH)
    if not done:
        raise FileNotFoundError(f"no finished result below {path}")
    return spark.read.parquet(f"{path}/{BATCH}={done[-1]}")


def start_push(
    result: DataFrame,
    path: str,
    checkpoint: str,
    *,
    mode: str = "complete",
    interval: str = "1 second",
    available_now: bool = False,
) -> StreamingQuery:
    """Keep a table up to date with a streaming result of few rows, such as newest positions, every second by default.

    In append mode the result is added to; otherwise each result replaces the last. ``start_updates`` is for results that grow.
    """
    if mode == "append":
        writer = result.writeStream.format("parquet").option("path", path).outputMode("append")
    else:
        writer = result.writeStream.foreachBatch(write_latest(path)).outputMode(mode)
    writer = writer.option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()
