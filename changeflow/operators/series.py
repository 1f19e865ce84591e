"""Per-second rates."""

from __future__ import annotations

from datetime import timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.functions.ranges import TimeRange


def is_row_change(event_type: str = "event_type") -> Column:
    return F.upper(event_type).isin("INSERT", "UPDATE", "DELETE")


def throughput_per_second(events: DataFrame) -> DataFrame:
    """Events (``qps``) and row changes (``tps``) of every second that has events."""
    return events.groupBy(F.date_trunc("second", "timestamp").alias("second")).agg(
        F.count(F.lit(1)).alias("qps"), F.count_if(is_row_change()).alias("tps")
    )


def throughput_series(events: DataFrame, rng: TimeRange) -> DataFrame:
    """Rates of every second of a range, zero where nothing happened."""
    first = int(rng.start.replace(tzinfo=timezone.utc).timestamp())
    seconds = events.sparkSession.range(first, first + rng.seconds + 1)
    rates = throughput_per_second(rng.apply(events))
    every = seconds.select(F.timestamp_seconds("id").alias("second"))
    return every.join(rates, "second", "left").select(
        "second", F.coalesce("qps", F.lit(0)).alias("qps"), F.coalesce("tps", F.lit(0)).alias("tps")
    )


COPY_KEY = ("seq", "target_name", "_content")


def with_content_key(events: DataFrame) -> DataFrame:
    """``events`` with ``_content``: null where ``seq`` tells events apart, else the SHA-256 of all columns."""
    whole = F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"})
    return events.withColumn("_content", F.when(F.col("seq").isNull(), F.sha2(whole, 256)))


def deduplicated_events(events: DataFrame) -> DataFrame:
    """Each event once per target, however often it was written. Events without ``seq`` are copies of each other only if
    all their columns are equal."""
    return with_content_key(events).dropDuplicates(list(COPY_KEY)).drop("_content")
