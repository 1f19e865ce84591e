"""Filters of the event and error lists. An empty value means no filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.functions.ranges import TimeRange

ALL_TIME = TimeRange()


def events_filtered(
    events: DataFrame,
    target: str = "",
    table: str = "",
    event_type: str = "",
    success: bool | None = None,
    rng: TimeRange = ALL_TIME,
) -> DataFrame:
    df = rng.apply(events)
    if target:
        df = df.where(F.col("target_name") == target)
    if table:
        df = df.where(F.col("table_name") == table)
    if event_type:
        df = df.where(F.lower("event_type") == event_type.lower())
    if success is not None:
        df = df.where(F.col("success") == int(success))
    return df


def errors_filtered(
    errors: DataFrame,
    level: str = "",
    target: str = "",
    table: str = "",
    keyword: str = "",
    rng: TimeRange = ALL_TIME,
) -> DataFrame:
    df = rng.apply(errors)
    if level:
        df = df.where(F.col("level") == level)
    if target:
        df = df.where(F.col("target_name") == target)
    if table:
        df = df.where(F.col("table_name") == table)
    if keyword:
        df = df.where(F.contains(F.col("message"), F.lit(keyword)))
    return df
