"""Display columns of the list pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Formats and units of the pages.
CLOCK = "HH:mm:ss"
DATE_CLOCK = "yyyy-MM-dd HH:mm:ss"
MESSAGE_LENGTH = 50
DAYS, HOURS, MINUTES = "天", "时", "分"


def table_label(target: Column | str = "target_name", table: Column | str = "table_name") -> Column:
    return F.concat_ws(".", target, table)


def position_label(file: str = "binlog_file", pos: str = "binlog_pos", gtid: str | None = None) -> Column:
    place = F.concat(F.col(file), F.lit(":"), F.col(pos).cast("string"))
    if gtid is None:
        return place
    return F.when(F.length(F.col(gtid)) > 0, F.concat(F.lit("GTID: "), F.col(gtid))).otherwise(place)


def message_label(message: Column | str = "message") -> Column:
    message = F.col(message) if isinstance(message, str) else message
    short = F.concat(F.substring(message, 1, MESSAGE_LENGTH), F.lit("..."))
    return F.when(F.char_length(message) > MESSAGE_LENGTH, short).otherwise(message)


def uptime_label(seconds: Column | str) -> Column:
    """``d h m`` parts of an uptime in seconds."""
    seconds = F.col(seconds) if isinstance(seconds, str) else seconds
    days = F.floor(seconds / 86400)
    hours = F.floor(seconds % 86400 / 3600)
    minutes = F.floor(seconds % 3600 / 60)
    parts = ((days, DAYS), (hours, HOURS), (minutes, MINUTES))
    return F.concat_ws(" ", *[F.concat(value.cast("string"), F.lit(unit)) for value, unit in parts])


def event_labels(events: DataFrame) -> DataFrame:
    """Text columns of the event list."""
    gtid = "gtid" if "gtid" in events.columns else None
    return events.select(
        "seq",
        table_label().alias("table_label"),
        position_label(gtid=gtid).alias("position_label"),
        F.date_format("timestamp", CLOCK).alias("clock"),
        F.date_format("timestamp", DATE_CLOCK).alias("date_clock"),
        F.upper("event_type").alias("type_label"),
        (F.col("success") == 1).alias("succeeded"),
    )


def error_labels(errors: DataFrame) -> DataFrame:
    """Text columns of the error list."""
    return errors.select(
        "seq",
        "level",
        table_label().alias("table_label"),
        F.date_format("timestamp", DATE_CLOCK).alias("date_clock"),
        message_label().alias("message_label"),
    )
