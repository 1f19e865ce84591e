"""Time ranges. Both ends belong to a range; the current time is always given by the caller."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.schemas import MONTH

# Default ranges of the endpoints.
LAST_5_MINUTES = timedelta(minutes=5)
LAST_HOUR = timedelta(hours=1)
LAST_DAY = timedelta(hours=24)
LAST_7_DAYS = timedelta(days=7)

Moment = datetime | str | int | None


def moment(value: Moment) -> datetime | None:
    """UTC time from a datetime, ISO text or Unix seconds; ``None``, ``0`` and ``''`` mean not given."""
    if not value:
        return None
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if isinstance(value, (int, float)):
        return datetime.fromtimestamp(value, timezone.utc).replace(tzinfo=None)
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return value


def timestamp(value: datetime) -> Column:
    """A timestamp literal whose value does not depend on the session time zone."""
    seconds = int(value.replace(tzinfo=timezone.utc, microsecond=0).timestamp())
    return F.timestamp_seconds(F.lit(seconds))


@dataclass(frozen=True)
class TimeRange:
    start: datetime | None = None
    end: datetime | None = None

    @classmethod
    def of(cls, start: Moment = None, end: Moment = None) -> TimeRange:
        return cls(moment(start), moment(end))

    @classmethod
    def resolve(cls, as_of: Moment, default: timedelta, start: Moment = None, end: Moment = None) -> TimeRange:
        """Missing end: ``as_of``. Missing start: ``default`` before the end."""
        last = moment(end) or moment(as_of)
        return cls(moment(start) or last - default, last)

    @classmethod
    def today(cls, as_of: Moment) -> TimeRange:
        """From 00:00:00 of the day of ``as_of`` to 23:59:59 of the next day."""
        midnight = moment(as_of).replace(hour=0, minute=0, second=0, microsecond=0)
        return cls(midnight, midnight + timedelta(days=2, seconds=-1))

    @property
    def seconds(self) -> int:
        return int((self.end - self.start).total_seconds())

    def contains(self, column: Column | str) -> Column:
        column = F.col(column) if isinstance(column, str) else column
        condition = F.lit(True)
        if self.start is not None:
            condition = condition & (column >= timestamp(self.start))
        if self.end is not None:
            condition = condition & (column <= timestamp(self.end))
        return condition

    def apply(self, df: DataFrame, column: str = "timestamp") -> DataFrame:
        """Rows of the range; months outside it are pruned when the table is split by month."""
        if MONTH in df.columns:
            month = F.col(MONTH).cast(T.IntegerType())
            if self.start is not None:
                df = df.where(month >= int(self.start.strftime("%Y%m")))
            if self.end is not None:
                df = df.where(month <= int(self.end.strftime("%Y%m")))
        if self.start is None and self.end is None:
            return df
        return df.where(self.contains(column))
