"""Summaries of the monitoring tables from which status, target lists and delays are shown without reading all history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.functions.ranges import TimeRange
from changeflow.operators.stats import DELAY_HISTOGRAM_KEYS, POSITION_COLUMNS, delay_histogram, merge_delay_histogram, newest_rows
from changeflow.sources.monitor_tables import monitor_table
from changeflow.summary import Summarise, Summary

# newest rows kept of each table: by which columns, and what of them
NEWEST = {
    "sync_events": (["target_name", "success"], ["timestamp", "seq"]),
    "sync_errors": (["target_name"], ["timestamp", "seq", "message"]),
    "sync_positions": (["target_name"], ["timestamp", "seq", *POSITION_COLUMNS[1:]]),
}
DELAYS = "delays"


def _newest(table: str) -> tuple[Summarise, Summarise]:
    keys, columns = NEWEST[table]
    return (
        lambda rows: newest_rows(rows, keys, columns),
        lambda parts: newest_rows(parts, keys, columns, F.col("n_rows")),
    )


class MonitorSummaries:
    """Newest rows by target, and delay histograms by hour, of the monitoring tables below ``root``; kept below ``path``.

    ``refresh`` is a plain job. Between two refreshes readers summarise what is new themselves, so results are never behind.
    """

    def __init__(self, spark: SparkSession, root: str, path: str):
        tables = {name: monitor_table(spark, root, name) for name in NEWEST}
        self._kept = {name: Summary(table, f"{path}/{name}", *_newest(name)) for name, table in tables.items()}
        self._kept[DELAYS] = Summary(
            tables["sync_positions"], f"{path}/{DELAYS}", delay_histogram, merge_delay_histogram, DELAY_HISTOGRAM_KEYS
        )

    def refresh(self) -> None:
        for table in NEWEST:
            self.refresh_table(table)

    def refresh_table(self, table: str) -> None:
        """Cover what is new in one table."""
        self._kept[table].refresh()
        if table == "sync_positions":
            self._kept[DELAYS].refresh()

    def newest(self, table: str) -> DataFrame:
        """Newest row of each target (of events: each target and outcome), with ``n_rows``."""
        return self._kept[table].read()

    def delays(self, rng: TimeRange = TimeRange()) -> DataFrame:
        """Delay histograms of the months of a range."""
        return self._kept[DELAYS].read(_months(rng))

    def uncovered(self, table: str) -> list[str]:
        """Files of a table, or of the delays, that the next reader has to read."""
        return self._kept[table].uncovered()


def _months(rng: TimeRange) -> Callable[[str], bool]:
    first = rng.start.strftime("%Y%m") if rng.start else ""
    last = rng.end.strftime("%Y%m") if rng.end else "~"
    return lambda month: first <= month <= last
