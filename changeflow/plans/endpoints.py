"""The read endpoints over stored monitoring tables, each with its default range.

Every method returns DataFrames. ``as_of`` is the current time; it is given, so that
the same call gives the same answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from changeflow.functions.ranges import LAST_7_DAYS, LAST_HOUR, Moment, TimeRange
from changeflow.operators import filters, listing, stats
from changeflow.plans import status
from changeflow.plans.summaries import MonitorSummaries
from changeflow.schemas import POSITION_TARGET
from changeflow.sources.monitor_tables import read_monitor
from changeflow.targets import TargetConfig, registered_targets


class MonitorEndpoints:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        targets: Sequence[TargetConfig],
        started: Moment,
        switches: DataFrame | None = None,
        service: str = status.RUNNING,
        rates: DataFrame | None = None,
        summaries: MonitorSummaries | None = None,
    ):
        """``root`` holds the monitoring tables, ``started`` is the start of the service,
        ``switches`` the status changes made by hand, ``service`` the state of the service, ``rates`` the events of each
        second (``second``, ``qps``, ``tps``) as a stream keeps them; with ``summaries``, no answer about the newest rows reads
        history that they cover."""
        self.summaries = summaries
        self.spark, self.root, self.configs = spark, root, targets
        self.started, self.switches, self.service, self.rates = started, switches, service, rates

    def _table(self, table: str) -> DataFrame:
        return read_monitor(self.spark, self.root, table)

    @property
    def _events(self) -> DataFrame:
        return self._table("sync_events")

    @property
    def _errors(self) -> DataFrame:
        return self._table("sync_errors")

    @property
    def _positions(self) -> DataFrame:
        return self._table("sync_positions")

    def _newest(self, table: str) -> DataFrame:
        """The newest rows of a table, or all of it."""
        return self._table(table) if self.summaries is None else self.summaries.newest(table)

    def _live(self, as_of: Moment) -> DataFrame:
        live = status.live_status(self._newest("sync_positions"), self.started, as_of, self.service)
        return live if self.rates is None else status.with_live_rates(live, self.rates, as_of)

    def _target_status(self) -> DataFrame:
        changes = status.status_changes(self._newest("sync_events"), self.switches)
        return status.target_status(registered_targets(self.spark, self.configs), changes)

    def status(self, as_of: Moment) -> DataFrame:
        return status.service_status(self._live(as_of), self._events, self._target_status(), as_of)

    def health(self, as_of: Moment) -> DataFrame:
        return status.health(self._live(as_of), self._target_status())

    def metrics(self, as_of: Moment) -> DataFrame:
        return status.metrics_24h(self._live(as_of), self._events, self._errors, self._target_status(), as_of)

    def metrics_history(self, name: str, as_of: Moment, start: Moment = None, end: Moment = None) -> DataFrame:
        return listing.metric_history(
            self._table("sync_metrics"), name, TimeRange.resolve(as_of, LAST_HOUR, start, end)
        )

    def events(
        self,
        target: str = "",
        table: str = "",
        event_type: str = "",
        success: bool | None = None,
        start: Moment = None,
        end: Moment = None,
        page: int = 1,
        size: int = listing.PAGE_SIZE,
    ) -> tuple[DataFrame, DataFrame]:
        """A page of events, and the number of all that match."""
        rows = filters.events_filtered(self._events, target, table, event_type, success, TimeRange.of(start, end))
        return listing.page(rows, page, size), listing.total(rows)

    def events_stats(self, as_of: Moment, start: Moment = None, end: Moment = None) -> DataFrame:
        return stats.event_stats(self._events, self._errors, TimeRange.resolve(as_of, LAST_7_DAYS, start, end))

    def errors(
        self,
        level: str = "",
        target: str = "",
        table: str = "",
        keyword: str = "",
        start: Moment = None,
        end: Moment = None,
        page: int = 1,
        size: int = listing.PAGE_SIZE,
    ) -> tuple[DataFrame, DataFrame]:
        """A page of errors, and the number of all that match."""
        rows = filters.errors_filtered(self._errors, level, target, table, keyword, TimeRange.of(start, end))
        return listing.page(rows, page, size), listing.total(rows)

    def errors_stats(self, as_of: Moment, start: Moment = None, end: Moment = None) -> tuple[DataFrame, DataFrame]:
        """Errors by level, target and table, and the totals."""
        rng = TimeRange.resolve(as_of, LAST_7_DAYS, start, end)
        return stats.error_stats(self._errors, rng), stats.error_totals(self._errors, rng)

    def position(self, target: str | None = POSITION_TARGET) -> DataFrame:
        return stats.current_position(self._newest("sync_positions"), target)

    def position_history(
        self, as_of: Moment, target: str = POSITION_TARGET, start: Moment = None, end: Moment = None
    ) -> DataFrame:
        return listing.position_history(self._positions, target, TimeRange.resolve(as_of, LAST_HOUR, start, end))

    def latency(self, as_of: Moment, target: str = "", start: Moment = None, end: Moment = None) -> DataFrame:
        rng = TimeRange.resolve(as_of, LAST_HOUR, start, end)
        if self.summaries is None:
            return stats.latency_stats(self._positions, rng, target)
        return stats.latency_from_histogram(self.summaries.delays(rng), self._positions, rng, target)

    def latency_history(self, as_of: Moment, target: str = "", start: Moment = None, end: Moment = None) -> DataFrame:
        return listing.latency_history(self._positions, TimeRange.resolve(as_of, LAST_HOUR, start, end), target)

    def targets(self, as_of: Moment) -> DataFrame:
        """Registered targets with the figures of 7 days; without any, the names found in events."""
        newest = None if self.summaries is None else self._newest("sync_events")
        if self.configs:
            return status.target_listing(self._target_status(), self._events, self._errors, as_of, newest)
        return status.target_listing_from_events(self._events, self._errors, as_of, newest)
