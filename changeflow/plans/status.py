"""Service status, health, metrics and target lists."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeflow.functions.ranges import LAST_5_MINUTES, LAST_7_DAYS, LAST_DAY, Moment, TimeRange, moment, timestamp
from changeflow.operators.stats import event_stats, order_number, recent_throughput, target_stats

# Delay limits in seconds, states and messages of the health report.
DELAY_WARNING = 60
DELAY_ERROR = 300
RUNNING = "running"
CONNECTED = "connected"
DEFAULT_KIND = "clickhouse"
BAD_TARGET = ("error", "disconnected")
MESSAGE_LATENCY = "延迟正常"
MESSAGE_TARGETS = "所有目标正常"


def with_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row, as a scalar subquery."""
    names = one_row.columns
    packed = one_row.select(F.struct(*names)).scalar()
    return df.withColumn("_one", packed).select(*df.columns, *[F.col(f"_one.{n}").alias(n) for n in names])


def live_status(positions: DataFrame, started: Moment, as_of: Moment, status: str = RUNNING) -> DataFrame:
    """One row: newest position and delay, and the uptime in whole seconds."""
    uptime = int((moment(as_of) - moment(started)).total_seconds())
    newest = positions.orderBy(order_number().desc(), F.col("binlog_file").desc_nulls_last(), F.col("binlog_pos").desc_nulls_last()).limit(1)
    last = newest.select(F.struct("binlog_file", "binlog_pos", "delay_seconds")).scalar()
    return positions.sparkSession.range(1).withColumn("last", last).select(
        F.lit(status).alias("status"),
        F.coalesce("last.binlog_file", F.lit("")).alias("binlog_file"),
        F.coalesce("last.binlog_pos", F.lit(0)).cast("bigint").alias("binlog_pos"),
        F.coalesce("last.delay_seconds", F.lit(0)).cast("bigint").alias("delay_seconds"),
        F.lit(uptime).cast("bigint").alias("uptime"),
    )


def with_live_rates(live: DataFrame, rates: DataFrame, as_of: Moment) -> DataFrame:
    """``live`` with the rates (``second``, ``qps``, ``tps``) of the last full second before ``as_of``, 0 if it has none."""
    last = timestamp(moment(as_of) - timedelta(seconds=1))
    found = rates.where(F.col("second") == last).agg(F.max("qps").alias("qps"), F.max("tps").alias("tps"))
    figure = lambda c: F.coalesce(c, F.lit(0)).cast("double").alias(c)
    return with_one_row(live, found.select(figure("qps"), figure("tps")))


def target_status(registered: DataFrame, changes: DataFrame) -> DataFrame:
    """Status of every registered target: the last change in ``changes``
    (``seq``, ``timestamp``, ``target_name``, ``status``), else ``connected``.

    Changes are first reduced by hashing to one row per target and status.
    """
    per_status = changes.groupBy("target_name", "status").agg(F.max(order_number()).alias("place"), F.max("timestamp").alias("timestamp"))
    newest = Window.partitionBy("target_name").orderBy(F.col("place").desc(), F.col("status").desc())
    last = per_status.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1")
    last = last.select("target_name", F.col("status").alias("last_status"), "timestamp")
    joined = registered.join(last, registered["name"] == last["target_name"], "left")
    return joined.select(
        "name",
        "type",
        F.coalesce("last_status", F.lit(CONNECTED)).alias("status"),
        "is_enabled",
        F.col("timestamp").alias("last_sync_time"),
    )


def status_changes(events: DataFrame, switches: DataFrame | None = None) -> DataFrame:
    """Status changes: every successful event connects its target, and ``switches``
    (``seq``, ``timestamp``, ``target_name``, ``status``) adds those made by hand."""
    connected = events.where("success = 1").select(
        "seq", "timestamp", "target_name", F.lit(CONNECTED).alias("status")
    )
    return connected if switches is None else connected.unionByName(switches)


def service_status(live: DataFrame, events: DataFrame, targets: DataFrame, as_of: Moment) -> DataFrame:
    """Status page: one row per target, the service columns repeated.

    ``live`` may carry ``qps`` and ``tps``; without them, or when both are 0, the
    rate of the last 5 minutes is shown.
    """
    recent = recent_throughput(events, TimeRange.resolve(as_of, LAST_5_MINUTES))
    service = with_one_row(live, recent.select(F.col("qps").alias("_qps"), F.col("tps").alias("_tps")))
    if {"qps", "tps"} <= set(live.columns):
        idle = (F.col("qps") == 0) & (F.col("tps") == 0)
        service = service.withColumns(
            {"qps": F.when(idle, F.col("_qps")).otherwise(F.col("qps")), "tps": F.when(idle, F.col("_tps")).otherwise(F.col("tps"))}
        ).drop("_qps", "_tps")
    else:
        service = service.withColumnsRenamed({"_qps": "qps", "_tps": "tps"})
    service = service.withColumnRenamed("status", "service_status")
    return with_one_row(targets, service)


def health(live: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per check, each with the overall status."""
    bad = targets.agg(F.count_if(F.col("status").isin(*BAD_TARGET)).alias("bad"))
    one = with_one_row(live, bad)
    delay = F.col("delay_seconds")
    service = F.when(F.col("status") == RUNNING, "ok").otherwise("error")
    latency = F.when(delay > DELAY_ERROR, "error").when(delay > DELAY_WARNING, "warning").otherwise("ok")
    target = F.when(F.col("bad") > 0, "error").otherwise("ok")

    def check(name: str, status: Column, message: Column) -> Column:
        return F.struct(F.lit(name).alias("check_name"), status.alias("check_status"), message.alias("message"))

    checks = F.array(
        check("service", service, F.col("status")),
        check("latency", latency, F.lit(MESSAGE_LATENCY)),
        check("targets", target, F.lit(MESSAGE_TARGETS)),
    )
    states = F.array(service, latency, target)
    overall = (
        F.when(F.array_contains(states, "error"), "unhealthy")
        .when(F.array_contains(states, "warning"), "degraded")
        .otherwise("healthy")
    )
    return one.select(overall.alias("overall"), F.inline(checks))


def metrics_24h(live: DataFrame, events: DataFrame, errors: DataFrame, targets: DataFrame, as_of: Moment) -> DataFrame:
    """Status page with the event figures of the last 24 hours."""
    stats = event_stats(events, errors, TimeRange.resolve(as_of, LAST_DAY))
    return with_one_row(service_status(live, events, targets, as_of), stats)


def target_listing(
    registered: DataFrame, events: DataFrame, errors: DataFrame, as_of: Moment, newest: DataFrame | None = None
) -> DataFrame:
    """Registered targets with the figures of the last 7 days. ``newest`` is a summary of all events."""
    rng = TimeRange.resolve(as_of, LAST_7_DAYS)
    status = [] if "status" not in registered.columns else ["status"]
    base = registered.select("name", "type", *status, "is_enabled")
    listing = base.join(target_stats(events, errors, base, rng, newest), "name", "left")
    if not status:
        listing = listing.withColumn("status", F.lit(CONNECTED))
    return listing.select("name", "type", "status", "is_enabled", "total_events", "total_errors", "last_sync_time")


def target_listing_from_events(
    events: DataFrame, errors: DataFrame, as_of: Moment, newest: DataFrame | None = None
) -> DataFrame:
    """The same list for names found in events, when no target is registered."""
    named = events if newest is None else newest
    names = named.where("target_name != ''").select(F.col("target_name").alias("name")).distinct()
    figures = target_stats(events, errors, names, TimeRange.resolve(as_of, LAST_7_DAYS), newest)
    return figures.select(
        "name",
        F.lit(DEFAULT_KIND).alias("type"),
        F.lit(CONNECTED).alias("status"),
        F.lit(True).alias("is_enabled"),
        "total_events",
        "total_errors",
        "last_sync_time",
    )
