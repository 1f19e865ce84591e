"""Aggregations over the monitoring tables."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeflow.functions.names import target_aliases
from changeflow.functions.ranges import TimeRange

# Percentiles of the latency report.
P95, P99 = 0.95, 0.99

# Delays per bucket of the percentile histogram: delays of 32 bits give at most
# 65,536 buckets of 65,536 delays, so neither running sum sees more rows than that.
DELAY_BUCKET = 1 << 16


def _count() -> Column:
    return F.count(F.lit(1))


def _long(column: Column, default: int | None = 0) -> Column:
    return (column if default is None else F.coalesce(column, F.lit(default))).cast("bigint")


def order_number() -> Column:
    """Place of a record in time as one number: its time, then its ``seq``, what is missing first. Unlike a struct, it can be
    compared in a hash aggregate."""
    micros = F.coalesce(F.unix_micros(F.col("timestamp").cast("timestamp")), F.lit(-(1 << 62))).cast("decimal(38,0)")
    step = F.lit("10000000000000000000").cast("decimal(20,0)")
    return (micros.cast("decimal(19,0)") * step).cast("decimal(38,0)") + F.coalesce("seq", F.lit(-1)).cast("decimal(20,0)")


def event_stats_by_type(events: DataFrame, rng: TimeRange) -> DataFrame:
    """One row per type, types compared in upper case."""
    return (
        rng.apply(events)
        .groupBy(F.upper("event_type").alias("event_type"))
        .agg(
            _count().alias("event_count"),
            F.sum("rows_count").alias("total_rows"),
            F.avg("duration_ms").alias("avg_duration"),
            F.max("duration_ms").alias("max_duration"),
        )
    )


def event_stats(events: DataFrame, errors: DataFrame, rng: TimeRange) -> DataFrame:
    """One row: events by type, rows, errors, duration average (whole ms), maximum and minimum.

    Events and errors meet as one stream of narrow rows, so this is one aggregation.
    """
    narrow = rng.apply(events).select(F.upper("event_type").alias("type"), "rows_count", "duration_ms")
    failed = rng.apply(errors).select(
        F.lit("").alias("type"), F.lit(None).cast("bigint").alias("rows_count"), F.lit(None).cast("bigint").alias("duration_ms")
    )
    both = narrow.withColumn("failed", F.lit(0)).unionByName(failed.withColumn("failed", F.lit(1)))

    def of_type(name: str) -> Column:
        return F.count_if((F.col("failed") == 0) & (F.col("type") == name))

    return both.agg(
        of_type("INSERT").alias("total_insert"),
        of_type("UPDATE").alias("total_update"),
        of_type("DELETE").alias("total_delete"),
        _long(F.sum("rows_count")).alias("total_rows"),
        F.count_if(F.col("failed") == 1).alias("total_errors"),
        _long(F.floor(F.avg("duration_ms"))).alias("avg_duration"),
        _long(F.max("duration_ms")).alias("max_duration"),
        _long(F.min("duration_ms")).alias("min_duration"),
    )


def event_type_share(events: DataFrame, rng: TimeRange) -> DataFrame:
    """Share of each event type in the range."""
    counts = rng.apply(events).groupBy(F.upper("event_type").alias("event_type")).agg(_count().alias("n"))
    whole = F.sum("n").over(Window.partitionBy())  # one row per type
    return counts.select("event_type", "n", (F.col("n") / whole).alias("share"))


def _delay_ranks(delays: DataFrame, times: Column | None = None) -> DataFrame:
    """Distinct delays with their count ``c``, the rows up to each delay and all rows ``n``. A row counts once or, with
    ``times``, so many times."""
    bucket = F.floor(F.col("delay_seconds") / DELAY_BUCKET).cast("bigint")
    counted = delays.groupBy(bucket.alias("bucket"), "delay_seconds").agg((_count() if times is None else F.sum(times)).alias("c"))
    buckets = counted.groupBy("bucket").agg(F.sum("c").alias("in_bucket"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    starts = buckets.select(
        F.col("bucket").alias("_bucket"),
        F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("before"),
        F.sum("in_bucket").over(Window.partitionBy()).alias("n"),
    )
    inside = F.sum("c").over(Window.partitionBy("bucket").orderBy("delay_seconds"))
    return (
        counted.withColumn("inside", inside)
        .join(starts, F.col("bucket").eqNullSafe(F.col("_bucket")))  # no null filter, so one scan serves both sides
        .select("delay_seconds", "c", (F.col("before") + F.col("inside")).alias("upto"), "n")
    )


def latency_stats(positions: DataFrame, rng: TimeRange, target: str = "") -> DataFrame:
    """One row: average, maximum, minimum, current, P95 and P99 delay; zeros for an empty range.

    A percentile is the delay at rank ``floor(count * p)``, at least 1, in ascending
    order. Everything but the current delay comes from the counts per distinct delay.
    """
    rows = rng.apply(positions)
    if target:
        rows = rows.where(F.col("target_name") == target)
    rows = rows.where("delay_seconds is not null")
    current = rows.agg(F.max_by("delay_seconds", order_number()).alias("current")).scalar()
    return _latency_figures(_delay_ranks(rows.select("delay_seconds")), current)


def _latency_figures(ranks: DataFrame, current: Column) -> DataFrame:
    rank = {p: F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(p))) for p in (P95, P99)}

    def at(p: float) -> Column:
        return _long(F.min(F.when(F.col("upto") >= rank[p], F.col("delay_seconds"))))

    figures = ranks.agg(
        F.coalesce(F.sum(F.col("c") * F.col("delay_seconds")) / F.sum("c"), F.lit(0.0)).alias("avg_delay"),
        _long(F.max("delay_seconds")).alias("max_delay"),
        _long(F.min("delay_seconds")).alias("min_delay"),
        at(P95).alias("p95_delay"),
        at(P99).alias("p99_delay"),
    )
    return figures.withColumn("current_delay", _long(current))


DELAY_HISTOGRAM_KEYS = ("hour", "target_name", "delay_seconds")


def delay_histogram(positions: DataFrame) -> DataFrame:
    """Exact delay histogram of each hour and target: how often a delay occurs (``n``) and the last place where it does.

    Unlike percentiles, histograms can be added up, so those of hours give the percentiles of any range of hours.
    """
    hour = F.date_trunc("hour", "timestamp").alias("hour")
    rows = positions.where("delay_seconds is not null")
    return rows.groupBy(hour, *DELAY_HISTOGRAM_KEYS[1:]).agg(_count().alias("n"), F.max(order_number()).alias("last_place"))


def merge_delay_histogram(partial: DataFrame) -> DataFrame:
    """Histogram of partial histograms."""
    return partial.groupBy(*DELAY_HISTOGRAM_KEYS).agg(F.sum("n").alias("n"), F.max("last_place").alias("last_place"))


def whole_hours(rng: TimeRange) -> tuple[TimeRange | None, list[TimeRange]]:
    """The whole hours of a range, and what is left of it at its ends. Times are whole seconds; both ends belong to a range."""
    cut = lambda t: t.replace(minute=0, second=0, microsecond=0)
    first, stop = rng.start, rng.end
    if first is not None and first != cut(first):
        first = cut(first) + timedelta(hours=1)
    if stop is not None:
        stop = cut(stop)
    if first is not None and stop is not None and first >= stop:
        return None, [rng]
    second = timedelta(seconds=1)
    ends = [] if first == rng.start else [TimeRange(rng.start, first - second)]
    ends += [] if stop is None else [TimeRange(stop, rng.end)]
    return TimeRange(first, None if stop is None else stop - second), ends


def latency_from_histogram(histogram: DataFrame, positions: DataFrame, rng: TimeRange, target: str = "") -> DataFrame:
    """Same row as ``latency_stats``: whole hours come from their histograms, only the hours that the range cuts from
    ``positions``."""
    hours, ends = whole_hours(rng)
    parts = [delay_histogram(end.apply(positions)) for end in ends]
    if hours is not None:
        parts.append(hours.apply(histogram, "hour").select(*parts[0].columns) if parts else hours.apply(histogram, "hour"))
    rows = reduce(DataFrame.unionByName, parts)
    if target:
        rows = rows.where(F.col("target_name") == target)
    current = rows.agg(F.max_by("delay_seconds", "last_place").alias("current")).scalar()
    return _latency_figures(_delay_ranks(rows.select("delay_seconds", "n"), F.col("n")), current)


def _errors_by_place(errors: DataFrame, rng: TimeRange) -> DataFrame:
    return rng.apply(errors).groupBy("level", "target_name", "table_name").agg(_count().alias("n"))


def error_stats(errors: DataFrame, rng: TimeRange) -> DataFrame:
    """Errors by level, by target and by table, as rows ``(dimension, key, n)``.

    The rows are counted once per combination; the three breakdowns expand only those counts.
    """
    counts = _errors_by_place(errors, rng)
    columns = ["level", "target_name", "table_name"]
    sets = counts.groupingSets([[c] for c in columns], *columns).agg(
        F.sum("n").alias("n"), *[F.grouping(c).alias(f"_{c}") for c in columns]
    )
    dimension = F.when(F.col("_level") == 0, "level").when(F.col("_target_name") == 0, "target").otherwise("table")
    key = (
        F.when(F.col("_level") == 0, F.col("level"))
        .when(F.col("_target_name") == 0, F.col("target_name"))
        .otherwise(F.col("table_name"))
    )
    return sets.select(dimension.alias("dimension"), key.alias("key"), "n")


def error_totals(errors: DataFrame, rng: TimeRange) -> DataFrame:
    return rng.apply(errors).agg(
        F.count_if(F.col("level") == "ERROR").alias("total_errors"),
        F.count_if(F.col("level") == "WARNING").alias("total_warnings"),
    )


def known_targets(events: DataFrame) -> DataFrame:
    """Target names that occur in events, sorted."""
    return events.where("target_name != ''").select("target_name").distinct().orderBy("target_name")


def alias_pairs(names: DataFrame) -> DataFrame:
    """One row per target ``name`` and each ``alias`` under which it occurs in history."""
    return names.select("name", F.explode(target_aliases("name")).alias("alias"))


def target_stats(
    events: DataFrame, errors: DataFrame, names: DataFrame, rng: TimeRange, newest: DataFrame | None = None
) -> DataFrame:
    """Events and errors in the range and the time of the last event ever, per target ``name``
    (one row each in ``names``).

    Events and errors are counted per recorded name first; only those few rows meet the aliases. With ``newest``, a summary
    of all events (``target_name``, ``timestamp``), only the range is read.
    """
    alias = F.col("target_name").alias("alias")
    if newest is None:
        seen = events.groupBy(alias).agg(F.count_if(rng.contains("timestamp")).alias("events"), F.max("timestamp").alias("last"))
    else:
        counted = rng.apply(events).groupBy(alias).agg(_count().alias("events"))
        seen = newest.groupBy(alias).agg(F.max("timestamp").alias("last")).join(counted, "alias", "left")
    failed = rng.apply(errors).groupBy(F.col("target_name").alias("alias")).agg(_count().alias("errors"))
    return (
        alias_pairs(names)
        .join(seen, "alias", "left")
        .join(failed, "alias", "left")
        .groupBy("name")
        .agg(
            _long(F.sum("events")).alias("total_events"),
            _long(F.sum("errors")).alias("total_errors"),
            F.max("last").alias("last_sync_time"),
        )
    )


def newest_rows(df: DataFrame, keys: list[str], columns: list[str], times: Column | None = None) -> DataFrame:
    """The newest row of each of few ``keys``: their places by a hash aggregate over all rows, then only the rows that stand
    there. Of rows that share a place the one with the greatest ``columns`` counts. ``n_rows`` counts each row once or, with
    ``times``, so many times."""
    placed = df.withColumn("_place", order_number())
    n = _count() if times is None else F.sum(times)
    last = placed.groupBy(*keys).agg(F.max("_place").alias("_last"), n.alias("_n"))
    same = [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys]
    found = placed.join(last.withColumnsRenamed({k: f"_{k}" for k in keys}), [*same, F.col("_place") == F.col("_last")])
    best = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in columns])
    return found.withColumn("_best", F.row_number().over(best)).where("_best = 1").select(*keys, *columns, F.col("_n").alias("n_rows"))


def target_error_totals(errors: DataFrame, registered: DataFrame) -> DataFrame:
    """Error count and last message of every registered target with errors."""
    return error_totals_of_newest(newest_rows(errors, ["target_name"], ["message"]), registered)


def error_totals_of_newest(last: DataFrame, registered: DataFrame) -> DataFrame:
    """The same from the newest error of each target (``target_name``, ``message``, ``n_rows``)."""
    return registered.join(last, F.col("name") == F.col("target_name")).select(
        "name", F.col("n_rows").alias("total_errors"), F.col("message").alias("last_error")
    )


def recent_throughput(events: DataFrame, rng: TimeRange) -> DataFrame:
    """Row changes per second in a range, 5 minutes by default: the fallback for both live rates."""
    changes = F.count_if(F.upper("event_type").isin("INSERT", "UPDATE", "DELETE"))
    rate = changes / F.lit(float(rng.seconds))
    return rng.apply(events).agg(rate.alias("qps"), rate.alias("tps"))


POSITION_COLUMNS = ("timestamp", "binlog_file", "binlog_pos", "gtid", "delay_seconds")


def current_position(positions: DataFrame, target: str | None = None) -> DataFrame:
    """The last saved position of each target."""
    df = positions if target is None else positions.where(F.col("target_name") == target)
    columns = [c for c in POSITION_COLUMNS if c in df.columns]
    return newest_rows(df, ["target_name"], columns).drop("n_rows")


HOURLY_EVENTS_KEYS = ("hour", "target_name", "table_name", "event_type")
HOURLY_LATENCY_KEYS = ("hour", "target_name")


def event_sums() -> list[Column]:
    """Figures of the hourly event rollup: sums and counts, so partial rollups can be merged."""
    return [
        _count().alias("event_count"),
        F.sum("rows_count").alias("total_rows"),
        F.sum("duration_ms").alias("sum_duration"),
        F.max("duration_ms").alias("max_duration"),
        F.sum("success").cast("bigint").alias("success_count"),
    ]


def delay_sums() -> list[Column]:
    """Figures of the hourly delay rollup."""
    return [
        _count().alias("samples"),
        F.sum("delay_seconds").alias("sum_delay"),
        F.max("delay_seconds").alias("max_delay"),
        F.min("delay_seconds").alias("min_delay"),
    ]


def events_hourly(events: DataFrame) -> DataFrame:
    """Hourly event rollup."""
    hour = F.date_trunc("hour", "timestamp").alias("hour")
    return events.groupBy(hour, *HOURLY_EVENTS_KEYS[1:]).agg(*event_sums())


def merge_events_hourly(partial: DataFrame) -> DataFrame:
    """Rollup of partial event rollups."""
    sums = [F.sum(c).alias(c) for c in ("event_count", "total_rows", "sum_duration", "success_count")]
    return partial.groupBy(*HOURLY_EVENTS_KEYS).agg(*sums, F.max("max_duration").alias("max_duration"))


def read_events_hourly(rollup: DataFrame) -> DataFrame:
    return rollup.withColumn("avg_duration", F.col("sum_duration") / F.col("event_count"))


def latency_hourly(positions: DataFrame) -> DataFrame:
    """Hourly delay rollup."""
    hour = F.date_trunc("hour", "timestamp").alias("hour")
    return positions.groupBy(hour, *HOURLY_LATENCY_KEYS[1:]).agg(*delay_sums())


def merge_latency_hourly(partial: DataFrame) -> DataFrame:
    """Rollup of partial delay rollups."""
    return partial.groupBy(*HOURLY_LATENCY_KEYS).agg(
        F.sum("samples").alias("samples"),
        F.sum("sum_delay").alias("sum_delay"),
        F.max("max_delay").alias("max_delay"),
        F.min("min_delay").alias("min_delay"),
    )


def read_latency_hourly(rollup: DataFrame) -> DataFrame:
    return rollup.withColumn("avg_delay", F.col("sum_delay") / F.col("samples"))
