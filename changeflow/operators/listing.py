"""Pages, last-n lists and histories."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.functions.ranges import TimeRange

# Default page size and buffer sizes.
PAGE_SIZE = 20
MAX_EVENTS = 10_000
MAX_ERRORS = 1_000
# The most rows of a list that a task keeps at a time; rows that are drawn to find a place in a longer one, or are brought to
# the driver to find a page's end; and how far around the place's share of the drawn rows values are taken.
KEPT = 10_000
DRAWN = 1_000
AROUND = (-48, -16, 0, 16, 48)


def order_columns(df: DataFrame) -> list[str]:
    """Columns that order a list: time, ``seq``, then all others that can be ordered, so that only equal rows tie."""
    first = [c for c in ("timestamp", "seq") if c in df.columns]
    others = [f.name for f in df.schema.fields if f.name not in first and not isinstance(f.dataType, T.MapType)]
    return first + others


def _newest_first(df: DataFrame) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in order_columns(df)]


def newest(df: DataFrame, offset: int, size: int) -> DataFrame:
    """Rows ``offset .. offset + size`` in order of time, newest first and rows without a time last.

    Up to ``KEPT`` rows from the start, Spark keeps ``offset + size`` rows per task. Beyond, jobs find the first and the last
    row by counting, and the rows from one to the other are sorted by many tasks. ``page_after`` goes on from a row at any
    depth.
    """
    if offset + size <= KEPT:
        return df.orderBy(*_newest_first(df)).offset(offset).limit(size)
    return _stretch(df, offset, size).orderBy(*_newest_first(df))


def _literal(value, kind: T.DataType) -> Column:
    """A value that was collected; times may be microseconds."""
    if value is not None and isinstance(kind, T.StructType):
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields, strict=True)])
    if value is not None and isinstance(kind, T.ArrayType):
        return F.array(*[_literal(v, kind.elementType) for v in value]).cast(kind)
    if isinstance(kind, T.TimestampType) and isinstance(value, int):
        return F.timestamp_micros(F.lit(value))
    if value is not None and isinstance(kind, T.TimestampNTZType):
        return F.lit(str(value)).cast(kind)
    return F.lit(value).cast(kind)


def _readable(df: DataFrame, column: str) -> Column:
    """A column as it is collected: times in a form that no time zone of the driver changes."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.col(column).cast("string")
    return F.unix_micros(column) if isinstance(kind, T.TimestampType) else F.col(column)


def _equal(df: DataFrame, values: tuple) -> Column:
    """Rows with the given values of ``order_columns``."""
    columns = order_columns(df)
    same = [F.col(c).eqNullSafe(_literal(v, df.schema[c].dataType)) for c, v in zip(columns, values, strict=True)]
    return reduce(Column.__and__, same)


@dataclass(frozen=True)
class _Place:
    """A row in a list: its values of ``order_columns``, the rows before it, and those equal to it with itself."""

    values: tuple
    before: int
    same: int


def _values_around(rows: DataFrame, n: int, column: str, share: float) -> list:
    """A few values of a column of ``n`` rows, newest first, from a random sample around the given share of its order."""
    size = min(DRAWN, n)
    drawn = rows.select(F.col(column).alias("value")).orderBy(F.rand(1)).limit(size)
    at = F.row_number().over(Window.orderBy(F.col("value").desc_nulls_last()))
    wanted = {min(size, max(1, round(share * size) + d)) for d in AROUND}
    picked = drawn.withColumn("at", at).where(F.col("at").isin(*wanted)).select("at", _readable(drawn, "value").alias("value"))
    return [row.value for row in sorted(picked.collect(), key=lambda row: row.at)]


def _place(df: DataFrame, rank: int) -> _Place | None:
    """The row that ``rank`` rows precede; ``None`` past the end.

    Column by column, rows are counted around a few values, and those on the wrong side of a value are left aside until
    ``KEPT`` rows remain, or all that remain are equal. A job returns a few values and counts.
    """
    columns, rows, before, n = order_columns(df), df, 0, df.count()
    if rank >= n:
        return None
    known = 0  # columns that have one value in all remaining rows
    while n > KEPT and known < len(columns):
        column, kind = F.col(columns[known]), df.schema[columns[known]].dataType
        found = _values_around(rows, n, columns[known], (rank - before + 0.5) / n)
        if not found:
            raise RuntimeError("the rows of the list change from job to job")
        ahead = [column.isNotNull() if v is None else column > _literal(v, kind) for v in found]
        equal = [column.eqNullSafe(_literal(v, kind)) for v in found]
        counts = rows.select(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(ahead + equal)]).first()
        start, end, side = 0, n, []
        for i, (less, same) in enumerate(zip(counts[: len(found)], counts[len(found) :], strict=True)):
            if before + less > rank:
                end = less
                side.append(ahead[i])
                break
            start = less
            if before + less + same > rank:
                end = less + same
                side = [equal[i]]
                known += 1
                break
            start = less + same
            side = [] if found[i] is None else [(column < _literal(found[i], kind)) | column.isNull()]
        rows, before, n = reduce(DataFrame.where, side, rows), before + start, end - start
    shown = rows.select(*[_readable(rows, c).alias(f"v{i}") for i, c in enumerate(columns)])
    if known == len(columns):
        return _Place(tuple(shown.first()), before, n)
    order = [F.col(f"v{i}").desc_nulls_last() for i in range(len(columns))]
    values = tuple(shown.orderBy(*order).offset(rank - before).limit(1).first())
    last = rows.select(F.count_if(~_from(df, values)), F.count_if(_equal(df, values))).first()
    return _Place(values, before + last[0], last[1])


def _stretch(df: DataFrame, offset: int, size: int) -> DataFrame:
    """Rows ``offset .. offset + size`` of the order, in any order. Of equal rows at an end, as many as belong to it."""
    first, last = _place(df, offset) if offset else None, _place(df, offset + size - 1)
    if offset and first is None:
        return df.limit(0)
    if first and last and first.before == last.before:
        return df.where(_equal(df, first.values)).limit(size)
    time, rows, parts = order_columns(df)[0], df, []
    kind = df.schema[time].dataType
    if first:
        rest = first.before + first.same - offset
        rows = rows.where(_from(df, first.values))
        if first.values[0] is not None:  # bounds on the bare column reach the scan
            rows = rows.where((F.col(time) <= _literal(first.values[0], kind)) | F.col(time).isNull())
        if rest < first.same:
            rows = rows.where(~_equal(df, first.values))
            parts.append(df.where(_equal(df, first.values)).limit(rest))
    if last:
        rest = offset + size - last.before
        ahead = ~_from(df, last.values)
        rows = rows.where(ahead | _equal(df, last.values) if rest == last.same else ahead)
        if last.values[0] is not None:
            rows = rows.where(F.col(time) >= _literal(last.values[0], kind))
        if rest < last.same:
            parts.append(df.where(_equal(df, last.values)).limit(rest))
    return reduce(DataFrame.union, parts, rows)


def page(df: DataFrame, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """A page of a list, newest first; numbers start at 1."""
    number = number if number > 0 else 1
    size = size if size > 0 else PAGE_SIZE
    return newest(df, (number - 1) * size, size)


@dataclass(frozen=True)
class PageEnd:
    """Where a page ended: the last row's values of ``order_columns``, and how many rows equal to it were shown."""

    values: tuple
    shown: int


def page_end(rows: DataFrame, before: PageEnd | None = None) -> PageEnd | None:
    """The end of a page from ``page`` or ``page_after``; ``None`` if it has no row. ``before`` is the end of the page
    before it."""
    columns = order_columns(rows)
    most = rows._jdf.queryExecution().optimizedPlan().maxRows()
    if most.isDefined() and most.get() <= DRAWN:
        shown = rows.collect()
        if not shown:
            return None
        keys = [tuple(row[c] for c in columns) for row in shown]
        values, same = keys[-1], sum(1 for key in keys if key == keys[-1])
    else:  # nulls are least in a struct, so the least one is the last of the list
        last = rows.select(F.min(F.struct(*columns)).alias("last")).first().last
        if last is None:
            return None
        values = tuple(last)
        same = rows.where(_equal(rows, values)).count()
    return PageEnd(values, same + (before.shown if before and before.values == values else 0))


def _from(df: DataFrame, values: tuple) -> Column:
    """Rows that stand at or after a place in the order: newest first, nulls last."""
    columns = [F.col(c) for c in order_columns(df)]
    here = F.lit(True)
    for column, value, kind in reversed(list(zip(columns, values, [df.schema[c].dataType for c in order_columns(df)], strict=True))):
        at = _literal(value, kind)
        later = F.lit(False) if value is None else (column < at) | column.isNull()
        here = later | (column.eqNullSafe(at) & here)
    return here


def page_after(df: DataFrame, end: PageEnd, size: int = PAGE_SIZE) -> DataFrame:
    """The page that follows another: the same cost at any depth. No row is left out or shown twice, however many share
    their time, their number or all their values."""
    size, shown = size if size > 0 else PAGE_SIZE, end.shown
    rows = df.where(_from(df, end.values))
    if end.values[0] is not None:  # the bound on the bare column reaches the scan
        rows = rows.where((F.col("timestamp") <= F.lit(end.values[0])) | F.col("timestamp").isNull())
    if shown + size > KEPT and rows.where(_equal(df, end.values)).count() == shown:
        rows, shown = rows.where(~_equal(df, end.values)), 0
    return newest(rows, shown, size)


def all_pages(df: DataFrame, size: int) -> DataFrame:
    """Every row with the number of its ``page``, walked page by page as a reader would."""
    pages, end = [], None
    while True:
        rows = page(df, 1, size) if end is None else page_after(df, end, size)
        end = page_end(rows, end)
        if end is None:
            break
        pages.append(rows.withColumn("page", F.lit(len(pages) + 1)))
    return reduce(DataFrame.union, pages) if pages else df.limit(0).withColumn("page", F.lit(0))


def total(df: DataFrame) -> DataFrame:
    """Number of rows of a list."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def last_n(df: DataFrame, n: int = MAX_EVENTS) -> DataFrame:
    """The last ``n`` records, oldest first."""
    return newest(df, 0, n).orderBy("timestamp", "seq")


def position_history(positions: DataFrame, target: str, rng: TimeRange) -> DataFrame:
    df = rng.apply(positions).where(F.col("target_name") == target)
    return df.orderBy("timestamp", "seq").select("timestamp", "binlog_file", "binlog_pos", "delay_seconds")


def metric_history(metrics: DataFrame, name: str, rng: TimeRange) -> DataFrame:
    df = rng.apply(metrics).where(F.col("metric_name") == name)
    return df.orderBy("timestamp", "seq").select("timestamp", "metric_name", "metric_value")


def latency_history(positions: DataFrame, rng: TimeRange, target: str = "") -> DataFrame:
    df = rng.apply(positions)
    if target:
        df = df.where(F.col("target_name") == target)
    return df.orderBy("timestamp", "seq").select(
        "timestamp", F.lit("latency").alias("metric_name"), F.col("delay_seconds").cast("double").alias("metric_value")
    )
