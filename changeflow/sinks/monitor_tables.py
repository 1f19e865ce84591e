"""Writing, and expiring, the monitoring tables.

    <root>/<table>/yyyymm=<month>/batch=<label>/

Months that were merged or cleaned are kept beside that, see ``rewritable``. Sorted by time inside the files; columns looked up by equality carry a bloom filter.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow import storage
from changeflow.functions.ranges import Moment, moment, timestamp
from changeflow.rewritable import Change
from changeflow.schemas import BATCH, MONITOR_BLOOM, MONITOR_SORT, MONITOR_TABLES, MONTH
from changeflow.sources.monitor_tables import monitor_table, table_schema

# Fixed value: days of history kept.
HISTORY_DAYS = 30

DIRECT = "direct"
MERGED = "merged"


def monitor_rows(df: DataFrame, table: str, batch: str = DIRECT) -> DataFrame:
    """Rows in the layout of a monitoring table: its columns and types, whole seconds, month and batch.

    Missing ``tags`` and ``seq`` are filled with null; any other missing or extra column is an error.
    """
    schema = table_schema(table)
    optional = {"seq", "tags", MONTH, BATCH}
    missing = [n for n in schema.names if n not in df.columns and n not in optional]
    extra = [n for n in df.columns if n not in schema.names]
    if missing or extra:
        raise ValueError(f"{table}: missing columns {missing}, unknown columns {extra}")
    kinds = {f.name: f.dataType for f in schema.fields}
    if "success" in df.columns:
        df = df.withColumn("success", F.col("success").cast(T.IntegerType()))
    df = df.withColumn("timestamp", F.date_trunc("second", "timestamp"))
    stored = ["seq", *MONITOR_TABLES[table].names]
    columns = [
        (F.col(n) if n in df.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in stored
    ]
    month = F.date_format("timestamp", "yyyyMM").cast(T.IntegerType())
    return df.select(*columns, month.alias(MONTH), F.lit(batch).alias(BATCH))


def _bloom(table: str) -> dict[str, str]:
    return {f"parquet.bloom.filter.enabled#{column}": "true" for column in MONITOR_BLOOM[table]}


def discard_batch(spark: SparkSession, root: str, table: str, batch: str) -> None:
    """Remove what an earlier attempt wrote under a batch label."""
    monitor_table(spark, root, table).discard(batch)


def append_monitor(df: DataFrame, root: str, table: str, batch: str = DIRECT) -> None:
    """Append records. A ``batch`` label other than the default makes the write
    repeatable: rows of an earlier attempt under that label are replaced."""
    spark = df.sparkSession
    path = f"{root}/{table}"
    if batch != DIRECT:
        discard_batch(spark, root, table, batch)
    rows = monitor_rows(df, table, batch).sortWithinPartitions(MONTH, BATCH, *MONITOR_SORT[table])
    rows.write.mode("append").partitionBy(MONTH, BATCH).options(**_bloom(table)).parquet(path)


def create_monitor_tables(spark: SparkSession, root: str) -> None:
    """Make the tables readable before their first record."""
    for table in MONITOR_TABLES:
        if not storage.exists(spark, f"{root}/{table}"):
            fields = [f for f in table_schema(table).fields if f.name not in (MONTH, BATCH)]
            spark.createDataFrame([], T.StructType(fields)).write.parquet(f"{root}/{table}")


def within_ttl(df: DataFrame, as_of: Moment, days: int = HISTORY_DAYS) -> DataFrame:
    """Rows that have not expired: ``timestamp + days > as_of``."""
    limit = timestamp(moment(as_of))
    expires = F.col("timestamp") + F.make_dt_interval(F.lit(days))
    df = df.where(expires > limit)
    # the same bound on the bare column reaches the scan
    return df.where(F.col("timestamp") > timestamp(moment(as_of) - timedelta(days=days)))


def cleanup_table(spark: SparkSession, root: str, table: str, before: Moment) -> None:
    """Delete rows older than ``before``.

    Whole months go without being read; only the month ``before`` lies in is rewritten. All of it takes effect at once, rows
    appended meanwhile stay, and the files go with the next clean-up, when no reader still uses them.
    """
    before = moment(before)
    month = before.strftime("%Y%m")
    months = monitor_table(spark, root, table)
    months.purge()
    values = months.values()
    changes: dict[str, Change | None] = {old: None for old in values if old < month}
    if month in values:
        rows = months.read().where(F.col(MONTH) == int(month))
        if not rows.where(F.col("timestamp") < timestamp(before)).isEmpty():
            kept = lambda rows: rows.where(F.col("timestamp") >= timestamp(before))
            changes[month] = lambda rows: kept(rows).sortWithinPartitions(BATCH, *MONITOR_SORT[table])
    if changes:
        months.rewrite(changes, **_bloom(table))


def merge_month(spark: SparkSession, root: str, table: str, month: str) -> None:
    """Replace the many small batch folders of a month by one, ordered by time.

    For a month no stream writes to any more, since a repeated batch would not find its label. Rows appended while the
    month is being merged stay beside it.
    """

    def merged(rows: DataFrame) -> DataFrame:
        ordered = rows.withColumn(BATCH, F.lit(MERGED)).repartitionByRange(F.col("timestamp"), F.col("seq"))
        return ordered.sortWithinPartitions(BATCH, *MONITOR_SORT[table])

    months = monitor_table(spark, root, table)
    if month in months.values():
        months.rewrite({month: merged}, **_bloom(table))


def cleanup(spark: SparkSession, root: str, before: Moment) -> None:
    """Delete rows older than ``before`` from every monitoring table."""
    for table in MONITOR_TABLES:
        if storage.exists(spark, f"{root}/{table}"):
            cleanup_table(spark, root, table, before)


def expire(spark: SparkSession, root: str, as_of: Moment, days: int = HISTORY_DAYS) -> None:
    """Apply the time to live: rows with ``timestamp + days <= as_of`` go."""
    cleanup(spark, root, moment(as_of) - timedelta(days=days) + timedelta(seconds=1))
