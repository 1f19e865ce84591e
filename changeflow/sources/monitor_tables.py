"""Monitoring tables as DataFrames, split by month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from changeflow.functions.ranges import TimeRange
from changeflow.rewritable import RewritableTable
from changeflow.schemas import BATCH, MONITOR_TABLES, MONTH


def table_schema(table: str) -> T.StructType:
    """Schema of a monitoring table on disk: an optional ``seq``, then its columns and partitions."""
    if table not in MONITOR_TABLES:
        raise ValueError(f"unknown monitoring table {table!r}, expected one of {tuple(MONITOR_TABLES)}")
    return T.StructType(
        [
            T.StructField("seq", T.LongType()),
            *MONITOR_TABLES[table].fields,
            T.StructField(MONTH, T.IntegerType()),
            T.StructField(BATCH, T.StringType()),
        ]
    )


def monitor_table(spark: SparkSession, root: str, table: str) -> RewritableTable:
    return RewritableTable(spark, f"{root}/{table}", MONTH, table_schema(table))


def read_monitor(spark: SparkSession, root: str, table: str, rng: TimeRange = TimeRange()) -> DataFrame:
    """A monitoring table; a time range prunes months and reaches the Parquet scan."""
    return rng.apply(monitor_table(spark, root, table).read())
