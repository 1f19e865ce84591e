"""Which targets receive which part of the log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.targets import TargetConfig, included_tables


def included_changes(changes: DataFrame, targets: Sequence[TargetConfig]) -> DataFrame:
    """Changes of tables some target wants. A literal list, so the scan can use it."""
    return changes.where(F.col("table_name").isin(included_tables(targets)))


def route_changes(changes: DataFrame, target_tables: DataFrame) -> DataFrame:
    """One row per change and enabled target that lists its table (exact name).

    ``target_tables`` has one row per target and table.
    """
    routes = target_tables.where("enabled").select("target", "target_name", "table_name")
    return changes.join(routes, "table_name")


def _mentions(query: Column, table: str, whole_word: bool) -> Column:
    if whole_word:
        return F.regexp_like(query, F.lit(rf"(?i)(^|[^\w]){table}([^\w]|$)"))
    return F.contains(query, F.lit(table))


def route_ddl(log: DataFrame, targets: Sequence[TargetConfig], whole_word: bool = False) -> DataFrame:
    """One row per DDL statement and target with a table the statement mentions.

    A mention is a plain substring unless ``whole_word``. The names come from the
    configuration, so every statement is tested in place and nothing is joined.
    """
    query = F.col("ddl_query")
    hits = []
    for t in targets:
        if not t.enabled or not t.tables:
            continue
        hit = F.lit(False)
        for table in dict.fromkeys(t.tables):
            hit = hit | _mentions(query, table, whole_word)
        hits.append(F.when(hit, F.lit(t.qualified_name)))
    names = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    ddl = log.where((F.col("kind") == "ddl") & query.isNotNull())
    return ddl.withColumn("target_name", F.explode(names))


def routed_counts(changes: DataFrame, target_tables: DataFrame) -> DataFrame:
    """Changes per target, table and action, counted before routing so only counts are joined."""
    counts = changes.groupBy("table_name", "action").agg(F.count(F.lit(1)).alias("n"))
    routed = route_changes(counts, target_tables)
    return routed.select("target_name", "table_name", "action", F.col("n").alias("changes"))
