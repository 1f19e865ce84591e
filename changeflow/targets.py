"""Replication targets: which tables each one receives, and in which form Spark sees that."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Prefix of a qualified target name, compaction interval in minutes.
NAME_PREFIX = "ClickHouse"
DEFAULT_INTERVAL_MINUTES = 1440


@dataclass(frozen=True)
class Schedule:
    """How often a target is to be compacted; read by whatever scheduler starts the job."""

    enable: bool = False
    interval: int = DEFAULT_INTERVAL_MINUTES

    @property
    def minutes(self) -> int | None:
        if not self.enable:
            return None
        return self.interval if self.interval > 0 else DEFAULT_INTERVAL_MINUTES


@dataclass(frozen=True)
class TargetConfig:
    name: str
    tables: tuple[str, ...]
    kind: str = "clickhouse"
    enabled: bool = True
    schedule: Schedule = Schedule()
    options: Mapping[str, str] | None = field(default_factory=dict)

    @property
    def qualified_name(self) -> str:
        return f"{NAME_PREFIX}:{self.name}"


_TARGET_ROW = pa.schema(
    [
        ("target", pa.string()),
        ("target_name", pa.string()),
        ("target_type", pa.string()),
        ("target_ord", pa.int32()),
        ("table_name", pa.string()),
        ("table_ord", pa.int32()),
        ("enabled", pa.bool_()),
    ]
)


def target_tables(spark: SparkSession, targets: Iterable[TargetConfig]) -> DataFrame:
    """One row per target and table, however often a target lists a table.

    Built from Arrow, so Spark holds it as a local relation of known size. Joins
    with it carry no hint: below ``spark.sql.autoBroadcastJoinThreshold`` Spark
    broadcasts it, above it shuffles.
    """
    targets = list(targets)
    if len({t.name for t in targets}) < len(targets):
        raise ValueError("target names must differ")
    rows = [
        {
            "target": t.name,
            "target_name": t.qualified_name,
            "target_type": t.kind,
            "target_ord": ord_,
            "table_name": table,
            "table_ord": table_ord,
            "enabled": t.enabled,
        }
        for ord_, t in enumerate(targets)
        for table_ord, table in enumerate(dict.fromkeys(t.tables))
    ]
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=_TARGET_ROW))


def registered_targets(spark: SparkSession, targets: Iterable[TargetConfig]) -> DataFrame:
    """One row per registered target: ``name`` (qualified), ``type`` and ``is_enabled``."""
    schema = pa.schema([("name", pa.string()), ("type", pa.string()), ("is_enabled", pa.bool_())])
    rows = [{"name": t.qualified_name, "type": t.kind, "is_enabled": t.enabled} for t in targets]
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def included_tables(targets: Sequence[TargetConfig]) -> list[str]:
    """Every table some target wants, in first-seen order."""
    return list(dict.fromkeys(table for t in targets for table in t.tables))
