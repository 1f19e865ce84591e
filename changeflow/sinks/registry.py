"""Target kinds and the functions that write for them."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.functions.names import POSITION_VERSION
from changeflow.operators.decode import key_moves, parse_images, versioned
from changeflow.sinks.current_table import CurrentTable
from changeflow.targets import TargetConfig


@dataclass(frozen=True)
class TableOutcome:
    """What became of a table's changes: the error that refused them, or the rows that went to quarantine."""

    error: str | None = None
    quarantined: int = 0


# (changes of the target's tables in one micro-batch, batch id) -> outcome of each table that had changes. A sink that
# raises has written no table; one that returns nothing has written all.
Sink = Callable[[DataFrame, int], "dict[str, TableOutcome] | None"]
# (target, table schemas, root folder) -> sink
SinkFactory = Callable[[TargetConfig, dict[str, T.StructType], str], Sink]

# Kinds that are known but have no writer.
NOT_IMPLEMENTED = ("elasticsearch", "mysql")

NO_SEQ = "a change has no seq: set the target option version=position"

_factories: dict[str, SinkFactory] = {}


def register_sink(kind: str, factory: SinkFactory) -> None:
    _factories[kind] = factory


def resolve_sinks(
    targets: Sequence[TargetConfig], schemas: dict[str, T.StructType], root: str
) -> dict[str, Sink]:
    """A sink for each target, by qualified name; configuration errors are raised here."""
    sinks = {}
    for target in targets:
        if target.kind in NOT_IMPLEMENTED:
            raise ValueError(f"target {target.name}: {target.kind} is not implemented yet")
        if target.kind not in _factories:
            raise ValueError(f"target {target.name}: unknown target type {target.kind!r}")
        if target.options is None:
            raise ValueError(f"target {target.name}: its {target.kind} configuration is missing")
        sinks[target.qualified_name] = _factories[target.kind](target, schemas, root)
    return sinks


def table_path(root: str, target: TargetConfig, table: str) -> str:
    return f"{root.rstrip('/')}/{target.name}/{table}"


def current_tables(
    spark: SparkSession, target: TargetConfig, schemas: dict[str, T.StructType], root: str
) -> dict[str, CurrentTable]:
    """The replicated tables of a target. Its options:

    ``path``             folder instead of the common root
    ``key``              key column, default ``id``, else the first column
    ``version``          ``position`` for a log whose rows have no ``seq``
    ``key_change``       ``move``: an update of the key deletes the old key
    ``files_per_batch``  most files a batch writes per table
    """
    options = target.options or {}
    files = options.get("files_per_batch")
    return {
        table: CurrentTable(
            spark,
            table_path(options.get("path", root), target, table),
            schemas[table],
            (options.get("key", "id"),),
            POSITION_VERSION if options.get("version") == "position" else T.LongType(),
            int(files) if files else None,
        )
        for table in dict.fromkeys(target.tables)
    }


class TableSink:
    """Appends the images of each table of a target to its replicated table; rows that do not fit go to quarantine."""

    def __init__(self, target: TargetConfig, schemas: dict[str, T.StructType], root: str):
        missing = [t for t in target.tables if t not in schemas]
        if missing:
            raise ValueError(f"target {target.name}: no schema for tables {missing}")
        options = target.options or {}
        self.target, self.schemas, self.root = target, schemas, root
        self.by_position, self.move = options.get("version") == "position", options.get("key_change") == "move"
        self.key = options.get("key", "id")

    def _write_table(self, name: str, table: CurrentTable, changes: DataFrame, batch_id: int) -> TableOutcome:
        counted = Observation()
        rows = changes.where(changes["table_name"] == name)
        if not self.by_position:
            rows = rows.withColumn("seq", F.coalesce("seq", F.raise_error(F.lit(NO_SEQ))))
        good, bad = parse_images(rows, self.schemas[name], counted, keep_before=self.move, key=self.key)
        if self.move:
            good = good.unionByName(key_moves(good, table.keys[0]))
        table.append(versioned(good, self.by_position), batch_id)
        n_bad = int(counted.get["bad"] or 0)
        if n_bad:
            table.quarantine(bad, batch_id)
        return TableOutcome(quarantined=n_bad)

    def _outcome(self, name: str, table: CurrentTable, changes: DataFrame, batch_id: int) -> TableOutcome:
        try:
            return self._write_table(name, table, changes, batch_id)
        except Exception as failure:  # other tables are written all the same
            return TableOutcome(error=str(failure))

    def write(self, changes: DataFrame, batch_id: int, present: Collection[str]) -> dict[str, TableOutcome]:
        """Write the tables that have changes, all at once; ``present`` are the names found in the batch."""
        spark = changes.sparkSession
        tables = {n: t for n, t in current_tables(spark, self.target, self.schemas, self.root).items() if n in present}
        if not tables:
            return {}
        one = inheritable_thread_target(spark)(self._outcome)
        with ThreadPoolExecutor(len(tables)) as pool:
            started = {name: pool.submit(one, name, table, changes, batch_id) for name, table in tables.items()}
            return {name: outcome.result() for name, outcome in started.items()}

    def __call__(self, changes: DataFrame, batch_id: int) -> dict[str, TableOutcome]:
        present = {row[0] for row in changes.select("table_name").distinct().collect()}  # tables of the target at most
        return self.write(changes, batch_id, present)


def table_sink(target: TargetConfig, schemas: dict[str, T.StructType], root: str) -> Sink:
    return TableSink(target, schemas, root)


register_sink("clickhouse", table_sink)
register_sink("parquet", table_sink)
