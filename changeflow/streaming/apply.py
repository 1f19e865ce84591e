"""Continuous apply: a change log stream into replicated tables and monitoring tables."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Collection, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from changeflow import storage
from changeflow.functions.names import event_sequence
from changeflow.operators.records import (
    collapse_rows,
    error_records,
    event_positions,
    event_records,
    last_control,
    position_records,
)
from changeflow.schemas import ACTIONS, BATCH, CORRUPT, MONTH
from changeflow.sinks.monitor_tables import append_monitor, create_monitor_tables, discard_batch
from changeflow.sinks.registry import Sink, TableOutcome, TableSink, resolve_sinks
from changeflow.sources.change_log import split_corrupt
from changeflow.sources.monitor_tables import monitor_table
from changeflow.targets import TargetConfig

# Spark's name for the id of the stream that runs in a thread
STREAM_ID = "sql.streaming.queryId"


@dataclass(frozen=True)
class Outcome:
    """Of a target: its time, and the outcomes of its tables; tables it doesn't name were written."""

    target_name: str
    duration_ms: int
    tables: dict[str, TableOutcome]


@dataclass(frozen=True)
class Retried:
    """Of a batch tried again: the outcomes of its tables."""

    batch_id: int
    tables: dict[str, TableOutcome]

    @property
    def done(self) -> bool:
        return all(outcome.error is None for outcome in self.tables.values())


@dataclass
class ApplyJob:
    """Writes each micro-batch to every enabled target.

    A table that fails stops no other table or target: its changes of the batch are kept
    under ``<root>/_retry`` and tried again with the next batch. Unreadable rows are kept under ``<root>/_unreadable``,
    rows that do not fit their table in its quarantine. All three leave error records, at first and when tried again; a late
    success makes the batch's event records successful ones. Rows carry their version, so the order of arrival does not
    matter. Every output is a folder named after the batch, so a repeated batch replaces its earlier attempt; what
    ``<root>/_ledger`` says a target took in that attempt of the same stream isn't written again.
    """

    targets: Sequence[TargetConfig]
    schemas: dict[str, T.StructType]
    root: str
    monitor_root: str | None = None
    monitor_enabled: bool = True
    recorded_at: Column | None = None
    sinks: dict[str, Sink] | None = None

    def __post_init__(self):
        self.active = [t for t in self.targets if t.enabled]
        if self.sinks is None:
            self.sinks = resolve_sinks(self.active, self.schemas, self.root)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        cached, unreadable = batch, None
        in_thread = inheritable_thread_target(batch.sparkSession)
        try:
            if CORRUPT in batch.columns:
                batch, unreadable = split_corrupt(batch)
                unreadable = self._keep_unreadable(unreadable, batch_id)
            present = _present_tables(batch)
            # every target at once, so that a slow one delays no other
            with ThreadPoolExecutor(len(self.active) + 2) as pool:
                writes = [pool.submit(in_thread(self._write_target), batch, batch_id, t, present) for t in self.active]
                if self._monitored:
                    log = batch.withColumn("seq", event_sequence())
                    carry = self._carry(batch.sparkSession, batch_id)
                    steps = [
                        pool.submit(in_thread(step), log, batch_id, carry)
                        for step in (self._write_positions, self._save_carry)
                    ]
                written = [w.result() for w in writes]
                outcomes = [outcome for outcome, _ in written]
                for target, (_, retried) in zip(self.active, written, strict=True):
                    self._settle(batch.sparkSession, target, retried)
                if self._monitored:
                    self._write_events(log, batch_id, carry, outcomes, unreadable)
                    for step in steps:
                        step.result()
        finally:
            cached.unpersist()

    @property
    def _monitored(self) -> bool:
        return self.monitor_enabled and self.monitor_root is not None

    @property
    def _now(self) -> Column:
        return self.recorded_at if self.recorded_at is not None else F.current_timestamp()

    def _changes(self, batch: DataFrame, target: TargetConfig) -> DataFrame:
        wanted = F.col("table_name").isin(list(target.tables)) & F.col("action").isin(*ACTIONS)
        return batch.where((F.col("kind") == "row") & wanted)

    def _retry_path(self, target: TargetConfig) -> str:
        return f"{self.root}/_retry/{target.name}"

    def _write_target(
        self, batch: DataFrame, batch_id: int, target: TargetConfig, present: Collection[str]
    ) -> tuple[Outcome, list[Retried]]:
        started, spark = time.monotonic(), batch.sparkSession
        stream = spark.sparkContext.getLocalProperty(STREAM_ID)
        retried = self._try_again(spark, target, before=batch_id)
        taken = self._taken(spark, target, batch_id, stream)
        if taken is not None:
            return taken, retried
        sink = self.sinks[target.qualified_name]
        changes = self._changes(batch, target)
        try:
            tables = (sink.write(changes, batch_id, present) if isinstance(sink, TableSink) else sink(changes, batch_id)) or {}
        except Exception as failure:
            tables = {name: TableOutcome(error=str(failure)) for name in dict.fromkeys(target.tables)}
        failed = [name for name, outcome in tables.items() if outcome.error is not None]
        if failed:
            kept = changes.where(F.col("table_name").isin(failed))
            kept.write.mode("overwrite").parquet(f"{self._retry_path(target)}/{BATCH}={batch_id}")
        outcome = Outcome(target.qualified_name, int((time.monotonic() - started) * 1000), tables)
        self._note(spark, target, batch_id, stream, outcome)
        return outcome, retried

    def _ledger(self, target: TargetConfig) -> str:
        return f"{self.root}/_ledger/{target.name}"

    def _note(self, spark: SparkSession, target: TargetConfig, batch_id: int, stream: str | None, outcome: Outcome) -> None:
        """Write down what became of a batch; notes of batches that can't be repeated any more go."""
        if stream is None:
            return
        tables = {name: [o.error, o.quarantined] for name, o in outcome.tables.items()}
        text = json.dumps({"stream": stream, "duration_ms": outcome.duration_ms, "tables": tables})
        storage.write_text(spark, f"{self._ledger(target)}/{batch_id}.json", text)
        for old in storage.numbered(spark, self._ledger(target)):
            if old < batch_id - 1:
                storage.delete(spark, f"{self._ledger(target)}/{old}.json")

    def _taken(self, spark: SparkSession, target: TargetConfig, batch_id: int, stream: str | None) -> Outcome | None:
        """What became of a batch in an earlier attempt of the same stream, if that got so far with this target."""
        text = storage.read_text(spark, f"{self._ledger(target)}/{batch_id}.json") if stream else None
        noted = json.loads(text) if text else {}
        if noted.get("stream") != stream or not noted:
            return None
        tables = {name: TableOutcome(error, quarantined) for name, (error, quarantined) in noted["tables"].items()}
        return Outcome(target.qualified_name, noted["duration_ms"], tables)

    def _keep_unreadable(self, rows: DataFrame, batch_id: int) -> DataFrame | None:
        """Store the text of rows that can't be read, if there are any."""
        path = f"{self.root}/_unreadable/{BATCH}={batch_id}"
        if not rows.limit(1).count():
            storage.delete(rows.sparkSession, path)
            return None
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.parquet(path)

    def pending(self, spark: SparkSession, target: TargetConfig) -> list[int]:
        """Batches a target has not taken yet."""
        return storage.finished(spark, self._retry_path(target), BATCH)

    def retry(self, spark: SparkSession, target: TargetConfig, before: int | None = None) -> None:
        """Write the changes that earlier failures of this target left behind, each batch by itself, and put its records
        right. What fails again stays pending, so later batches need not wait for it."""
        self._settle(spark, target, self._try_again(spark, target, before))

    def _try_again(self, spark: SparkSession, target: TargetConfig, before: int | None = None) -> list[Retried]:
        retried = []
        for batch_id in self.pending(spark, target):
            if before is not None and batch_id >= before:
                continue
            changes = spark.read.parquet(f"{self._retry_path(target)}/{BATCH}={batch_id}")
            try:
                tables = self.sinks[target.qualified_name](changes, batch_id) or {}
            except Exception as failure:
                tables = {name: TableOutcome(error=str(failure)) for name in dict.fromkeys(target.tables)}
            retried.append(Retried(batch_id, tables))
        return retried

    def _settle(self, spark: SparkSession, target: TargetConfig, retried: Sequence[Retried]) -> None:
        """Records of batches tried again; the changes of those that were taken go at last, so that a stop in between leads
        to another try."""
        for again in retried:
            if self._monitored:
                self._correct(spark, target, again)
            if again.done:
                storage.delete(spark, f"{self._retry_path(target)}/{BATCH}={again.batch_id}")

    def _correct(self, spark: SparkSession, target: TargetConfig, again: Retried) -> None:
        """Event records of the tables that were taken become successful, and what was refused or set aside this time is an
        error record of its own, in place of that of the try before."""
        events, root = monitor_table(spark, self.monitor_root, "sync_events"), self.monitor_root
        present = storage.matching(spark, f"{events.path}/{MONTH}=*/{BATCH}={_label(again.batch_id)}-failed-*")
        present += storage.matching(spark, f"{events.path}/_rewritten/{MONTH}=*/g=*/{BATCH}={_label(again.batch_id)}-failed-*")
        failed = {path.rsplit("/", 1)[1].split("=", 1)[1] for path in present}
        problems = []
        for table in dict.fromkeys(target.tables):
            outcome, label = again.tables.get(table, TableOutcome()), _pair_label(again.batch_id, "failed", target, table)
            if outcome.error is None and label in failed:
                rows = events.read().where(F.col(BATCH) == label).drop(MONTH, BATCH)
                rows = rows.withColumns({"success": F.lit(1), "error_msg": F.lit("")})
                append_monitor(rows, root, "sync_events", _pair_label(again.batch_id, "taken", target, table))
                events.discard(label)
            if (outcome.error is not None and label in failed) or outcome.quarantined:
                problems.append({"target_name": target.qualified_name, "table_name": table, "message": _message(outcome)})
        if problems:
            rows = error_records(spark.createDataFrame(pa.Table.from_pylist(problems)), self._now)
            append_monitor(rows, root, "sync_errors", _pair_label(again.batch_id, "retry", target))

    def _write_positions(self, log: DataFrame, batch_id: int, carry: DataFrame | None) -> None:
        append_monitor(position_records(log, self._now), self.monitor_root, "sync_positions", _label(batch_id))

    def _write_events(
        self, log: DataFrame, batch_id: int, carry: DataFrame | None, outcomes: list[Outcome], unreadable: DataFrame | None
    ) -> None:
        """Event records with the real outcome of every table, and error records of what was refused, set aside or unreadable."""
        spark = log.sparkSession
        positioned = event_positions(log, carry=carry)
        events = collapse_rows(positioned.where(F.col("action").isin(*ACTIONS)), extra=["last_pos"])
        routes = _outcome_routes(spark, self.active, outcomes)
        records = event_records(events, self._now, routes=routes, duration_ms=F.col("duration_ms"), error=F.col("error"))
        for table in ("sync_events", "sync_errors"):
            discard_batch(spark, self.monitor_root, table, f"{_label(batch_id)}*")
        # what failed has a label of its own for each target and table, so that a later success can replace it
        append_monitor(records.where("success = 1"), self.monitor_root, "sync_events", _label(batch_id))
        for target, outcome in zip(self.active, outcomes, strict=True):
            for name, own in outcome.tables.items():
                if own.error is not None:
                    pair = (F.col("target_name") == target.qualified_name) & (F.col("table_name") == name)
                    append_monitor(records.where(pair), self.monitor_root, "sync_events", _pair_label(batch_id, "failed", target, name))

        errors = []
        if any(t.error or t.quarantined for o in outcomes for t in o.tables.values()):
            present = events.select("table_name").distinct()
            failed = routes.where("error is not null or quarantined > 0").join(present, "table_name", "left_semi")
            errors.append(error_records(failed, self._now))
        if unreadable is not None:
            named = unreadable.select(
                F.lit("").alias("target_name"), F.lit("").alias("table_name"), F.lit("unreadable change").alias("message"), F.col(CORRUPT).alias("raw")
            )
            errors.append(error_records(named, self._now, raw_data=F.col("raw")))
        if errors:
            append_monitor(reduce(DataFrame.unionByName, errors), self.monitor_root, "sync_errors", _label(batch_id))

    def _carry(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        """The last control row of each file of the earlier batches."""
        earlier = [b for b in storage.finished(spark, f"{self.monitor_root}/_carry", BATCH) if b < batch_id]
        if not earlier:
            return None
        return spark.read.parquet(f"{self.monitor_root}/_carry/{BATCH}={earlier[-1]}")

    def _save_carry(self, log: DataFrame, batch_id: int, carry: DataFrame | None) -> None:
        control = last_control(log)
        if carry is not None:  # a row for each file, as any of them may go on
            both = control.unionByName(carry).groupBy("binlog_file")
            control = both.agg(F.max("seq").alias("seq"), F.max_by("binlog_pos", "seq").alias("binlog_pos"))
        path = f"{self.monitor_root}/_carry"
        control.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")
        for old in storage.finished(log.sparkSession, path, BATCH):
            if old < batch_id - 1:
                storage.delete(log.sparkSession, f"{path}/{BATCH}={old}")


def _label(batch_id: int) -> str:
    return f"apply-{batch_id:09d}"


def _pair_label(batch_id: int, what: str, target: TargetConfig, table: str = "") -> str:
    """Label of the records of a target, or of one of its tables, in a batch."""
    pair = hashlib.md5(json.dumps([target.name, table]).encode()).hexdigest()[:16]
    return f"{_label(batch_id)}-{what}-{pair}"


def _message(outcome: TableOutcome) -> str | None:
    """Of an error record, ``None`` if all went well."""
    if outcome.error is None and outcome.quarantined:
        return f"{outcome.quarantined} rows do not fit the table and are in its quarantine"
    return outcome.error


def _present_tables(batch: DataFrame) -> set[str]:
    """Tables that a batch has changes of: a few names, found once for all targets."""
    rows = batch.where((F.col("kind") == "row") & F.col("action").isin(*ACTIONS)).select("table_name").distinct()
    return {row[0] for row in rows.collect()}


_ROUTE = pa.schema(
    [
        ("target_name", pa.string()),
        ("table_name", pa.string()),
        ("enabled", pa.bool_()),
        ("duration_ms", pa.int64()),
        ("error", pa.string()),
        ("quarantined", pa.int64()),
        ("message", pa.string()),
    ]
)


def _outcome_routes(spark: SparkSession, targets: Sequence[TargetConfig], outcomes: Sequence[Outcome]) -> DataFrame:
    """One row per target and table with its outcome, as a local relation."""
    rows = []
    for t, o in zip(targets, outcomes, strict=True):
        for table in dict.fromkeys(t.tables):
            own = o.tables.get(table, TableOutcome())
            rows.append(
                {
                    "target_name": t.qualified_name,
                    "table_name": table,
                    "enabled": True,
                    "duration_ms": o.duration_ms,
                    "error": own.error,
                    "quarantined": own.quarantined,
                    "message": _message(own),
                }
            )
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=_ROUTE))


def start_apply(
    changes: DataFrame, job: ApplyJob, checkpoint: str, *, available_now: bool = False, interval: str = "10 seconds"
) -> StreamingQuery:
    """Start the job on a change log stream; it resumes from ``checkpoint``."""
    if job.monitor_enabled and job.monitor_root:
        create_monitor_tables(changes.sparkSession, job.monitor_root)
    writer = changes.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()
