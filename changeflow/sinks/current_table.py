"""A replicated table on shared storage: an append-only log of row images and a compacted snapshot in key buckets.

    <path>/log/batch=<n>/               row images of micro-batch n, with _version and _deleted
    <path>/touched/<n>.json             key buckets that batch n has rows of
    <path>/snapshot/v=<k>/bucket=<b>/   newest row of each key of bucket b, as compaction k wrote it
    <path>/manifest/<k>.json            which folder holds each bucket after compaction k, and the batches it includes
    <path>/quarantine/batch=<n>/        rows that do not fit the table

A compaction reads and writes the buckets that its batches touch; the manifest goes on with the folders of all others.
Readers take the newest manifest, which is committed as one file. A batch folder counts once its ``_SUCCESS`` marker is
there, and writing a batch again replaces it. The manifest says which batches the snapshot holds, so a batch that a failed
target takes late, after a compaction, is still seen.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow import storage
from changeflow.operators.state import latest_per_key, merge_onto, without_deleted
from changeflow.schemas import BATCH, DELETED, VERSION

SNAPSHOT = "v"
BUCKET = "bucket"
BUCKETS = 16  # for small tables; about one for each GB of the snapshot is a good number


@dataclass(frozen=True)
class Manifest:
    """``held``: the compaction that wrote each bucket's folder; ``of``: number of buckets; ``batches``: those included."""

    number: int
    of: int
    held: dict[int, int]
    batches: frozenset[int]


class CurrentTable:
    def __init__(
        self,
        spark: SparkSession,
        path: str,
        columns: T.StructType,
        keys: Sequence[str] = ("id",),
        version: T.DataType = T.LongType(),
        files_per_batch: int | None = None,
        buckets: int = BUCKETS,
    ):
        """``columns`` are the table's own columns; ``keys`` its key, by default ``id``
        or else the first column. ``files_per_batch`` keeps the files of small batches few. Another number of
        ``buckets`` than before takes effect with the next compaction, which then writes all of them."""
        self.spark = spark
        self.path = path.rstrip("/")
        self.keys = [k for k in keys if k in columns.names] or columns.names[:1]
        self.schema = T.StructType(
            [*columns.fields, T.StructField(VERSION, version), T.StructField(DELETED, T.BooleanType())]
        )
        self.files_per_batch = files_per_batch
        self.buckets = buckets

    def _bucket(self) -> Column:
        """Bucket of a row. Spark deals rows by the same hash, so a multiple of ``buckets`` partitions by key has rows of
        one bucket in each."""
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets))

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Write the row images of a batch; the same batch again replaces it."""
        missing = [c for c in self.schema.names if c not in rows.columns]
        if missing:
            raise ValueError(f"{self.path}: rows lack {missing}")
        typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        if self.files_per_batch:
            typed = typed.coalesce(self.files_per_batch)
        seen = Observation()
        typed = typed.observe(seen, F.collect_set(self._bucket()).alias(BUCKET))
        storage.delete(self.spark, self._touched_file(batch_id))
        typed.write.mode("overwrite").parquet(f"{self.path}/log/{BATCH}={batch_id}")
        touched = {"of": self.buckets, "buckets": sorted(seen.get[BUCKET] or [])}
        storage.write_text(self.spark, self._touched_file(batch_id), json.dumps(touched))

    def quarantine(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/quarantine/{BATCH}={batch_id}")

    def _touched_file(self, batch_id: int) -> str:
        return f"{self.path}/touched/{batch_id}.json"

    def touched(self, batches: Iterable[int]) -> set[int]:
        """Buckets that batches have rows of. Batches without a note of it are looked through."""
        buckets, unknown = set(), []
        for batch in batches:
            noted = storage.read_text(self.spark, self._touched_file(batch))
            found = json.loads(noted) if noted else {}
            if found.get("of") == self.buckets:
                buckets.update(found["buckets"])
            else:
                unknown.append(batch)
        if unknown:
            buckets.update(row[0] for row in self._read_batches(unknown).select(self._bucket()).distinct().collect())
        return buckets

    def batches(self) -> list[int]:
        return storage.finished(self.spark, f"{self.path}/log", BATCH)

    def manifest(self) -> Manifest | None:
        """The newest one."""
        numbers = storage.numbered(self.spark, f"{self.path}/manifest")
        if not numbers:
            return None
        read = json.loads(storage.read_text(self.spark, f"{self.path}/manifest/{max(numbers)}.json"))
        held = {int(b): v for b, v in read["held"].items()}
        return Manifest(max(numbers), read["of"], held, frozenset(read["batches"]))

    def snapshot_version(self) -> int | None:
        """Number of the newest snapshot, if there is one."""
        manifest = self.manifest()
        return manifest.number if manifest else None

    def log(self) -> DataFrame:
        """Row images of all batches."""
        return self._read_batches(self.batches())

    def _read_batches(self, batches: Sequence[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/log/{BATCH}={b}" for b in batches])

    def _held(self, manifest: Manifest, buckets: Iterable[int]) -> DataFrame | None:
        """Snapshot rows of some buckets, ``None`` if no folder holds any."""
        folders = [f"{self.path}/snapshot/{SNAPSHOT}={manifest.held[b]}/{BUCKET}={b}" for b in buckets if b in manifest.held]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else None

    def snapshot(self) -> DataFrame:
        """Rows of the newest snapshot, tombstones included."""
        manifest = self.manifest()
        rows = self._held(manifest, manifest.held) if manifest else None
        return self.spark.createDataFrame([], self.schema) if rows is None else rows

    def current(self) -> DataFrame:
        """The visible rows: newest version of each key, without deleted keys. Buckets that no pending batch touches are
        read as they stand; the others are merged with the pending rows."""
        manifest, batches = self.manifest(), self.batches()
        if manifest is None:
            return without_deleted(latest_per_key(self._read_batches(batches), self.keys))
        pending = [b for b in batches if b not in manifest.batches]
        touched = self._touched_by(manifest, pending)
        parts = [self._held(manifest, [b for b in manifest.held if b not in touched])]
        if pending:
            changes, old = self._read_batches(pending), self._held(manifest, touched)
            parts.append(latest_per_key(changes, self.keys) if old is None else merge_onto(old, changes, self.keys))
        found = [without_deleted(p) for p in parts if p is not None]
        if not found:
            return without_deleted(self.spark.createDataFrame([], self.schema))
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    def _touched_by(self, manifest: Manifest, pending: Sequence[int]) -> set[int]:
        """Buckets of the manifest that pending batches touch; all of them if the number of buckets has changed."""
        if not pending:
            return set()
        return set(manifest.held) if manifest.of != self.buckets else self.touched(pending)

    def compact(self, forget_before: int | None = None) -> int | None:
        """Write the touched buckets of a snapshot of everything applied so far and return its number.

        Readers go on with the old snapshot until the new one is committed. Tombstones
        stay, so that an older image arriving late cannot bring a key back;
        ``forget_before`` drops those with a smaller version.
        """
        manifest, batches = self.manifest(), self.batches()
        included = manifest.batches if manifest else frozenset()
        pending = [b for b in batches if b not in included]
        if not pending:
            return manifest.number if manifest else None
        touched = self._touched_by(manifest, pending) if manifest else set()
        old_tombstone = F.col(DELETED) & (F.col(VERSION) < forget_before) if forget_before is not None else None
        if manifest and old_tombstone is not None and manifest.of == self.buckets:
            touched |= {row[0] for row in self.snapshot().where(old_tombstone).select(self._bucket()).distinct().collect()}
        old = self._held(manifest, touched) if manifest else None
        # a task writes one bucket only, and no bucket is written by more tasks than needed
        tasks = self.buckets * max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        rows = latest_per_key(self._read_batches(pending), self.keys).repartition(tasks, *self.keys)
        if old is not None:
            rows = merge_onto(old.repartition(tasks, *self.keys), rows, self.keys)
        if old_tombstone is not None:
            rows = rows.where(~old_tombstone)
        new = manifest.number + 1 if manifest else 0
        folder = f"{self.path}/snapshot/{SNAPSHOT}={new}"
        rows.withColumn(BUCKET, self._bucket()).write.mode("overwrite").partitionBy(BUCKET).parquet(folder)
        kept = {b: v for b, v in manifest.held.items() if b not in touched} if manifest and manifest.of == self.buckets else {}
        held = kept | {int(b): new for b in storage.partition_values(self.spark, folder, BUCKET)}
        text = json.dumps({"of": self.buckets, "held": held, "batches": sorted(batches)})
        storage.commit_text(self.spark, f"{self.path}/manifest/{new}.json", text)
        return new

    def vacuum(self) -> None:
        """Delete the batches the newest snapshot holds, and bucket folders it no longer refers to. Run it
        when no reader still uses them."""
        manifest = self.manifest()
        if manifest is None:
            return
        for batch in self.batches():
            if batch in manifest.batches:
                storage.delete(self.spark, f"{self.path}/log/{BATCH}={batch}")
                storage.delete(self.spark, self._touched_file(batch))
        for version in map(int, storage.partition_values(self.spark, f"{self.path}/snapshot", SNAPSHOT)):
            folder = f"{self.path}/snapshot/{SNAPSHOT}={version}"
            if version > manifest.number:
                continue  # being written
            if version not in manifest.held.values():
                storage.delete(self.spark, folder)
                continue
            for bucket in map(int, storage.partition_values(self.spark, folder, BUCKET)):
                if manifest.held.get(bucket) != version:
                    storage.delete(self.spark, f"{folder}/{BUCKET}={bucket}")
        for number in storage.numbered(self.spark, f"{self.path}/manifest"):
            if number < manifest.number:
                storage.delete(self.spark, f"{self.path}/manifest/{number}.json")


def compact_tables(tables: dict[str, CurrentTable]) -> dict[str, str]:
    """Compact each table; a failure is reported under its name and does not stop the others."""
    failures = {}
    for name, table in tables.items():
        try:
            table.compact()
        except Exception as error:
            failures[name] = str(error)
    return failures
