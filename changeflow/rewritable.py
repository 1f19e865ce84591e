"""Partitioned tables whose partitions can be rewritten while others append to them and read them.

    <path>/<column>=<v>/batch=<label>/                      what was appended
    <path>/_rewritten/<column>=<v>/g=<k>/batch=<label>/     a rewriting of a partition
    <path>/_pointer/<number>.json                           the rewriting that counts, and the files it stands for

A rewriting replaces exactly the files it has read, so rows appended meanwhile stay. One new pointer file exchanges any
number of partitions at once; readers follow the newest one. Replaced files stay until ``purge``, so that a reader that
began before finds them. Spark's own readers of ``<path>`` don't see folders whose names begin with ``_``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from changeflow import storage
from changeflow.schemas import BATCH

REWRITTEN = "_rewritten"
POINTER = "_pointer"
GENERATION = "g"

# rows of a partition -> rows that stay
Change = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Entry:
    """Of a rewritten partition: its generation (``None``: nothing is left of it), and the appended files it replaces."""

    generation: str | None
    replaced: frozenset[str] = field(default_factory=frozenset)


class RewritableTable:
    def __init__(self, spark: SparkSession, path: str, column: str, schema: T.StructType):
        """``schema`` has all columns, with ``column`` and ``batch``, by which the folders are named."""
        self.spark, self.path, self.column, self.schema = spark, path.rstrip("/"), column, schema

    def pointer(self) -> tuple[int, dict[str, Entry]]:
        """Number of the newest pointer, and its entries by partition."""
        numbers = storage.numbered(self.spark, f"{self.path}/{POINTER}")
        if not numbers:
            return -1, {}
        entries = json.loads(storage.read_text(self.spark, f"{self.path}/{POINTER}/{max(numbers)}.json"))
        return max(numbers), {v: Entry(e["generation"], frozenset(e["replaced"])) for v, e in entries.items()}

    def _commit(self, number: int, entries: Mapping[str, Entry]) -> None:
        text = json.dumps({v: {"generation": e.generation, "replaced": sorted(e.replaced)} for v, e in entries.items()})
        storage.commit_text(self.spark, f"{self.path}/{POINTER}/{number}.json", text)

    def values(self) -> list[str]:
        """Partitions that have files or a rewriting."""
        _, entries = self.pointer()
        found = set(storage.partition_values(self.spark, self.path, self.column)) - set(entries)
        return sorted(found | {v for v, e in entries.items() if e.generation or self._appended(v, e)})

    def _appended(self, value: str, entry: Entry | None) -> list[str]:
        """Files appended to a partition that its rewriting doesn't stand for."""
        files = storage.files(self.spark, f"{self.path}/{self.column}={value}")
        return [f for f in files if entry is None or f not in entry.replaced]

    def _folder(self, value: str, generation: str) -> str:
        return f"{self.path}/{REWRITTEN}/{self.column}={value}/{GENERATION}={generation}"

    def _read(self, appended: list[str], rewritten: list[str]) -> DataFrame:
        """Rows of appended files or folders and of rewritten partitions."""
        parts = []
        for base, paths in ((self.path, appended), (f"{self.path}/{REWRITTEN}", rewritten)):
            if paths:
                rows = self.spark.read.schema(self.schema).option("basePath", base).parquet(*paths)
                parts.append(rows.select(*self.schema.names))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return parts[0] if len(parts) == 1 else parts[0].union(parts[1])

    def read(self) -> DataFrame:
        """All rows, lazily; conditions on the partition column prune."""
        _, entries = self.pointer()
        if not entries:
            return self.spark.read.schema(self.schema).parquet(self.path)
        plain = [v for v in storage.partition_values(self.spark, self.path, self.column) if v not in entries]
        paths = [f"{self.path}/{self.column}={v}" for v in plain]
        paths += [f"{self.path}/{self.column}={v}/{f}" for v, e in entries.items() for f in self._appended(v, e)]
        return self._read(paths, [self._folder(v, e.generation) for v, e in entries.items() if e.generation])

    def live_files(self) -> dict[str, list[str]]:
        """Files that make up each partition now, by their names below the table."""
        _, entries = self.pointer()
        found = {}
        for value in self.values():
            entry, folder = entries.get(value), f"{self.column}={value}"
            names = [f"{folder}/{f}" for f in self._appended(value, entry)]
            if entry and entry.generation:
                kept = self._folder(value, entry.generation)
                names += [f"{kept.removeprefix(f'{self.path}/')}/{f}" for f in storage.files(self.spark, kept)]
            if names:
                found[value] = names
        return found

    def read_files(self, names: Iterable[str]) -> DataFrame:
        """Rows of some of the files that ``live_files`` names."""
        appended, rewritten = [], []
        for name in names:
            (rewritten if name.startswith(f"{REWRITTEN}/") else appended).append(f"{self.path}/{name}")
        return self._read(appended, rewritten)

    def rewrite(self, changes: Mapping[str, Change | None], **options: str) -> None:
        """Exchange partitions for what their changes make of them, all at once; ``None`` leaves nothing of a partition."""
        number, entries = self.pointer()
        new = dict(entries)
        for value, change in changes.items():
            entry = entries.get(value)
            files = self._appended(value, entry)
            before = entry.generation if entry else None
            generation = None
            if change is not None:
                paths = [f"{self.path}/{self.column}={value}/{f}" for f in files]
                rows = change(self._read(paths, [self._folder(value, before)] if before else []))
                generation = f"{number + 1}-{uuid.uuid4().hex[:8]}"
                folder = self._folder(value, generation)
                rows.drop(self.column).write.partitionBy(BATCH).options(**options).parquet(folder)
                if not storage.partition_values(self.spark, folder, BATCH):
                    generation = None
            new[value] = Entry(generation, frozenset(files) | (entry.replaced if entry else frozenset()))
        self._commit(number + 1, new)

    def discard(self, batch: str) -> None:
        """Remove all rows of a batch label."""
        for folder in (self.path, f"{self.path}/{REWRITTEN}"):
            inner = "" if folder == self.path else f"/{GENERATION}=*"
            storage.delete_matching(self.spark, f"{folder}/{self.column}=*{inner}/{BATCH}={batch}")

    def purge(self) -> None:
        """Delete what rewritings have replaced. For a time when no reader began before the last of them."""
        number, entries = self.pointer()
        if number < 0:
            return
        for value, entry in entries.items():
            for file in entry.replaced:
                storage.delete(self.spark, f"{self.path}/{self.column}={value}/{file}")
            for generation in storage.partition_values(self.spark, f"{self.path}/{REWRITTEN}/{self.column}={value}", GENERATION):
                made_for = int(generation.split("-")[0])
                if generation != entry.generation and made_for <= number:  # a later one is being written
                    storage.delete(self.spark, self._folder(value, generation))
        if any(e.replaced or not e.generation for e in entries.values()):
            self._commit(number + 1, {v: Entry(e.generation) for v, e in entries.items() if e.generation})
            number += 1
        for old in storage.numbered(self.spark, f"{self.path}/{POINTER}"):
            if old < number:
                storage.delete(self.spark, f"{self.path}/{POINTER}/{old}.json")
