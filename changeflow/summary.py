"""A summary of a partitioned table, kept up to date without reading what it covers already.

    <path>/part=<number>-<id>/     summary of one partition
    <path>/_pointer/<number>.json  the parts that count, each with the files of the table that it stands for

A part counts as long as all of its files still belong to the table; other files of the partition are summarised when the
summary is read. A partition that was merged, cleaned or lost a batch has other files and is read anew, so the result
always equals a summary of the whole table as it is now.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from changeflow import storage
from changeflow.rewritable import POINTER, RewritableTable

PART = "part"

Summarise = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Part:
    folder: str
    files: frozenset[str] = field(default_factory=frozenset)


class Summary:
    def __init__(self, table: RewritableTable, path: str, summarise: Summarise, merge: Summarise, order: tuple[str, ...] = ()):
        """``summarise`` turns rows of the table into a summary, ``merge`` a union of summaries into one of the same columns.
        ``order`` are the columns by which a part is sorted."""
        self.table, self.spark, self.path = table, table.spark, path.rstrip("/")
        self.summarise, self.merge, self.order = summarise, merge, order

    def _parts(self) -> tuple[int, dict[str, Part]]:
        numbers = storage.numbered(self.spark, f"{self.path}/{POINTER}")
        if not numbers:
            return -1, {}
        noted = json.loads(storage.read_text(self.spark, f"{self.path}/{POINTER}/{max(numbers)}.json"))
        return max(numbers), {v: Part(p["folder"], frozenset(p["files"])) for v, p in noted.items()}

    def _commit(self, number: int, parts: dict[str, Part]) -> None:
        text = json.dumps({v: {"folder": p.folder, "files": sorted(p.files)} for v, p in parts.items()})
        storage.commit_text(self.spark, f"{self.path}/{POINTER}/{number}.json", text)

    def _stored(self, folders: list[str], like: DataFrame) -> DataFrame:
        paths = [f"{self.path}/{PART}={folder}" for folder in folders]
        stored = self.spark.read.schema(like.schema).option("basePath", self.path).parquet(*paths)
        return stored.select(*like.columns)

    def _of(self, folders: list[str], files: list[str]) -> DataFrame:
        fresh = self.summarise(self.table.read_files(files))
        if not folders:
            return fresh
        stored = self._stored(folders, fresh)
        return self.merge(stored.unionByName(fresh) if files else stored)

    def uncovered(self, wanted: Callable[[str], bool] = lambda value: True) -> list[str]:
        """Files that a reader of some partitions has to read."""
        return self._split(wanted)[1]

    def _split(self, wanted: Callable[[str], bool]) -> tuple[list[str], list[str]]:
        parts, folders, rest = self._parts()[1], [], []
        for value, files in self.table.live_files().items():
            if not wanted(value):
                continue
            part = parts.get(value)
            if part and part.files <= set(files):
                folders.append(part.folder)
                files = [f for f in files if f not in part.files]
            rest += files
        return folders, rest

    def read(self, wanted: Callable[[str], bool] = lambda value: True) -> DataFrame:
        """The summary of the table, or of some of its partitions, as it is now."""
        return self._of(*self._split(wanted))

    def refresh(self) -> None:
        """Cover what was appended or rewritten since. Parts that an earlier refresh replaced are deleted, so a reader may
        still be at work on the newest but one while a refresh runs."""
        number, parts = self._parts()
        used = {p.folder for p in parts.values()}
        for folder in storage.partition_values(self.spark, self.path, PART):
            if folder not in used and int(folder.split("-")[0]) <= number:
                storage.delete(self.spark, f"{self.path}/{PART}={folder}")
        new = {}
        for value, files in self.table.live_files().items():
            part = parts.get(value)
            kept = part if part and part.files <= set(files) else None
            rest = [f for f in files if kept is None or f not in kept.files]
            if not rest:
                new[value] = kept
                continue
            folder = f"{number + 1}-{uuid.uuid4().hex[:8]}"
            rows = self._of([kept.folder] if kept else [], rest)
            rows = rows.sortWithinPartitions(*self.order) if self.order else rows
            rows.write.parquet(f"{self.path}/{PART}={folder}")
            new[value] = Part(folder, frozenset(files))
        if new != parts:
            self._commit(number + 1, new)
            for old in storage.numbered(self.spark, f"{self.path}/{POINTER}"):
                if old < number:
                    storage.delete(self.spark, f"{self.path}/{POINTER}/{old}.json")
