"""Change logs as batch or streaming DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.functions.names import file_number
from changeflow.schemas import CHANGE_LOG, CORRUPT

FORMATS = ("parquet", "json")


@dataclass(frozen=True)
class Position:
    """A place in the log: a sequence number, or a file and a position in it."""

    seq: int | None = None
    binlog_file: str | None = None
    binlog_pos: int = 0

    def passed(self) -> Column:
        """Rows after this place."""
        if self.seq is not None:
            return F.col("seq") > self.seq
        number = file_number("binlog_file")
        start = int(self.binlog_file.rsplit(".", 1)[1])
        return (number > start) | ((number == start) & (F.col("binlog_pos") > self.binlog_pos))


def read_changes(
    spark: SparkSession,
    path: str,
    *,
    streaming: bool = False,
    fmt: str = "parquet",
    schema: T.StructType = CHANGE_LOG,
    start: Position | None = None,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Read a change log of Parquet or JSON-lines files.

    A stream resumes from its checkpoint; ``start`` only says where a first run
    begins. JSON logs carry ``_corrupt_record``: see ``split_corrupt``.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown change log format {fmt!r}, expected one of {FORMATS}")
    if fmt == "json":
        schema = _with_corrupt(schema)
    reader = (spark.readStream if streaming else spark.read).schema(schema)
    if streaming and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return from_position(reader.format(fmt).load(path), start)


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def split_corrupt(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable rows, and the text of unreadable ones for the quarantine."""
    good = changes.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, changes.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def read_changes_kafka(
    spark: SparkSession,
    options: dict[str, str],
    *,
    streaming: bool = True,
    schema: T.StructType = CHANGE_LOG,
    start: str = "latest",
) -> DataFrame:
    """Read a change log from Kafka, one JSON object per message.

    ``options`` are Spark's Kafka options; the Kafka package must be on the class path.
    ``start`` (``earliest`` or ``latest``) holds for a first run without checkpoint.
    """
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    if streaming:
        reader = reader.option("startingOffsets", start)
    return parse_messages(reader.options(**options).load(), schema)


def parse_messages(messages: DataFrame, schema: T.StructType = CHANGE_LOG) -> DataFrame:
    """Change rows from messages whose ``value`` is a JSON object; unreadable
    messages keep their text in ``_corrupt_record``."""
    row = F.from_json(F.col("value").cast("string"), _with_corrupt(schema), {"mode": "PERMISSIVE"})
    return messages.select(row.alias("row")).select("row.*")


def from_position(changes: DataFrame, start: Position | None) -> DataFrame:
    """Changes after a place in the log; unreadable rows have no place and stay."""
    if start is not None and CORRUPT in changes.columns:
        return changes.where(start.passed() | F.col(CORRUPT).isNotNull())
    return changes if start is None else changes.where(start.passed())


def newest_position(changes: DataFrame) -> Position:
    """The newest place of a log, from one aggregated row: where a first run that
    wants no history begins."""
    row = changes.agg(F.max("seq").alias("seq")).first()
    return Position(seq=-1 if row["seq"] is None else row["seq"])
