"""Names of targets and positions in the log, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.targets import NAME_PREFIX

# The older name kept in history for targets of this family.
FAMILY_PREFIX = "clickhouse-"
FAMILY_ALIAS = "clickhouse-primary"


def qualified(name: Column | str) -> Column:
    return F.concat(F.lit(f"{NAME_PREFIX}:"), name)


def target_aliases(name: Column | str) -> Column:
    """Every name under which a target may appear in history: itself, the part
    after ``Type:``, and the family alias for names of that family."""
    name = F.col(name) if isinstance(name, str) else name
    colon = F.instr(name, ":")
    short = F.when(colon > 1, F.substr(name, colon + 1))
    family = F.when(F.startswith(short, F.lit(FAMILY_PREFIX)), F.lit(FAMILY_ALIAS))
    return F.array_distinct(F.array_compact(F.array(name, short, family)))


def file_number(file: Column | str) -> Column:
    """Numeric suffix of a log file name; names order by it, not as text."""
    return F.regexp_extract(file, r"\.([0-9]+)$", 1).try_cast(T.LongType())


def event_sequence() -> Column:
    """``seq``, or where the producer gave none a number that orders events as their
    place in the log does: positions take 32 bits, file numbers the bits above."""
    place = F.shiftleft(file_number("binlog_file"), 32) + F.col("binlog_pos")
    return F.coalesce(F.col("seq"), place)


# A version made of (file number, position, row) needs more digits than a long holds.
POSITION_VERSION = T.DecimalType(38, 0)


def log_version(columns: Sequence[str], by_position: bool = False) -> Column:
    """Version of a change: its ``seq``, which numbers the rows of the log, else (or
    with ``by_position``) its file number, position and row as one number."""
    if "seq" in columns and not by_position:
        return F.col("seq").cast(T.LongType())
    row_idx = F.col("row_idx") if "row_idx" in columns else F.lit(0)
    digits = [(file_number("binlog_file"), 9, 19), (F.col("binlog_pos"), 10, 9), (row_idx, 9, 0)]
    parts = [
        number.cast(T.DecimalType(size, 0)) * F.lit(f"1{'0' * zeros}").cast(T.DecimalType(zeros + 1, 0))
        for number, size, zeros in digits
    ]
    return (parts[0] + parts[1] + parts[2]).cast(POSITION_VERSION)


def key_column(df: DataFrame, key: str = "id") -> str:
    """The key column of a table: ``key`` if it has one, else its first column."""
    return key if key in df.columns else df.columns[0]
