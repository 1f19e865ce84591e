"""Scratch tables and small helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# the ASCII white space that separates words: \x20 and \x09-\x0D
BLANKS = " \t\n\x0b\f\r"
# what a Python worker holds of its input at a time
BATCH_ROWS = 1_000
_own_folder: str | None = None
_used: dict[str, list[str]] = {}
_sent: set[str] = set()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share; a local session may do without the setting."""
    global _own_folder
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if _own_folder is None:
            _own_folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        base = _own_folder
    path = f"{base.rstrip('/')}/llm-{label}-{uuid.uuid4().hex[:12]}"
    _used.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """``df`` as a written table: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = folder or scratch_dir(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables. Call it when the results made from them have been written."""
    for path in _used.pop(spark.sparkContext.applicationId, []):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def python_ready(spark: SparkSession, rows: int = BATCH_ROWS, batch_bytes: str = "16m") -> None:
    """Send this package to the Python workers, and bound what they get at a time, by rows and by bytes."""
    application = spark.sparkContext.applicationId
    if application not in _sent:
        package = Path(__file__).resolve().parents[1]
        archive = str(Path(tempfile.mkdtemp(prefix="run-")) / f"{package.name}.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(package.rglob("*.py")):
                out.write(path, path.relative_to(package.parent))
        spark.sparkContext.addPyFile(archive)
        _sent.add(application)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch_bytes)


def text_of(batch_column) -> Iterator[bytes]:
    """UTF-8 of each text of an Arrow column; a null text is empty."""
    for text in batch_column.to_pylist():
        yield text.encode("utf-8", "surrogatepass") if text else b""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """Path of a public vocabulary file, by default of the installed package; every machine has it there."""
    if folder is None:
        import public_tokenizers

        return public_tokenizers.path(name)
    return f"{folder}/{name}"


def any_row(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def same(left: Column, right: Column) -> Column:
    """Equal, or both null."""
    return left.eqNullSafe(right)


def code_points(text: Column) -> Column:
    return F.char_length(text)
