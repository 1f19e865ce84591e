"""The few folder operations Spark's readers and writers do not offer, on the session's file system."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return fs.exists(jpath)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below ``path``; empty when it does not exist."""
    fs, jpath = _fs(spark, path)
    if not fs.exists(jpath):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(jpath) if s.isDirectory())


def numbered(spark: SparkSession, path: str, suffix: str = ".json") -> list[int]:
    """Numbers ``n`` of the files ``<n><suffix>`` directly below ``path``."""
    fs, jpath = _fs(spark, path)
    if not fs.exists(jpath):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(jpath)]
    return sorted(int(n.removesuffix(suffix)) for n in names if n.endswith(suffix) and n.removesuffix(suffix).isdigit())


def files(spark: SparkSession, path: str) -> list[str]:
    """Data files at any depth below ``path``, by their names from there; no hidden ones."""
    fs, jpath = _fs(spark, path)
    if not fs.exists(jpath):
        return []
    base, found, listed = f"{fs.makeQualified(jpath).toString()}/", [], fs.listFiles(jpath, True)
    while listed.hasNext():
        name = listed.next().getPath().toString().removeprefix(base)
        if not any(part.startswith(("_", ".")) for part in name.split("/")):
            found.append(name)
    return sorted(found)


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values ``v`` of the folders ``column=v`` below ``path``."""
    prefix = f"{column}="
    return [n[len(prefix) :] for n in subfolders(spark, path) if n.startswith(prefix)]


def finished(spark: SparkSession, path: str, column: str) -> list[int]:
    """Numbers of the folders ``column=<n>`` whose write was committed."""
    fs, jpath = _fs(spark, f"{path}/{column}=*/_SUCCESS")
    markers = fs.globStatus(jpath) or []
    return sorted(int(m.getPath().getParent().getName().split("=", 1)[1]) for m in markers)


def delete(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return fs.delete(jpath, True)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern matches."""
    fs, jpath = _fs(spark, pattern)
    return [status.getPath().toString() for status in fs.globStatus(jpath) or []]


def delete_matching(spark: SparkSession, pattern: str) -> None:
    fs, jpath = _fs(spark, pattern)
    for status in fs.globStatus(jpath) or []:
        fs.delete(status.getPath(), True)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, jsource = _fs(spark, source)
    if not fs.rename(jsource, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"cannot move {source} to {target}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """Content of a small file, ``None`` when there is none."""
    fs, jpath = _fs(spark, path)
    if not fs.exists(jpath):
        return None
    stream = fs.open(jpath)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, in place of an earlier one."""
    fs, jpath = _fs(spark, path)
    stream = fs.create(jpath, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def commit_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all; an error if it is there already."""
    if exists(spark, path):
        raise FileExistsError(path)
    folder, name = path.rsplit("/", 1)
    draft = f"{folder}/_draft-{uuid.uuid4().hex[:12]}-{name}"
    write_text(spark, draft, text)
    move(spark, draft, path)
