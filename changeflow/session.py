"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Settings the jobs rely on. AQE sizes the shuffle partitions at run time, so the
# initial number is only an upper bound for the largest shuffle.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.parallelPartitionDiscovery.threshold": "32",
}


def build_session(
    name: str = "changeflow", master: str | None = None, shuffle_partitions: int | None = None, **conf: str
) -> SparkSession:
    """A session with ``SETTINGS``; ``conf`` keys use ``_`` for ``.`` or are passed as they are."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str, base: str | None = None) -> str:
    """A new folder below ``base``, by default ``spark.checkpoint.dir``, which every executor can reach."""
    base = base or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"{base.rstrip('/')}/changeflow-{label}-{uuid.uuid4().hex[:12]}"
