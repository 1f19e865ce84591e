"""Shards by extendible hashing: every shard holds a prefix of hash bits, and only shards beyond the byte limit split on
another bit. DataFrame functions only.

Bytes are added up per prefix of ``depth`` bits and, from those sums, for every shorter prefix; a row's shard is its
shortest prefix whose rows fit the limit. That is the directory after all splits. Prefixes that are too large even at
``depth`` go on with ``MORE_BITS`` further bits, their rows alone. Rows whose key agrees in all bits, that is rows of one
key, can't be split by the hash; such a bucket gets overflow pages that are filled up to the limit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeflow.llm.common import any_row, stored

FIRST_BITS_BEYOND = 3
MORE_BITS = 8
HASH_BITS = 60
PARTS = 1_024


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text; of the empty text for null."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _prefix(bits: Column, depth: Column) -> Column:
    """The first ``depth`` bits as a text of 0 and 1."""
    return F.substring(F.lpad(F.bin(bits), HASH_BITS, "0"), F.lit(1), depth)


def _directory(rows: DataFrame, start: int, depth: int, limit: int) -> DataFrame:
    """(leaf, shard, shard_bytes): for each prefix of ``depth`` bits the shortest one that fits, null if none does."""
    leaves = rows.groupBy("leaf").agg(F.sum("bytes").alias("bytes"))
    leaves = stored(leaves, "leaves")
    every = leaves.select("leaf", "bytes", F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("depth"))
    every = every.withColumn("prefix", F.substring(F.col("leaf"), F.lit(1), F.col("depth")))
    sums = every.groupBy("prefix").agg(F.sum("bytes").alias("shard_bytes")).where(F.col("shard_bytes") <= limit)
    fits = every.join(sums, "prefix").groupBy("leaf").agg(F.min("depth").alias("depth"))
    fits = fits.select("leaf", F.substring(F.col("leaf"), F.lit(1), F.col("depth")).alias("shard"))
    sums = sums.withColumnRenamed("prefix", "shard")
    found = fits.join(sums, "shard")
    return stored(leaves.select("leaf").join(found, "leaf", "left"), "directory")


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of rows (doc_id, bits, bytes) whose buckets can't be split: rows are numbered within each bucket, by
    parts so that no task holds a bucket, and a page takes as many as its largest row allows."""
    rows = stored(rows.select("doc_id", "bits", "bytes").withColumn("row", F.monotonically_increasing_id()), "overflow")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int"))
    sums = rows.groupBy("bits", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bits").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("bits", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    largest = rows.groupBy("bits").agg(F.max("bytes").alias("largest"))
    number = F.row_number().over(Window.partitionBy("bits", "part").orderBy("row")) - 1
    numbered = rows.withColumn("number", number).join(sums, ["bits", "part"]).join(largest, "bits")
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("largest", F.lit(1))))
    page = F.floor((F.col("base") + F.col("number")) / per_page).cast("bigint")
    paged = stored(numbered.select("doc_id", "bits", "bytes", page.alias("page")), "pages")
    full = paged.groupBy("bits", "page").agg(F.sum("bytes").alias("shard_bytes"))
    return paged.join(full, ["bits", "page"])


def extendible_shards(docs: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """A row for each row of ``docs`` (text and the key): doc_id (the key), bytes (of the text, null: 0), shard (the prefix as
    0s and 1s, empty if one shard holds all), depth, page (0 but for overflow pages), shard_bytes.

    No (shard, page) exceeds ``limit`` bytes unless it holds a single row. Rows of equal keys share a bucket.
    """
    size = F.coalesce(F.octet_length(docs["text"].cast("string")), F.lit(0)).cast("bigint")
    rows = stored(docs.select(docs[key].alias("doc_id"), hash_bits(docs[key]).alias("bits"), size.alias("bytes")), "hashes")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    start, depth = 0, min(HASH_BITS, FIRST_BITS_BEYOND + max(0, math.ceil(math.log2(max(1, total / limit)))))
    done = []
    while True:
        leafed = rows.withColumn("leaf", _prefix(F.col("bits"), F.lit(depth)))
        directory = _directory(leafed, start, depth, limit)
        at = leafed.join(directory, "leaf")
        done.append(at.where("shard is not null").select("doc_id", "bytes", "shard", F.lit(0).cast("bigint").alias("page"), "shard_bytes"))
        if not any_row(directory.where("shard is null")):
            break
        rows = stored(at.where("shard is null").select("doc_id", "bits", "bytes"), "oversized")
        if depth == HASH_BITS:
            paged = _pages(rows, limit)
            done.append(paged.select("doc_id", "bytes", _prefix(F.col("bits"), F.lit(HASH_BITS)).alias("shard"), "page", "shard_bytes"))
            break
        start, depth = depth + 1, min(HASH_BITS, depth + MORE_BITS)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "bytes", "shard", F.length("shard").alias("depth"), "page", "shard_bytes")


def write_shards(docs: DataFrame, path: str, limit: int, key: str = "doc_id") -> None:
    """The rows of ``docs`` in folders by shard and page; keys must be unique, as they name a row's shard."""
    at = extendible_shards(docs, limit, key).select(F.col("doc_id").alias("its_key"), F.col("shard").alias("its_shard"), F.col("page").alias("its_page"))
    rows = docs.join(at, docs[key].eqNullSafe(F.col("its_key"))).drop("its_key")
    rows = rows.withColumn("its_shard", F.concat(F.lit("b"), "its_shard"))
    rows.repartition("its_shard", "its_page").write.partitionBy("its_shard", "its_page").parquet(path)
