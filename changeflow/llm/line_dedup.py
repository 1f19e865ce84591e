"""Lines that many documents share, counted in levelled sorted runs of line hashes. DataFrame functions only.

``LineRuns`` keeps (key1, key2, n): two 64-bit hashes of a line's key and the documents that have it. A run is a table
bucketed and sorted by the hashes. ``add`` merges a batch: its hashes are anti-joined with those that the runs already
know to be common, and the rest becomes a run of level 0. ``FANOUT`` runs of a level are compacted to one of the next,
adding up their counts, so a batch meets few runs and a hash is rewritten once a level.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.common import BLANKS, scratch_dir, stored

FANOUT = 2
BATCHES = 4
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, CAPITALS, SMALL))


def lines_of(text: Column) -> Column:
    """Array of the lines of a text; one empty line for a null or empty text."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("key1"), F.xxhash64(F.lit("line"), key).alias("key2")]


def merged(one: DataFrame, other: DataFrame) -> DataFrame:
    """Merge of two sorted runs; both are bucketed alike, so neither is shuffled or sorted."""
    more = other.withColumnRenamed("n", "more")
    total = F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))
    return one.join(more, ["key1", "key2"], "full").select("key1", "key2", total.alias("n"))


class LineRuns:
    """Runs of line hashes with the number of documents that have each, for lines found in ``limit`` documents or more."""

    def __init__(self, spark: SparkSession, limit: int, fanout: int = FANOUT) -> None:
        self.spark, self.limit, self.fanout = spark, limit, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    def _run(self, counts: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex[:12]}"
        dealt = counts.repartition(self.buckets, "key1", "key2").write.bucketBy(self.buckets, "key1", "key2").sortBy("key1", "key2")
        dealt.option("path", scratch_dir(self.spark, "line-run")).format("parquet").saveAsTable(name)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def totals(self) -> DataFrame:
        """(key1, key2, n) over all runs."""
        return reduce(merged, self.runs())

    def common(self) -> DataFrame:
        return self.totals().where(F.col("n") >= self.limit).select("key1", "key2")

    def add(self, batch: DataFrame) -> None:
        """Merge the counts (key1, key2, n) of a batch, a row for each hash."""
        fresh = batch.select("key1", "key2", "n")
        if self.runs():
            fresh = fresh.join(self.common(), ["key1", "key2"], "left_anti")
        self._put(0, self._run(fresh))

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            compacted = reduce(merged, self.levels[level])
            self.levels[level] = []
            self._put(level + 1, self._run(compacted))


def without_common_lines(
    docs: DataFrame, least_documents: int = 10, least_chars: int = 1, batches: int = BATCHES
) -> DataFrame:
    """(row, kept_text, n_lines, n_dropped) for each row of ``docs`` (text, and doc_id if there is one): its columns in one
    struct, the text without its common lines, and the lines before and dropped.

    A line is common if its key has ``least_chars`` code points or more and ``least_documents`` rows of ``docs`` or more
    have it; then every such line goes. Each row counts as a document, repeated rows too. A null or empty text is one
    empty line and becomes the empty text.
    """
    spark = docs.sparkSession
    row = F.struct(*[docs[c] for c in docs.columns])
    text = docs["text"].cast("string")
    identity = [docs["doc_id"]] if "doc_id" in docs.columns else []
    base = docs.select(
        row.alias("row"),
        lines_of(text).alias("lines"),
        F.xxhash64(F.lit("a"), *identity, text).alias("id1"),
        F.xxhash64(F.lit("b"), text, *identity).alias("id2"),
    )
    keyed = base.select("id1", "id2", F.posexplode("lines").alias("pos", "line")).select("id1", "id2", "pos", line_key(F.col("line")).alias("key"))
    keyed = keyed.where(F.char_length("key") >= max(1, least_chars))

    own = base.select("id1", F.array_distinct(F.transform("lines", line_key)).alias("keys"))
    own = own.select(F.pmod("id1", F.lit(batches)).cast("int").alias("batch"), F.explode("keys").alias("key"))
    own = own.where(F.char_length("key") >= max(1, least_chars)).select("batch", *hashes(F.col("key")))
    counts = stored(own.groupBy("batch", "key1", "key2").agg(F.count("*").alias("n")), "line-counts")
    runs = LineRuns(spark, least_documents)
    for batch in range(batches):
        runs.add(counts.where(F.col("batch") == batch))
    common = stored(runs.common(), "common-lines")

    hits = keyed.select("id1", "id2", "pos", *hashes(F.col("key"))).join(common, ["key1", "key2"], "left_semi")
    hits = hits.groupBy("id1", "id2").agg(F.sort_array(F.collect_set("pos")).alias("drop"))
    found = base.join(stored(hits, "line-hits"), ["id1", "id2"], "left")
    bounds = F.concat(F.array(F.lit(-1)), F.col("drop"), F.array(F.size("lines")))
    between = F.transform(
        F.sequence(F.lit(0), F.size("bounds") - 2),
        lambda i: F.slice(F.col("lines"), F.get(F.col("bounds"), i) + 2, F.get(F.col("bounds"), i + 1) - F.get(F.col("bounds"), i) - 1),
    )
    kept = F.when(F.col("drop").isNull(), F.coalesce(F.col("row.text").cast("string"), F.lit(""))).otherwise(F.array_join(F.flatten(between), "\n"))
    return found.withColumn("bounds", bounds).select(
        "row",
        kept.alias("kept_text"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
