"""From raw documents to sampled token pieces, in five stages.

``run`` writes each stage's documents as Parquet and reads them again for the next. All stages but the last return the
columns of ``documents``; ``n_chars`` follows the text. The stages' operators say what they do with nulls, empty texts and
repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.common import stored, table, tokenizer_file
from changeflow.llm.line_dedup import without_common_lines
from changeflow.llm.mixing import Mix, mixed_documents
from changeflow.llm.near_dup import deduplicated
from changeflow.llm.quality import keep_good
from changeflow.llm.sampling import encode_sampled

PIECES = "piece_bpe_32k.model"
# sampled segmentations can't be written in SQL
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier test keep."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share."""
    rows = without_common_lines(docs, least_documents=10, least_chars=1)
    columns = {c: F.col("row").getField(c).alias(c) for c in docs.columns}
    columns["text"] = F.col("kept_text").alias("text")
    if "n_chars" in columns:
        columns["n_chars"] = F.char_length("kept_text").cast("bigint").alias("n_chars")
    return rows.select(*columns.values())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more."""
    return deduplicated(docs, shingle=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them, a row for each pass over a document, cut to the words it takes."""
    return mixed_documents(docs, Mix(block=2_048))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, pieces, n_pieces): a sampled segmentation of each text."""
    encoded = encode_sampled(docs, tokenizer_file(PIECES), seed=1, sharpness=1.0)
    return encoded.withColumn("n_pieces", F.size("pieces").cast("bigint"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("pieces", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
