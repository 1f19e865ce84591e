"""The registered queries of the corpus operators and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.common import table, tokenizer_file
from changeflow.llm.language import language_id
from changeflow.llm.line_dedup import without_common_lines
from changeflow.llm.mixing import Mix, mix_sources
from changeflow.llm.near_dup import near_duplicates
from changeflow.llm.phrases import decontaminated
from changeflow.llm.prefix_trie import prefix_trie
from changeflow.llm.quality import quality_verdicts
from changeflow.llm.repair import token_files
from changeflow.llm.sampling import sampled_digests
from changeflow.llm.sharding import extendible_shards
from changeflow.llm.token_counts import token_counts
from changeflow.llm.topk import top_k
from changeflow.llm.whitening import whitened

SHARD_BYTES = 1 << 20
PIECES = "piece_bpe_32k.model"
BYTE_BPE = "byte_bpe_50k.json"


def op1_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust outliers of the statistics of all documents."""
    return quality_verdicts(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix takes of each document: weights 3, 1, 2, 150 % of all words, no source more than twice."""
    return mix_sources(table(spark, sf_dir, "documents"), Mix(weights=(3, 1, 2), percent=150, most=2))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents by the best segmentation over the public vocabulary."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file(PIECES))


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from three quarters of them."""
    rows = language_id(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "held_out", "lang_pred", "score", "n_languages")


def op5_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of at most 1 MiB of text of all documents."""
    return extendible_shards(table(spark, sf_dir, "documents"), limit=SHARD_BYTES)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: two-word shingles, similarity 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten documents or more share."""
    rows = without_common_lines(table(spark, sf_dir, "documents"), least_documents=10, least_chars=1)
    return rows.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as grammar-compressed files and read back."""
    return token_files(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_BPE))


def op9_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentations of all documents, decoded again."""
    return sampled_digests(table(spark, sf_dir, "documents"), tokenizer_file(PIECES), seed=1, sharpness=1.0)


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of each hundredth vector with all others."""
    return top_k(table(spark, sf_dir, "embeddings"), k=10, every=100, factor=1024)


def op11_phrase_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that stand in a ten-word window of a benchmark item, by a positional index."""
    return decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened along their 32 leading components."""
    return whitened(table(spark, sf_dir, "embeddings"), most=32)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_quality_outliers": op1_quality_outliers,
    "op2_mixing": op2_mixing,
    "op3_token_counts": op3_token_counts,
    "op4_language_mixture": op4_language_mixture,
    "op5_extendible_shards": op5_extendible_shards,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_line_dedup": op7_line_dedup,
    "op8_token_files": op8_token_files,
    "op9_sampled_pieces": op9_sampled_pieces,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_phrase_decontamination": op11_phrase_decontamination,
    "op12_whitening": op12_whitening,
    "op13_prefix_trie": op13_prefix_trie,
}

WORDS = r"[^\x20\x09-\x0D]+"
TERMS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op6_near_duplicates": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORDS}') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), ranked AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY c, s) AS r FROM shingles
  JOIN (SELECT s, count(*) AS c FROM shingles GROUP BY s) USING (s)
), rare AS (
  SELECT doc_id, s FROM ranked JOIN sizes USING (doc_id) WHERE r <= n - ceil(0.8 * n) + 1
), candidates AS (
  SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM rare x JOIN rare y ON x.s = y.s AND x.doc_id < y.doc_id
), common AS (
  SELECT a, b, count(*) AS n_common FROM candidates JOIN shingles x ON x.doc_id = a JOIN shingles y ON y.doc_id = b AND y.s = x.s
  GROUP BY a, b
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * n_common >= 80 * (p.n + q.n - n_common)
), reach AS (
  SELECT doc_id AS start, doc_id AS node FROM documents
  UNION SELECT start, CASE WHEN a = node THEN b ELSE a END FROM reach JOIN links ON a = node OR b = node
), least AS (
  SELECT start AS doc_id, min(node) AS component_id FROM reach GROUP BY start
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
""",
    "op7_line_dedup": rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, {LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(common.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common ON keyed.key = common.key GROUP BY doc_id
""",
    "op5_extendible_shards": f"""
WITH rows AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes,
    lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT), 60, '0') AS bits
  FROM documents
), every AS (
  SELECT doc_id, bytes, d AS depth, substr(bits, 1, d) AS shard FROM rows, generate_series(0, 40) AS s(d)
), sums AS (
  SELECT shard, sum(bytes)::BIGINT AS shard_bytes, count(*) AS n FROM every GROUP BY shard
)
SELECT doc_id, bytes, arg_min(shard, depth) AS shard, min(depth)::INTEGER AS depth, 0::BIGINT AS page,
  arg_min(shard_bytes, depth) AS shard_bytes
FROM every JOIN sums USING (shard) WHERE shard_bytes <= {SHARD_BYTES} GROUP BY doc_id, bytes
""",
    "op10_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id != q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 10
""",
    "op11_phrase_decontamination": rf"""
WITH doc_rows AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{TERMS}') AS w FROM documents
), items AS (
  SELECT row_number() OVER () AS item, item_id::VARCHAR AS name, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{TERMS}') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT name, least(10, len(w)) AS width, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT *, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM items WHERE len(w) > 0)
), places AS (
  SELECT row, i, width, array_to_string(w[i:i + width - 1], ' ') AS phrase
  FROM (SELECT row, w, unnest(generate_series(1, len(w))) AS i FROM doc_rows), (SELECT DISTINCT width FROM windows) WHERE i + width - 1 <= len(w)
), hits AS (
  SELECT row, i, p.width, name FROM places p JOIN windows x ON x.width = p.width AND x.phrase = p.phrase
), covered AS (
  SELECT row, count(DISTINCT pos) AS n_hit FROM (SELECT row, unnest(generate_series(i, i + width - 1)) AS pos FROM hits) GROUP BY row
), named AS (
  SELECT row, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS ids FROM (SELECT DISTINCT row, name FROM hits) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_rows LEFT JOIN covered USING (row) LEFT JOIN named USING (row)
""",
    "op13_prefix_trie": """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS rank
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS source, xor(4294967295, list_reduce(
    list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda crc, byte: list_reduce(
      [1, 2, 3, 4, 5, 6, 7, 8], lambda v, bit: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(crc, byte)
    ), 4294967295)) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT i.conv_id, 0 AS part, t.rank, role, text FROM ids i JOIN turns t ON t.conv_id = i.source AND t.rank <= h
  UNION ALL SELECT i.conv_id, 1, t.rank, role, text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.rank > h
), placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, rank) AS depth,
    md5(length(role)::VARCHAR || ':' || role || text) AS digest, length(text) AS chars
  FROM rebuilt
), paths AS (
  SELECT conv_id, depth, chars, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM placed
), ends AS (
  SELECT i.conv_id, coalesce(max(depth), 0) AS depth, coalesce(max(path), '') AS path FROM ids i LEFT JOIN paths USING (conv_id) GROUP BY i.conv_id
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM paths GROUP BY path, depth
  UNION ALL SELECT '', 0, min(conv_id), count(*), 0 FROM ids HAVING count(*) > 0
), children AS (
  SELECT substr(path, 1, length(path) - 32) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), counted AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.path = n.path
), sums AS (
  SELECT substr(path, 1, 32 * above) AS path, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM (SELECT *, unnest(generate_series(0, depth)) AS above FROM counted) GROUP BY 1
), ended AS (
  SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM ends GROUP BY path
)
SELECT c.conv_id::BIGINT AS conv_id, c.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, c.n_convs::BIGINT AS n_convs,
  c.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
  coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM counted c JOIN sums s ON s.path = c.path LEFT JOIN ended e ON e.path = c.path
LEFT JOIN nodes p ON c.depth > 0 AND p.path = substr(c.path, 1, length(c.path) - 32)
""",
}
