from __future__ import annotations

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from changeflow.llm import line_dedup, sharding


def key(line: str) -> str:
    small = str.maketrans(line_dedup.CAPITALS, line_dedup.SMALL)
    return line.strip(" \t\n\x0b\f\r").translate(small)


def kept_lines(texts, least):
    common = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    return ["\n".join(x for x in (t or "").split("\n") if not (key(x) and common[key(x)] >= least)) for t in texts]


def test_lines_equal_brute_force(spark):
    made = random.Random(2)
    pool = ["Head", "hEAD ", "\tTail\x0b", "É", "é", "", "  ", "own"] + [f"line {k}" for k in range(30)]
    texts = ["\n".join(made.choice(pool) for _ in range(made.randint(1, 12))) for _ in range(120)] + [None, "", "\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.without_common_lines(docs, 10).select("row.doc_id", "kept_text", "n_lines", "n_dropped").collect()}
    want = kept_lines(texts, 10)
    assert [got[i].kept_text for i in range(len(texts))] == want
    assert [got[i].n_lines for i in range(len(texts))] == [len((t or "").split("\n")) for t in texts]
    assert any(r.n_dropped for r in got.values())


def test_repeated_rows_and_clashing_names(spark, odd_documents, no_documents):
    rows = odd_documents.withColumns({c: F.lit(3) for c in ("drop", "id1", "lines", "kept_text")})
    out = line_dedup.without_common_lines(rows, 3)
    got = out.select("row.*", F.col("kept_text").alias("left"), F.col("n_dropped").alias("gone")).collect()
    assert len(got) == odd_documents.count()
    assert all(r.left == "" and r.gone == 1 for r in got if (r.text or "").startswith("Repeated row"))
    assert line_dedup.without_common_lines(no_documents).count() == 0


def test_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, limit=3)
    for batch in range(5):
        rows = [(k, k, 1) for k in range(batch + 1)]
        runs.add(spark.createDataFrame(rows, "key1 long, key2 long, n long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert sorted(r.key1 for r in runs.common().collect()) == [0, 1, 2]
    assert max(r.n for r in runs.totals().collect()) == 3  # a hash known to be common is not stored again


def test_shards_fit_and_are_minimal(spark):
    made = random.Random(4)
    rows = [(i, "x" * made.randint(0, 400)) for i in range(500)] + [(1_000, "y" * 5_000)] + [(2_000, "z" * 30)] * 200
    limit = 2_000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.extendible_shards(docs, limit).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in got:
        sizes[r.shard, r.page] += r.bytes
    assert all(sizes[r.shard, r.page] == r.shard_bytes for r in got)
    members = Counter((r.shard, r.page) for r in got)
    assert all(n <= limit or members[k] == 1 for k, n in sizes.items())
    bits = lambda i: format(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), "060b")
    all_bits = [(bits(i), len(t)) for i, t in rows]
    for r in got:
        assert bits(r.doc_id).startswith(r.shard)
        if r.shard:  # its parent was too large
            assert sum(n for b, n in all_bits if b.startswith(r.shard[:-1])) > limit
    assert {r.shard for r in got if r.doc_id == 2_000} == {bits(2_000)} and max(r.page for r in got) == 3


def test_shards_of_odd_rows(spark, odd_documents, no_documents):
    assert sharding.extendible_shards(odd_documents, 100_000_000).select("shard").distinct().collect()[0][0] == ""
    assert sharding.extendible_shards(odd_documents, 1_000).count() == odd_documents.count()
    assert sharding.extendible_shards(no_documents, 1_000).count() == 0


def test_written_shards_hold_all_rows(spark, folder):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), 50).alias("text"))
    sharding.write_shards(docs, f"{folder}/shards", 1_000)
    back = spark.read.parquet(f"{folder}/shards")
    assert back.count() == 300
    assert back.groupBy("its_shard", "its_page").agg(F.sum(F.length("text")).alias("n")).agg(F.max("n")).first()[0] <= 1_000


def test_native_plans_have_no_python(spark, odd_documents):
    for df in (line_dedup.without_common_lines(odd_documents), sharding.extendible_shards(odd_documents, 1_000)):
        plan = df._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
