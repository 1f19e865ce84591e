from __future__ import annotations

import random
import timeit
import zlib

import numpy as np
import pyarrow as pa
import pytest

from changeflow.llm import language, topk

SYLLABLES = {"aa": "ka lo mi tu re sa".split(), "bb": "sch ung ein ver ich ge".split(), "cc": "eau oi que les ment tion".split()}


def text_in(lang, made, words):
    return " ".join("".join(made.choice(SYLLABLES[lang]) for _ in range(made.randint(1, 4))) for _ in range(words))


def documents(spark, n=400):
    made = random.Random(9)
    rows = []
    for i in range(n):
        lang = made.choice(sorted(SYLLABLES))
        rows.append((i, text_in(lang, made, made.randint(3, 60)), lang if i % 11 else None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def test_held_out_documents_are_named(spark):
    docs, rows = documents(spark)
    got = {r.doc_id: r for r in language.language_id(docs).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == {r[0] for r in held}
    right = [got[i].lang_pred == lang for i, _, lang in held if lang]
    assert sum(right) >= 0.98 * len(right)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_only_training_rows_teach(spark):
    docs, rows = documents(spark)
    from pyspark.sql import functions as F

    wrong = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    a = {r.doc_id: (r.lang_pred, r.score) for r in language.language_id(docs).collect()}
    assert a == {r.doc_id: (r.lang_pred, r.score) for r in language.language_id(wrong).collect()}


def test_mixtures_are_the_best_on_a_grid(spark):
    docs, _ = documents(spark)
    names, logs = language.train(docs.where("lang is not null"))
    made = random.Random(1)
    text = text_in("aa", made, 60) + " " + text_in("cc", made, 30)
    share = language.proportions([text], logs)[0]
    assert share[names.index("aa")] > share[names.index("cc")] > 0.2 and share[names.index("bb")] == 0
    counts = language.trigrams(text, logs.shape[1])
    at = np.flatnonzero(counts)
    p = np.exp(logs[:, at])
    value = lambda a: (counts[at] * np.log(a * p[0] + (1 - a) * p[2])).sum()
    best = max(np.linspace(0.01, 0.99, 99), key=value)
    assert abs(best - share[0]) < 0.03


def test_language_of_odd_and_no_rows(spark, odd_documents, no_documents):
    got = {r.doc_id: r for r in language.language_id(odd_documents).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 3))
    assert got[5].lang_pred == "en" and not got[None].held_out
    assert language.language_id(no_documents).count() == 0
    unlabelled = odd_documents.withColumn("lang", odd_documents.text.substr(1, 0)).where("text is null or doc_id is null")
    assert {r.lang_pred for r in language.language_id(unlabelled).collect()} == {"und"}


def test_model_size_is_bounded():
    assert language.bucket_count(4) == language.BUCKETS
    assert all(n * language.bucket_count(n) <= language.CELLS for n in (300, 1_000, 10_000))


def brute(rows, k, every):
    ok = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: v for i, v in ok if i is not None and i % every == 0}.items():
        cut = lambda x: max(-(2**63), min(2**63 - 1, x))
        scored = sorted((-cut(sum(x * y for x, y in zip(a, b, strict=True))), i) for i, b in ok if i != q and i is not None and len(b) == len(a))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e8])
def test_top_k_equals_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    made = np.random.default_rng(int(scale))
    rows = [(i, (made.normal(size=12) * scale).tolist()) for i in range(400)]
    rows += [(1_000 + i, rows[0][1]) for i in range(60)] + [(2_000, None), (2_001, [None] * 12), (2_010, [float("nan")] * 12), (2_020, [float("inf")] * 12), (None, rows[0][1])]
    rows += [(3_000, [1.0, 2.0]), (3_001, [2.0, 1.0]), (4_000, []), (4_001, [])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(docs, 10, 10).collect()}
    assert got == brute(rows, 10, 10)


def test_top_k_of_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (3, [0.5, 1.0]), (5, [0.5, 1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(docs, 10, 100).collect()} == brute(rows, 10, 100)
    assert topk.top_k(docs.limit(0)).count() == 0
    assert topk.top_k(docs.where("vec_id != 0")).count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e8])
def test_top_k_of_more_blocks_than_a_task_holds(spark, monkeypatch, scale):
    for name, value in (("BLOCK", 25), ("QUERY_BLOCK", 9), ("HELD", 2), ("GROUPS", 3), ("TILE", 64), ("WIDE", 8)):
        monkeypatch.setattr(topk, name, value)
    made = np.random.default_rng(int(scale))
    rows = [(i, (made.normal(size=12) * scale).tolist()) for i in range(300)]
    rows += [(i, rows[20][1]) for i in range(300, 420)] + [(i, [0.0] * 12) for i in range(420, 450)] + [(30, rows[30][1]), (33, rows[33][1]), (500, [1.0, None] * 6)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(docs, 10, 10).collect()}
    assert got == brute(rows, 10, 10)


@pytest.mark.parametrize("largest", [1, 400, 2**20, 2**40, 2**62])
def test_products_are_exact_in_the_type_they_are_made_in(largest):
    made = np.random.default_rng(1)
    whole = made.integers(-largest, largest, size=(30, 12), endpoint=True).astype(np.float64)
    ids = np.arange(30)
    q, found, score = topk.pair(ids[:6], whole[:6], ids, whole, 30)
    rows = [[int(x) for x in v] for v in whole]
    cut = lambda x: max(-(2**63), min(2**63 - 1, x))
    want = {(a, b, cut(sum(x * y for x, y in zip(rows[a], rows[b], strict=True)))) for a in range(6) for b in range(30) if a != b}
    assert set(zip(q.tolist(), found.tolist(), score.tolist(), strict=True)) == want and len(q) == len(want)


def test_a_pair_of_blocks_costs_little_more_than_sorting_its_products():
    """Query by query, the phases took eight times as long as that."""
    made = np.random.default_rng(2)
    vectors = np.floor(made.normal(size=(4_096, 64)) / 8 * 1_024)
    queries, ids, q_ids = vectors[:1_024], np.arange(4_096), np.arange(1_024)
    columns = {"length": [64], "q_block": [0], "ids": [ids.tobytes()], "vectors": [vectors.tobytes()], "q_ids": [q_ids.tobytes()], "q_vectors": [queries.tobytes()]}
    batch = pa.RecordBatch.from_pydict(columns)
    plain = lambda: np.sort(queries @ vectors.T, axis=1)
    phases = lambda: list(topk._task(10)(iter([batch])))
    least = [min(timeit.repeat(f, number=1, repeat=5)) for f in (plain, phases)]
    assert least[1] < 5 * least[0]


@pytest.mark.parametrize("held", [0, 1, 50])
def test_reports_of_a_task_are_merged(monkeypatch, held):
    """Blocks of queries and candidates in any order, more of them than a task holds, with equal scores and repeated ids."""
    monkeypatch.setattr(topk, "HELD", held)
    monkeypatch.setattr(topk, "TILE", 64)
    made = np.random.default_rng(4)
    vectors = made.integers(-3, 4, size=(90, 6)).astype(np.int16)
    ids = np.sort(made.integers(0, 70, size=90))
    dealt = [np.arange(at, 90, 3) for at in range(3)]
    q_rows = [np.flatnonzero(np.diff(ids, prepend=-1) > 0)[at::2] for at in range(2)]
    rows = [{"length": 6, "q_block": b, "ids": ids[c].tobytes(), "vectors": vectors[c].tobytes(), "q_ids": ids[q].tobytes(), "q_vectors": vectors[q].tobytes()} for c in dealt for b, q in enumerate(q_rows)]
    kinds = pa.schema([("length", pa.int32()), ("q_block", pa.int32()), *[(c, pa.binary()) for c in ("ids", "vectors", "q_ids", "q_vectors")]])
    best = {}
    for q in np.concatenate(q_rows):
        order = sorted((-int(vectors[q].astype(int) @ v.astype(int)), int(i)) for i, v in zip(ids, vectors, strict=True) if i != ids[q])
        best[int(ids[q])] = [(i, -s) for s, i in order[:4]]
    batches = [pa.RecordBatch.from_pylist(rows[at : at + 2], schema=kinds) for at in range(0, len(rows), 2)]
    got = {}
    for found in topk._task(4)(iter(batches)):
        for row in found.to_pylist():
            got.setdefault(row["query_id"], []).append((-row["score"], row["vec_id"]))
    assert {q: [(i, -s) for s, i in sorted(x)[:4]] for q, x in got.items()} == best
    assert all(len(x) == 4 for x in got.values()) or held < 2
