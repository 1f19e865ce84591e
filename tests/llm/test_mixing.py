from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

from changeflow.llm import mixing
from changeflow.llm.mixing import Mix


def documents(spark, n=600):
    made = random.Random(8)
    sources = ["s0"] * 6 + ["s1", "s10", "s2", "é", None]
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(made.randint(0, 200))), made.choice(sources), "en", 0) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long"), rows


def water_levels(sizes: dict, weights=(3, 1, 2), percent=150, most=2) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, open_names = {}, set(names)
    whole = sum(sizes.values()) * percent / 100
    while True:
        left = whole - sum(most * sizes[s] for s in names if s not in open_names)
        share = {s: left * weight[s] / sum(weight[x] for x in open_names) for s in open_names}
        over = {s for s in open_names if share[s] > most * sizes[s]}
        if not over:
            return {s: share.get(s, most * sizes[s]) for s in names}
        open_names -= over
    return target


def test_targets_and_taken_words(spark):
    docs, rows = documents(spark)
    mix = Mix(block=16, shard_blocks=50)
    got = {r.doc_id: r for r in mixing.mix_sources(docs, mix).collect()}
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, text, source, *_ in rows:
        sizes[source] += len(text.split())
        assert got[i].size == len(text.split()) and got[i].taken <= 2 * got[i].size
        taken[source] += got[i].taken
    want = water_levels(sizes)
    for i, _, source, *_ in rows:
        assert got[i].source_size == sizes[source] and abs(got[i].target - want[source]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 2 * 16 + 0.01 * want[s] for s in want)
    assert {r.doc_id: r.taken for r in mixing.mix_sources(docs.repartition(7), mix).collect()} == {i: got[i].taken for i in got}


def test_shards_draw_what_there_is():
    slots = np.array([5, 0, 700, 33, 1])
    drawn = [mixing.shard_counts(slots, 9, t, 1) for t in range(9)]
    assert (sum(c for c, _ in drawn) == slots).all()
    assert all((drawn[t][1] == sum((c for c, _ in drawn[:t]), np.zeros(5, int))).all() for t in range(9))
    assert max(c.sum() for c, _ in drawn) - min(c.sum() for c, _ in drawn) <= 9
    large = np.array([3 * 10**12, 10**12])
    assert (sum(mixing.shard_counts(large, 4, t, 1)[0] for t in range(4)) == large).all()


def test_permutations():
    for size in (1, 2, 3, 7, 64, 1000):
        assert sorted(mixing.permuted(np.arange(size), size, (1, 2, 3)).tolist()) == list(range(size))
    assert (mixing.permuted(np.arange(1000), 1000, (1, 2, 3)) != mixing.permuted(np.arange(1000), 1000, (1, 2, 4))).any()


def test_every_slot_once(spark):
    docs, _ = documents(spark, 200)
    mix = Mix(block=16, shard_blocks=50)
    at, sources = mixing.placed(docs, mix)
    slots = mixing.slots_of(sources, mix).collect()
    assert len({(r.shard, r.slot) for r in slots}) == len(slots) == sum(r.slots for r in sources.collect())
    assert len({(r.number, r.block, r["pass"]) for r in slots}) == len(slots)


def test_texts_of_the_mix(spark):
    docs, rows = documents(spark, 200)
    mix = Mix(block=16, shard_blocks=50)
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(docs, mix).collect()}
    words, whole = defaultdict(int), {i: t for i, t, *_ in rows}
    out = mixing.mixed_documents(docs, mix)
    assert out.columns == docs.columns
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        assert set(r.text.split()) <= set(whole[r.doc_id].split()) and r.n_chars == len(r.text)
    assert {i: n for i, n in taken.items() if n} == dict(words)


def test_odd_and_no_rows(spark, odd_documents, no_documents):
    got = mixing.mix_sources(odd_documents).collect()
    assert len(got) == odd_documents.count()
    assert all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix_sources(no_documents).count() == 0
    assert mixing.mixed_documents(odd_documents).columns == odd_documents.columns
    assert mixing.mixed_documents(no_documents).count() == 0
    empty = no_documents.union(odd_documents.where("text is null").select(*no_documents.columns))
    assert {(r.taken, r.target) for r in mixing.mix_sources(empty).collect()} == {(0, 0.0)}


def test_cut_text():
    assert mixing.cut_text("a  b\nc d", 4, [(0, 2), (2, 2)]) == "a  b\nc d"
    assert mixing.cut_text("a  b\nc d", 4, [(0, 1), (2, 1), (3, 1)]) == "a\nc d"


def test_large_nodes_are_drawn_too():
    """Two billion slots of a source, more than are drawn at once."""
    slots = np.array([2_000_000_000, 700, 1_500_000_001], np.int64)
    counts, before = zip(*(mixing.shard_counts(slots, 4, k, 7) for k in range(4)), strict=True)
    assert (sum(counts) == slots).all() and (before[0] == 0).all() and (before[3] + counts[3] == slots).all()
    assert all((c >= 0).all() for c in counts)
    again = mixing.shard_counts(slots, 4, 2, 7)
    other = mixing.shard_counts(slots, 4, 2, 8)
    assert (again[0] == counts[2]).all() and (other[0] != counts[2]).any()
    spread = [int(mixing._halved(slots, int(slots.sum()) // 2, [k])[0]) - 1_000_000_000 for k in range(40)]
    assert 5_000 < np.std(spread) < 40_000  # hypergeometric: about 14,600


def test_slots_are_written_before_they_are_joined(spark):
    docs = spark.createDataFrame([(k, "a b c " * 50, f"s{k % 3}") for k in range(60)], "doc_id long, text string, source string")
    plan = mixing.mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan
