from __future__ import annotations

import random
from itertools import combinations

import pytest

from changeflow.llm import near_dup


def components(rows, shingle, percent):
    sets = [set(near_dup.shingle_set((t or "").encode(), shingle).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            parent[find(j)] = find(i)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), doc_id), doc_id)
    return {doc_id: (len(sets[k]), least[find(k)]) for k, (doc_id, _) in enumerate(rows)}


def made_rows(seed, groups=12, size=14, words=60, edits=9):
    made = random.Random(seed)
    rows, n = [], 0
    for _ in range(groups):
        base = [f"v{made.randint(0, 5000)}" for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(made.randint(0, edits)):
                copy[made.randrange(words)] = f"v{made.randint(0, 5000)}"
            rows.append((made.randint(0, 10**6) * 1000 + n, " ".join(copy)))
            n += 1
    return rows


@pytest.mark.parametrize(("shingle", "block", "shingles"), [(2, 256, 400_000), (2, 4, 400_000), (5, 256, 400_000), (2, 256, 150)])
def test_groups_equal_all_pairs(spark, monkeypatch, shingle, block, shingles):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(near_dup, "LARGE", 40 * block - 156)  # small blocks also take the rounds with further pivots
    rows = made_rows(shingle)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(docs, shingle, 80).collect()
    want = components(rows, shingle, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_and_no_rows(spark, odd_documents, no_documents):
    got = near_dup.near_duplicates(odd_documents, 2, 80).collect()
    assert len(got) == odd_documents.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[0].n_shingles == by_id[1].n_shingles == 0 and by_id[0].kept and by_id[1].kept
    assert by_id[4].n_shingles == 1
    assert by_id[6].component_id == 5 and not by_id[6].kept
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert near_dup.near_duplicates(no_documents).count() == 0
    kept = near_dup.deduplicated(odd_documents, 2, 80)
    assert kept.columns == odd_documents.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10]


def test_case_and_white_space_of_ascii_only():
    same = near_dup.shingle_set("A b\x0bC".encode(), 2)
    assert (near_dup.shingle_set(b"a B c", 2) == same).all()
    assert len(near_dup.shingle_set("É b c".encode(), 2)) == 1
    assert (near_dup.shingle_set("É b".encode(), 2) != near_dup.shingle_set("é b".encode(), 2)).all()
