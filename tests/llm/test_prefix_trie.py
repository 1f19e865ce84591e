from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from changeflow.llm import prefix_trie

KIND = "conv_id long, turn long, role string, text string"


def expected(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv].append(((turn is not None, turn or 0), tie, (role, text)))
    turns = {c: [x[2] for x in sorted(t)] for c, t in turns.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(turns.get(c - c % 100, [])[:h] + turns[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in rebuilt.items():
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        out.append(
            (
                min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), children[path],
                sum(not children[p] for p in below), sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
                hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, KIND).repartition(3)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df, **more).collect()), key=repr)


@pytest.mark.parametrize("block", [1, 2, 4])
def test_nodes_equal_brute_force(spark, block):
    made = random.Random(block)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 220), 1_000, 1_001]:
        for t in range(made.choice([1, 2, 3, 5, 8, 13])):
            rows.append((c, t, made.choice(["user", "assistant"]) if t > 3 else "user", made.choice("ab") if t > 1 else "same 😀"))
    assert run(spark, rows, block=block) == expected(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "a", "b"), (7, None, None, None), (7, 2, "r", None), (7, 2, "r", None), (7, 2, None, "r"), (7, None, "x", "é" * 3)]
    rows += [(201, 1, "u", "only"), (305, 0, "", ""), (300, 5, None, "t"), (306, 0, "a", "bc"), (307, 0, "ab", "c")]
    assert run(spark, rows) == expected(rows)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], KIND + ", depth int, p1 int")
    assert prefix_trie.prefix_trie(df).count() == len(expected(rows))
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0
    assert prefix_trie.prefix_trie(df.where("conv_id IS NULL")).count() == 0


def test_all_turnless_end_at_the_root(spark):
    rows = [(c, 0, "u", "x") for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6]
    got = run(spark, rows)
    assert got == expected(rows) and len(got) == 1 and got[0][5] == 1


def test_a_long_conversation_and_many_copies(spark):
    rows = [(500, t, "u", f"t{t % 7}") for t in range(700)] + [(501, t, "u", f"t{t % 7}") for t in range(650)]
    rows += [(c, t, "u", f"t{t}") for c in range(600, 640) for t in range(3)]
    got = run(spark, rows)
    assert got == expected(rows)


def test_sums_run_on_over_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(c, t, bytes([t % 5] * 16)) for c, n in ((1, 3), (2, 400), (3, 2)) for t in range(n)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, digest binary").repartition(5)
        got = prefix_trie.with_running_sums(df, None, ["turn"], "test").collect()
        assert sorted((r.conv_id, r.turn, r.s1) for r in got) == sorted((c, t, t + 1) for c, t, _ in rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ids_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    rows = [(p, p, c) for p in range(4) for c in range(p * 30)]
    df = spark.createDataFrame(rows, "p1 long, p2 long, conv_id long").orderBy(F.rand(1))
    got = {r.p1: r.ends_sha256 for r in prefix_trie.end_digests(df).collect()}
    assert got == {p: hashlib.sha256(",".join(map(str, range(p * 30))).encode()).hexdigest() for p in range(1, 4)}
