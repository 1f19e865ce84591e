from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from changeflow.llm import phrases

SMALL = str.maketrans(phrases.CAPITALS, phrases.SMALL)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(SMALL))


def expected(texts, items, window):
    """(n_words, n_hit, n_items, sha256) of each text."""
    out = []
    for text in texts:
        w, hit, names = words(text), set(), set()
        for name, item in items:
            x = words(item)
            width = min(window, len(x))
            for s in range(len(x) - width + 1 if x else 0):
                for p in range(len(w) - width + 1):
                    if w[p : p + width] == x[s : s + width]:
                        hit.update(range(p, p + width))
                        names.add(name)
        listed = ",".join(sorted(str(n) for n in names if n is not None))
        out.append((len(w), len(hit), len(names), hashlib.sha256(listed.encode()).hexdigest()))
    return out


def run(spark, texts, items, window=10):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r.doc_id: r for r in phrases.decontaminated(docs, bench, window).collect()}
    assert all(r.contaminated == (r.n_hit > 0) for r in rows.values())
    return [(rows[i].n_words, rows[i].n_hit, rows[i].n_items, rows[i].items_sha256) for i in range(len(texts))]


def test_hits_equal_brute_force(spark):
    made = random.Random(5)
    pool = ["The", "the", "É", "é", "7", "a", "b", "c-d", "日本", "x_y"]
    line = lambda n: " ".join(made.choice(pool) for _ in range(n))
    items = [(k, line(made.choice([1, 2, 3, 6, 9]))) for k in range(25)] + [(3, "a b a"), (90, ""), (91, None), (92, " ... ")]
    texts = [line(made.randint(0, 60)) for _ in range(60)] + [None, "", "--", items[4][1], (items[5][1] or "") * 3]
    assert run(spark, texts, items, 3) == expected(texts, items, 3)


def test_long_items_meet_in_part(spark):
    made = random.Random(6)
    word = lambda: "".join(made.choice("abcdef") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(12)]
    parts = [w.split() for _, w in items]
    texts = [" ".join(p[a : a + n] + ["own"] + q[:9]) for p in parts for q in parts[:3] for a, n in ((0, 10), (3, 27), (20, 10), (5, 9))]
    texts += [" ".join(parts[0] * 40), " ".join(parts[1][15:] + parts[1][:15]), " ".join(parts[2]).upper() + "!" + ",".join(parts[3])]
    got = run(spark, texts, items)
    assert got == expected(texts, items, 10)
    assert any(hit for _, hit, _, _ in got) and any(not hit for _, hit, _, _ in got)


def test_common_passage_in_all_texts(spark):
    passage = " ".join(f"p{k}" for k in range(12))
    texts = [f"{passage} own{i}" for i in range(400)]
    assert run(spark, texts, [(1, passage), (2, passage), (3, "p0 p1")]) == expected(texts[:1], [(1, passage), (2, passage), (3, "p0 p1")], 10) * 400


def test_odd_and_no_rows(spark, odd_documents, no_documents):
    bench = spark.createDataFrame([(None, "repeated row of some words that says a thing", 1)], "item_id string, text string, row int")
    rows = odd_documents.withColumns({c: F.lit("clash") for c in ("row", "words", "n_words", "item", "name", "place", "term", "pos")})
    got = phrases.decontaminated(rows, bench).collect()
    assert len(got) == rows.count()
    hit = [r for r in got if r.contaminated]
    assert len(hit) == 4 and {r.n_items for r in hit} == {1} and {r.items_sha256 for r in hit} == {hashlib.sha256(b"").hexdigest()}
    assert phrases.decontaminated(no_documents, bench).count() == 0
    assert not any(r.contaminated for r in phrases.decontaminated(rows, bench.limit(0)).collect())


def test_proximity_equals_brute_force(spark):
    made = random.Random(8)
    texts = [" ".join(made.choice("abcdefgh") for _ in range(made.randint(0, 40))) for _ in range(40)] + [None]
    items = [(1, "a b c"), (2, "h"), (3, "a a g f"), (4, "zz a"), (5, None)]
    within = 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = phrases.PositionalIndex.build(docs, "doc_id")
    found = phrases.proximity_matches(index, spark.createDataFrame(items, "item_id long, text string"), within)
    got = found.join(index.forward.select("row", "doc_id"), "row").collect()
    holds = lambda w, x, s: set(x) <= set(w[max(s, 0) : s + within])
    for r in got:
        assert holds(words(texts[r.doc_id]), words(dict(items)[int(r["name"])]), r.start)
    want = {
        (i, str(k)) for i, t in enumerate(texts) for k, x in items if words(x) and any(holds(words(t), words(x), s) for s in range(len(words(t))))
    }
    assert {(r.doc_id, r["name"]) for r in got} == want and want


def test_no_python_in_the_plan(spark, odd_documents):
    bench = spark.createDataFrame([("1", "word")], "item_id string, text string")
    plan = phrases.decontaminated(odd_documents, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
