from __future__ import annotations

import random

import numpy as np

from changeflow.llm import quality


def brute_counts(text: str) -> tuple[int, ...]:
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_counts_equal_brute_force():
    made = random.Random(3)
    texts = ["", " ", "a", "a b c a b c", "a a a a a", "ß 日本 ß\nß 日本 ß\n\n", "x\x1cy z\x85w", "#* $%&|<>"]
    texts += ["".join(made.choice(["a", "b", " ", "\n", "é", "#", "a b c "]) for _ in range(made.randint(0, 120))) for _ in range(200)]
    for text in texts:
        assert quality.counts_of(text.encode())[:5] == brute_counts(text), text


def documents(spark, n=900):
    made = random.Random(5)
    vocab = ["".join(made.choice("abcdefghijklmnop") for _ in range(made.randint(2, 9))) for _ in range(3000)]
    rows = []
    for i in range(n):
        words = [made.choice(vocab) for _ in range(made.randint(60, 300))]
        if i % 10 == 3:
            words = [w + "$$$" for w in words]
        rows.append((i, " ".join(words).capitalize() + ".", "en", "s0" if i % 3 else f"s{i % 60}", 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), rows


def test_outliers_go_and_clean_rows_stay(spark):
    docs, rows = documents(spark)
    got = {r.doc_id: r for r in quality.quality_verdicts(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept == (i % 10 != 3) for i in got)
    assert not any(r.base_failed for r in got.values())
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in got if got[i].kept}


def test_one_moderate_statistic_rejects_alone(spark):
    """Beside clean texts of 80 two-word lines, each of the others is moderately off in a single statistic."""
    made = random.Random(8)
    vocab = ["".join(made.choice("abcdefghijklmnop") for _ in range(made.randint(4, 7))) for _ in range(4000)]
    lines = lambda: [f"{made.choice(vocab).capitalize()} {made.choice(vocab)}." for _ in range(80)]
    off = {
        "word length": lambda t: [line.replace(" ", "xx xx") for line in t],
        "symbols": lambda t: [line + "$" * (k % 4 == 0) for k, line in enumerate(t)],
        "repeated words": lambda t: [*t[:60], *(f"{t[0]} {t[1]} w{k}\n{k}v" if k < 6 else t[60 + k] for k in range(20))],
        "repeated lines": lambda t: [t[0] if k % 4 == 0 else line for k, line in enumerate(t)],
        "capitals": lambda t: [line[:4].upper() + line[4:] for line in t],
        "marks": lambda t: [line.replace(" ", ",;: ") for line in t],
    }
    clean = 600
    rows = [(i, "\n".join(lines()), "en", "s", 0) for i in range(clean)]
    rows += [(clean + k, "\n".join(change(lines())), "en", "s", 0) for k, change in enumerate(off.values())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in quality.quality_verdicts(docs).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [name for k, name in enumerate(off) if got[clean + k].kept] == []
    assert all(got[i].kept for i in range(clean))


def test_estimate_equals_numpy(spark):
    """The distances of a pool by the distributed steps are those of the same steps on one machine."""
    docs, _ = documents(spark)
    stats = quality.with_statistics(docs).cache()
    named, found = quality.estimates(stats)
    from pyspark.sql import functions as F

    rows = stats.join(named, "own").where("pool like 'group%' and not base_failed").select(quality.vector().alias("x"), "pool").collect()
    estimate = {r.pool: r for r in found.collect()}
    for pool in {r.pool for r in rows}:
        x = np.array([r.x for r in rows if r.pool == pool])
        quart = np.array([sorted(c)[int(np.ceil(q * len(c))) - 1] for c in x.T for q in (0.25, 0.5, 0.75)]).reshape(-1, 3)
        mean, spread = quart[:, 1], np.maximum((quart[:, 2] - quart[:, 0]) / 1.349, quality.FLOOR)
        inverse = np.diag(1 / spread**2)
        for step in range(quality.STEPS + 1):
            d = np.maximum(np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean), 1e-9)
            bins = np.clip(np.ceil(quality.BINS * np.log2(d)), -quality.BIN_RANGE, quality.BIN_RANGE)
            if step == quality.STEPS:
                use = bins <= np.floor(quality.BINS * np.log2(quality.REWEIGHT))
            else:
                levels, counts = np.unique(bins, return_counts=True)
                use = np.isin(bins, levels[np.cumsum(counts) - counts < quality.SHARE * len(x)])
            mean = x[use].mean(axis=0)
            cov = np.cov(x[use].T, bias=True) * quality._correction(use.sum() / len(x)) + np.diag(np.square(quality.FLOOR))
            inverse = np.linalg.inv(cov)
        assert np.allclose(estimate[pool].mean, mean, atol=1e-6)
        assert np.allclose(np.array(estimate[pool].inverse).reshape(6, 6), inverse, rtol=1e-4, atol=1e-4)
    assert F is not None
    stats.unpersist()


def test_odd_and_no_rows(spark, odd_documents, no_documents):
    got = quality.quality_verdicts(odd_documents).collect()
    assert len(got) == odd_documents.count()
    assert all(r.base_failed and not r.kept for r in got if r.n_words < 50)
    assert quality.quality_verdicts(no_documents).count() == 0
    assert quality.keep_good(odd_documents).columns == odd_documents.columns
    assert quality.keep_good(no_documents).count() == 0
