"""Language ID by multilingual mixture inference.

Each language has probabilities of byte trigrams of lower-case text, in hashed buckets, counted over all training rows. A
document is a mixture: its trigrams come from languages in unknown proportions. Starting from the single language of
highest likelihood, the language along which the likelihood rises most is added, expectation-maximisation estimates the
proportions anew, and the larger set stays if the gain exceeds ``PENALTY`` times the logarithm of the number of trigrams;
if the likelihood rises along none, no larger set can be better, as it is concave in the proportions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.llm.common import python_ready

BUCKETS = 1 << 14
CELLS = 1 << 22  # languages times buckets; more languages have fewer buckets each, so that the model stays below 32 MB
SMOOTHING = 0.1
ROUNDS = 10
PENALTY = 2.0
UNDECIDED = "und"
_letter = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    """Rows kept from training; a row without an id isn't, but doesn't train either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def trigrams(text: str, buckets: int) -> np.ndarray:
    """Counts of the buckets of a text's byte trigrams, a space before and behind."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    code = (data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)) * np.uint32(2_654_435_761)
    return np.bincount(code >> np.uint32(32 - (buckets.bit_length() - 1)), minlength=buckets)


def bucket_count(languages: int) -> int:
    most = max(256, CELLS // max(1, languages))
    return min(BUCKETS, 1 << (most.bit_length() - 1))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order of code points, and the logarithm of each one's trigram probabilities, from all rows (text, lang)."""
    spark = docs.sparkSession
    python_ready(spark, batch_bytes="4m")
    rows = docs.where("text is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    names = sorted(r[0] for r in rows.select("lang").distinct().collect())
    buckets = bucket_count(len(names))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = trigrams(text, buckets)
                if lang in sums:
                    sums[lang] += found
                else:
                    sums[lang] = found
        for lang, found in sums.items():
            at = np.flatnonzero(found)
            columns = [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(found[at], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])

    counts = rows.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.full((len(names), buckets), SMOOTHING)
    place = {name: k for k, name in enumerate(names)}
    for lang, bucket, n in counts.collect():  # at most CELLS rows
        table[place[lang], bucket] += n
    return names, np.log(table / table.sum(axis=1, keepdims=True))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def proportions(texts: list[str], logs: np.ndarray) -> np.ndarray:
    """Share of each language in each text (a row for each text with a letter)."""
    counted = [trigrams(t, logs.shape[1]) for t in texts]
    at = [np.flatnonzero(c) for c in counted]
    sizes = np.array([len(a) for a in at])
    bucket = np.concatenate(at)
    times = np.concatenate([c[a] for c, a in zip(counted, at, strict=True)]).astype(float)
    chance, log = np.exp(logs.T)[bucket], logs.T[bucket]
    starts = np.cumsum(sizes) - sizes
    n = _sums(times, starts)
    single = _sums(times[:, None] * log, starts)
    share = np.zeros(single.shape)
    share[np.arange(len(texts)), single.argmax(axis=1)] = 1.0
    likelihood = single.max(axis=1)
    open_rows = np.arange(len(texts))
    for _ in range(logs.shape[0] - 1):
        if not len(open_rows):
            break
        rows = np.concatenate([np.arange(starts[k], starts[k] + sizes[k]) for k in open_rows])
        own = np.repeat(np.arange(len(open_rows)), sizes[open_rows])
        begin = np.cumsum(sizes[open_rows]) - sizes[open_rows]
        p, x, now = chance[rows], times[rows], share[open_rows]
        rise = _sums(p * (x / np.einsum("rl,rl->r", p, now[own]))[:, None], begin) / n[open_rows, None]
        rise[now > 0] = 0
        new = rise.argmax(axis=1)
        some = np.arange(len(open_rows))
        better = rise[some, new] > 1
        trial = now * 0.5
        trial[some, new] = 0.5
        for _ in range(ROUNDS):
            mixed = np.einsum("rl,rl->r", p, trial[own])
            trial = trial * _sums(p * (x / mixed)[:, None], begin) / n[open_rows, None]
        reached = _sums(x * np.log(np.einsum("rl,rl->r", p, trial[own])), begin)
        better &= reached - likelihood[open_rows] > PENALTY * np.log(n[open_rows])
        good = open_rows[better]
        share[good], likelihood[good] = trial[better], reached[better]
        open_rows = good
    return share


COLUMNS = "doc_id bigint, held_out boolean, lang_pred string, score double, n_languages int, languages array<string>, shares array<double>"


def identify(docs: DataFrame, names: list[str], logs: np.ndarray) -> DataFrame:
    """See ``COLUMNS``, for each row of ``docs`` (doc_id, text): the language of the largest share, this share, and all
    languages of the text with their shares. A text that is null or has no letter is ``und`` with the score 0, and so is
    every text if nothing was learned. Texts alone decide."""
    model = docs.sparkSession.sparkContext.broadcast((names, logs))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = model.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            some = [k for k, t in enumerate(texts) if t and names and _letter.search(t)]
            best, score = [UNDECIDED] * len(texts), [0.0] * len(texts)
            found: list[list[str]] = [[] for _ in texts]
            shares: list[list[float]] = [[] for _ in texts]
            if some:
                for k, row in zip(some, proportions([texts[k] for k in some], logs), strict=True):
                    order = [j for j in np.argsort(-row, kind="stable") if row[j] > 0]
                    found[k], shares[k] = [names[j] for j in order], [float(min(1.0, row[j])) for j in order]
                    best[k], score[k] = found[k][0], shares[k][0]
            columns = [batch.column(0), batch.column(1), pa.array(best), pa.array(score, pa.float64())]
            columns += [pa.array([len(f) for f in found], pa.int32()), pa.array(found, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score", "n_languages", "languages", "shares"])

    python_ready(docs.sparkSession, rows=500, batch_bytes="2m")
    rows = docs.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(predict, COLUMNS)


def language_id(docs: DataFrame) -> DataFrame:
    """Train on the rows that aren't held out, and identify all rows."""
    training = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    return identify(docs, *train(training))
