"""Token counts by a count-only Viterbi search over unigram vocabulary matches.

The best score and its number of pieces are carried from character to character, see ``pieces``; no path is kept. Scores
are those of the vocabulary file, whole numbers, so sums are exact, ties are true ties, and a text's result is the sum of
its segments' results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.llm.common import python_ready
from changeflow.llm.pieces import best_counts, segments, vocabulary

KEPT = 250_000
LONGEST_KEPT = 64
COLUMNS = "doc_id bigint, n_chars bigint, n_segments bigint, n_pieces bigint, score double"


class Counter:
    """Pieces and scores of segments; keeps those of a bounded number."""

    def __init__(self, path: str) -> None:
        self.vocab = vocabulary(path)
        self.place: dict[str, int] = {}
        self.counts, self.scores = np.empty(0, np.int64), np.empty(0)

    def count(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """(segments, pieces, score) of each text."""
        parts = [segments(t) for t in texts]
        fresh = set(chain.from_iterable(parts)).difference(self.place)
        if len(self.place) + len(fresh) > KEPT:
            fresh = set(chain.from_iterable(parts))
            self.place, self.counts, self.scores = {}, self.counts[:0], self.scores[:0]
        names = list(fresh)
        for at in range(0, len(names), 20_000):
            counts, scores = best_counts(names[at : at + 20_000], self.vocab)
            self.place.update(zip(names[at : at + 20_000], range(len(self.counts), len(self.counts) + len(counts)), strict=True))
            self.counts, self.scores = np.r_[self.counts, counts], np.r_[self.scores, scores]
        made = []
        for names in parts:
            at = np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))
            made.append((len(names), int(self.counts[at].sum()), float(self.scores[at].sum())))
        for name in [s for s in fresh if len(s) > LONGEST_KEPT]:
            del self.place[name]
        return made


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text), see ``COLUMNS``, by the vocabulary file ``model``. A null or empty text
    has no pieces and the score 0. ``n_chars`` are code points, ``score`` is that of the best segmentation."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.setdefault(model, Counter(model))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = counter.count(texts)
            columns = [batch.column(0), pa.array([len(t) for t in texts], pa.int64())]
            columns += [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "n_segments", "n_pieces", "score"])

    python_ready(docs.sparkSession, batch_bytes="2m")
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(count, COLUMNS)
