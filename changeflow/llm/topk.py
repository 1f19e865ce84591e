"""Exact top-k search by inner product in three phases with a uniform threshold.

Vectors are cut into ``LISTS`` runs of dimensions; a candidate's score is the sum of its ``LISTS`` partial scores. Queries
and candidates lie in blocks of bounded size, and each block of queries meets each block of candidates in one task. The
partial scores of such a pair are made once, and the phases follow one another on them:

1. The candidates that lead one of the partial score lists, by what k + 1 in the task's first block reach, are looked up
   in the whole scores. The k-th best of them, or of those that the task has of the query from other blocks, is a score that at
   least k candidates reach: the safe cutoff.
2. A candidate that reaches the cutoff has a partial score of at least cutoff / LISTS in some list. These are marked; their
   bound, known partial scores and the threshold for the others, reaches the cutoff then.
3. The whole scores of these are resolved exactly, and the k best at or above the cutoff are kept.

A task reports its k best of each query, and the last step merges the reports. Equal scores are ordered by id throughout, so k
rows are enough however many candidates tie. Every query is scored against every candidate: the work is the product of their
numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.llm.common import python_ready, stored

LISTS = 4
QUERY_BLOCK = 4_096
BLOCK = 8_192
# the dimensions of which a block has so many vectors; of longer ones it has fewer
WIDE = 256
# parts of the candidates that each get the queries once
GROUPS = 64
# blocks of queries whose reports a task holds
HELD = 64
# scores that are looked at together: they stay in a core's cache
TILE = 2**18
LARGEST = 2.0**61

# vectors are stored in the smallest of these types that holds a block exactly; a component's size tells which
STORED = (np.int16, np.float32, np.float64)
FITS = {np.int16: 2.0**15 - 1, np.float32: 2.0**127}

PACKED = "block int, length int, ids binary, vectors binary"


def finite(vector: Column) -> Column:
    """Whether no component is null, infinite or not a number."""
    return ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def scaled(values: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * x) as whole numbers in doubles, as far as 64 bits reach."""
    return np.clip(np.floor(values * factor), -(2.0**63), 2.0**63)


def packed(rows: DataFrame, size: int, factor: int) -> tuple[DataFrame, int]:
    """Rows (id, v) as blocks of about ``size`` scaled vectors of one length, and the number of blocks. Vectors with a
    component that is null or not finite are left out."""
    sizes = rows.withColumn("length", F.size("v"))
    wide = F.count("*") * F.greatest(F.lit(1.0), F.col("length") / WIDE)
    most = sizes.groupBy("length").agg(wide.alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = max(1, int(-(-most // size)))
    dealt = sizes.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))

    def pack(key, rows):
        block, length = (x.as_py() for x in key)
        ids = rows["id"].to_numpy()
        parts = [x.flatten().to_numpy(zero_copy_only=False) for x in rows["v"].chunks]
        values = np.concatenate(parts).astype(np.float64).reshape(len(ids), length)
        kept = np.flatnonzero(np.isfinite(values).all(axis=1))
        kept = kept[np.argsort(ids[kept], kind="stable")]
        with np.errstate(over="ignore"):
            values = scaled(values[kept], factor)
            small = [kind for kind in STORED[:-1] if (np.abs(values) <= FITS[kind]).all() and (values.astype(kind) == values).all()]
        values = values.astype(small[0]) if small else values
        made = [[block], [length], [ids[kept].tobytes()], [values.tobytes()]]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(x, kind) for x, kind in zip(made, kinds, strict=True)], ["block", "length", "ids", "vectors"])

    return stored(dealt.groupBy("block", "length").applyInArrow(pack, PACKED), "blocks"), blocks


def exact_type(a: np.ndarray, b: np.ndarray):
    """The fastest type in which inner products of these whole numbers, and of parts of them, are exact: no sum on the way
    exceeds the product of the lengths."""
    with np.errstate(over="ignore", invalid="ignore"):
        lengths = [float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)).max(initial=0)) * (1 + 1e-9) for m in (a, b)]
        bound = max(*lengths, lengths[0] * lengths[1])
    for limit, kind in ((2.0**24, np.float32), (2.0**53, np.float64), (LARGEST, np.int64)):
        if bound < limit:
            return kind
    return object


def _as(values: np.ndarray, kind) -> np.ndarray:
    if kind is object:
        return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)
    return np.ascontiguousarray(values, dtype=kind)


def _lead(scores: np.ndarray, n: int) -> np.ndarray:
    """For each row a score that n of its entries reach, and few others: the n-th highest of the best of small groups."""
    many, size = scores.shape
    if size <= n:
        return scores.min(axis=1, keepdims=True)
    deep = max(1, size // max(8 * n, 128))
    groups = size // deep
    best = scores[:, : deep * groups].reshape(many, deep, groups).max(axis=1)
    ordered = np.sort(best, axis=1) if best.dtype == object else np.partition(best, groups - n, axis=1)
    return ordered[:, groups - n : groups - n + 1]


def _least(cutoffs: np.ndarray, sure: np.ndarray, kind) -> np.ndarray:
    """Cutoffs as a column of a type; where none is sure, what all scores reach."""
    none = np.iinfo(np.int64).min if kind is np.int64 else float("-inf")
    least = cutoffs.astype(kind)
    least[~sure] = none
    return least[:, None]


def _places(marked: np.ndarray) -> np.ndarray:
    """Places of what is marked, of which there is little: eight marks are looked at together."""
    flat = marked.ravel()
    even = len(flat) // 8 * 8
    near = (np.flatnonzero(flat[:even].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([near[flat[near]], even + np.flatnonzero(flat[even:])])


def _whole(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit numbers, as far as these reach."""
    if scores.dtype == object:
        scores = np.array([max(-(2**63), min(2**63 - 1, x)) for x in scores], object)
    return scores.astype(np.int64)


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k highest scores, of equal ones those with the least ids."""
    order = np.lexsort((ids, ~scores, query))
    by = query[order]
    first = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]])) if len(by) else by
    rank = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
    return order[rank < k]


def pair(
    q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, known: list | None = None, leads: list | None = None
) -> list[np.ndarray]:
    """(query id, id, score) of the k best of a block of queries in a block of candidates and in ``known``, which other blocks
    of candidates gave. Both blocks' ids ascend. ``leads`` holds what leads the lists; a first block fills it."""
    kind, many, n = exact_type(queries, vectors), len(q_ids), len(ids)
    runs = [r for r in np.array_split(np.arange(queries.shape[1]), LISTS) if len(r)]
    left = [_as(queries[:, r], kind) for r in runs] or [np.zeros((many, 1), kind)]
    right = [_as(vectors[:, r].T, kind) for r in runs] or [np.zeros((1, n), kind)]
    known = known or [np.empty(0, np.int64)] * 3
    leads = [] if leads is None else leads
    new = n > 0 and not leads
    if new:
        leads += [np.empty((many, 1), kind) for _ in left]
    step = max(1, TILE // max(1, n))
    tiles = [np.empty((min(step, many), n), kind) for _ in range(len(left) + 1)]
    marks = [np.empty((min(step, many), n), bool) for _ in range(2)]
    found = []

    def marked(partial: list[np.ndarray], leasts: list[np.ndarray], whole: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Places with a partial score and a whole score that are high enough."""
        high, more = (m[: len(whole)] for m in marks)
        np.greater_equal(partial[0], leasts[0], out=high)
        for p, value in zip(partial[1:], leasts[1:], strict=True):
            np.logical_or(high, np.greater_equal(p, value, out=more), out=high)
        return _places(np.logical_and(high, np.greater_equal(whole, least, out=more), out=high))

    def others(start: int, places: np.ndarray, scores: np.ndarray) -> list[np.ndarray]:
        """Query, candidate's id and score of what isn't the query itself."""
        query, candidate = np.divmod(places, n)
        part = [q_ids[start + query], ids[candidate], _whole(scores)]
        return [x[part[0] != part[1]] for x in part]

    for start in range(0, many if n else 0, step):
        part = slice(start, min(many, start + step))
        partial = [t[: part.stop - start] for t in tiles]
        for a, b, out in zip(left, right, partial[:-1], strict=True):
            np.matmul(a[part], b, out=out)
        whole = partial.pop()
        np.add(partial[0], partial[1] if len(partial) > 1 else 0, out=whole)
        for p in partial[2:]:
            np.add(whole, p, out=whole)
        if new:
            for p, lead in zip(partial, leads, strict=True):
                lead[part] = _lead(p, k + 1)
        cuts = _kth(known, q_ids[part], k)  # leaders below can't raise it
        places = marked(partial, [x[part].astype(kind, copy=False) for x in leads], whole, _least(cuts, _sure(cuts), kind))
        leaders = others(start, places, whole.ravel()[places])
        best = _best(*leaders, k)
        cuts = np.maximum(cuts, _kth([x[best] for x in leaders], q_ids[part], k))
        sure = _sure(cuts)
        places = marked(partial, [_least(-(-cuts // len(left)), sure, kind)] * len(partial), whole, _least(cuts, sure, kind))
        kept = others(start, places, whole.ravel()[places])
        best = _best(*kept, k)
        found.append([x[best] for x in kept])
    found = [np.concatenate(x) for x in zip(known, *found, strict=True)]
    best = _best(*found, k)
    return [x[best] for x in found]


def _kth(found: list[np.ndarray], q_ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query in reports ordered by query and rank; the least number where there are fewer."""
    least = np.full(len(q_ids), -(2**63))
    if len(found[0]):
        at = np.searchsorted(found[0], q_ids) + k - 1
        full = at < len(found[0])
        full[full] = found[0][at[full]] == q_ids[full]
        least[full] = found[2][at[full]]
    return least


def _sure(cuts: np.ndarray) -> np.ndarray:
    """Whether a cutoff is one: within 62 bits, where no score was cut."""
    return (cuts > -(2**62)) & (cuts < 2**62)


def _task(k: int):
    """The work on pairs of blocks: a task's k best of each query."""

    def numbers(column: pa.Array, row: int, kind) -> np.ndarray:
        return np.frombuffer(column[row].as_buffer(), kind)

    def block(batch: pa.RecordBatch, row: int, ids: str, vectors: str) -> tuple[np.ndarray, np.ndarray]:
        ids, data = numbers(batch.column(ids), row, np.int64), batch.column(vectors)[row].as_buffer()
        length = batch.column("length")[row].as_py()
        kind = next((x for x in STORED if data.size == np.dtype(x).itemsize * len(ids) * length), np.float64)
        return ids, np.frombuffer(data, kind).reshape(len(ids), length)

    def reports(kept: dict) -> Iterator[pa.RecordBatch]:
        for found in kept.values():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])
        kept.clear()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, list[np.ndarray]] = {}
        leads: dict[tuple, list[np.ndarray]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                key = tuple(batch.column(c)[row].as_py() for c in ("length", "q_block"))
                blocks = [*block(batch, row, "q_ids", "q_vectors"), *block(batch, row, "ids", "vectors")]
                kept[key] = pair(*blocks, k, kept.get(key), leads.setdefault(key, []))
                if len(kept) > HELD:
                    yield from reports(kept)
                    leads.clear()
        yield from reports(kept)

    return work


def _merged(reports: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return reports.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, factor: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) of rows (vec_id, embedding): for each row whose id is divisible by ``every`` its
    ``k`` highest inner products with the other rows, equal ones by id; all of them if there are fewer.

    Vectors that are null or hold a null or a value that isn't finite, and rows without an id, take no part. Only vectors
    of one length are compared. Rows that repeat an id are one candidate each and never a candidate of that id; a repeated
    query gives its rows once. Scores beyond 64 bits are cut to 64 bits.
    """
    python_ready(vectors.sparkSession, rows=256)
    kind = vectors.schema["embedding"].dataType
    narrow = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    vector = F.col("embedding") if narrow else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("id"), vector.alias("v")).where("id is not null and v is not null")
    candidates, n_blocks = packed(rows, BLOCK, factor)
    queries, _ = packed(rows.where((F.pmod("id", F.lit(every)) == 0) & finite(F.col("v"))).dropDuplicates(["id"]), QUERY_BLOCK, factor)
    queries = queries.select(F.col("block").alias("q_block"), "length", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    queries = queries.repartition("q_block", "length")  # many tasks copy them
    groups = min(n_blocks, max(GROUPS, n_blocks // 16))
    candidates = candidates.withColumn("group", F.col("block") % groups)

    placed = queries.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    pairs = candidates.join(placed.hint("merge"), ["group", "length"])  # the copies are more than Spark takes them for
    columns = ["length", "q_block", "ids", "vectors", "q_ids", "q_vectors"]
    reports = pairs.select(*columns).mapInArrow(_task(k), "query_id bigint, vec_id bigint, score bigint")
    return _merged(reports, k).select("query_id", "rank", "vec_id", "score")
