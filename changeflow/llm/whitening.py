"""Whitening of embeddings; the components come from FEAST's contour integration.

1. Sums of all vectors, then sums of products of the vectors less a whole number near their mean, in tasks over Arrow
   batches. Both are exact integers that Spark adds up as decimals, so the covariance doesn't depend on how rows are dealt.
2. Inertia counts (negative pivots of a symmetric factorisation of V - sI) cut the upper end of the spectrum into intervals
   of few eigenvalues, at places with no eigenvalue near.
3. Each interval is a row of a Spark job. Its task sums quadrature points of the contour around the interval, that is
   solutions of complex shifted systems; this projects a random block onto the interval's eigenspace. Rayleigh-Ritz on
   the block gives its components, and the step is repeated from these until residuals are at rounding level.
4. Every interval must give as many components as its inertia counts say, or the work stops with an error.
5. Rows are projected, and the covariance of what was projected is summed in tasks and compared with the identity.

What the driver holds is bounded by the dimension: square matrices of it, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.llm.common import python_ready

SCALE, OFFSET = 64, 1_000_000
LARGEST = 2**57  # entries beyond this, times SCALE, are taken as this
DIGIT = 18  # bits of a factor of an exact product: 4,096 of them add up below 2**53
ROWS = 4_096
PER_INTERVAL = 8
NODES = 16
ITERATIONS = 12
SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def inertia(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix below ``shift``: negative pivots of its Bunch-Kaufman factorisation."""
    a, below, k = matrix - shift * np.eye(len(matrix)), 0, 0
    limit = (1 + 17**0.5) / 8
    while k < len(a):
        col = np.abs(a[k + 1 :, k])
        r = k + 1 + int(col.argmax()) if len(col) else k
        largest = col.max(initial=0.0)
        if max(abs(a[k, k]), largest) == 0:
            k += 1
            continue
        two = False
        if abs(a[k, k]) < limit * largest:
            row = np.abs(a[r, k:]).copy()
            row[r - k] = 0
            other = row.max()
            if abs(a[k, k]) * other >= limit * largest**2:
                pass
            elif abs(a[r, r]) >= limit * other:
                a[[k, r], k:] = a[[r, k], k:]
                a[k:, [k, r]] = a[k:, [r, k]]
            else:
                two = True
                a[[k + 1, r], k:] = a[[r, k + 1], k:]
                a[k:, [k + 1, r]] = a[k:, [r, k + 1]]
        width = 2 if two else 1
        pivot, side = a[k : k + width, k : k + width].copy(), a[k + width :, k : k + width].copy()
        below += int((np.linalg.eigvalsh(pivot) < 0).sum())
        a[k + width :, k + width :] -= side @ np.linalg.solve(pivot, side.T)
        k += width
    return below


def intervals(matrix: np.ndarray, most: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues between) of intervals, highest first, that hold the ``most`` largest positive eigenvalues.
    Ends have no eigenvalue within 1e-10 of the matrix's size; an interval holds more than ``PER_INTERVAL`` only where they
    are too close to be cut apart."""
    d = len(matrix)
    size = float(np.abs(matrix).sum(axis=1).max())
    zero = size * d * 2e-16 * 8
    above = lambda s: d - inertia(matrix, s)
    clear = lambda s: inertia(matrix, s - size * 1e-10) == inertia(matrix, s + size * 1e-10)
    known = {2 * size: 0, zero: above(zero)}
    wanted = min(most, known[zero])
    if not wanted:
        return []

    def cut(low: float, high: float, n_low: int, n_high: int) -> float | None:
        """A clear place that parts the eigenvalues between, near the middle first."""
        part = 0.5
        for _ in range(60):
            s = low + (high - low) * part
            if high - low < size * 4e-10 or not low < s < high:
                return None
            n = known.setdefault(s, above(s))
            if n_high < n < n_low:
                if clear(s):
                    return s
                part = part * 0.99 + 0.0037
            elif n == n_low:
                low, part = s, 0.5
            else:
                high, part = s, 0.5
        return None

    done, todo = [], [(zero, 2 * size)]
    while todo:
        low, high = todo.pop()
        n_low, n_high = known[low], known[high]
        if n_high >= wanted or n_low == n_high:
            continue
        middle = cut(low, high, n_low, n_high) if n_low - n_high > PER_INTERVAL else None
        if middle is None:
            done.append((low, high, n_low - n_high))
        else:
            todo += [(low, middle), (middle, high)]
    return sorted(done, reverse=True)


def contour(matrix: np.ndarray, block: np.ndarray, low: float, high: float) -> np.ndarray:
    """The block's part in the eigenspace of (low, high): Gauss-Legendre points on the upper half of the circle through
    both ends; the lower half is its conjugate."""
    at, weight = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros(block.shape)
    for x, w in zip(at, weight, strict=True):
        turn = np.exp(1j * np.pi / 2 * (x + 1))
        solved = np.linalg.solve((centre + radius * turn) * np.eye(len(matrix)) - matrix, block.astype(complex))
        out += w / 2 * (radius * turn * solved).real
    return out


def feast(matrix: np.ndarray, low: float, high: float, expected: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of (low, high) and their unit eigenvectors, as columns, falling. ``expected`` sizes the block."""
    d = len(matrix)
    block = np.random.Generator(np.random.PCG64(seed)).standard_normal((d, min(d, expected + expected // 2 + 4)))
    size = float(np.abs(matrix).sum(axis=1).max())
    # an end beyond the spectrum would make the circle wide and the points far from the eigenvalues
    high = min(high, size * 1.001)
    best = (np.inf, np.empty(0), np.empty((d, 0)))
    for _ in range(ITERATIONS):
        basis, _ = np.linalg.qr(contour(matrix, block, low, high))
        values, small = np.linalg.eigh(basis.T @ matrix @ basis)
        block = basis @ small
        inside = (values > low) & (values < high)
        values, vectors = values[inside][::-1], block[:, inside][:, ::-1]
        rest = np.abs(matrix @ vectors - vectors * values).max(initial=0.0)
        if len(values) == expected and rest < best[0]:
            best = (rest, values, vectors)
        elif len(best[1]):
            break
        if len(values) == expected and rest <= 4e-16 * size:
            break
    return best[1], best[2]


def components(spark, matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``most`` positive eigenvalues, falling, and their eigenvectors as columns. A task for each interval."""
    parts = intervals(matrix, most)
    if not parts:
        return np.empty(0), np.empty((len(matrix), 0))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, expected in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values, vectors = feast(matrix, low, high, expected)
                made = [pa.array([low] * len(values), pa.float64()), pa.array(values), pa.array(list(vectors.T), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(made, names=["low", "value", "vector"])

    rows = spark.createDataFrame(parts, "low double, high double, expected int").repartition(len(parts), "low")
    found = rows.mapInArrow(solve, "low double, value double, vector array<double>").collect()
    for low, high, expected in parts:
        n = sum(1 for r in found if r["low"] == low)
        if n != expected:
            raise ArithmeticError(f"{n} components in ({low}, {high}), inertia counts say {expected}")
    found.sort(key=lambda r: -r["value"])
    found = found[:most]
    return np.array([r["value"] for r in found]), np.array([r["vector"] for r in found]).T


def usable(vectors: DataFrame, id_column: str, column: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that take part, and their length: without nulls or non-finite entries, not empty, and as
    long as most of them; of lengths that are equally common, the largest."""
    v = vectors[column].cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(F.coalesce(x, F.lit(float("nan")))))
    rows = vectors.select(vectors[id_column].cast("bigint").alias("vec_id"), v.alias("v")).where(F.coalesce(finite, F.lit(False)))
    lengths = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("length")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    length = most["length"] if most else 0
    return rows.where(F.size("v") == length) if length else rows.limit(0), length


def _batches(batches: Iterator[pa.RecordBatch], d: int, scale: int, offset: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and whole numbers, a row for each vector."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield batch.column(0), np.floor(np.clip(flat * scale, -LARGEST, LARGEST)).astype(np.int64) + offset


def _decimals(values: np.ndarray) -> pa.Array:
    from decimal import Context

    exact = Context(prec=60)
    return pa.array([exact.create_decimal(int(x)) for x in values], pa.decimal128(38, 0))


def _summed(rows: DataFrame, sums: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> list[int]:
    """Exact sums over all rows of the arrays of whole numbers that ``sums`` makes of a task's rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = sums(batches)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(made)), pa.int64()), _decimals(made)], names=["k", "value"])

    out = rows.mapInArrow(partial, "k bigint, value decimal(38,0)").groupBy("k").agg(F.sum("value").alias("value"))
    return [int(r["value"]) for r in sorted(out.collect(), key=lambda r: r["k"])]


def exact_products(z: np.ndarray) -> np.ndarray:
    """z.T @ z of whole numbers, exact, as Python integers; at most ``ROWS`` rows."""
    sign, left, digits = np.sign(z).astype(np.float64), np.abs(z), []
    while left.any():
        digits.append(sign * (left & (2**DIGIT - 1)).astype(np.float64))
        left = left >> DIGIT
    total = np.zeros((z.shape[1], z.shape[1]), object)
    for i, a in enumerate(digits):
        for j, b in enumerate(digits):
            total = total + (a.T @ b).astype(np.int64).astype(object) * (1 << DIGIT * (i + j))
    return total


def whitened(
    vectors: DataFrame, most: int = 32, scale: int = SCALE, offset: int = OFFSET, id_column: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """Row per vector that takes part and component, up to ``most``: vec_id, component, n, deviation, whitened, explained,
    identity_error.

    Vectors that are null, empty or hold null or non-finite entries take no part, nor those of another length than most
    have. An entry c becomes x = floor(``scale`` * c) + ``offset``. ``deviation`` is the sum over dimensions of
    (n * x - S)**2, S the sums of the x of all n vectors. Components are eigenvectors of the covariance of x (divisor n) by
    falling eigenvalue e, from 1 on; directions without variance are none, so vectors that are all equal have no row.
    ``whitened`` is x less its mean, projected, over sqrt(e); ``explained`` is e over the trace; ``identity_error`` the
    largest entry of the whitened rows' covariance less the identity. Repeated rows and ids count and return each; an id
    may be null; other columns are ignored. Without vectors there are no rows.
    """
    spark = vectors.sparkSession
    python_ready(spark, ROWS)
    rows, d = usable(vectors, id_column, column)
    if not d:
        return spark.createDataFrame([], SCHEMA)

    def plain(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(d + 1, object)
        for _, x in _batches(batches, d, scale, offset):
            total[0] += len(x)
            high, low = x >> 30, x & (2**30 - 1)
            total[1:] += high.sum(axis=0).astype(object) * (1 << 30) + low.sum(axis=0).astype(object)
        return total

    n, *sums = _summed(rows, plain)
    near = np.array([s // n for s in sums], np.int64)  # a whole number close to the mean
    rest = [s - n * int(m) for s, m in zip(sums, near, strict=True)]

    def products(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((d, d), object)
        for _, x in _batches(batches, d, scale, offset):
            total = total + exact_products(x - near)
        return total[np.triu_indices(d)]

    matrix = np.zeros((d, d))
    for (i, j), p in zip(zip(*np.triu_indices(d), strict=True), _summed(rows, products), strict=True):
        matrix[i, j] = matrix[j, i] = (n * p - rest[i] * rest[j]) / (n * n)
    values, directions = components(spark, matrix, most)
    k = len(values)
    if not k:
        return spark.createDataFrame([], SCHEMA)
    weights, shift = directions / np.sqrt(values), np.array([r / n for r in rest])
    explained = values / np.trace(matrix)

    def projected(x: np.ndarray) -> np.ndarray:
        return ((x - near) - shift) @ weights

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for _, x in _batches(batches, d, scale, offset):
            w = projected(x)
            first, second = first + w.sum(axis=0), second + w.T @ w
        made = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(made)), pa.int64()), pa.array(made)], names=["k", "value"])

    spreads = rows.mapInArrow(spread, "k bigint, value double").groupBy("k").agg(F.sum("value").alias("value")).collect()
    made = np.array([r["value"] for r in sorted(spreads, key=lambda r: r["k"])]) / n
    covariance = made[k:].reshape(k, k) - np.outer(made[:k], made[:k])
    error = float(np.abs(covariance - np.eye(k)).max())
    rest_array = np.array(rest, object)

    def deviations(z: np.ndarray) -> np.ndarray:
        bound = n * (int(np.abs(z).max(initial=0)) + 1)
        if bound * bound * d < 2**62:
            return ((n * z - rest_array.astype(np.int64)) ** 2).sum(axis=1)
        return ((n * z.astype(object) - rest_array) ** 2).sum(axis=1)  # beyond a long, Arrow refuses it

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _batches(batches, d, scale, offset):
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(np.repeat(deviations(x - near), k), pa.int64()),
                    pa.array(projected(x).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, SCHEMA)
