"""SentencePiece encoding by sampled segmentations, and decoding.

Each piece has the probability 1 / (1 + its rank in the vocabulary) to the power ``sharpness``, up to a factor. Sums over
all paths to a place are filtered forward through the lattice of each distinct segment, see ``pieces``; then every
occurrence of a segment samples its own path backwards, edge by edge, by the share of the sum that came over it. The
random numbers are a hash of the seed, the row's key, the segment's place in its text and the step, so a row's
segmentation doesn't depend on other rows, on partitions or on retries. Decoding joins the bytes of the pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.llm.common import python_ready
from changeflow.llm.pieces import Vocabulary, lattice, segments, vocabulary

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from hashes."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M1
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * (1.0 / 2**53)


def sampled_pieces(texts: list[str], keys: np.ndarray, vocab: Vocabulary, seed: int, sharpness: float) -> list[np.ndarray]:
    """The pieces of a sampled segmentation of each text; ``keys`` are the rows' 64-bit keys."""
    parts = [segments(t) for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    place: dict[str, int] = {}
    at = np.fromiter((place.setdefault(s, len(place)) for part in parts for s in part), np.int64, int(sizes.sum()))
    if not len(at):
        return [np.empty(0, np.int32) for _ in texts]
    names = list(place)
    lat = lattice(names, vocab)
    rank = np.minimum(-vocab.scores, len(vocab.scores))
    weight = -sharpness * np.log1p(np.maximum(rank, 0.0))
    lone = -sharpness * np.log1p(2.0 * len(vocab.scores))
    total = np.full(lat.nodes, -np.inf)
    total[lat.first] = 0.0
    rising = np.empty(len(lat.end))  # of each edge, its end, and the share of the end's sum up to and with the edge
    low, high = np.zeros(len(total), np.int32), np.zeros(len(total), np.int32)
    for edges, groups in lat.levels():
        piece = lat.piece[edges]
        reach = total[lat.start[edges]] + np.where(piece >= 0, weight[piece], lone)
        counts = np.diff(np.r_[groups, len(reach)])
        ends = lat.end[edges][groups]
        top = np.maximum.reduceat(reach, groups)
        mass = np.exp(reach - np.repeat(top, counts))
        whole = np.add.reduceat(mass, groups)
        total[ends] = top + np.log(whole)
        run = np.cumsum(mass)
        run -= np.repeat(run[groups] - mass[groups], counts)
        rising[edges] = lat.end[edges] + np.minimum(run / np.repeat(whole, counts), 1.0)
        low[ends], high[ends] = edges.start + groups, edges.start + groups + counts

    row_of = np.repeat(np.arange(len(parts)), sizes)
    inside = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    base = (keys.astype(np.uint64)[row_of] * M1 + np.uint64(seed & (2**64 - 1))) * M2 + inside.astype(np.uint64) * M1
    node, todo, steps = lat.last[at].astype(np.int64), np.arange(len(at)), []
    step = 0
    while len(todo):
        u = _uniform(base[todo] + np.uint64(step * int(M2) & (2**64 - 1)))
        end = node[todo]
        # edges are sorted by end node, so one search finds the edge
        edge = np.clip(np.searchsorted(rising, end + u, side="right"), low[end], high[end] - 1)
        steps.append((todo, edge))
        node[todo] = lat.start[edge]
        todo = todo[node[todo] != lat.first[at[todo]]]
        step += 1
    used = np.concatenate([t for t, _ in steps])
    edges = np.concatenate([e for _, e in steps])
    back = np.concatenate([np.full(len(t), k) for k, (t, _) in enumerate(steps)])
    order = np.lexsort((-back, used))
    edges, used = edges[order], used[order]
    piece = lat.piece[edges].astype(np.int64)
    width = np.where(piece >= 0, 1, -1 - piece)
    out = np.repeat(piece, width).astype(np.int32)
    spell = np.flatnonzero(piece < 0)
    if len(spell):
        starts = np.cumsum(width) - width
        for k, ids in zip(spell, lat.spelled_bytes(edges[spell], vocab), strict=True):
            out[starts[k] : starts[k] + width[k]] = ids
    per_row = np.bincount(row_of[used], weights=width, minlength=len(parts)).astype(np.int64)
    return np.split(out, np.cumsum(per_row)[:-1])


def decoded(pieces: np.ndarray, vocab: Vocabulary) -> bytes:
    """The text's UTF-8: the pieces' bytes without the space in front."""
    return b"".join(map(vocab.decoded.__getitem__, pieces.tolist()))[1:]


def row_key(doc_id: Column, text: Column) -> Column:
    """Of a row: its id; of a row without one, its text."""
    return F.coalesce(doc_id.cast("bigint"), F.xxhash64(text))


def encode_sampled(docs: DataFrame, model: str, seed: int = 1, sharpness: float = 1.0) -> DataFrame:
    """(doc_id, pieces) for each row of ``docs`` (doc_id, text). A null or empty text has no pieces. Rows that repeat an id
    and text get the same pieces."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = sampled_pieces(texts, batch.column(2).to_numpy(), vocab, seed, sharpness)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "pieces"])

    python_ready(docs.sparkSession, batch_bytes="512k")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint"), text.alias("text"), row_key(F.col("doc_id"), text).alias("row_key"))
    return rows.mapInArrow(encode, "doc_id bigint, pieces array<int>")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, pieces); a null text comes back as the empty one."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            texts = [decoded(np.array(p or [], np.int32), vocab).decode("utf-8", "surrogatepass") for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    python_ready(encoded.sparkSession, batch_bytes="1m")
    return encoded.select("doc_id", "pieces").mapInArrow(decode, "doc_id bigint, text string")


def sampled_digests(docs: DataFrame, model: str, seed: int = 1, sharpness: float = 1.0) -> DataFrame:
    """(doc_id, n_pieces, pieces_crc32, lossless) for each row of ``docs``: what its sampled pieces are, and whether they
    decode to its text. The checksum is over the ids as little-endian 32-bit numbers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = sampled_pieces(texts, batch.column(2).to_numpy(), vocab, seed, sharpness)
            back = [decoded(p, vocab) == t.encode("utf-8", "surrogatepass") for p, t in zip(found, texts, strict=True)]
            columns = [batch.column(0), pa.array([len(p) for p in found], pa.int64())]
            columns += [pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in found], pa.int64()), pa.array(back)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pieces", "pieces_crc32", "lossless"])

    python_ready(docs.sparkSession, batch_bytes="512k")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint"), text.alias("text"), row_key(F.col("doc_id"), text).alias("row_key"))
    return rows.mapInArrow(digest, "doc_id bigint, n_pieces bigint, pieces_crc32 bigint, lossless boolean")
