"""Token ids as files: byte-level BPE ids in ascending order of documents, compressed by Re-Pair grammars.

The file format is a Parquet folder; a row is a shard of about ``SHARD_IDS`` ids:

    part, shard        place in the order of documents
    doc_ids, sizes     the shard's documents and their numbers of ids, the end id included
    n_ids              sum of sizes
    rules              pairs of symbols as little-endian 32-bit numbers; pair k stands for symbol FIRST_RULE + k
    lengths            ids that each rule expands to, as 32-bit numbers
    symbols            the sequence, as 32-bit numbers

Compression counts the pairs of neighbouring symbols, gives each pair that occurs twice or more without overlap a new symbol
and replaces it wherever no more frequent pair overlaps, until no pair occurs twice. The pairs seen ``FALLS[0]`` times or more
come first, until there are none; then those seen ``FALLS[1]`` times or more, and so on. After a round only places whose pair
has changed are counted anew: a pair of older symbols never becomes more frequent. No rule goes on past a document's end. With
the lengths, ``ids_between`` decodes any range without expanding what lies before.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeflow.llm.common import python_ready, scratch_dir

END = 2
FIRST_RULE = 1 << 16
SHARD_IDS = 1 << 20
PART_BYTES = 64 << 20
FALLS = (32, 2)
KEPT = 1_000_000
# longer pieces of texts aren't kept
LONGEST_KEPT = 64
# where every rule of the byte-level split ends a piece: between letters or digits and ASCII signs; an apostrophe may begin a
# piece of its own with what follows
_letter, _sign = "0-9A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
_cut = re.compile(f"(?<=[{_letter}])(?=[{_sign}])|(?<=[{_sign}])(?=[{_letter}])").split
SIGNS = "".join(re.findall(f"[{_sign}]", "".join(map(chr, range(128)))))
# most words: one piece, perhaps with signs behind it
WORD = f"^\n?[{_letter}]+"

FILE = "part int, shard int, doc_ids array<bigint>, sizes array<int>, n_ids bigint, rules binary, lengths binary, symbols binary"


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Those of ranges, one range after the other."""
    at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    at += np.arange(len(at))
    return at


class Encoder:
    """Ids of texts by the tokenizers library, which is asked once for each piece of a word it hasn't seen.

    Byte-level BPE splits a text before every single space or line's end that a visible character follows, and such a part
    further at the places of ``_cut``, so the ids of a text are those of its pieces. Texts with other runs of blanks are encoded
    whole. A bounded number of pieces is kept; one that follows a space or a line's end begins with it.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > FIRST_RULE:
            raise ValueError("ids must be below 65536")
        self.begins = np.zeros(FIRST_RULE, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.begins[i] = token[:1] in ("Ġ", "Ċ")  # how the vocabulary writes a space and a line's end
        self.known: dict[str, int] = {}  # places in starts and sizes, which tell those in pool
        self.pool, self.starts, self.sizes = np.empty(0, np.uint16), np.empty(0, np.int64), np.empty(0, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _asked(self, marked: list[str], other: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them each has) of new pieces; what begins the ``marked`` ones tells them apart."""
        made, sizes = [self.pool[:0]], [self.sizes[:0]]
        for at in range(0, len(marked), 20_000):
            some = marked[at : at + 20_000]
            ids = np.concatenate(self._ids(["".join(some[k : k + 64]) for k in range(0, len(some), 64)]))
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) != len(some):
                raise ValueError("a piece holds a space")
            made.append(ids)
            sizes.append(np.diff(starts, append=len(ids)))
        for at in range(0, len(other), 20_000):
            found = self._ids(other[at : at + 20_000])
            made += found
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        return np.concatenate(made), np.concatenate(sizes)

    def _found(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each of ``pieces`` start, how many it has)."""
        at = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(at < 0)
        names = [pieces[k] for k in missing.tolist()]
        fresh = sorted(set(names), key=len)
        short = bisect_right(fresh, LONGEST_KEPT, key=len)
        ids, sizes, starts, n = self.pool, self.sizes, self.starts, len(self.sizes)
        place: dict[str, int] = {}
        for some, keep in ((fresh[:short], n + short <= KEPT), (fresh[short:], False)):
            marked, other = [p for p in some if p[0] in " \n" and p != "\n"], [p for p in some if p[0] not in " \n" or p == "\n"]
            more, own = self._asked(marked, other)
            starts = np.r_[starts, np.cumsum(own) - own + len(ids)]
            ids, sizes = np.concatenate([ids, more]), np.concatenate([sizes, own])
            place.update(zip(chain(marked, other), range(n + len(place), len(sizes)), strict=True))
            if keep:
                self.known.update(place)
                self.pool, self.sizes, self.starts = ids, sizes, starts
        at[missing] = np.fromiter(map(place.__getitem__, names), np.int64, len(names))
        return ids, starts[at], sizes[at]

    def encode_all(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them each text has), 16 bits an id."""
        texts = pc.fill_null(pa.array(texts, pa.large_string()), "")
        if not len(texts):
            return self.pool[:0], self.sizes[:0]
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        begin = parts.offsets.to_numpy()[:-1]
        encoded = parts.values.dictionary_encode()
        words = encoded.dictionary
        usual = pc.match_substring_regex(words, f"{WORD}[{_sign}]*$")
        words, n_usual = pa.concat_arrays([words.filter(usual), words.filter(pc.invert(usual))]), pc.sum(usual).as_py()
        usual = usual.to_numpy(zero_copy_only=False)
        place = np.empty(len(words), np.int64)
        place[usual], place[~usual] = np.arange(n_usual), np.arange(n_usual, len(words))
        item = place[encoded.indices.to_numpy()]

        others = words[n_usual:].to_pylist()
        unclear, ends, alone = (np.zeros(len(words), bool) for _ in range(3))
        # blanks that don't begin a piece with what follows, or perhaps a special token
        unclear[n_usual:] = [not w or w[w[0] == "\n" :][:1].isspace() or "<|" in w for w in others]
        ends[n_usual:], alone[n_usual:] = [w[-1:].isspace() for w in others], [w == "\n" for w in others]
        bad = unclear[item]
        bad[1:] |= ends[item[:-1]] & alone[item[1:]]
        odd = np.logical_or.reduceat(bad, begin)
        at_first, first = np.unique(item[begin[~odd]], return_inverse=True)
        item[begin[~odd]] = len(words) + first

        stems = pc.utf8_rtrim(words[:n_usual], SIGNS)
        signed = pc.not_equal(pc.binary_length(stems), pc.binary_length(words[:n_usual]))
        stems, signs = (x.dictionary_encode() for x in (stems, pc.replace_substring_regex(words[:n_usual].filter(signed), WORD, "")))
        pieces = [w if w[0] == "\n" else " " + w for w in stems.dictionary.to_numpy(zero_copy_only=False).tolist()]
        behind = np.full(n_usual, -1)
        behind[signed.to_numpy(zero_copy_only=False)] = len(pieces) + signs.indices.to_numpy()
        pieces += signs.dictionary.to_pylist()
        order = np.stack([stems.indices.to_numpy(), behind], axis=1).ravel()
        cut = [_cut(" a" if u else w if w[0] == "\n" else " " + w) for w, u in zip(others, unclear[n_usual:].tolist(), strict=True)]
        cut += map(_cut, words.take(pa.array(at_first)).to_pylist())
        order = np.r_[order[order >= 0], np.arange(len(pieces), len(pieces) + sum(map(len, cut)))]
        pieces += chain.from_iterable(cut)
        n_pieces = np.r_[1 + (behind >= 0), np.fromiter(map(len, cut), np.int64, len(cut))]
        pool, starts, sizes = self._found(pieces)
        starts, sizes = starts[order], sizes[order]
        whole = self._ids(texts.filter(pa.array(odd)).to_pylist())
        ids = np.concatenate([pool[_places(starts, sizes)], *whole])
        sizes = np.r_[np.add.reduceat(sizes, np.cumsum(n_pieces) - n_pieces), np.fromiter(map(len, whole), np.int64, len(whole))]

        item[begin[odd]] = len(n_pieces) + np.arange(len(whole))
        each = sizes[item]
        if odd.any():
            follows = np.repeat(odd, np.diff(begin, append=len(item)))
            follows[begin] = False
            each[follows] = 0
        return ids[_places((np.cumsum(sizes) - sizes)[item], each)], np.add.reduceat(each, begin)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """16-bit ids of each text."""
        ids, sizes = self.encode_all(texts)
        return np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else []


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _grouped(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, which have so many bits, in groups of equal ones: (their places, where each group begins, the groups' keys)."""
    below = len(key).bit_length()
    if bits + below <= 64:  # sorting numbers is several times faster than sorting their places
        run = key << np.uint64(below)
        run |= np.arange(len(key), dtype=np.uint64)
        run.sort()
        order = (run & np.uint64((1 << below) - 1)).astype(np.int64)
        run >>= np.uint64(below)
    else:
        order = np.argsort(key, kind="stable")
        run = key[order]
    begin = np.flatnonzero(np.r_[np.ones(min(1, len(run)), bool), run[1:] != run[:-1]])
    return order, begin, run[begin]


class _Sequence:
    """Symbols as a linked list over the places of the ids; place ``n`` stands before the first and behind the last."""

    def __init__(self, ids: np.ndarray) -> None:
        n = len(ids)
        self.n, self.symbols, self.n_symbols = n, np.r_[ids.astype(np.uint32), np.uint32(0)], FIRST_RULE
        self.after, self.before = np.arange(1, n + 2), np.r_[n, np.arange(n)]
        self.stays, self.mark, self.busy = np.ones(n + 1, bool), np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        self.begins = self.symbols != END  # a pair does: neither ends a document nor is gone
        self.begins[max(n - 1, 0) :] = False

    def sorted_places(self, *places: np.ndarray) -> np.ndarray:
        """Those of ``places`` at which a pair begins, ascending."""
        if sum(map(len, places)) < self.n >> 6:
            found = np.sort(np.concatenate(places))
            return found[self.begins[found] & (np.diff(found, prepend=-1) > 0)]
        for some in places:
            self.mark[some] = True
        self.mark &= self.begins
        found = np.flatnonzero(self.mark)
        self.mark[:] = False
        return found

    def pairs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(order, sizes, times, odd): indexes of the places ``at`` by their pair, how many each pair has, how often each pair
        occurs without overlap, and whether an equal pair that counts overlaps the place."""
        first, second = self.symbols[at], self.symbols[self.after[at]]
        bits = self.n_symbols.bit_length()
        key = first.astype(np.uint64)
        key <<= np.uint64(bits)
        key |= second
        order, begin, names = _grouped(key, 2 * bits)
        sizes = np.diff(begin, append=len(at))
        odd, times = np.zeros(len(at), bool), sizes
        twins = np.flatnonzero(first == second)
        if len(twins):  # only equal symbols make equal pairs that overlap
            place = np.arange(len(twins))
            same = np.zeros(len(twins), bool)
            same[1:] = (first[twins[1:]] == first[twins[:-1]]) & (self.after[at[twins[:-1]]] == at[twins[1:]])
            odd[twins] = (place - np.maximum.accumulate(np.where(same, 0, place))) % 2 == 1
            if odd.any():
                times = sizes - np.bincount(np.searchsorted(names, key[odd]), minlength=len(sizes))
        return order, sizes, times, odd

    def _undisputed(self, live: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ascending places and the ranks of their pairs: those that neither neighbour outranks; then those that this leaves
        free."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        near = self.after[live[:-1]] == live[1:]  # overlaps the next one
        while len(live):
            ahead = mine[:-1] <= mine[1:]
            first = np.ones(len(live), bool)
            first[:-1] = ahead | ~near
            first[1:] &= ~(ahead & near)
            own = np.flatnonzero(first)
            found.append((live[own], mine[own]))
            rest = ~first
            rest[:-1] &= ~(first[1:] & near)
            rest[1:] &= ~(first[:-1] & near)
            live, mine, near = live[rest], mine[rest], (near & rest[1:])[rest[:-1]]
            near = near[: max(len(live) - 1, 0)]
        return tuple(np.concatenate([f[k] for f in found]) for k in range(2))

    def replace(self, live: np.ndarray, odd: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rules, places to count again) of replacing the pairs at the places ``live``. A pair of which others leave only one
        place isn't replaced."""
        tally = np.zeros(int(ranks.max()) + 1, np.int64)
        lone = np.zeros(len(tally), bool)
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        open_, open_ranks, now = live, ranks, ~odd
        while now.any():
            places, own = self._undisputed(open_[now], open_ranks[now])
            tally += np.bincount(own, minlength=len(tally))
            if (tally == 1).any():
                lone |= tally == 1
                tally[lone] = 0
                kept = ~lone[own]
                places, own = places[kept], own[kept]
            taken.append((places, own))
            self.busy[places] = self.busy[self.before[places]] = self.busy[self.after[places]] = True
            rest = ~self.busy[open_]
            open_, open_ranks = open_[rest], open_ranks[rest]
            rest = ~lone[open_ranks]
            open_, open_ranks = open_[rest], open_ranks[rest]
            now = np.ones(len(open_), bool)
        places, own = (np.concatenate([t[k] for t in taken]) for k in range(2))
        second, left = self.after[places], self.before[places]
        self.busy[places] = self.busy[left] = self.busy[second] = False
        first = np.full(len(tally), -1)
        first[own] = np.arange(len(own))
        used = first >= 0
        first, name = first[used], np.cumsum(used) - 1
        rules = np.stack([self.symbols[places[first]], self.symbols[second[first]]], axis=1).astype(np.int64)
        self.symbols[places] = self.n_symbols + name[own]
        self.n_symbols += len(first)
        self.begins[places] = self.begins[second]
        self.begins[second] = self.stays[second] = False
        behind = self.after[second]
        self.after[places] = behind
        self.before[behind] = places
        return rules, self.sorted_places(live, places, left)


def compress(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, lengths, symbols) of ids below ``FIRST_RULE``."""
    text = _Sequence(ids)
    rules: list[np.ndarray] = [np.empty((0, 2), np.int64)]
    at = np.flatnonzero(text.begins)
    for least in FALLS:
        rare: list[np.ndarray] = [at[:0]]  # places of pairs for the next ones of FALLS
        while len(at):
            order, sizes, times, odd = text.pairs(at)
            often = np.flatnonzero(times >= least)
            rank = np.full(len(times), -1, np.int32)  # of pairs that occur once
            rank[times >= 2] = -2
            rank[often[np.argsort(-times[often], kind="stable")]] = np.arange(len(often))
            ranks = np.empty(len(at), np.int32)
            ranks[order] = np.repeat(rank, sizes)
            rare.append(at[ranks == -2])
            if not len(often):
                break
            live = np.flatnonzero(ranks >= 0)
            made, at = text.replace(at[live], odd[live], ranks[live])
            rules.append(made)
        at = text.sorted_places(*rare)
    found = np.concatenate(rules)
    return found.astype("<u4"), symbol_sizes(found)[FIRST_RULE:].astype("<u4"), text.symbols[:-1][text.stays[:-1]].astype("<u4")


def symbol_sizes(rules: np.ndarray) -> np.ndarray:
    """Ids that each symbol expands to."""
    sizes = np.r_[np.ones(FIRST_RULE, np.int64), np.zeros(len(rules), np.int64)]
    todo = np.arange(len(rules))
    while len(todo):
        first, second = sizes[rules[todo, 0]], sizes[rules[todo, 1]]
        known = (first > 0) & (second > 0)
        sizes[FIRST_RULE + todo[known]] = (first + second)[known]
        todo = todo[~known]
    return sizes


def _expanded(symbols: np.ndarray, at: np.ndarray, rules: np.ndarray, sizes: np.ndarray, low: int, high: int) -> np.ndarray:
    """Ids [low, high) of ``symbols`` that begin at the places ``at``; what lies outside isn't expanded."""
    out = np.empty(high - low, np.uint32)
    while len(symbols):
        inside = (at < high) & (at + sizes[symbols] > low)
        symbols, at = symbols[inside], at[inside]
        nested = symbols >= FIRST_RULE
        out[at[~nested] - low] = symbols[~nested]
        at, pairs = at[nested], rules[symbols[nested] - FIRST_RULE].astype(np.int64)
        symbols, at = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([at, at + sizes[pairs[:, 0]]])
    return out


def expand(symbols: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """Ids of a sequence of symbols, from those of all rules if these aren't many more."""
    symbols, sizes = symbols.astype(np.int64), symbol_sizes(rules)
    if sizes[FIRST_RULE:].sum() <= 4 * max(FIRST_RULE, sizes[symbols].sum()):
        begin = np.cumsum(sizes) - sizes
        pool = np.empty(int(sizes.sum()), np.uint32)
        pool[:FIRST_RULE] = np.arange(FIRST_RULE)
        todo, known = np.arange(len(rules)), np.arange(len(sizes)) < FIRST_RULE
        while len(todo):
            ready = known[rules[todo]].all(axis=1)
            now, todo = todo[ready], todo[~ready]
            parts = rules[now].ravel()
            pool[_places(begin[FIRST_RULE + now], sizes[FIRST_RULE + now])] = pool[_places(begin[parts], sizes[parts])]
            known[FIRST_RULE + now] = True
        return pool[_places(begin[symbols], sizes[symbols])]
    ends = np.cumsum(sizes[symbols])
    return _expanded(symbols, ends - sizes[symbols], rules, sizes, 0, int(ends[-1]) if len(ends) else 0)


def ids_between(row: dict, low: int, high: int) -> np.ndarray:
    """Ids [low, high) of a shard's row, from the symbols that cover them."""
    rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
    symbols = np.frombuffer(row["symbols"], "<u4").astype(np.int64)
    sizes = np.r_[np.ones(FIRST_RULE, np.int64), np.frombuffer(row["lengths"], "<u4")]
    ends = np.cumsum(sizes[symbols])
    a, b = np.searchsorted(ends, [low, high - 1], side="right")
    return _expanded(symbols[a : b + 1], (ends - sizes[symbols])[a : b + 1], rules, sizes, low, high)


def write_ids(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encode the texts of ``docs`` (doc_id, text) and write them in the file format. A null text is empty: the end id alone.
    Rows without an id come first; rows of one id stay separate documents."""
    from pyspark import TaskContext

    spark = docs.sparkSession
    python_ready(spark, rows=20_000, batch_bytes="8m")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, part, shard = encoder(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            rules, lengths, symbols = compress(np.concatenate(ids))
            own, counts = pa.concat_arrays(doc_ids), pa.array(np.concatenate(sizes), pa.int32())
            arrays = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (own, counts))]
            arrays += [pa.array([sum(map(len, ids))], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (rules, lengths, symbols))]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "shard", "doc_ids", "sizes", "n_ids", "rules", "lengths", "symbols"])

        waiting = 0
        for batch in batches:
            own, found, counts = batch.column(0), *work.encode_all(batch.column(1))
            found, counts = np.insert(found, np.cumsum(counts), END), counts + 1
            while len(counts):
                ends = np.cumsum(counts)
                full = int(np.searchsorted(ends, SHARD_IDS - waiting)) + 1  # documents up to which a shard is full
                n = int(ends[min(full, len(ends)) - 1])
                doc_ids.append(own[:full])
                sizes.append(counts[:full])
                ids.append(found[:n])
                waiting += n
                own, counts, found = own[full:], counts[full:], found[n:]
                if waiting >= SHARD_IDS:
                    yield row()
                    doc_ids, sizes, ids, waiting, shard = [], [], [], 0, shard + 1
        if ids:
            yield row()

    text = F.col("text").cast("string")
    size = docs.select(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    rows.mapInArrow(encode, FILE).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files: the ids of all documents before it, its own with
    the end id, and the CRC-32 of these as little-endian 32-bit numbers."""
    python_ready(spark, rows=1)
    files = spark.read.schema(FILE).parquet(path)
    of_part = files.groupBy("part").agg(F.sum("n_ids").alias("n_part"))
    before = lambda c: F.coalesce(F.sum(c).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_part = of_part.select("part", before("n_part").alias("part_start"))  # a row for each part
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "shard", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("in_part"))
    starts = starts.join(of_part, "part").select("part", "shard", (F.col("part_start") + F.col("in_part")).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = expand(np.frombuffer(row["symbols"], "<u4"), np.frombuffer(row["rules"], "<u4").reshape(-1, 2)).astype("<u4")
                ends = np.cumsum(row["sizes"])
                own = [ids[b - n : b] for b, n in zip(ends, row["sizes"], strict=True)]
                n = len(own)
                arrays = [pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64())]
                arrays += [pa.array(ends - row["sizes"], pa.int64()), pa.array(row["sizes"], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"])

    columns = "part int, shard int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint"
    docs = files.drop("n_ids", "lengths").mapInArrow(decode, columns)
    at = docs.join(starts, ["part", "shard"])
    return at.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the ids of all documents and read them back, see ``write_ids`` and ``read_documents``."""
    path = path or scratch_dir(docs.sparkSession, "token-files")
    write_ids(docs, path, tokenizer)
    return read_documents(docs.sparkSession, path)
