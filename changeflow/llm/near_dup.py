"""Near duplicates by b-bit MinHash: low bits of the minima, bands for candidates, exact confirmation on full sets.

1. Each text becomes a set of k-word shingles (64-bit hashes), ``bands * rows`` minima, the lowest four bits of which
   are packed, and a key for each band. Texts with equal sets fall into a class; only its smallest id goes on.
2. Documents that share a band key form a cell. A cell isn't expanded into pairs: its smallest member, the pivot, is
   compared with the others. All cells of a pivot make a group, so a pair is compared once however many bands it shares.
3. A pair's similarity is estimated from the equal four-bit fields, corrected for the 1/16 that agree by chance. Pairs
   five standard deviations below the threshold go; the others are confirmed on the full sets of both texts.
4. Groups whose members are all in one component by then are done. Those with more than ``LARGE`` members get up to
   ``PIVOT_ROUNDS`` further pivots, best-linked members first. In the groups that are still open, the members outside the
   largest component meet it and each other in blocks, on full sets, and only links that join components leave a task.
   So no link between components is lost, however large a group is, and near copies of one text cost a few rows each.
5. Components of the confirmed links give each document the smallest id it reaches.

A pair at exactly the threshold shares no band with probability (1 - 0.8 ** 6) ** 48 = 4.6e-7.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.llm.common import any_row, python_ready, stored, text_of
from changeflow.llm.components import connected_components

BANDS, ROWS = 48, 6
MARKED = 208  # functions whose low bits are kept
SIZES_APART = 70  # sets smaller than this only meet sets of about their size
BITS = 4
PIVOT_ROUNDS = 4
BLOCK, BLOCK_SHINGLES = 256, 400_000  # rows of a block, and shingles of all of them
LARGE = 10_000
WORDS_KEPT = 100_000
MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

# rows without an id get one from here on, by their text
NO_ID = 2**62
SIGNATURE = "doc_id bigint, n_shingles bigint, key1 bigint, key2 bigint, bits array<bigint>, bands array<bigint>"


class _WordHash(dict):
    """64-bit hashes of words; keeps a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS_KEPT and len(word) < 64:
            self[word] = value
        return value


_hashes = _WordHash()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX2
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of all words if there are fewer; empty without words."""
    words = text.lower().split()  # ASCII letters and ASCII white space only, as these are bytes
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    width = min(size, n)
    run = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        run = _mixed(run * MIX + ids[k : n - width + 1 + k])
    return np.unique(run)


def _factors(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    made = np.random.Generator(np.random.PCG64(20_240_607)).integers(0, 2**31, (2, bands * rows), dtype=np.uint32)
    return made[0] * np.uint32(2) + np.uint32(1), made[1]


def minima(hashes: np.ndarray, factor: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over the set, as 32 bits."""
    least = np.full(len(factor), 2**32 - 1, np.uint32)
    values = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(values), 2048):
        part = np.bitwise_xor.outer(mask, values[at : at + 2048])
        part *= factor[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """The lowest four bits of each minimum, mixed before, 16 of them to a 64-bit number."""
    low = np.zeros(-(-len(least) // 16) * 16, np.uint64)
    low[: len(least)] = _mixed(least.astype(np.uint64) * MIX) & np.uint64(15)
    shifts = np.arange(16, dtype=np.uint64) * np.uint64(BITS)
    return (low.reshape(-1, 16) << shifts).sum(axis=1, dtype=np.uint64)


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        key = _mixed(key * MIX + column.astype(np.uint64))
    return key


def size_classes(size: Column, percent: int) -> Column:
    """Classes that a set of this size is compared in. Sets that can reach the threshold differ by a factor of at most
    100 / percent, so their classes are equal or next to each other; each joins its own class and the next. Sets of
    ``SIZES_APART`` and more are one class: there, bands alone keep strangers apart, which tiny sets often share."""
    step = math.log(100 / percent) if percent < 100 else math.log(2)
    last = math.ceil(math.log(SIZES_APART) / step)
    own = F.least(F.lit(last), F.floor(F.log(size.cast("double")) / step + 1e-9)).cast("int")
    return F.sequence(own, F.least(F.lit(last), own + 1))


def signatures(docs: DataFrame, shingle: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), see ``SIGNATURE``; no text or no word: an empty set without keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, mask = _factors(bands, rows)
        for batch in batches:
            sizes, one, two, bits, keys = [], [], [], [], []
            for text in text_of(batch.column(1)):
                found = shingle_set(text, shingle)
                sizes.append(len(found))
                if not len(found):
                    one.append(None), two.append(None), bits.append(None), keys.append(None)
                    continue
                least = minima(found, factor, mask)
                digest = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
                one.append(int(digest[0])), two.append(int(digest[1]))
                bits.append(packed(least[:MARKED]).view(np.int64)), keys.append(band_keys(least, bands, rows).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(bits, longs), pa.array(keys, longs)],
                names=["doc_id", "n_shingles", "key1", "key2", "bits", "bands"],
            )

    python_ready(docs.sparkSession, batch_bytes="2m")
    return docs.select("doc_id", "text").mapInArrow(sign, SIGNATURE)


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles, low) of rows (node, text); ``low`` are the distinct lowest 16 bits of the shingles."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(text, shingle).view(np.int64) for text in text_of(batch.column(1))]
            low = [np.unique(x.astype(np.int16)) for x in found]
            made = [pa.array(found, pa.list_(pa.int64())), pa.array(low, pa.list_(pa.int16()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["node", "shingles", "low"])

    return docs.select("node", "text").mapInArrow(sets, "node bigint, shingles array<bigint>, low array<smallint>")


def estimated(left: Column, right: Column, functions: int = MARKED) -> Column:
    """Similarity from two packed signatures, corrected for fields that agree by chance."""
    fields = -(-functions // 16) * 16
    nonzero = lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
    differ = F.zip_with(left, right, lambda x, y: F.bit_count(nonzero(x.bitwiseXOR(y)).bitwiseAND(F.lit(0x1111111111111111))))
    n_differ = F.aggregate(differ, F.lit(0), lambda s, x: s + x)
    equal = (F.lit(fields) - n_differ - F.lit(fields - functions)) / F.lit(float(functions))
    chance = 1 / 2**BITS
    return (equal - chance) / (1 - chance)


def cutoff(threshold: float, functions: int = MARKED) -> float:
    """Five standard deviations of the estimate below the threshold."""
    chance = 1 / 2**BITS
    equal = chance + (1 - chance) * threshold
    return threshold - 5 * math.sqrt(equal * (1 - equal) / functions) / (1 - chance)


def confirmed(pairs: DataFrame, sig: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. Before, the packed bits and then the lowest 16 bits of the
    shingles rule out most of the others; a common shingle has common bits, so these never say too little. The joins on
    ``a``, which may be a pivot of very many pairs, have no aggregate above them, so Spark may split such a partition."""
    bits_a = sig.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    bits_b = sig.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    near = pairs.join(bits_b, "b").join(bits_a, "a")
    near = near.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    near = stored(near.where(estimated(F.col("bits_a"), F.col("bits_b")) >= cutoff(percent / 100)).select("a", "b", "n_a", "n_b"), "near")
    reach = lambda both: 100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)
    low_a, low_b = (sets.select(F.col("node").alias(c), F.col("low").alias(f"low_{c}")) for c in "ab")
    met = F.least(F.col("n_a") - F.size("low_a"), F.col("n_b") - F.size("low_b"))  # shingles of one text that share their bits
    likely = near.join(low_b, "b").join(low_a, "a").where(reach(F.size(F.array_intersect("low_a", "low_b")) + met))
    likely = stored(likely.select("a", "b", "n_a", "n_b"), "likely")
    set_a, set_b = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    return likely.join(set_b, "b").join(set_a, "a").where(reach(F.size(F.array_intersect("set_a", "set_b")))).select("a", "b")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of bits over the shingles that two or more of the sets have; two rows' common bits are the common shingles."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, which, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[which] > 1
    _, column = np.unique(which[shared], return_inverse=True)
    width = int(column.max(initial=-1)) + 1
    bits = np.zeros((len(sets), -(-max(width, 1) // 64) * 8), np.uint8)
    np.bitwise_or.at(bits, (owner[shared], column // 8), (1 << (column % 8)).astype(np.uint8))
    return bits.view(np.uint64)


def _links_in_blocks(members: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components within each group, from members (group, node, label). The largest component of a group
    meets the other members, and these meet each other, in blocks of about ``BLOCK`` rows and ``BLOCK_SHINGLES`` shingles at
    most; a block leaves out links between what its other links join already."""
    parts = members.join(reps.select("node", "n"), "node").groupBy("group", "label").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    sizes = parts.groupBy("group").agg(F.max(F.struct("size", "label", "n")).alias("main"), F.sum("size").alias("all"), F.sum("n").alias("all_n"))
    chunks = lambda rows, n: F.greatest(F.lit(1), F.ceil(rows / BLOCK), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    n_main, n_rest = chunks(F.col("main.size"), F.col("main.n")), chunks(F.col("all") - F.col("main.size"), F.col("all_n") - F.col("main.n"))
    sizes = sizes.select("group", F.col("main.label").alias("main"), n_main.alias("n_main"), n_rest.alias("n_rest"))
    dealt = members.join(sizes, "group").withColumn("in_main", F.col("label") == F.col("main"))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("node"), F.when(F.col("in_main"), F.col("n_main")).otherwise(F.col("n_rest"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    chunk = F.col("chunk")
    with_rest = F.transform(upto("n_rest"), lambda k: place("main", k, chunk, F.lit(1)))
    with_main = F.transform(upto("n_main"), lambda k: place("main", chunk, k, F.lit(0)))
    among = F.transform(upto("n_rest"), lambda k: place("rest", F.least(k, chunk), F.greatest(k, chunk), (chunk > k).cast("int")))
    meets = dealt.withColumn("at", F.explode(F.when(F.col("in_main"), with_rest).otherwise(F.concat(with_main, among))))
    rows = meets.select("group", "node", "label", "at.*").join(sets.select("node", "shingles"), "node")

    def compare(key, pdf: pd.DataFrame) -> pd.DataFrame:
        found = [np.asarray(x, np.int64) for x in pdf["shingles"]]
        size, bits = np.array([len(x) for x in found]), common_counts(found)
        node, side = pdf["node"].to_numpy(), pdf["side"].to_numpy()
        _, label = np.unique(pdf["label"].to_numpy(), return_inverse=True)
        alone = key[1] == "rest" and key[2] == key[3]
        first = np.flatnonzero(side == 0)
        second = first if alone else np.flatnonzero(side == 1)
        root = list(range(len(pdf)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        made = []
        for k in first:
            both = np.bitwise_count(bits[second] & bits[k]).sum(axis=1, dtype=np.int64)
            linked = second[(100 * both >= percent * (size[second] + size[k] - both)) & (label[second] != label[k])]
            for other in linked.tolist():
                x, y = top(int(label[k])), top(int(label[other]))
                if x != y:
                    root[x] = y
                    made.append((min(node[k], node[other]), max(node[k], node[other])))
        return pd.DataFrame(made, columns=["a", "b"]).astype(np.int64)

    return rows.groupBy("group", "kind", "i", "j").applyInPandas(compare, "a bigint, b bigint").distinct()


def linked_components(docs: DataFrame, sig: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, root) of the classes that are linked with another one; a class goes by its smallest doc_id, its node."""
    wide = sig.where("n_shingles > 0").withColumnRenamed("doc_id", "node")
    reps = wide.join(classes, ["node", "key1", "key2"], "left_semi").select("node", F.col("n_shingles").alias("n"), "bits", "bands")
    reps = stored(reps, "reps")
    cells = reps.select("node", F.posexplode("bands").alias("band", "key"), size_classes(F.col("n"), percent).alias("sizes"))
    cells = cells.select("node", "band", "key", F.explode("sizes").alias("sizes")).select("node", "band", F.xxhash64("band", "key", "sizes").alias("cell"))
    shared = cells.groupBy("cell").agg(F.count("*").alias("size"), F.min("node").alias("pivot")).where("size > 1")
    members = cells.join(shared, "cell").select(F.col("pivot").alias("group"), "node").distinct()
    members = stored(members, "members")
    # the hint keeps texts from being sorted; only the ids of a partition are held in memory
    sets = docs.join(members.select(F.col("node").alias("doc_id")).distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    sets = stored(shingle_sets(sets.select(F.col("doc_id").alias("node"), "text"), shingle), "sets")
    pairs = members.where("node != group").select(F.col("group").alias("a"), F.col("node").alias("b"))
    links = stored(confirmed(pairs, reps, sets, percent), "links")
    roots = connected_components(links)
    used = members.select("group").distinct().withColumn("pivot", F.col("group"))
    turn, last = 0, False
    while not last:
        labels = roots.select("node", F.col("root").alias("label"))
        labelled = members.join(labels, "node", "left").select("group", "node", F.coalesce("label", "node").alias("label"))
        torn = labelled.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"))
        tried = used.groupBy("group").agg(F.count("*").alias("tried"))
        torn = torn.where("low != high").join(tried, "group").where("size - tried > 1").select("group", "size")
        labelled = stored(labelled.join(torn, "group"), "open")
        if not any_row(labelled):
            break
        members = labelled.select("group", "node")
        large = labelled.where(F.col("size") > LARGE)
        last = turn == PIVOT_ROUNDS or not any_row(large)
        if last:
            more = _links_in_blocks(labelled.drop("size"), reps, sets, percent)
        else:
            ends = links.select(F.col("a").alias("node")).union(links.select("b"))
            degrees = ends.groupBy("node").agg(F.count("*").alias("degree"))
            fresh = large.join(used.withColumnRenamed("pivot", "node"), ["group", "node"], "left_anti")
            ranked = fresh.join(degrees, "node", "left").select("group", "node", "label", F.coalesce("degree", F.lit(0)).alias("degree"))
            best = ranked.groupBy("group").agg(F.max(F.struct("degree", "node", "label")).alias("best"))
            best = stored(best.select("group", F.col("best.node").alias("pivot"), F.col("best.label").alias("pivot_label")), "pivots")
            used = stored(used.join(torn, "group", "left_semi").union(best.select("group", "pivot")), "used")
            met = large.join(best, "group").where("label != pivot_label")
            more = confirmed(met.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), reps, sets, percent)
        more = stored(more, "links")
        if any_row(more):
            links = links.union(more)
            roots = connected_components(links)
        turn += 1
    return roots


def _keyed(docs: DataFrame) -> list[Column]:
    """The id that a row goes by, and its text."""
    text = docs["text"].cast("string")
    of_text = F.lit(NO_ID) + F.pmod(F.coalesce(F.xxhash64(text), F.lit(0)), F.lit(NO_ID))
    return [F.coalesce(docs["doc_id"].cast("bigint"), of_text).alias("doc_id"), text.alias("text")]


def _rooted(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, root) of each row, by the ids that rows go by."""
    keyed = docs.select(*_keyed(docs))
    sig = stored(signatures(keyed, shingle), "signatures")
    classes = sig.where("n_shingles > 0").groupBy("key1", "key2").agg(F.min("doc_id").alias("node"))
    classes = stored(classes, "classes")
    roots = linked_components(keyed, sig, classes, shingle, percent)
    rooted = classes.join(roots, "node", "left").select("key1", "key2", F.coalesce("root", "node").alias("root"))
    some = sig.where("n_shingles > 0").join(stored(rooted, "rooted"), ["key1", "key2"]).select("doc_id", "n_shingles", "root")
    none = sig.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("root"))
    return some.unionByName(none)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_shingles, component_id, kept.

    Two texts are linked if 100 * |common shingles| >= ``percent`` * |all shingles|. ``component_id`` is the smallest
    doc_id reached over links; a text that is null, empty or without words is linked with nothing and is its own
    component. Rows that repeat a doc_id are separate rows. A row without an id is linked like others but comes after
    every id: its component_id is null if it reaches none, and one text of such a component is kept.
    """
    named = lambda c: F.when(F.col(c) < NO_ID, F.col(c)).alias({"root": "component_id"}.get(c, c))
    rows = _rooted(docs, shingle, percent)
    return rows.select(named("doc_id"), "n_shingles", named("root"), (F.col("doc_id") == F.col("root")).alias("kept"))


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of ``docs``, with its columns: the row of the smallest id; texts without words all stay."""
    kept = stored(_rooted(docs, shingle, percent).where("doc_id = root").select(F.col("doc_id").alias("its_id")), "kept")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), _keyed(docs)[0].alias("its_id"))
    rows = rows.join(kept.distinct(), "its_id", "left_semi")
    if any_row(kept.groupBy("its_id").count().where("count > 1")):  # rows that repeat an id
        rows = rows.dropDuplicates(["its_id"])
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
