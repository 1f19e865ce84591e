"""Mixing sources to target weights by blocks and slots.

1. The words of each source, document after document, are packed into blocks of a fixed length (a small source has
   shorter ones, so that it has ``LEAST_BLOCKS``). Running word counts come from sums per chunk of a source, so a source
   with a third of all rows is spread over many tasks.
2. Targets are shared by weight, with a limit of ``most`` times a source's size; they become a number of slots.
3. Each output shard draws its counts of slots per source. They are multinomial draws given that all shards together
   take every source's slots: the shards' range is halved again and again, and the slots of each half are a
   multivariate hypergeometric draw seeded by the node's place. So a shard finds its counts, and how many slots earlier
   shards took, on its own, and no target is missed by chance.
4. Slot k of a source with n blocks takes block ``permuted(k mod n)`` of pass k div n; the permutation is a keyed Feistel
   network that walks until it is below n, another one for each source and pass. Blocks are joined by index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.llm.common import python_ready, same, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
LEAST_BLOCKS = 256
CHUNK_ROWS = 50_000
LEAST_CHUNKS = 256
DRAWN_AT_ONCE = 5 * 10**8  # numpy draws from less than 10**9; a larger node is drawn in parts


@dataclass(frozen=True)
class Mix:
    """Sizes of a mix; ``percent`` of all words are shared, a source gives at most ``most`` times its words."""

    weights: tuple[int, ...] = WEIGHTS
    percent: int = 150
    most: int = 2
    block: int = 128
    shard_blocks: int = 8_192
    seed: int = 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size) -> with number, weight and target. The excess over the limits is shared anew by weight, in
    rounds over the table of sources, until no target is above."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in mix.weights]), (F.col("number") % len(mix.weights) + 1).cast("int"))
    table = stored(sizes.withColumn("number", number).withColumn("weight", weight), "sources")
    limit = F.col("source_size") * mix.most
    whole = (table.agg(F.sum("source_size")).first()[0] or 0) * mix.percent / 100
    scale = 0.0
    while True:
        full = limit <= F.col("weight") * scale
        row = table.agg(
            F.sum(F.when(full, limit).otherwise(0)).alias("taken"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight")
        ).first()
        if not row or not row["weight"]:
            break
        next_scale = (whole - row["taken"]) / row["weight"]
        if next_scale <= scale:
            break
        scale = next_scale
    return table.withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.lit(scale)))


def with_blocks(table: DataFrame, mix: Mix) -> DataFrame:
    """With the block length, blocks and slots of each source."""
    length = F.greatest(F.lit(1), F.least(F.lit(mix.block), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("bigint")
    blocks = F.ceil(F.col("source_size") / F.col("length")).cast("bigint")
    slots = F.least(F.col("blocks") * mix.most, F.round(F.col("target") * F.col("blocks") / F.greatest(F.col("source_size"), F.lit(1)))).cast("bigint")
    return table.withColumn("length", length).withColumn("blocks", blocks).withColumn("slots", slots)


def _halved(counts: np.ndarray, take: int, seed: list[int]) -> np.ndarray:
    parts = int(counts.sum()) // DRAWN_AT_ONCE + 1
    made = np.random.Generator(np.random.PCG64(seed))
    left, drawn = np.zeros_like(counts), 0
    for k in range(parts):
        some = counts * (k + 1) // parts - counts * k // parts
        until = min(take * (k + 1) // parts, drawn + int(some.sum()))
        left += made.multivariate_hypergeometric(some, until - drawn, method="marginals")
        drawn = until
    return left


def shard_counts(slots: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in a shard, and in the shards before it."""
    counts, before, low, high = slots.astype(np.int64), np.zeros(len(slots), np.int64), 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        left = _halved(counts, int(counts.sum()) * (middle - low) // (high - low), [seed, low, high])
        if shard < middle:
            counts, high = left, middle
        else:
            counts, before, low = counts - left, before + left, middle
    return counts, before


def permuted(index: np.ndarray, size: int, key: tuple[int, ...]) -> np.ndarray:
    """Pseudorandom permutation of range(size), at ``index``."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    rounds = np.random.Generator(np.random.PCG64(list(key))).integers(0, 2**63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        a, b = out[todo] >> np.uint64(half), out[todo] & low
        for r in rounds:
            f = (b ^ (r >> np.uint64(32))) * r
            a, b = b, a ^ ((f ^ (f >> np.uint64(29))) >> np.uint64(7)) & low
        out[todo] = (a << np.uint64(half)) | b
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def slots_of(table: DataFrame, mix: Mix) -> DataFrame:
    """(shard, slot, number, block, pass) of every slot. The driver has three numbers for each source, no rows."""
    spark = table.sparkSession
    python_ready(spark)
    rows = sorted(tuple(r) for r in table.where("slots > 0").select("number", "blocks", "slots").collect())
    numbers, blocks, slots = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    total, seed = int(slots.sum()), mix.seed
    shards = max(1, -(-total // mix.shard_blocks))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard in pdf["id"]:
                counts, before = shard_counts(slots, shards, int(shard), seed)
                found = []
                for s in np.flatnonzero(counts):
                    k = before[s] + np.arange(counts[s])
                    turn = k // blocks[s]
                    block = np.empty(len(k), np.int64)
                    for p in np.unique(turn):
                        at = turn == p
                        block[at] = permuted(k[at] % blocks[s], int(blocks[s]), (seed, int(numbers[s]), int(p)))
                    found.append(pd.DataFrame({"number": numbers[s], "block": block, "pass": turn}))
                if found:
                    made = pd.concat(found)
                    order = np.random.Generator(np.random.PCG64([seed, 1, int(shard)])).permutation(len(made))
                    yield made.assign(shard=shard, slot=order)[["shard", "slot", "number", "block", "pass"]]

    parts = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    schema = "shard bigint, slot bigint, number int, block bigint, pass bigint"
    return spark.range(0, shards if total else 0, 1, parts).mapInPandas(draw, schema)


def placed(docs: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame]:
    """(id1, id2, doc_id, size, number, start) of each row, its first word's place in its source, and the sources."""
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"),
        F.xxhash64(F.lit("a"), "doc_id", text, "source").alias("id1"), F.xxhash64(F.lit("b"), text, "source", "doc_id").alias("id2"),
    )
    rows = stored(rows, "sizes")
    sources = stored(with_blocks(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), mix), mix), "targets")
    from pyspark.sql import Window

    chunks = max(LEAST_CHUNKS, -(-rows.count() // CHUNK_ROWS))
    named = rows.join(sources.select(F.col("source").alias("its"), "number"), same(F.col("source"), F.col("its"))).drop("its")
    named = named.withColumn("chunk", F.pmod(F.xxhash64("id1"), F.lit(chunks)).cast("int"))
    running = Window.partitionBy("number", "chunk").orderBy("doc_id", "size", "id1", "id2").rowsBetween(Window.unboundedPreceding, -1)
    sums = named.groupBy("number", "chunk").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("number", "chunk", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    inside = named.withColumn("inside", F.coalesce(F.sum("size").over(running), F.lit(0)))
    at = inside.join(stored(sums, "chunk-starts"), ["number", "chunk"])
    return stored(at.select("id1", "id2", "doc_id", "size", "number", (F.col("base") + F.col("inside")).alias("start")), "placed"), sources


def spans(docs_placed: DataFrame, sources: DataFrame, mix: Mix) -> DataFrame:
    """The mix: (shard, slot, pass, number, block, start, first, n): n words of the row at ``start``, from word ``first`` on."""
    lengths = sources.select("number", "length")
    rows = docs_placed.where("size > 0").join(lengths, "number").withColumn("end", F.col("start") + F.col("size"))
    first, last = F.floor(F.col("start") / F.col("length")), F.floor((F.col("end") - 1) / F.col("length"))
    pieces = rows.withColumn("block", F.explode(F.sequence(first, last)))
    low, high = F.greatest("start", F.col("block") * F.col("length")), F.least("end", (F.col("block") + 1) * F.col("length"))
    pieces = pieces.select("number", "block", "start", (low - F.col("start")).alias("first"), (high - low).alias("n"))
    return pieces.join(stored(slots_of(sources, mix), "slots"), ["number", "block"])


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target (its source's), taken.

    ``taken`` are the words that the mix takes of it, repeats counted. A null text has no words; null is a source of its
    own, the last. Repeated rows are separate rows. With no words at all every target is 0.
    """
    at, sources = placed(docs, mix)
    taken = spans(at, sources, mix).groupBy("number", "start").agg(F.sum("n").alias("taken"))
    some = at.where("size > 0").join(taken, ["number", "start"], "left").select("doc_id", "size", "number", "taken")
    none = at.where("size = 0").select("doc_id", "size", "number", F.lit(None).cast("bigint").alias("taken"))
    rows = some.unionByName(none).join(sources.select("number", "source_size", "target"), "number")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix as documents with the columns of ``docs``: a row for each row and pass that the mix takes words of, its text
    cut to those words and what stands between them. A row that is taken whole keeps its text."""
    at, sources = placed(docs, mix)
    taken = spans(at, sources, mix).groupBy("number", "start", "pass").agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("spans"))
    taken = taken.join(at.where("size > 0").select("number", "start", "id1", "id2", "size"), ["number", "start"])
    taken = stored(taken.select("id1", "id2", "size", "spans"), "mix-spans")
    text = docs["text"].cast("string")
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.xxhash64(F.lit("a"), docs["doc_id"], text, docs["source"]).alias("id1"),
        F.xxhash64(F.lit("b"), text, docs["source"], docs["doc_id"]).alias("id2"),
    )
    if rows.groupBy("id1", "id2").count().where("count > 1").limit(1).count():
        rows = rows.dropDuplicates(["id1", "id2"])  # each copy has spans of its own
    made = rows.join(taken, ["id1", "id2"])

    @F.pandas_udf("string")
    def cut(texts: pd.Series, sizes: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([cut_text(t, n, [(p["first"], p["n"]) for p in ps]) for t, n, ps in zip(texts, sizes, parts, strict=True)])

    made = made.withColumn("cut", cut(F.col("row.text").cast("string"), "size", "spans"))
    fields = {c: F.col("row").getField(c).alias(c) for c in docs.columns}
    fields["text"] = F.col("cut").alias("text")
    if "n_chars" in fields:
        fields["n_chars"] = F.char_length("cut").cast("bigint").alias("n_chars")
    return made.select(*fields.values())


def cut_text(text: str, size: int, parts: list[tuple[int, int]]) -> str:
    """The text from the first to the last word of each run of parts, runs a line apart."""
    import re

    runs: list[list[int]] = []
    for first, n in parts:
        if runs and runs[-1][1] == first:
            runs[-1][1] = first + n
        else:
            runs.append([first, first + n])
    if runs == [[0, size]]:
        return text
    words = [m.span() for m in re.finditer(WORD, text)]
    return "\n".join(text[words[a][0] : words[b - 1][1]] for a, b in runs)
