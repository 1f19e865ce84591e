"""Trie of conversation prefixes by fixed-length block hashing.

1. Turns are ranked within their conversation, and get a prefix hash: the running 128-bit sum of hashes of (turn, place).
   Sums can be cut anywhere, so a conversation with a third of all turns is ranked and summed by many tasks; what a part
   needs from the parts before it is one row for each part.
2. Blocks of ``BLOCK`` turns are grouped by the prefix hashes at their start and end, that is by all turns up to their
   end. Most tasks' rows of a common prefix are counted before the shuffle.
3. A start with one block after it doesn't branch there: the block's turns are nodes as they stand. Where siblings
   diverge, only their blocks, one for each group, are cut into turns, and these grouped by prefix hash.
4. Sums over subtrees come by doubling: in round k each node adds what its descendants 2**k levels below have gathered.
   Nodes that neither get nor give any more leave, so long rounds only concern long conversations.
5. The ids of the conversations that end at a node are sorted over range partitions, joined to strings of bounded length
   there, and hashed string after string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.llm.common import any_row, python_ready, stored

BLOCK = 4
GROUP = 100  # conversations whose rebuilt heads come from one of them
HEADS = 6  # heads have fewer turns
IDS = 16_384  # ids in a string to be hashed
ODD1, ODD2, ODD3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
NODES = "p1 bigint, p2 bigint, depth bigint, q1 bigint, q2 bigint, n bigint, conv_id bigint, chars bigint"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * ODD2
    x = (x ^ (x >> np.uint64(27))) * ODD3
    return x ^ (x >> np.uint64(31))


def place_hashes(digest: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each turn (two halves of its digest) and its place."""
    low, high, at = digest[:, 0], digest[:, 1], place.astype(np.uint64) * ODD1
    return np.stack([_mixed(low ^ _mixed(high + at)), _mixed(high ^ _mixed(low ^ ~at))], axis=1)


def running(values: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums (wrapping) down the rows of each run of equal keys, and a mark at each run's first row."""
    sums = np.cumsum(values, axis=0, dtype=np.uint64)
    first = np.concatenate([[True], key[1:] != key[:-1]])
    at = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    return sums - (sums[at] - values[at]), first


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def with_running_sums(rows: DataFrame, place: str | None, order: list[str], label: str) -> DataFrame:
    """``rows`` (conv_id, digest of 16 bytes, others) with s1, s2: running sums down the rows of each conversation, in
    ``order``, the row itself included. They are sums of ones if ``place`` is None, of ``place_hashes`` else.

    The rows are dealt by range, so a part has at most one conversation that began before it; each part's last sums, a
    row for each part, go through the driver to the parts that follow."""
    spark = rows.sparkSession
    columns = rows.columns
    dealt = rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    dealt = dealt.withColumn("part", F.spark_partition_id())
    at = dealt.columns.index
    conv_at, digest_at, place_at = at("conv_id"), at("digest"), at(place) if place else None
    names = [*dealt.columns, "s1", "s2", "line"]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry, line = None, np.zeros(2, np.uint64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = _longs(batch.column(conv_at))
            if place_at is None:
                values = np.ones((len(key), 2), np.uint64)
            else:
                digest = np.frombuffer(b"".join(batch.column(digest_at).to_pylist()), np.uint64).reshape(-1, 2)
                values = place_hashes(digest, _longs(batch.column(place_at)))
            sums, first = running(values, key)
            if key[0] == last:
                until = int(np.flatnonzero(first)[1]) if first.sum() > 1 else len(key)
                sums[:until] += carry
            last, carry = key[-1], sums[-1].copy()
            made = [pa.array(sums[:, k].view(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made, pa.array(np.arange(line, line + len(key)))], names=names)
            line += len(key)

    kinds = ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes)
    made = stored(dealt.mapInArrow(local, f"{kinds}, s1 bigint, s2 bigint, line bigint"), label)
    edge = F.max_by(F.struct("conv_id", "s1", "s2"), "line").alias("last")
    edges = made.groupBy("part").agg(F.min("conv_id").alias("low"), edge).collect()
    base: dict[int, tuple[int, int, int]] = {}  # part -> the conversation it goes on with, and its sums so far
    before: tuple[int, int, int] | None = None
    for e in sorted(edges, key=lambda e: e["part"]):
        conv, s1, s2 = e["last"]
        if before and before[0] == e["low"]:
            base[e["part"]] = before
            if conv == before[0]:
                s1, s2 = s1 + before[1], s2 + before[2]
        before = (conv, s1, s2)
    wrapped = {part: (conv, np.array([s1 % 2**64, s2 % 2**64], np.uint64)) for part, (conv, s1, s2) in base.items()}
    part_at = names.index("part")
    out = [*columns, "s1", "s2"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, key = _longs(batch.column(part_at)), _longs(batch.column(conv_at))
            sums = [_longs(batch.column(names.index(s))).view(np.uint64).copy() for s in ("s1", "s2")]
            for p in np.unique(part).tolist():
                if p in wrapped:
                    goes_on = (part == p) & (key == wrapped[p][0])
                    for k in (0, 1):
                        sums[k][goes_on] += wrapped[p][1][k]
            kept = [batch.column(names.index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(s.view(np.int64)) for s in sums]], names=out)

    if not wrapped:
        return made.select(*out)
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return made.mapInArrow(whole, f"{kinds}, s1 bigint, s2 bigint")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, chars) of each turn that has a conv_id; null role and text are empty."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where(conversations["conv_id"].isNotNull())
    return rows.select(
        conversations["conv_id"].cast("bigint").alias("conv_id"), conversations["turn"].cast("bigint").alias("turn"),
        digest.alias("digest"), F.char_length(text).cast("bigint").alias("chars"),
    )


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, chars, ends) of the rebuilt conversations, from 1 on, and (conv_id) of those without turns.

    The first h turns come from conversation conv_id - conv_id % ``GROUP``, the others are its own after its first h;
    h is the remainder of the CRC-32 of the id by ``HEADS``."""
    ranked = with_running_sums(turns, None, ["turn", "digest"], "ranked")
    ranked = stored(ranked.select("conv_id", F.col("s1").alias("rank"), "digest", "chars"), "ranks")
    counts = ranked.groupBy("conv_id").agg(F.count("*").alias("n"))
    counts = stored(counts, "lengths")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    heads = counts.select("conv_id", "n", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("source"))
    lengths = counts.select(F.col("conv_id").alias("source"), F.col("n").alias("source_n"))
    heads = heads.join(lengths, "source", "left")
    heads = heads.withColumn("k", F.least(F.col("h"), F.coalesce("source_n", F.lit(0))))
    heads = heads.withColumn("length", F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    heads = stored(heads.select("conv_id", "source", "h", "k", "length"), "heads")
    ends = (F.col("depth") == F.col("length")).alias("ends")
    own = ranked.join(heads, "conv_id").where("rank > h").withColumn("depth", F.col("k") + F.col("rank") - F.col("h"))
    lent = ranked.where(F.col("rank") < HEADS).withColumnRenamed("conv_id", "source")
    lent = lent.join(heads, "source").where("rank <= k").withColumn("depth", F.col("rank"))
    parts = [x.select("conv_id", "depth", "digest", "chars", ends) for x in (own, lent)]
    return parts[0].unionByName(parts[1]), heads.where("length = 0").select("conv_id")


def trie_nodes(prefixes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``NODES`` below the root, from (conv_id, depth, chars, p1, p2, q1, q2): prefix hashes with and without the turn."""
    number = F.floor((F.col("depth") - 1) / block)
    turns = F.sort_array(F.collect_list(F.struct("depth", "p1", "p2", "q1", "q2", "chars")))  # ``block`` at most
    blocks = prefixes.groupBy("conv_id", number.alias("block")).agg(turns.alias("turns"))
    last = F.element_at("turns", -1)
    blocks = blocks.select(
        "conv_id", "block", "turns",
        F.col("turns")[0]["q1"].alias("from1"), F.col("turns")[0]["q2"].alias("from2"), last["p1"].alias("to1"), last["p2"].alias("to2"),
    )
    blocks = stored(blocks, "blocks")
    key = ["from1", "from2", "to1", "to2"]
    groups = stored(blocks.groupBy(*key).agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.min("block").alias("block")), "block-groups")
    single = groups.groupBy("from1", "from2").agg(F.count("*").alias("siblings"), F.min("to1").alias("to1"), F.min("to2").alias("to2"))
    single = single.where("siblings = 1").select(*key, F.lit(True).alias("alone"))
    groups = groups.join(single, key, "left").join(blocks.select("conv_id", "block", "turns"), ["conv_id", "block"])
    cut = groups.select("n", "conv_id", F.coalesce("alone", F.lit(False)).alias("alone"), F.explode("turns").alias("turn"))
    cut = stored(cut.select("turn.p1", "turn.p2", "turn.depth", "turn.q1", "turn.q2", "n", "conv_id", "turn.chars", "alone"), "cut-blocks")
    columns = ["p1", "p2", "depth", "q1", "q2", "n", "conv_id", "chars"]
    straight = cut.where("alone").select(*columns)
    branching = cut.where("NOT alone").groupBy("p1", "p2", "depth", "q1", "q2", "chars")
    branching = branching.agg(F.sum("n").alias("n"), F.min("conv_id").alias("conv_id")).select(*columns)
    return stored(straight.unionByName(branching), "nodes")


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """(p1, p2, leaves, saved) of (p1, p2, depth, q1, q2, leaves, saved), summed over each node and all below it. The root
    isn't among the nodes."""
    todo = nodes.select("p1", "p2", "depth", F.col("q1").alias("j1"), F.col("q2").alias("j2"), "leaves", "saved")
    done: list[DataFrame] = []
    step = 1  # (j1, j2) is the ancestor so many levels up
    while any_row(deep := todo.where(F.col("depth") > step)):
        gained = deep.groupBy(F.col("j1").alias("p1"), F.col("j2").alias("p2"))
        gained = gained.agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        jumps = todo.where(F.col("depth") > step).select(F.col("p1").alias("j1"), F.col("p2").alias("j2"), F.col("j1").alias("t1"), F.col("j2").alias("t2"))
        rows = todo.join(gained, ["p1", "p2"], "left")
        far = rows.where(F.col("depth") > 2 * step).join(jumps, ["j1", "j2"])
        near = rows.where(F.col("depth") <= 2 * step).withColumns({c: F.lit(None).cast("bigint") for c in ("t1", "t2")})
        total = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
        goes_on = ((F.col("depth") > 2 * step) | F.col("more_leaves").isNotNull()).alias("goes_on")
        rows = far.unionByName(near)
        rows = stored(rows.select("p1", "p2", "depth", F.col("t1").alias("j1"), F.col("t2").alias("j2"), total("leaves"), total("saved"), goes_on), "subtree-sums")
        done.append(rows.where("NOT goes_on"))
        todo, step = rows.where("goes_on"), 2 * step
    out = todo.select("p1", "p2", "leaves", "saved")
    for rows in done:
        out = out.union(rows.select("p1", "p2", "leaves", "saved"))
    return out


def end_digests(ends: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256) from (p1, p2, conv_id): SHA-256 of the ids, ascending, joined by commas."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p1, p2, conv = (_longs(c) for c in batch.columns)
            cuts = np.flatnonzero((p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])) + 1
            cuts = np.union1d(np.concatenate([[0], cuts, [len(p1)]]), np.arange(0, len(p1), IDS))
            text = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            at = cuts[:-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(p1[at]), pa.array(p2[at]), pa.array(conv[at]), pa.array(text, pa.string())], names=["p1", "p2", "first", "ids"]
            )

    dealt = ends.select("p1", "p2", "conv_id").repartitionByRange("p1", "p2", "conv_id").sortWithinPartitions("p1", "p2", "conv_id")
    parts = stored(dealt.mapInArrow(strings, "p1 bigint, p2 bigint, first bigint, ids string"), "end-ids")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            made: list[tuple[int, int, str]] = []
            for p1, p2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if (p1, p2) != node:
                    if state:
                        made.append((*node, state.hexdigest()))
                    node, state = (p1, p2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield rows_of(made)
        if state:
            yield rows_of([(*node, state.hexdigest())])

    def rows_of(made: list[tuple[int, int, str]]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kinds[k]) for k in range(3)], names=["p1", "p2", "ends_sha256"])

    dealt = parts.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "first")
    return dealt.mapInArrow(hashed, "p1 bigint, p2 bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations (conv_id, turn, role, text), see ``rebuilt_turns``: conv_id
    (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns; its members are the conversations that start with it, the root's all of
    them. ``n_leaves`` are the childless nodes of its subtree, itself included; ``saved_tokens`` sums (members - 1) times
    the code points of the last text over the subtree; ``ends_sha256`` is of the ids that end at the node. Turns are ordered
    by turn, null first; turns with equal numbers, and repeated rows, by the MD5 of role and text. A null role or text is
    empty. Rows without a conv_id belong to no conversation; other columns are ignored. Without conversations there is no
    node.
    """
    python_ready(conversations.sparkSession, 10_000)
    turns, empty = rebuilt_turns(turn_rows(conversations))
    prefixes = with_running_sums(turns, "depth", ["depth"], "prefixes")
    own = _own_hashes(prefixes)
    prefixes = stored(own, "prefix-hashes")
    nodes = trie_nodes(prefixes, block)
    ends = prefixes.where("ends").select("p1", "p2", "conv_id")
    ends = ends.unionByName(empty.select(F.lit(0).cast("bigint").alias("p1"), F.lit(0).cast("bigint").alias("p2"), "conv_id"))
    ends = stored(ends, "ends")

    children = nodes.groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    rows = nodes.join(children, ["p1", "p2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    rows = stored(rows, "node-children")
    leaf, saved = (F.col("n_children") == 0).cast("bigint"), (F.col("n") - 1) * F.col("chars")
    sums = stored(subtree_sums(rows.select("p1", "p2", "depth", "q1", "q2", leaf.alias("leaves"), saved.alias("saved"))), "sums")
    whole = rows.agg(F.sum(leaf).alias("n_leaves"), F.sum(saved).alias("saved_tokens"), F.count_if(F.col("depth") == 1).alias("n_children"))
    members = ends.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    members = stored(members, "root")  # one row, or none
    first = members.select(F.col("conv_id").alias("root_conv_id"))

    digests = stored(end_digests(ends), "end-digests")
    nothing = F.sha2(F.lit(""), 256)
    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("above"))
    rows = rows.join(sums, ["p1", "p2"]).join(digests, ["p1", "p2"], "left")
    top = rows.where("depth = 1").join(F.broadcast(first)).withColumnRenamed("root_conv_id", "above")
    rows = rows.where("depth > 1").join(parents, ["q1", "q2"]).unionByName(top)
    rows = rows.select(
        "conv_id", "depth", F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
    at_root = digests.where("p1 = 0 AND p2 = 0").agg(F.max("ends_sha256").alias("ends_sha256"))
    root = members.join(F.broadcast(whole)).join(F.broadcast(at_root))
    leaves = F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("n_leaves"))
    root = root.select(
        "conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs",
        "n_children", leaves.cast("bigint").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
    return rows.unionByName(root)


def _own_hashes(prefixes: DataFrame) -> DataFrame:
    """(conv_id, depth, chars, ends, p1, p2, q1, q2): q is p without the turn's own hash."""
    at = {c: k for k, c in enumerate(prefixes.columns)}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest = np.frombuffer(b"".join(batch.column(at["digest"]).to_pylist()), np.uint64).reshape(-1, 2)
            own = place_hashes(digest, _longs(batch.column(at["depth"])))
            before = [pa.array((_longs(batch.column(at[s])).view(np.uint64) - own[:, k]).view(np.int64)) for k, s in enumerate(("s1", "s2"))]
            kept = [batch.column(at[c]) for c in ("conv_id", "depth", "chars", "ends", "s1", "s2")]
            yield pa.RecordBatch.from_arrays([*kept, *before], names=["conv_id", "depth", "chars", "ends", "p1", "p2", "q1", "q2"])

    kinds = "conv_id bigint, depth bigint, chars bigint, ends boolean, p1 bigint, p2 bigint, q1 bigint, q2 bigint"
    return prefixes.mapInArrow(split, kinds)
