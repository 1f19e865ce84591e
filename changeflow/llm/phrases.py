"""Benchmark decontamination by a distributed positional inverted index. DataFrame functions only.

The index has two tables. ``forward`` holds each text's words, ``postings`` a row (term, row, pos) for each of them; a
part of ``postings`` covers the texts of one part of ``forward``, and equal terms stand together in it, so texts are not
shuffled to build it.

A phrase search aligns whole items instead of single windows. Position p of an item and position q of a text give the
offset-adjusted place q - p, which is the same for all windows of one occurrence.

1. The frequencies of the items' terms are counted in the postings. Windows with a term that no text has are left out.
2. Each window names its two rarest positions; windows that name the same two are one lookup. The adjusted lists of both
   terms are intersected. What remains are places (row, item, place), nearly all of them real.
3. The other terms are intersected at those places only, with ``forward``, and runs of a window's length or more are kept.

A term that a third of all texts have is looked up only where it is the rarest of a window. Items are joined by ordinary
joins, which Spark broadcasts when their measured size allows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.llm.common import stored

# what separates words, once A-Z are in lower case
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10


def words_of(text: Column) -> Column:
    """Array of the words of a text, A-Z in lower case; empty for a null text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    small = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, CAPITALS, SMALL))
    return F.array_remove(F.split(small, GAPS, -1), "")


@dataclass(frozen=True)
class PositionalIndex:
    """``forward`` (row, words, n_words and the columns of the texts but text), ``postings`` (term, row, pos)."""

    forward: DataFrame
    postings: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, *columns: str) -> PositionalIndex:
        """Index of ``docs`` (text and ``columns``). Rows are numbered once, in the written table, so repeated ids and
        repeated rows stay apart."""
        rows = docs.select(*[docs[c] for c in columns], words_of(docs["text"]).alias("words"))
        numbered = rows.select(F.monotonically_increasing_id().alias("row"), *columns, "words", F.size("words").cast("bigint").alias("n_words"))
        forward = stored(numbered, "forward")
        tokens = forward.select("row", F.posexplode("words").alias("pos", "term"))
        tokens = tokens.withColumn("key", F.xxhash64("term")).sortWithinPartitions("key").select("term", "row", "pos")
        return cls(forward, stored(tokens, "postings"))

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """(term, n) of the terms that a text has, from (term)."""
        return self.postings.join(terms.select("term").distinct(), "term").groupBy("term").agg(F.count("*").alias("n"))


def _items(items: DataFrame) -> DataFrame:
    """(item, name, words, n_items_words) of the rows that have words."""
    rows = items.select(items["item_id"].cast("string").alias("name"), words_of(items["text"]).alias("words"))
    rows = rows.where(F.size("words") > 0).select(F.monotonically_increasing_id().alias("item"), "name", "words", F.size("words").alias("length"))
    return stored(rows, "items")


def _with_frequencies(index: PositionalIndex, named: DataFrame) -> DataFrame:
    """``named`` with ``counts``: how often the texts have each of its words, 0 for never."""
    terms = named.select("item", F.posexplode("words").alias("at", "term"))
    counted = stored(index.frequencies(terms), "frequencies")
    counts = terms.join(counted, "term", "left").groupBy("item")
    counts = counts.agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n")))).alias("counts"))
    return named.join(counts, "item")


def _lookups(index: PositionalIndex, named: DataFrame, window: int) -> DataFrame:
    """(item, at1, term1, at2, term2): the rarest two positions of every window; at2 is null in windows of one word."""
    width = F.least(F.lit(window), F.col("length"))
    starts = F.sequence(F.lit(1), F.col("length") - width + 1)
    rows = _with_frequencies(index, named).withColumn("start", F.explode(starts))
    ranked = F.array_sort(F.transform(F.slice("counts", F.col("start"), width), lambda x: F.struct(x["n"].alias("n"), x["at"].alias("at"))))
    rows = rows.withColumn("ranked", ranked).where(F.col("ranked")[0]["n"] > 0)
    at1, at2 = F.col("ranked")[0]["at"], F.get(F.col("ranked"), F.lit(1))["at"]
    word = lambda at: F.get(F.col("words"), at)
    rows = rows.select("item", at1.alias("at1"), word(at1).alias("term1"), at2.alias("at2"), word(at2).alias("term2"))
    return stored(rows.distinct(), "lookups")


def _places(index: PositionalIndex, lookups: DataFrame) -> DataFrame:
    """(row, item, place) where both of a lookup's terms stand as in the item."""
    first = index.postings.join(lookups, F.col("term") == F.col("term1"))
    place = F.col("pos") - F.col("at1")
    first = first.select("row", "item", place.alias("place"), F.col("term2").alias("term"), (place + F.col("at2")).alias("pos"))
    seconds = lookups.where("term2 IS NOT NULL").select(F.col("term2").alias("term")).distinct()
    second = index.postings.join(seconds, "term", "left_semi")
    met = first.where("term IS NOT NULL").join(second, ["row", "term", "pos"], "left_semi").select("row", "item", "place")
    return met.union(first.where("term IS NULL").select("row", "item", "place")).distinct()


def phrase_matches(index: PositionalIndex, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, item, name, start, stop): the places in ``index`` where ``window`` or more successive words of an item stand,
    as long as they go; all words of an item that has fewer. ``items`` has item_id and text; items without words have no
    match. Places of one item may overlap."""
    named = _items(items)
    places = stored(_places(index, _lookups(index, named, window)), "places")
    item = named.select("item", "name", F.col("words").alias("wanted"), "length")
    rows = index.forward.select("row", "words", "n_words").join(places, "row").join(item, "item")
    here = lambda i: F.when(F.col("place") + i >= 0, F.get(F.col("words"), F.col("place") + i))
    other = F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda i: ~here(i).eqNullSafe(F.get(F.col("wanted"), i)))
    bounds = F.concat(F.array(F.lit(-1)), other, F.array(F.col("length")))
    rows = rows.select("row", "item", "name", "place", "length", bounds.alias("bounds"))
    between = F.transform(
        F.sequence(F.lit(0), F.size("bounds") - 2),
        lambda k: F.struct(
            (F.col("place") + F.get(F.col("bounds"), k) + 1).alias("start"), (F.col("place") + F.get(F.col("bounds"), k + 1)).alias("stop")
        ),
    )
    least = F.least(F.lit(window), F.col("length"))
    runs = rows.select("row", "item", "name", least.alias("least"), F.explode(between).alias("run"))
    return runs.where(F.col("run.stop") - F.col("run.start") >= F.col("least")).select("row", "item", "name", "run.start", "run.stop")


def proximity_matches(index: PositionalIndex, items: DataFrame, within: int) -> DataFrame:
    """(row, item, name, start): the texts' stretches of ``within`` words that hold all different words of an item, in any
    order, by the first word of each; of stretches around one place of the item's rarest word only the first. A stretch may
    begin before the text does, then start is below 0."""
    named = _items(items)
    ranked = _with_frequencies(index, named.withColumn("words", F.array_distinct("words")).withColumn("length", F.size("words")))
    order = F.array_sort(F.transform("counts", lambda x: F.struct(x["n"].alias("n"), x["at"].alias("at"))))
    ranked = ranked.withColumn("order", order).where((F.col("order")[0]["n"] > 0) & (F.col("length") <= within))
    ranked = stored(ranked.select("item", "name", "words", "length", F.get(F.col("words"), F.col("order")[0]["at"]).alias("rarest")), "rarest")
    anchors = index.postings.join(ranked.select("item", "length", F.col("rarest").alias("term")), "term")
    anchors = anchors.select("row", "item", "length", F.col("pos").alias("anchor"))
    block = F.floor(F.col("anchor") / within)
    near = anchors.withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
    terms = ranked.select("item", F.explode("words").alias("term"))
    met = index.postings.join(terms, "term").withColumn("block", F.floor(F.col("pos") / within))
    met = near.join(met, ["row", "item", "block"]).where(F.abs(F.col("pos") - F.col("anchor")) < within)
    around = met.groupBy("row", "item", "length", "anchor").agg(F.collect_list(F.struct("term", "pos")).alias("around"))
    held = lambda s: F.size(F.array_distinct(F.transform(F.filter("around", lambda x: (x["pos"] >= s) & (x["pos"] < s + within)), lambda x: x["term"])))
    found = F.filter(F.sequence(F.col("anchor") - (within - 1), F.col("anchor")), lambda s: held(s) == F.col("length"))
    rows = around.select("row", "item", F.array_min(found).alias("start")).where("start IS NOT NULL").distinct()
    return rows.join(ranked.select("item", "name"), "item").select("row", "item", "name", "start")


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Row per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    ``items`` has item_id and text. A window is ``window`` successive words of an item, all its words if it has fewer; a
    word of a text inside any occurrence of one is hit. ``n_items`` are the different item_ids with such windows,
    ``items_sha256`` the SHA-256 of them, sorted as strings and joined by commas. A null or empty text has no words; an
    item without words has no window; rows that repeat a doc_id are separate rows; rows of ``items`` that repeat an id
    count as one item, and a null id is counted but adds nothing to the list. Other columns of both are ignored; a table
    without rows gives none, and without items nothing is hit.
    """
    index = PositionalIndex.build(docs, "doc_id")
    runs = phrase_matches(index, items, window).groupBy("row")
    names = F.array_distinct(F.collect_set(F.struct("name")))
    hits = runs.agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("runs"), names.alias("names"))
    none = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    total = F.aggregate(
        "runs",
        none,
        lambda s, x: F.struct(
            F.greatest(s["end"], x["stop"].cast("bigint")).alias("end"),
            (s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(s["end"], x["start"].cast("bigint")))).cast("bigint").alias("n"),
        ),
        lambda s: s["n"],
    )
    listed = F.array_sort(F.array_compact(F.transform("names", lambda x: x["name"])))
    hits = hits.select("row", total.alias("n_hit"), F.size("names").cast("bigint").alias("n_items"), F.array_join(listed, ",").alias("ids"))
    rows = index.forward.select("row", "doc_id", "n_words").join(hits, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
