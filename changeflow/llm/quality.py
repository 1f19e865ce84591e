"""Robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

Statistics of a text are transformed to a vector, see ``vector``. Within each group, the estimate is the mean and the
covariance of the ``SHARE`` of rows that lie closest to it: starting from medians and quartile ranges, concentration
steps take the closest rows of the last estimate and estimate anew, which never raises the covariance's determinant.
The closest rows are found from counts per bin of the logarithm of the distance (16 bins per doubling), with the sums
and products of the vectors beside the counts; so a step is one partial aggregation over all rows, a group with a third
of all rows costs some hundred rows a task, and rows at equal distances are taken together. One reweighting step
follows. A row is rejected if its squared Mahalanobis distance exceeds ``LIMIT``, the chi-square quantile that one normal row
in 10,000 exceeds. Where a group has no spread in a dimension, that is 5.28 times its ``FLOOR``: each statistic can reject alone.

A (language, source) with fewer than ``LEAST_ROWS`` rows is pooled with the others of its language, a pool that is still
smaller with all such pools; the rows of a last pool that is too small are not judged and stay.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.llm.common import python_ready, stored, text_of

SHARE = 0.75
STEPS = 6
LEAST_ROWS = 100
BINS = 16
BIN_RANGE = 320
DIMENSIONS = 6
# least standard deviation of each dimension: a statistic that is constant in clean text must not make any other value infinitely far
FLOOR = (0.03, 0.02, 0.06, 0.08, 0.03, 0.03)
LIMIT = 27.856  # 99.99 % of the chi-square distribution with 6 degrees of freedom
REWEIGHT = 14.449  # 97.5 % of the chi-square distribution with 6 degrees of freedom

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
MARKS = b"!\"'()+,-./:;=?@[\\]^_`{}~"
BLANK = b" \t\n\x0b\x0c\r"
CONTINUED = bytes(range(0x80, 0xC0))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines")
STATISTICS = "struct<" + ", ".join(f"{name}: bigint" for name in COUNTS) + ">"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) >= n - 1:
        return 0
    pair = ids[:-1] * len(known) + ids[1:]
    if len(known) >= 2_000_000:  # else the three ids fit 63 bits
        _, pair = np.unique(pair, return_inverse=True)
    window = pair[:-1] * len(known) + ids[2:]
    _, at, times = np.unique(window, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[at] > 1)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def counts_of(text: bytes) -> tuple[int, ...]:
    """The values named in ``COUNTS``; a word is a run of characters other than ASCII white space."""
    words = text.split()
    core = text.translate(None, BLANK)
    less = lambda chars: len(core) - len(core.translate(None, chars))
    seen: set[bytes] = set()
    dup = lines = 0
    for line in text.split(b"\n"):
        if line.strip(BLANK):
            lines += 1
            dup += line in seen
            seen.add(line)
    return len(words), len(core) - less(CONTINUED), less(SYMBOLS), dup, repeated_words(words), less(UPPER), less(MARKS), lines


def statistics(text: Column) -> Column:
    """Struct of ``COUNTS`` of a text; null and empty texts have zeros."""

    @F.arrow_udf(STATISTICS)
    def count(column: pa.Array) -> pa.Array:
        rows = np.array([counts_of(t) for t in text_of(column)], np.int64).reshape(-1, len(COUNTS))
        return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(COUNTS))], names=list(COUNTS))

    return count(text.cast("string"))


def vector(s: str = "stat") -> Column:
    """Word length (log), and shares of symbols, repeated words, repeated lines, capitals and punctuation (arcsine of the root)."""
    share = lambda a, b: F.asin(F.sqrt(F.least(F.col(f"{s}.{a}") / F.greatest(F.col(f"{s}.{b}"), F.lit(1)), F.lit(1.0))))
    return F.array(
        F.log(F.greatest(F.col(f"{s}.word_chars"), F.lit(1)) / F.greatest(F.col(f"{s}.n_words"), F.lit(1))),
        share("n_symbols", "word_chars"), share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines"),
        share("n_upper", "word_chars"), share("n_marks", "word_chars"),
    )


def _estimate(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Mean and inverse covariance of a group from its sums per distance bin; the rows of the nearest bins that hold
    ``share`` of the group, or those up to bin ``upto``."""
    share, upto = key[1], key[2]
    pdf = pdf.sort_values("bin")
    n = pdf["n"].to_numpy(float)
    before = np.cumsum(n) - n
    used = before < share * n.sum() if upto is None or pd.isna(upto) else pdf["bin"].to_numpy() <= upto
    if not used.any():
        used[0] = True
    p, total = DIMENSIONS, n[used].sum()
    sums = pdf[[f"s{i}" for i in range(p)]].to_numpy()[used].sum(axis=0)
    mean = sums / total
    products = pdf[[f"p{i}_{j}" for i in range(p) for j in range(i, p)]].to_numpy()[used].sum(axis=0)
    cov = np.zeros((p, p))
    cov[np.triu_indices(p)] = products / total
    cov = np.triu(cov) + np.triu(cov, 1).T - np.outer(mean, mean)
    cov = cov * _correction(total / n.sum()) + np.diag(np.square(FLOOR))
    return pd.DataFrame({"pool": [key[0]], "mean": [mean.tolist()], "inverse": [np.linalg.inv(cov).ravel().tolist()]})


def _correction(share: float) -> float:
    """Factor that makes the covariance of the nearest ``share`` of normal rows that of all rows."""
    if share >= 0.999:
        return 1.0
    tail = lambda x, terms: np.exp(-x / 2) * sum((x / 2) ** k / float(np.prod(range(1, k + 1))) for k in range(terms))
    low, high = 0.0, 100.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - tail(middle, DIMENSIONS // 2) < share else (low, middle)
    return share / max(1 - tail(low, DIMENSIONS // 2 + 1), 1e-9)


def _squared_distance() -> Column:
    """Of x from ``mean`` under ``inverse``, all arrays."""
    off = [F.col("x")[i] - F.col("mean")[i] for i in range(DIMENSIONS)]
    terms = [off[i] * off[j] * F.col("inverse")[i * DIMENSIONS + j] for i in range(DIMENSIONS) for j in range(DIMENSIONS)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.greatest(total, F.lit(0.0))


def _bin_of(distance: Column) -> Column:
    return F.greatest(F.lit(-BIN_RANGE), F.least(F.lit(BIN_RANGE), F.ceil(BINS * F.log2(F.greatest(distance, F.lit(1e-9)))))).cast("int")


def _step(rows: DataFrame, label: str, share: float, upto: int | None = None) -> DataFrame:
    """Estimates from rows (pool, x, d2)."""
    p, x = DIMENSIONS, F.col("x")
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(p)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(p) for j in range(i, p)]
    bins = rows.groupBy("pool", _bin_of(F.col("d2")).alias("bin")).agg(F.count("*").alias("n"), *sums, *products)
    bins = bins.withColumns({"share": F.lit(share), "upto": F.lit(upto).cast("int")})
    schema = "pool string, mean array<double>, inverse array<double>"
    return stored(bins.groupBy("pool", "share", "upto").applyInPandas(_estimate, schema), label)


def group_key(lang: Column, source: Column | None = None) -> Column:
    """Name of a group; nulls are a value of their own."""
    name = lambda c: F.coalesce(F.concat(F.char_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return name(lang) if source is None else F.concat(name(lang), F.lit("/"), name(source))


def pools(rows: DataFrame) -> DataFrame:
    """(own, lang_key) of rows to vote -> (own, pool): the group, its language's pool or the last one."""
    sizes = rows.groupBy("own", "lang_key").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") < LEAST_ROWS)
    of_lang = small.groupBy("lang_key").agg(F.sum("n").alias("n_lang"))
    named = sizes.join(of_lang, "lang_key", "left")
    pool = F.when(F.col("n") >= LEAST_ROWS, F.concat(F.lit("group "), F.col("own")))
    pool = pool.when(F.col("n_lang") >= LEAST_ROWS, F.concat(F.lit("language "), F.col("lang_key"))).otherwise("rest")
    return stored(named.select("own", pool.alias("pool")), "pools")


def estimates(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows (stat, own, lang_key, base_failed): (own, pool) and (pool, mean, inverse); rows that fail the base rules take no part."""
    clean = stats.where("not base_failed").select("own", "lang_key", vector().alias("x"))
    named = pools(clean)
    rows = stored(clean.join(named, "own").select("pool", "x"), "vectors")
    quartiles = [F.percentile_approx(F.col("x")[i], [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(DIMENSIONS)]
    spread = lambda i: F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOOR[i]))
    inverse = [1 / (spread(i) * spread(i)) if i == j else F.lit(0.0) for i in range(DIMENSIONS) for j in range(DIMENSIONS)]
    start = rows.groupBy("pool").agg(F.count("*").alias("n"), *quartiles).where((F.col("pool") != "rest") | (F.col("n") >= LEAST_ROWS))
    found = stored(start.select("pool", F.array(*[F.col(f"q{i}")[1] for i in range(DIMENSIONS)]).alias("mean"), F.array(*inverse).alias("inverse")), "start")
    for step in range(STEPS + 1):
        at = rows.join(found, "pool").select("pool", "x", _squared_distance().alias("d2"))
        last = step == STEPS
        found = _step(at, f"estimate{step}", SHARE, int(np.floor(BINS * np.log2(REWEIGHT))) if last else None)
    return named, found


def with_statistics(docs: DataFrame, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """(row, stat, own, lang_key, base_failed): the columns of ``docs`` in one struct, beside what the rules need."""
    python_ready(docs.sparkSession, batch_bytes="2m")
    own = group_key(F.col("row.lang"), F.col("row.source"))
    base = (F.col("stat.n_words") < least_words) | (100 * F.col("stat.n_repeat_words") > most_repeated * F.col("stat.n_words"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = rows.withColumn("stat", statistics(F.col("row.text")))
    return rows.select("row", "stat", own.alias("own"), group_key(F.col("row.lang")).alias("lang_key"), base.alias("base_failed"))


def judged(stats: DataFrame, named: DataFrame, found: DataFrame) -> DataFrame:
    """``stats`` with distance (null where no estimate applies) and kept. The groups' estimates are written, so that Spark
    knows their size and moves texts only if there are too many groups to broadcast."""
    own = stored(named.join(found, "pool").select("own", "mean", "inverse"), "group-estimates")
    rows = stats.withColumn("x", vector()).join(own, "own", "left").withColumn("distance", _squared_distance())
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= LIMIT)
    return rows.withColumn("kept", kept).drop("x", "mean", "inverse")


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, lang, source): doc_id, the counts, base_failed, kept, distance.

    A null or empty text has no words and fails the base rules. Null languages and sources are groups of their own.
    """
    stats = with_statistics(docs)
    stats = stored(stats.select(F.col("row.doc_id").alias("doc_id"), "stat", "own", "lang_key", "base_failed"), "statistics")
    named, found = estimates(stats)
    return judged(stats, named, found).select("doc_id", "stat.*", "base_failed", "kept", "distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns. The statistics are counted once for the estimates and
    once for the verdicts, which costs less than moving all texts by key."""
    columns = docs.columns
    stats = with_statistics(docs)
    narrow = stored(stats.select("stat", "own", "lang_key", "base_failed"), "statistics")
    named, found = estimates(narrow)
    return judged(stats, named, found).where("kept").select(*[F.col("row").getField(c).alias(c) for c in columns])
