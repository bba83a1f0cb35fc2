"""Quality rules: plain limits, then robust multivariate outliers.

Each document becomes a vector of transformed statistics. Per language and source a minimum-covariance-determinant estimate is found by
concentration steps: distances under the present mean and covariance, then mean and covariance of the nearest three quarters.
Rows far from the result by Mahalanobis distance are rejected. A step is one aggregation: rows are summed by pool and distance bin, with
map-side combining, so a source with a third of all rows costs no more than any other; the nearest share is then
taken in whole bins from these sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlead.session import settle

#: Transformed statistics: characters a word, symbols, repeated lines, repeated words, capitals, other marks.
DIMENSIONS = ("v_length", "v_symbols", "v_lines", "v_repeats", "v_capitals", "v_marks")
#: Standard deviations below which a statistic counts as constant: the least by which it must differ to matter.
FLOORS = (0.04, 0.06, 0.12, 0.06, 0.06, 0.08)
#: Share of a pool's rows the estimate is made of.
SHARE = 0.75
STEPS = 6
#: Bins of the distance, per factor of two, and their range.
PER_OCTAVE, LOWEST, HIGHEST = 8, -80, 400
#: Fixed value: median of the chi-squared distribution with six degrees of freedom.
CHI2_MEDIAN = 5.348120627447123
#: Squared distance of an outlier, after scaling to that median.
CUTOFF = 80.0
#: A source with fewer rows in a language shares a pool with the language's other small ones.
LEAST_ROWS = 200

# Kinds of bytes: 0 other letters and digits, 1 white space, 2 continuation, 3 capital, 4 symbol, 5 other mark.
KIND = np.zeros(256, dtype=np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 1
KIND[0x80:0xC0] = 2
KIND[65:91] = 3
KIND[list(b"!\"'()+,-./:;=?@[\\]^_`{}~")] = 5
KIND[list(b"#*$%&|<>")] = 4


def statistics(text: str | None) -> tuple[int, int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, capitals, other marks, lines with a word."""
    if not text:
        return (0,) * 8
    body = text.encode(errors="replace")
    kinds = np.bincount(KIND[np.frombuffer(body, dtype=np.uint8)], minlength=6)
    words = body.split()
    lines = [line for line in body.split(b"\n") if line and not line.isspace()]
    repeats = 0
    if len(words) > 5:
        grams = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(grams)) < len(grams):
            found = Counter(grams)
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            at = np.array([i for i, g in enumerate(grams) if found[g] > 1])
            np.add.at(edge, at, 1)
            np.add.at(edge, at + 5, -1)
            repeats = int((np.cumsum(edge) > 0).sum())
    return (len(words), int(len(body) - kinds[1] - kinds[2]), int(kinds[4]), len(lines) - len(set(lines)), repeats,
            int(kinds[3]), int(kinds[5]), len(lines))


def failed(n_words, n_repeats):
    """The plain limits."""
    return (n_words < 10) | (100 * n_repeats > 20 * n_words)


def vectors(s: np.ndarray) -> np.ndarray:
    """Transformed statistics of rows of ``statistics``. Ratios lean on a few expected words, so short texts vary no more than long ones."""
    words, chars, symbols, dup, repeats, capitals, marks, lines = s.astype(float).T
    return np.column_stack([
        np.log((chars + 100) / (words + 20)), np.sqrt(symbols / (words + 20)), np.sqrt(dup / (lines + 5)),
        np.sqrt(repeats / (words + 20)), np.sqrt(capitals / (chars + 100)), np.sqrt(marks / (words + 20))])


STATS = ("id bigint, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
         "n_repeat_words bigint, base_failed boolean, " + ", ".join(f"{d} double" for d in DIMENSIONS))


def document_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Statistics of each row, STATS. Null texts have no words; null languages and sources become empty."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                s = np.array([statistics(t) for t in part.column(3).to_pylist()], dtype=np.int64).reshape(-1, 8)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], *(pa.array(s[:, i]) for i in range(5)), pa.array(failed(s[:, 0], s[:, 4])),
                     *(pa.array(v) for v in vectors(s).T)], [f.split()[0] for f in STATS.split(", ")])

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(F.col(key).cast("bigint").alias("id"), blank("lang"), blank("source"), F.col(text).alias("text")).mapInArrow(rows, STATS)


def pools(stats: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """(lang, source, pool): the pool whose estimate judges a source's rows.

    A source with ``least`` passing rows in a language is a pool of its own; smaller ones share the language's pool, and languages whose
    shared pool is still smaller share one pool. Every row is in exactly one.
    """
    n = settle(stats.where("not base_failed").groupBy("lang", "source").count(), "pool-counts")
    small = n.where(F.col("count") < least).groupBy("lang").agg(F.sum("count").alias("shared"))
    name = F.when(F.col("count") >= least, F.to_json(F.struct("lang", "source"))).when(
        F.col("shared") >= least, F.to_json(F.struct("lang"))).otherwise("{}")
    return settle(n.join(small, "lang", "left").select("lang", "source", name.alias("pool")), "pools")


N = len(DIMENSIONS)
PAIRS = [(i, j) for i in range(N) for j in range(i, N)]
MEANS = [f"m{i}" for i in range(N)]
PRECISIONS = [f"p{i}_{j}" for i, j in PAIRS]
PARAMETERS = "pool string, " + ", ".join(f"{c} double" for c in [*MEANS, *PRECISIONS])


def _distance() -> str:
    """SQL for the squared Mahalanobis distance."""
    c = [f"({d} - m{i})" for i, d in enumerate(DIMENSIONS)]
    return " + ".join(f"{1 if i == j else 2} * {c[i]} * {c[j]} * p{i}_{j}" for i, j in PAIRS)


def _bin(distance):
    return F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.floor(F.log2(distance + 1e-12) * PER_OCTAVE))).cast("int")


def _parameters(means: np.ndarray, precisions: np.ndarray, pool: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pool, *(pa.array(means[:, i]) for i in range(N)), *(pa.array(precisions[:, i, j]) for i, j in PAIRS)],
        ["pool", *MEANS, *PRECISIONS])


def start(rows: DataFrame) -> DataFrame:
    """First parameters of each pool: medians, and quartile distances as the only spread."""
    q = rows.groupBy("pool").agg(*[F.percentile_approx(d, [0.25, 0.5, 0.75], 2000).alias(d) for d in DIMENSIONS])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array([c.to_pylist() for c in batch.columns[1:]], dtype=float).reshape(N, -1, 3)
            spread = np.maximum((v[:, :, 2] - v[:, :, 0]) / 1.349, np.array(FLOORS)[:, None])
            yield _parameters(v[:, :, 1].T, np.stack([np.diag(1 / s**2) for s in spread.T]) if v.shape[1] else np.empty((0, N, N)), batch.column(0))

    return q.mapInArrow(solve, PARAMETERS)


def binned(rows: DataFrame, parameters: DataFrame, sums: bool = True) -> DataFrame:
    """Rows, and sums of the vectors and their products, by pool and distance bin."""
    near = rows.join(parameters, "pool").withColumn("bin", _bin(F.expr(_distance())))
    products = [F.sum(F.col(DIMENSIONS[i]) * F.col(DIMENSIONS[j])).alias(f"s{i}_{j}") for i, j in PAIRS] if sums else []
    firsts = [F.sum(d).alias(f"s{i}") for i, d in enumerate(DIMENSIONS)] if sums else []
    return near.groupBy("pool", "bin").agg(F.count(F.lit(1)).alias("n"), *firsts, *products)


def _inner(bins: DataFrame, share: float) -> DataFrame:
    """The bins, nearest first, that together first hold the share of their pool. A pool has at most HIGHEST - LOWEST + 1 bins."""
    upto = Window.partitionBy("pool").orderBy("bin")
    return bins.withColumn("all_n", F.sum("n").over(Window.partitionBy("pool"))).withColumn(
        "inside", F.sum("n").over(upto) - F.col("n")).where(F.col("inside") < share * F.col("all_n"))


def concentrate(rows: DataFrame, parameters: DataFrame, share: float = SHARE) -> DataFrame:
    """One concentration step: parameters of the nearest share of each pool."""
    names = ["n", *(f"s{i}" for i in range(N)), *(f"s{i}_{j}" for i, j in PAIRS)]
    total = _inner(binned(rows, parameters), share).groupBy("pool").agg(*[F.sum(c).alias(c) for c in names])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], dtype=float)
            mean = (v[1:1 + N] / v[0]).T
            cov = np.zeros((mean.shape[0], N, N))
            for (i, j), s in zip(PAIRS, v[1 + N:] / v[0]):
                cov[:, i, j] = cov[:, j, i] = s - mean[:, i] * mean[:, j]
            yield _parameters(mean, np.linalg.inv(cov + np.diag(np.square(FLOORS))), batch.column(0))

    return total.mapInArrow(solve, PARAMETERS)


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Parameters of each pool after ``steps`` concentration steps, with ``scale``: the median distance over its expectation.

    Each step is written, so a lost executor costs one step. Runs jobs while it is called.
    """
    now = settle(start(rows), "mcd-start")
    for _ in range(steps):
        now = settle(concentrate(rows, now), "mcd-step")
    middle = _inner(binned(rows, now, sums=False), 0.5).groupBy("pool").agg(F.max("bin").alias("bin"))
    # A spread below the floors makes small distances; it never widens the limit for others.
    scale = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("bin") + 1) / PER_OCTAVE) / CHI2_MEDIAN)
    return settle(now.join(middle, "pool").select("pool", *MEANS, *PRECISIONS, scale.alias("scale")), "mcd")


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", cutoff: float = CUTOFF, least: int = LEAST_ROWS) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept) of each row.

    Rows that fail the plain limits are not kept, have no distance and take no part in the estimates. Empty and null texts fail
    them. Repeated rows are judged alike. An empty table gives no rows. Runs jobs while it is called.
    """
    stats = settle(document_statistics(docs, text, key), "quality-statistics")
    pooled = stats.join(pools(stats, least), ["lang", "source"], "left")
    passing = pooled.where("not base_failed").select("pool", *DIMENSIONS)
    judged = pooled.join(estimates(passing), "pool", "left").withColumn(
        "distance", F.when(~F.col("base_failed"), F.expr(_distance()) / F.col("scale")))
    return judged.select(
        F.col("id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"))
