"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct words of a text and their prefixes, hashed. The machine has a weight
per term and, through a vector per term, one per pair of terms, so that two terms together
can say what neither says alone.

Training reads a bounded sample: at most ``sample`` labelled texts of each class, the first
in the order of a hash of their id, one row of each id. All terms are kept whose chi-square
would be reached by chance once in 10,000. Scoring covers every word of every text.

Defined cases: null and empty texts get the score of a text without known terms; without
labels of both classes every score is the share of toxic labels (0 without labels); a null
doc_id counts as held out; repeated rows get equal scores; an empty table gives no rows.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.llm.common import stored, unused
from stackloom.llm.wordhash import U64, Words, chunks, split
from stackloom.session import ship

SAMPLE, FACTORS, ROUNDS, DECAY, CHI_SQUARE = 2000, 8, 400, (1e-4, 1e-2), 15.14
THRESHOLD, FOLDS, HELD_OUT = 0.7, 3, 1
#: Byte lengths of the prefixes that are terms beside the whole word.
PREFIXES = (4, 5, 6, 7, 8)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: What separates terms: ASCII other than letters and digits.
BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term hash), not yet distinct, for all words and prefixes."""
    words = split(LOWER[data], offsets, BREAK)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    rows, hashes = [row], [words.hashes()]
    size = words.end - words.start
    for n in PREFIXES:
        longer = np.flatnonzero(size > n)
        head = Words(words.data, words.start[longer], words.start[longer] + n, words.first)
        rows.append(row[longer])
        hashes.append(head.hashes() ^ U64(n))
    return np.concatenate(rows), np.concatenate(hashes)


@dataclass
class Machine:
    """``score = sigmoid(bias + sum w + sum over pairs of v . v)`` over a text's known terms."""

    hashes: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def __post_init__(self):
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[(self.hashes & U64(0xFFFF)).astype(np.int64)] = True

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        row, term = terms(data, offsets)
        near = self.seen[(term & U64(0xFFFF)).astype(np.int64)]
        row, term = row[near], term[near]
        at = np.minimum(np.searchsorted(self.hashes, term), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == term if len(self.hashes) else np.zeros(len(term), bool)
        pair = np.unique(row[known] * (len(self.hashes) + 1) + at[known])
        row, at = np.divmod(pair, len(self.hashes) + 1)
        out = self.bias + np.bincount(row, self.w[at], minlength=n)
        for f in range(self.v.shape[1]):
            x = self.v[at, f]
            out = out + 0.5 * (np.bincount(row, x, minlength=n) ** 2 - np.bincount(row, x * x, minlength=n))
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def constant(positive: int, total: int) -> Machine:
    """The share of toxic labels, for every text."""
    share = positive / total if total else 0.0
    return Machine(np.zeros(0, np.uint64), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), np.zeros(0), np.zeros((0, FACTORS)))


def fit(hashes: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, rounds: int = ROUNDS, decay: tuple[float, float] = DECAY) -> Machine:
    """A machine over the sorted term ``hashes`` from each text's places in them and its label; both classes weigh the same."""
    n1 = int(labels.sum())
    n0 = len(labels) - n1
    ends = np.cumsum([len(r) for r in rows])
    starts = np.concatenate(([0], ends[:-1]))
    term = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    row, n = np.repeat(np.arange(len(rows)), ends - starts), len(hashes)

    def summed(x: np.ndarray) -> np.ndarray:
        """Sums over each text's terms."""
        c = np.concatenate((np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)))
        return c[ends] - c[starts]

    y, weight = labels.astype(float), np.where(labels > 0, 0.5 / n1, 0.5 / n0)
    rng = np.random.default_rng(7)
    values = [np.zeros(1), np.zeros(n), rng.normal(0, 0.01, (n, factors))]
    first, second = [np.zeros_like(p) for p in values], [np.zeros_like(p) for p in values]
    for t in range(1, rounds + 1):
        bias, w, v = values
        seen = v[term]
        s = summed(seen)
        z = bias + summed(w[term]) + 0.5 * ((s * s).sum(1) - summed((seen * seen).sum(1)))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        back = np.bincount(term, g[row], minlength=n)
        pairs = np.stack([np.bincount(term, (g * s[:, f])[row], minlength=n) for f in range(factors)], axis=1)
        grads = [np.array([g.sum()]), back + decay[0] * w, pairs - v * back[:, None] + decay[1] * v]
        for i, grad in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad * grad
            values[i] = values[i] - 0.05 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    bias, w, v = values
    return Machine(hashes, float(bias[0]), w, v)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def chi_square(d1: Column, d0: Column, n1: int, n0: int) -> Column:
    """Of a term that ``d1`` of ``n1`` toxic and ``d0`` of ``n0`` other texts have."""
    d1, d0 = d1.cast("double"), d0.cast("double")
    return F.pow(d1 * (n0 - d0) - d0 * (n1 - d1), 2.0) * (n1 + n0) / F.greatest(F.lit(1.0), (d1 + d0) * (n1 - d1 + n0 - d0) * n1 * n0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> Machine:
    """A machine from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, learning only from rows outside the held-out fold.

    The terms are counted and chosen in Spark; the driver gets the chosen ones alone.
    """
    ship(docs.sparkSession)
    known = labels.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    order = [F.xxhash64(F.lit(3), "doc_id"), "doc_id"]
    chosen = known.where("toxic = 1").orderBy(*order).limit(sample).union(known.where("toxic = 0").orderBy(*order).limit(sample))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * sample ids
    texts = texts.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text")  # one row of each

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1)):
                row, term = terms(data, offsets)
                by = np.lexsort((term, row))
                row, term = row[by], term[by]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
                row, term = row[new], term[new]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(j - i + 1)), pa.int32()), pa.array(term.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], names=["toxic", "terms"])

    found = stored(texts.mapInArrow(distinct, "toxic int, terms array<long>"), "toxicity-sample")
    size = {r.toxic: r["count"] for r in found.groupBy("toxic").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return constant(n1, n1 + n0)
    counts = found.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("d1"), F.count("*").alias("d"))
    ranked = counts.select("term", chi_square(F.col("d1"), F.col("d") - F.col("d1"), n1, n0).alias("chi")).where(F.col("chi") >= CHI_SQUARE)
    best = ranked.select("term").toArrow().column("term").to_numpy().view(np.uint64)
    hashes = np.sort(best)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for terms_ in batch.column(1):
                at = np.searchsorted(hashes, own := terms_.values.to_numpy().view(np.uint64))
                rows.append(at[hashes[np.minimum(at, len(hashes) - 1)] == own] if len(hashes) else at[:0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tolist() for r in rows], pa.list_(pa.int32()))], names=["toxic", "places"])

    seen = found.mapInArrow(places, "toxic int, places array<int>").toArrow()
    return fit(hashes, [np.array(x, np.int64) for x in seen.column("places").to_pylist()], seen.column("toxic").to_numpy().astype(np.int64), **options)


def score(docs: DataFrame, machine: Machine, column: str = "score") -> DataFrame:
    """``docs`` plus the score of its ``text``."""
    ship(docs.sparkSession)
    at, names = docs.columns.index("text"), docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [machine.score(data, offsets) for _, _, data, offsets in chunks(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*names, column])

    return docs.mapInArrow(run, f"{kinds}, `{column}` double")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``."""
    column = unused(docs, "toxicity")
    return score(docs, train(docs, labels), column).where(F.col(column) < threshold).drop(column)
