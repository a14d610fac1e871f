"""Quality rules: a linear-chain conditional random field marks each line content or boilerplate.

The lines of a text (``\\n``-split, with a word) are a chain with two labels. Viterbi decoding
gives the likeliest labels; a text is kept if its content lines hold at least ``share`` of its
words, and if the base rules do not fail it.

Training reads a bounded sample: at most ``sample`` labelled texts of each class, one row of each
id, with whole chains. All lines of
a good text are content. A bad text's lines start as boilerplate; after a first fit, those
that the field takes for content become content, unless none would be left.

Defined cases: null and empty texts have no words and fail the base rules; without labels of
both classes every line is content; a null doc_id is kept; repeated rows get equal results; an
empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm.wordhash import U64, WindowHash, Words, chunks, mix, split
from stackloom.session import ship

SAMPLE, SHARE, ROUNDS = 1500, 0.5, 120
#: Lines of a chain that are walked step by step while blocks of lines go side by side.
BLOCK = 32
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"
IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
#: Upper edges of the buckets of each line property; the last bucket is open.
EDGES = {
    "words": (2, 5, 10, 20, 60),
    "symbols": (0.0, 0.02, 0.06, 0.12),
    "bars": (0, 2, 5),
    "digits": (0.0, 0.05, 0.2),
    "same_as_before": (0.0, 0.1, 0.3, 0.6),
    "distinct": (0.3, 0.5, 0.7, 0.9),
    "word_length": (3.0, 4.5, 6.0, 9.0),
    "is_repeat": (0,),
    "ends_sentence": (0,),
    "marks": (0.0, 0.1, 0.4),
}
OFFSETS = np.concatenate(([0], np.cumsum([len(e) + 1 for e in EDGES.values()])))


@dataclass
class Lines:
    """The lines with a word of a run of texts: features (one column per property), words, and whether an earlier line of the text is equal.

    ``first[i]:first[i + 1]`` are the lines of text ``i``.
    """

    features: np.ndarray
    words: np.ndarray
    repeats: np.ndarray
    first: np.ndarray


def lines_of(data: np.ndarray, offsets: np.ndarray, words: Words, hashes: np.ndarray) -> Lines:
    breaks = np.flatnonzero(data == 0x0A)
    bounds = np.unique(np.concatenate((breaks + 1, offsets)))  # a line ends before its break, or where its text does
    which = np.searchsorted(bounds, words.start, side="right") - 1
    new = np.ones(len(which), bool)
    new[1:] = which[1:] != which[:-1]
    head = np.flatnonzero(new)
    line, n = np.cumsum(new) - 1, np.diff(np.append(head, len(which)))
    start = bounds[which[head]]
    end = bounds[np.minimum(which[head] + 1, len(bounds) - 1)]
    end = end - ((end > start) & (data[end - 1] == 0x0A))
    first = np.searchsorted(head, words.first)

    def share(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return sums[end] - sums[start]

    def summed(per_word: np.ndarray) -> np.ndarray:
        return np.add.reduceat(per_word.astype(np.int64), head) if len(head) else np.zeros(0, np.int64)

    last = data[words.end - 1]
    again = np.zeros(len(which), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & ~new[1:]
    distinct = np.unique(mix(hashes ^ mix(line.astype(np.uint64) + U64(1))), return_index=True)[1]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    whole = Words(data, start, end, first).hashes() ^ mix(row.astype(np.uint64) + U64(1))
    repeats = np.ones(len(head), bool)
    repeats[np.unique(whole, return_index=True)[1]] = False
    size = np.maximum(end - start, 1)
    values = (
        n,
        share(IS_SYMBOL[data]) / size,
        share(data == 0x7C),
        share((data >= 0x30) & (data <= 0x39)) / size,
        summed(again) / n,
        np.bincount(line[distinct], minlength=len(head)) / n,
        summed(words.end - words.start) / n,
        repeats,
        np.isin(last[head + n - 1], list(b".!?")),
        summed(IS_SYMBOL[last]) / n,
    )
    # Of each property the first bucket whose upper edge is not passed.
    features = np.stack([o + np.searchsorted(edges, v, side="left") for o, edges, v in zip(OFFSETS, EDGES.values(), values)], axis=1)
    return Lines(features.astype(np.int16), n, repeats, first)


@dataclass
class Field:
    """Weights for content against boilerplate: per feature, and for staying in content or in boilerplate."""

    weights: np.ndarray
    stay: np.ndarray

    def content(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The Viterbi labels of chains ``features[first[i]:first[i + 1]]``, all decoded side by side."""
        score, size = self.weights[features].sum(1), np.diff(first)
        order = np.argsort(-size, kind="stable")
        begin, size = first[:-1][order], size[order]
        stay_b, stay_c = self.stay.tolist()
        from_c, from_b, label = (np.zeros(len(score), bool) for _ in range(3))
        best_c, best_b = np.zeros(len(size)), np.zeros(len(size))
        alive = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
        for t, k in enumerate(alive.tolist()):
            at = begin[:k] + t
            c, b = best_c[:k], best_b[:k]
            if t:
                from_c[at], from_b[at] = c + stay_c >= b, c > b + stay_b
                c, b = np.maximum(c + stay_c, b), np.maximum(c, b + stay_b)
            best_c[:k], best_b[:k] = c + score[at], b
        now = best_c >= best_b
        for t in range(len(alive) - 1, -1, -1):
            at = begin[: alive[t]] + t
            label[at] = now[: alive[t]]
            now[: alive[t]] = np.where(label[at], from_c[at], from_b[at])
        return label


def marginals(e: np.ndarray, stay: np.ndarray, size: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chance of content per line, chances that a line and the one before are both boilerplate or both content).

    ``e[block, line]`` are scores of content; ``size`` tells the lines of each block, ``chain`` the
    chain it belongs to, whose blocks follow each other. Blocks are first walked side by side
    as matrices, then each chain carries its sums from block to block, so no chain is cut.
    """
    n, width = e.shape
    scores = np.stack([np.zeros_like(e), e], axis=2)
    step = np.array([[stay[0], 0.0], [0.0, stay[1]]])
    first = np.concatenate(([True], chain[1:] != chain[:-1]))
    entry = np.where(first[:, None, None], -np.log(2.0), step)  # a chain's first line has no line before
    whole = entry + scores[:, 0, None, :]
    for t in range(1, width):
        k = size > t
        whole[k] = np.logaddexp(whole[k, :, :1] + step[0], whole[k, :, 1:] + step[1]) + scores[k, t, None, :]
    begin = np.flatnonzero(first)
    length = np.diff(np.append(begin, n))
    before, after = np.zeros((n, 2)), np.zeros((n, 2))
    for t in range(1, int(length.max())):
        at = begin[length > t] + t
        before[at] = np.logaddexp.reduce(before[at - 1, :, None] + whole[at - 1], axis=1)
    for t in range(int(length.max()) - 2, -1, -1):
        at = begin[length > t + 1] + t
        after[at] = np.logaddexp.reduce(whole[at + 1] + after[at + 1, None, :], axis=2)
    alpha, beta = np.zeros((n, width, 2)), np.zeros((n, width, 2))
    alpha[:, 0] = np.logaddexp.reduce(before[:, :, None] + entry, axis=1) + scores[:, 0]
    for t in range(1, width):
        k = size > t
        alpha[k, t] = np.logaddexp.reduce(alpha[k, t - 1, :, None] + step, axis=1) + scores[k, t]
    for t in range(width - 1, -1, -1):
        last, inner = size == t + 1, size > t + 1
        beta[last, t] = after[last]
        if inner.any():
            beta[inner, t] = np.logaddexp.reduce(step + (scores[inner, t + 1] + beta[inner, t + 1])[:, None, :], axis=2)
    total = np.logaddexp.reduce(alpha[:, 0] + beta[:, 0], axis=1)
    p = np.exp(alpha[:, :, 1] + beta[:, :, 1] - total[:, None])
    source = np.concatenate((before[:, None], alpha[:, :-1]), axis=1)
    both = np.exp(source + stay + scores + beta - total[:, None, None])
    both[first, 0] = 0.0
    return p, both


def fit_field(chains: list[np.ndarray], labels: list[np.ndarray], rounds: int = ROUNDS) -> Field:
    """Maximum likelihood by Adam; every text weighs the same."""
    parts = [(i, s, min(s + BLOCK, len(c))) for i, c in enumerate(chains) for s in range(0, len(c), BLOCK)]
    size, chain = np.array([b - a for _, a, b in parts]), np.array([i for i, _, _ in parts])
    width = int(size.max())
    x, y, y_before = np.zeros((len(EDGES), len(parts), width), np.int16), np.zeros((len(parts), width), np.int8), np.full((len(parts), width), -1, np.int8)
    for k, (i, a, b) in enumerate(parts):
        x[:, k, : b - a], y[k, : b - a] = chains[i][a:b].T, labels[i][a:b]
        y_before[k, 1 : b - a] = labels[i][a : b - 1]
        if a:
            y_before[k, 0] = labels[i][a - 1]
    inside = np.arange(width) < size[:, None]
    weight = inside / np.array([len(chains[i]) for i in chain])[:, None] / len(chains)
    values = np.zeros(OFFSETS[-1] + 2)
    first, second = np.zeros_like(values), np.zeros_like(values)
    for r in range(1, rounds + 1):
        p, both = marginals(sum(values[k] for k in x), values[-2:], size, chain)
        g = (p - y) * weight
        grad = np.zeros_like(values)
        grad[:-2] = sum(np.bincount(k.ravel(), g.ravel(), minlength=OFFSETS[-1]) for k in x)
        for s in (0, 1):
            grad[OFFSETS[-1] + s] = ((both[:, :, s] - ((y == s) & (y_before == s))) * weight).sum()
        grad = grad + 1e-3 * values
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        values = values - 0.1 * (first / (1 - 0.9**r)) / (np.sqrt(second / (1 - 0.999**r)) + 1e-8)
    return Field(values[:-2], values[-2:])


def fit(chains: list[np.ndarray], good: np.ndarray) -> Field:
    chosen = [i for i, c in enumerate(chains) if len(c)]
    chains, good = [chains[i] for i in chosen], np.array([bool(good[i]) for i in chosen])
    if not len(chains) or good.all() or not good.any():
        return Field(np.ones(OFFSETS[-1]), np.zeros(2))
    labels = [np.full(len(c), int(g)) for c, g in zip(chains, good)]
    field = fit_field(chains, labels)
    first = np.cumsum([0, *map(len, chains)])
    found = field.content(np.concatenate(chains), first)
    for i, g in enumerate(good):
        own = found[first[i] : first[i + 1]].astype(np.int64)
        if not g and not own.all():
            labels[i] = own
    return fit_field(chains, labels)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """A field from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``."""
    ship(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1)).select("doc_id", "quality").distinct()
    order = [F.xxhash64(F.lit(11), "doc_id"), "doc_id"]
    chosen = known.where("quality = 1").orderBy(*order).limit(sample).union(known.where("quality = 0").orderBy(*order).limit(sample))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * sample ids
    texts = texts.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text")).select("quality", "text")  # one row of each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1)):
                words = split(data, offsets)
                lines = lines_of(data, offsets, words, words.hashes())
                lists = pa.ListArray.from_arrays(pa.array(lines.first * len(EDGES), pa.int32()), pa.array(lines.features.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], names=["quality", "features"])

    found = texts.mapInArrow(run, "quality int, features array<short>").toArrow()
    chains = [np.array(f, np.int16).reshape(-1, len(EDGES)) for f in found.column("features").to_pylist()]
    return fit(chains, found.column("quality").to_numpy())


def base_counts(data: np.ndarray, offsets: np.ndarray, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(words, code points in words, symbols, words in repeated 3-word windows) of each text."""

    def total(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[at])

    size = words.end - words.start
    inside = np.zeros(len(data) + 1, np.int8)
    inside[words.start] += 1
    np.subtract.at(inside, words.end, 1)
    points = (np.cumsum(inside[:-1]) > 0) & ((data & 0xC0) != 0x80)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    at = np.flatnonzero(words.left() >= 3)
    covered = np.zeros(len(size), bool)
    if len(at):
        with np.errstate(over="ignore"):
            key = WindowHash(hashes).of(at, at + 3) ^ mix(row[at].astype(np.uint64) + U64(1))
        _, group, count = np.unique(key, return_inverse=True, return_counts=True)
        again = at[count[group] > 1]
        for k in range(3):
            covered[again + k] = True
    return np.diff(words.first), total(points, offsets), total(IS_SYMBOL[data], offsets), total(covered, words.first)


def quality(docs: DataFrame, field: Field, share: float = SHARE) -> DataFrame:
    """Rows ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share`` for ``docs(doc_id, text)``."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1)):
                words = split(data, offsets)
                hashes = words.hashes()
                n, points, symbols, repeated = base_counts(data, offsets, words, hashes)
                lines = lines_of(data, offsets, words, hashes)
                row = np.repeat(np.arange(j - i), np.diff(lines.first))
                repeats = np.bincount(row, lines.repeats, minlength=j - i)
                kept = np.bincount(row, lines.words * field.content(lines.features, lines.first), minlength=j - i)
                content = kept / np.maximum(n, 1)
                failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)
                arrays = [n, points, symbols, repeats, repeated]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *[pa.array(x.astype(np.int64)) for x in arrays], pa.array(failed), pa.array(~failed & (content >= share)), pa.array(content)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{x} long" for x in names[1:6]) + ", base_failed boolean, kept boolean, content_share double")
