"""Substring deduplication: words covered by a repeated window of ``window`` words, by level-wise doubling.

Level 1 looks at windows of a quarter of the length (9 words for 35). Of each full window
only the one that a hash order picks is taken, its *anchor*: equal full windows have equal
anchors, so nothing is lost, and about one position in fourteen is sent. Anchors that are
repeated survive; around them windows of twice the length (18 words, ending or starting at
the anchor) must be repeated, and around those the full windows are compared. No level looks
at a window whose part was not repeated at the level before.

The full windows that share an anchor form one *context*, a span of at most twice the length.
Equal contexts are counted once; a repeated context settles all its windows, so only the few
contexts that stand alone, and those they may partly equal, have their windows listed.

Defined cases: a null text has no words; windows never cross documents; a window that repeats
within one document counts; repeated rows repeat all their windows; a null doc_id is a document
like any other; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm.common import join_hot, row_key, stored, unused
from stackloom.llm.wordhash import U64, Words, WindowHash, chunks, sliding_min, split
from stackloom.session import ship

WINDOW = 35
POSITION = U64(0xFFFFFFFF)


class Anchors:
    """Anchors of the texts of one chunk; positions count words from the chunk's first."""

    def __init__(self, words: Words, window: int):
        self.words, self.base = words, window // 4 + 1
        hashes, base = words.hashes(), self.base
        self.windows, left = WindowHash(hashes), words.left()
        at = np.arange(max(0, len(hashes) - base + 1))
        self.short = self.windows.of(at, at + base)
        order = (self.short & ~POSITION) | at.astype(np.uint64)
        least = sliding_min(order, window - base + 1) if len(order) > window - base else order[:0]
        starts = np.flatnonzero(left[: len(least)] >= window)
        anchor = (least[starts] & POSITION).astype(np.int64)
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        self.at = anchor[new]
        self.first = starts[new]
        self.count = np.diff(np.append(np.flatnonzero(new), len(starts)))
        self.row = np.searchsorted(words.first, self.at, side="right") - 1

    def context(self, window: int) -> np.ndarray:
        return self.windows.of(self.first, self.first + self.count - 1 + window)

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """32-bit hashes of the doubled windows that end and start with the anchor; 0 where the text ends before."""
        base, begin, end = self.base, self.words.first[self.row], self.words.first[self.row + 1]
        before, after = np.maximum(self.at - base, 0), np.minimum(self.at + 2 * base, self.words.first[-1])
        ending = np.where(self.at - base >= begin, self.windows.of(before, self.at + base) >> U64(33), U64(0))
        starting = np.where(self.at + 2 * base <= end, self.windows.of(self.at, after) >> U64(33), U64(0))
        return ending.astype(np.int64), starting.astype(np.int64)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchor_hashes(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                found = Anchors(split(data, offsets), window)
                yield pa.RecordBatch.from_arrays([signed(found.short[found.at])], names=["anchor"])

    return docs.select("text").mapInArrow(run, "anchor long")


def anchor_rows(keyed: DataFrame, window: int) -> DataFrame:
    """``anchor, ending, starting, context, k1, k2, at, first, n`` for each anchor; ``at``, ``first`` count the text's words."""
    names = ["anchor", "sides", "context", "k1", "k2", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, _, data, offsets in chunks(batch.column(2)):
                f = Anchors(split(data, offsets), window)
                ending, starting = f.sides()
                begin = f.words.first[f.row]
                place = ((f.at - begin) << 16) | ((f.at - f.first) << 8) | f.count
                yield pa.RecordBatch.from_arrays(
                    [signed(f.short[f.at]), pa.array((ending << 32) | starting), signed(f.context(window)), pa.array(k1[i + f.row]), pa.array(k2[i + f.row]), pa.array(place)], names=names
                )

    return keyed.select("k1", "k2", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def listed_windows(texts: DataFrame, window: int) -> DataFrame:
    """The full windows of chosen anchors: ``texts(k1, k2, text, places)`` to ``anchor, hash, k1, k2, start, copies``."""
    names = ["anchor", "hash", "k1", "k2", "start", "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            places = batch.column(3)
            for i, j, data, offsets in chunks(batch.column(2)):
                words = split(data, offsets)
                windows = WindowHash(words.hashes())
                part = places.slice(i, j - i)
                lengths = pa.compute.list_value_length(part).to_numpy()
                row = np.repeat(np.arange(j - i), lengths)
                flat = part.flatten()
                place, copies = flat.field("place").to_numpy(), flat.field("copies").to_numpy()
                begin = words.first[row]
                at, n = begin + (place >> 16), place & 255
                first = at - ((place >> 8) & 255)
                start = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                which = np.repeat(np.arange(len(n)), n)
                base = window // 4 + 1
                yield pa.RecordBatch.from_arrays(
                    [signed(windows.of(at, at + base)[which]), signed(windows.of(start, start + window)), pa.array(k1[i + row][which]), pa.array(k2[i + row][which]), pa.array(start - begin[which]), pa.array(copies[which])], names=names
                )

    return texts.select("k1", "k2", "text", "places").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows ``k1, k2, spans``: for documents with repeated windows the starts ``(first, n)`` of those windows; keys as ``row_key('doc_id', 'text')``."""
    ship(docs.sparkSession)
    k1, k2 = row_key("doc_id", "text")
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), "text")
    if not 4 <= window <= 255:
        raise ValueError("window must be 4 to 255 words")
    # Level 1: repeated anchors.
    repeated = stored(anchor_hashes(docs, window).groupBy("anchor").count().where("count > 1"), "substring-anchors")
    total = repeated.agg(F.sum("count")).first()[0] or 0
    alive = stored(join_hot(anchor_rows(keyed, window), repeated, ["anchor"], "count", total, "left_semi"), "substring-alive")
    contexts = stored(alive.groupBy("anchor", "context", "sides").agg(F.count("*").alias("copies"), F.min(F.struct("k1", "k2", "place")).alias("one")), "substring-contexts")
    many = contexts.where("copies > 1").groupBy("anchor", "context").agg(F.sum("copies").alias("copies"))  # sides differ only where hashes collide
    settled = join_hot(alive, many, ["anchor", "context"], "copies", total, "left_semi")
    settled = settled.select("k1", "k2", (F.shiftright("place", 16) - F.shiftright("place", 8).bitwiseAND(F.lit(255))).alias("first"), F.col("place").bitwiseAND(F.lit(255)).alias("n"))

    # Level 2: twice the length, around anchors of contexts that stand alone, and of those they may partly equal.
    alone = contexts.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if(F.col("copies") == 1).alias("alone")).where("alone > 0").drop("alone")
    open_ = stored(join_hot(contexts, alone, ["anchor"], "n", contexts.count(), "left_semi"), "substring-open")
    n = open_.count()
    sides = open_.select("anchor", "copies", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.shiftright("sides", 32).alias("value")), F.struct(F.lit(1).alias("side"), F.col("sides").bitwiseAND(F.lit(0xFFFFFFFF)).alias("value")))).alias("s")).select("anchor", "copies", "s.*").where("value <> 0")
    doubled = stored(sides.groupBy("anchor", "side", "value").agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).where("copies > 1").drop("copies"), "substring-doubled")
    ending = join_hot(open_.withColumn("value", F.shiftright("sides", 32)), doubled.where("side = 0").drop("side"), ["anchor", "value"], "n", n, "left_semi")
    starting = join_hot(open_.withColumn("value", F.col("sides").bitwiseAND(F.lit(0xFFFFFFFF))), doubled.where("side = 1").drop("side"), ["anchor", "value"], "n", n, "left_semi")
    chosen = ending.unionByName(starting).select("anchor", "context", "copies", "one").distinct()

    # Level 3: the full windows of what is left.
    places = chosen.groupBy("one.k1", "one.k2").agg(F.collect_list(F.struct("one.place", "copies")).alias("places"))
    windows = stored(listed_windows(keyed.join(places, ["k1", "k2"]), window), "substring-windows")
    single = stored(windows.where("copies = 1"), "substring-single")
    full = windows.groupBy("anchor", "hash").agg(F.sum("copies").alias("copies"), F.count_if(F.col("copies") == 1).alias("rows")).where("copies > 1 and rows > 0")
    alone = join_hot(single, full.drop("copies"), ["anchor", "hash"], "rows", single.count(), "left_semi").select("k1", "k2", F.col("start").alias("first"), F.lit(1).cast("long").alias("n"))
    spans = settled.unionByName(alone).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "n")).alias("spans"))
    return stored(spans, "substring-spans")


def covered(spans: list | None, n_words: int, window: int) -> np.ndarray:
    """Which words the windows cover."""
    change = np.zeros(n_words + 1, dtype=np.int64)
    if spans is not None and len(spans):
        first, n = spans
        np.add.at(change, first, 1)
        np.add.at(change, np.minimum(first + n - 1 + window, n_words), -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, digest: bool = False, counts: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """Columns of ``docs`` with ``text`` cut, plus the ``counts`` of words and of removed ones (columns of ``docs`` with these names are replaced).

    The kept words are joined by one space; a text that loses nothing stays as it is. With
    ``digest`` the text column is replaced by ``kept_sha256``, of the kept words joined by one space.
    """
    ship(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("text", *counts)]
    k1, k2 = row_key("doc_id", "text")
    a, b, first, n_ = (unused(docs, c) for c in ("k1", "k2", "first", "n"))
    spans = repeated_spans(docs.select("doc_id", "text"), window).select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("spans.first").alias(first), F.col("spans.n").alias(n_))
    joined = docs.select(*names, "text", k1.alias(a), k2.alias(b)).join(spans, [a, b], "left").select(*names, "text", first, n_)
    out = "kept_sha256" if digest else "text"
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names]
    w = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, begin, lengths = 0, 0, pa.compute.binary_length(batch.column(w)).to_pylist()
            for i, n in enumerate(lengths):
                size += n or 0
                if size > 4_000_000 or i == len(lengths) - 1:
                    yield part(batch.slice(begin, i + 1 - begin))
                    begin, size = i + 1, 0

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, gone, kept = [], [], []
        firsts, many = batch.column(w + 1), batch.column(w + 2)
        for i, text in enumerate(batch.column(w).to_pylist()):
            words = (text or "").encode().split()
            drop = None
            if firsts[i].is_valid:
                drop = covered((firsts[i].values.to_numpy(), many[i].values.to_numpy()), len(words), window)
            n = int(drop.sum()) if drop is not None else 0
            if n:
                words = [words[k] for k in np.flatnonzero(~drop).tolist()]
            total.append(len(words) + n)
            gone.append(n)
            if digest:
                kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
            else:
                kept.append(b" ".join(words).decode() if n else text)
        return pa.RecordBatch.from_arrays([*batch.columns[:w], pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*names, out, *counts])

    return joined.mapInArrow(run, ", ".join([*kinds, f"{out} string", *[f"`{c}` long" for c in counts]]))
