"""License scans: known notices found in texts by MinHash bands over overlapping windows.

Words are runs of letters and digits in lower case, shingles are five words (all words of a
shorter notice). Notices of more than ``n / 2`` and up to ``n`` shingles, ``n`` a power of two,
are looked for in windows of three consecutive blocks of ``n / 2`` shingles, one window per
block (of ``n`` shingles, one per shingle, for ``n`` up to 2), so that some window holds any
whole notice. A window that contains a notice to ``CONTAINED`` has a Jaccard similarity of at
least ``J`` with it (0.25 for large ``n``); each band is one MinHash, and a group of notices has
so many bands that the chance to meet in none, ``(1 - J) ** bands``, is at most ``MISSED``.

A window's MinHash values are looked up in the table of all notices' values; what they retrieve
is decided by exact containment of the notice's shingles.

Defined cases: null and empty texts have no notices; a notice that two windows show is
reported once; a null doc_id is kept; repeated rows are scanned each; an empty table gives
no rows. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stackloom.llm.notices import NOTICES
from stackloom.llm.toxicity import BREAK, LOWER
from stackloom.llm.wordhash import U64, WindowHash, chunks, split
from stackloom.session import ship

SHINGLE_WORDS, CONTAINED, MISSED = 5, 0.8, 1e-6
#: Odd factors, one per band; shingle hashes are mixed before.
FACTORS = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
NONE, SPREAD = U64(2**64 - 1), U64(0x9E3779B97F4A7C15)


def shingles_of(data: np.ndarray, offsets: np.ndarray, width: int):
    """(words, start word of each shingle, its hash, first shingle of each text); shingles stay within a text."""
    words = split(LOWER[data], offsets, BREAK)
    start = np.flatnonzero(words.left() >= width)
    return words, start, WindowHash(words.hashes()).of(start, start + width), np.searchsorted(start, words.first)


def merged(first: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of runs of ``by`` values that stay within ``first[i]:first[i + 1]``, the new ``first``)."""
    n = np.diff(first)
    count = -(-n // by)
    begin = np.concatenate(([0], np.cumsum(count)))
    within = np.arange(begin[-1]) - np.repeat(begin[:-1], count)
    return np.repeat(first[:-1], count) + by * within, begin


class Notices:
    """Notices of one shingle width that fall into windows of one size."""

    def __init__(self, texts: dict[str, str], width: int, size: int):
        self.width, self.size, self.names, self.sets = width, size, sorted(texts), []
        self.block, self.blocks = (1, size) if size <= 2 else (size // 2, 3)
        for name in self.names:
            raw = np.frombuffer(texts[name].encode(), np.uint8)
            self.sets.append(np.unique(shingles_of(raw, np.array([0, len(raw)]), width)[2]))
        window = self.block * self.blocks
        need = [(math.ceil(CONTAINED * len(s)), len(s)) for s in self.sets]
        least = min(k / (max(window, k) + t - k) for k, t in need)
        self.bands = 1 if least >= 1 else math.ceil(math.log(MISSED) / math.log(1 - least))
        if self.bands > len(FACTORS):
            raise ValueError(f"a containment of {CONTAINED} needs {self.bands} bands to miss less than {MISSED}; there are {len(FACTORS)}")
        # Per band the notices' values, and which of 65,536 slots they fall in.
        values = np.stack([[(s * f).min() for s in self.sets] for f in FACTORS[: self.bands]])
        self.order = values.argsort(1)
        self.values = np.take_along_axis(values, self.order, 1)
        self.slots = np.zeros((self.bands, 1 << 16), bool)
        np.put_along_axis(self.slots, self.slot(self.values), True, 1)

    @staticmethod
    def slot(values: np.ndarray) -> np.ndarray:
        return ((values * SPREAD) >> U64(48)).astype(np.int64)

    def looked_up(self, band: int, blocks: np.ndarray, ends: np.ndarray, head: np.ndarray) -> list[np.ndarray]:
        """(first block of a window, notice) of all that share this band's value."""
        blocks, found = np.concatenate((blocks, np.full(self.blocks - 1, NONE))), []
        least = blocks[head]
        for k in range(1, self.blocks):
            least = np.minimum(least, np.where(head + k < ends, blocks[head + k], NONE))
        near = np.flatnonzero(self.slots[band][self.slot(least)])
        at = np.searchsorted(self.values[band], least[near])
        for k in range(len(self.names)):  # notices that share the value
            here = at + k < len(self.names)
            here[here] = self.values[band][at[here] + k] == least[near[here]]
            near, at = near[here], at[here]
            if not len(near):
                break
            found.append(np.stack([head[near], self.order[band][at + k]], 1))
        return found


class Width:
    """All notices of one shingle width; a band's block minima of one size are made from those of half the size."""

    def __init__(self, width: int, groups: list[Notices]):
        self.width, self.groups = width, sorted(groups, key=lambda g: g.size)

    def retrieved(self, shingle: np.ndarray, first: np.ndarray) -> list[tuple[Notices, np.ndarray, np.ndarray, np.ndarray]]:
        """Per group (first shingle of a window, its end, notice) of all that share a band's value, each once."""
        levels, begin, block, start = [], first, 1, np.arange(len(shingle))
        while len(shingle) and block <= self.groups[-1].block:
            parts = np.arange(len(start))
            if block > 1:
                parts, begin = merged(begin, 2)
                start = start[parts]
            row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
            users = []
            for g in self.groups:
                if g.block == block:
                    # A text's last windows lie within the one before, but for its first.
                    head = np.flatnonzero((np.arange(len(row)) == begin[:-1][row]) | (np.arange(len(row)) + g.blocks <= begin[1:][row]))
                    users.append((g, head, begin[1:][row[head]], []))
            levels.append((block, parts, start, first[1:][row], users))
            block *= 2
        for band in range(max(g.bands for g in self.groups) if levels else 0):
            value = shingle * FACTORS[band]
            for block, parts, _, _, users in levels:
                if block > 1:
                    value = np.minimum.reduceat(value, parts)
                for g, head, ends, found in users:
                    if band < g.bands:
                        found += g.looked_up(band, value, ends, head)
        out = []
        for _, _, start, end, users in levels:
            for g, _, _, found in users:
                if found:
                    w, t = np.unique(np.concatenate(found), axis=0).T
                    out.append((g, start[w], np.minimum(start[w] + g.block * g.blocks, end[w]), t))
        return out

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str, int, int, float]]:
        """(text, notice, first word, end word, containment) of each place."""
        words, start, shingle, first = shingles_of(data, offsets, self.width)
        spans: dict[tuple[int, str], list[tuple[int, int, float]]] = {}
        for g, *windows in self.retrieved(shingle, first):
            for a, b, t in zip(*(x.tolist() for x in windows)):
                part = shingle[a:b]
                inside = np.flatnonzero(np.isin(part, g.sets[t]))
                share = len(np.unique(part[inside])) / len(g.sets[t])
                if share >= CONTAINED:
                    row = int(np.searchsorted(first, a, side="right")) - 1
                    base = start[a] - words.first[row]
                    spans.setdefault((row, g.names[t]), []).append((int(base + inside[0]), int(base + inside[-1] + self.width), share))
        return [(row, name, *place) for (row, name), found in spans.items() for place in joined(found)]


def joined(spans: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Spans that overlap become one, with the largest containment."""
    out: list[tuple[int, int, float]] = []
    for a, b, c in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1]), max(c, out[-1][2])
        else:
            out.append((a, b, c))
    return out


def notice_groups(notices: dict[str, str]) -> list[Width]:
    """Notices by shingle width and by the power of two that bounds their shingles."""
    groups: dict[int, dict[int, dict[str, str]]] = {}
    for name, text in notices.items():
        raw = np.frombuffer(text.encode(), np.uint8)
        n = len(split(LOWER[raw], np.array([0, len(raw)]), BREAK).start)
        if n:
            width = min(SHINGLE_WORDS, n)
            groups.setdefault(width, {}).setdefault(1 << max(0, n - width).bit_length(), {})[name] = text
    return [Width(width, [Notices(texts, width, size) for size, texts in sizes.items()]) for width, sizes in sorted(groups.items())]


def license_scan(docs: DataFrame, notices: dict[str, str] | None = None) -> DataFrame:
    """Rows ``doc_id, notice, start_word, end_word, containment`` for ``docs(doc_id, text)``: each place of each notice."""
    ship(docs.sparkSession)
    groups = notice_groups(NOTICES if notices is None else notices)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, offsets in chunks(batch.column(1)):
                rows = sorted(p for g in groups for p in g.scan(data, offsets))
                row, name, start, end, share = zip(*rows) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([i + r for r in row], pa.int32())), pa.array(name, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(share, pa.float64())], names=["doc_id", "notice", "start_word", "end_word", "containment"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, notice string, start_word long, end_word long, containment double")
