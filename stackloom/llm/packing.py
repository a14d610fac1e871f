"""Best-fit packing of token sequences by the sum-of-squares rule.

Documents become token ids and pieces of at most ``capacity`` tokens. A piece goes where the
sum over gaps of (number of open sequences with that gap) squared becomes smallest, longest
piece first; a new sequence is opened only where no open one has room.

Pieces are dealt to groups of about ``GROUP_PIECES`` by a hash of their place in the table, so
repeated rows spread, and each group is packed by one task; a group's few unfilled sequences
are the only waste that grouping adds.

Defined cases: a null text is empty and gives the end token alone; repeated rows are packed
each; a null doc_id is kept; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.llm.common import stored, unused
from stackloom.llm.wordhash import U64, Words, chunks, split
from stackloom.session import ship

CAPACITY, END = 2048, 0
GROUP_PIECES = 40_000
#: Pre-tokens whose ids a worker remembers, and text bytes encoded at once.
CACHED_UNITS = 250_000
CHUNK_BYTES, SLOTS = 1 << 18, 1 << 20
VOCABULARY = "word_bpe_49k.json"
#: What a tokenizer must do for its texts to be cut into pre-tokens here (fixed values): no token crosses white space, letters
#: run together in lower case, digits stand alone, other marks run together, and an apostrophe may start one with letters.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTER, DIGIT, MARK = 1, 2, 3
KIND = np.zeros(256, np.uint8)
KIND[0x21:0x7F] = MARK
KIND[0x30:0x3A] = DIGIT
KIND[0x41:0x5B] = KIND[0x61:0x7B] = KIND[0x80:] = LETTER
#: Control characters, which the cut below leaves to the tokenizer.
CONTROL = np.isin(np.arange(256), [*range(0x09), *range(0x0E, 0x20), 0x7F])


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts_like_this(description: dict) -> bool:
    """Whether a tokenizer, as its file describes it, cuts texts as :class:`UnitEncoder` does."""
    normalizer, pre = description.get("normalizer") or {}, description.get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers") or [{}]
    return (
        normalizer.get("normalizers") == NORMALIZERS
        and [p.get("type") for p in parts] == ["Split", "ByteLevel"]
        and parts[0].get("pattern") == {"Regex": PRE_TOKENS}
        and (parts[0].get("behavior"), parts[0].get("invert")) == ("Removed", True)
        and not parts[1].get("add_prefix_space")
        and description.get("post_processor") is None
        and description.get("truncation") is None
        and all(t["content"].startswith("<|") and not t["normalized"] and " " not in t["content"] for t in description.get("added_tokens", []))
    )


class TextEncoder:
    """Ids of whole texts by the tokenizer itself, for any tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin)."""
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        parts = [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(parts) if parts else np.zeros(0, "<u4"), np.cumsum([0, *map(len, parts)])


class UnitEncoder(TextEncoder):
    """The same ids from remembered pre-tokens, looked up for a whole chunk at once.

    Words of ASCII and Latin-1 letters, digits and marks are cut into pre-tokens by numpy; each
    new pre-token goes through the tokenizer's model once. Words with anything else are units
    that the whole tokenizer encodes. A unit is found by a hash and confirmed by its bytes.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.slots = np.zeros(SLOTS, np.int32)
        self.hashes, self.begin, self.size = np.zeros(1, np.uint64), np.zeros(1, np.int64), np.full(1, -1, np.int64)
        self.id_begin, self.id_count = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.bytes, self.ids = np.zeros(0, np.uint8), np.zeros(0, "<u4")

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
        """(units of the texts, which of them are whole words for the tokenizer)."""
        low = data.copy()
        low[(data >= 0x41) & (data <= 0x5A)] += 0x20
        kind = KIND[data]
        words = split(data, offsets)
        lead = data == 0xC3
        odd = (data >= 0x80) | CONTROL[data]
        if len(data):
            after = lead[:-1] & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            odd[:-1] &= ~after
            odd[1:] &= ~after
            low[1:][after & (data[1:] < 0x9F)] += 0x20
            odd[:-1] |= ((data[:-1] == 0x27) & (kind[1:] == LETTER)) | ((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        starts = kind > 0
        starts[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        starts[words.start] = True
        strange = np.unique(np.searchsorted(words.start, np.flatnonzero(odd), side="right") - 1)
        for a, b in zip(words.start[strange].tolist(), words.end[strange].tolist()):
            low[a:b] = data[a:b]
            starts[a + 1 : b] = False
        start = np.flatnonzero(starts)
        end = np.empty_like(start)
        end[:-1] = start[1:]
        if len(start):
            end[-1] = words.end[-1]
            last = np.searchsorted(start, words.start[1:]) - 1  # the last unit of each word ends with it
            end[last] = words.end[:-1]
        whole = np.zeros(len(start), bool)
        whole[np.searchsorted(start, words.start[strange])] = True
        return Words(low, start, end, np.searchsorted(start, offsets)), whole

    def learn(self, texts: list[str], whole: list[bool]) -> list[list[int]]:
        """Ids of new units."""
        from tokenizers.pre_tokenizers import ByteLevel

        model, plain = self.tokenizer.model.tokenize, [t for t, w in zip(texts, whole) if not w]
        space = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(" ")[0][0]
        cut = iter(ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(" ".join(plain))[0][0].split(space) if plain else ())
        rest = iter(self.tokenizer.encode_batch_fast([t for t, w in zip(texts, whole) if w], add_special_tokens=False))
        return [next(rest).ids if w else [t.id for t in model(next(cut))] for w in whole]

    def find(self, words: Words, hashes: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """The place of each unit, learning those that are new."""
        slot = (hashes & U64(SLOTS - 1)).astype(np.int64)
        at = self.slots[slot]
        missed = np.flatnonzero(self.hashes[at] != hashes)
        if not len(missed):
            return at
        values, first, which = np.unique(hashes[missed], return_index=True, return_inverse=True)
        places = [self.place.get(h, 0) for h in values.tolist()]
        fresh = [i for i, p in enumerate(places) if not p]
        if fresh:
            rows = missed[first[fresh]]
            start, end = words.start[rows], words.end[rows]
            raw = [words.data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist())]
            ids = self.learn([r.decode("utf-8", "replace") for r in raw], whole[rows].tolist())
            count = np.array(list(map(len, ids)), np.int64)
            base = len(self.hashes)
            for k, i in enumerate(fresh):
                places[i] = base + k
            self.place.update(zip(values[fresh].tolist(), range(base, base + len(fresh))))
            self.hashes = np.concatenate((self.hashes, values[fresh]))
            self.begin = np.concatenate((self.begin, len(self.bytes) + np.cumsum(end - start) - (end - start)))
            self.size = np.concatenate((self.size, end - start))
            self.id_begin = np.concatenate((self.id_begin, len(self.ids) + np.cumsum(count) - count))
            self.id_count = np.concatenate((self.id_count, count))
            self.bytes = np.concatenate((self.bytes, np.frombuffer(b"".join(raw), np.uint8)))
            self.ids = np.concatenate((self.ids, np.array([i for x in ids for i in x], "<u4")))
        places = np.array(places, np.int32)
        self.slots[slot[missed]] = places[which]
        at[missed] = places[which]
        return at

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.hashes) > CACHED_UNITS:
            self.clear()
        words, whole = self.units(data, offsets)
        at = self.find(words, words.hashes(), whole)
        size = words.end - words.start
        same = self.size[at] == size
        if same.all():
            same = self.bytes[spread(self.begin[at], size)] == words.data[spread(words.start, size)]
        if not same.all():  # two units of one hash
            return super().encode(data, offsets)
        count = self.id_count[at]
        return self.ids[spread(self.id_begin[at], count)], np.concatenate(([0], np.cumsum(count)))[words.first]


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``begin[i], begin[i] + 1, ..`` of ``count[i]`` numbers, one after the other."""
    ends = np.cumsum(count)
    return np.repeat(begin - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder per Python worker."""
    if path not in _encoders:
        with open(path, encoding="utf-8") as f:
            known = cuts_like_this(json.load(f))
        _encoders[path] = (UnitEncoder if known else TextEncoder)(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Rows ``doc_id, piece, start, length, ids`` for ``docs(doc_id, text)``; ids are little-endian unsigned 32-bit numbers, ``end`` last."""
    ship(docs.sparkSession)
    path, tail = path or vocabulary_path(), np.array([end], dtype="<u4").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for i, _, data, offsets in chunks(batch.column(1), CHUNK_BYTES):
                ids, first = enc.encode(data, offsets)
                yield part(batch.column(0), i, ids, first.tolist())

    def part(doc_ids: pa.Array, i: int, ids: np.ndarray, first: list[int]) -> pa.RecordBatch:
        rows: list[tuple] = []
        for k, (a, b) in enumerate(zip(first, first[1:])):
            raw = ids[a:b].tobytes() + tail
            for p, start in enumerate(range(0, len(raw), 4 * capacity)):
                cut = raw[start : start + 4 * capacity]
                rows.append((i + k, p, start // 4, len(cut) // 4, cut))
        k, *columns = zip(*rows)
        return pa.RecordBatch.from_arrays([doc_ids.take(pa.array(k, pa.int32())), *[pa.array(x, f.type) for x, f in zip(columns, fields)]], names=["doc_id", *fields.names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, longest first, sequences numbered from 0.

    With ``n[g]`` open sequences of gap ``g``, putting a piece of length ``s`` into gap ``g``
    changes the sum of squares by ``2 * (n[g - s] - n[g]) + 2``, or by ``1 - 2 * n[s]`` if that
    fills it; closed sequences (gap 0) do not count. A new sequence is opened only where no
    open one has room, as opening early wastes sequences when all pieces are known.
    """
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i in order.tolist():
        s = int(lengths[i])
        gap = capacity
        if count[s:capacity].any():
            change = 2 * (count[: capacity - s] - count[s:capacity]) + 2
            change[0] = 1 - 2 * count[s]
            change[count[s:capacity] == 0] = 1 << 40
            gap = int(change.argmin()) + s
        if gap == capacity:
            where, made = made, made + 1
        else:
            where = open_by_gap[gap].pop()
            count[gap] -= 1
            offset[i] = capacity - gap
        sequence[i] = where
        if gap > s:
            count[gap - s] += 1
            open_by_gap[gap - s].append(where)
    return sequence, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, salt: Column | None = None) -> DataFrame:
    """``pieces`` (a column ``length`` of at most ``capacity``) plus ``sequence_id`` and gapless ``offset`` (columns with these names are replaced)."""
    ship(pieces.sparkSession)
    pieces = stored(pieces.drop("sequence_id", "offset"), "pack-pieces")
    groups, group = max(1, -(-pieces.count() // group_pieces)), unused(pieces, "group")
    # Of a stored table each row has one place, also if a task runs again.
    dealt = pieces.withColumn(group, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int") if salt is None else salt)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows.drop(columns=group).assign(sequence_id=sequence * groups + key[0], offset=offset)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy(group).applyInPandas(run, f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, length, ids`` for packed pieces that still have their ``ids``."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
