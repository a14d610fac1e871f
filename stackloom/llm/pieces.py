"""SentencePiece byte-pair encoding and decoding by vectorised merge rounds.

A chunk of texts is one flat array of symbols, first one per character. Where two neighbours
stand together inside no piece of the vocabulary, no merge can ever join them, so the array is
cut there into words; a chunk's equal words are merged once. In a round every word that can
still be merged takes the pair of its best rank wherever it occurs, leftmost first and without
overlap; the array is compacted, finished words leave, and rounds go on until no pair remains.

The library merges one pair at a time: best score first, then leftmost. A round is the same as
long as no merge of it makes a pair of equal or better rank. Where one would, that word merges
only its leftmost occurrence in that round, so ids are the library's for any vocabulary.

Blanks often come in long runs, and their pieces all share one score below all others. If
that holds, blanks are cut from each other too, and what is left of a run in the end is merged
from the left in one pass.

Defined cases: a null text is empty and has no ids; an empty text has none either; repeated
rows are encoded each; a null id is kept; an empty table gives no rows. Only the named
columns are read. Models of another kind than byte-pair encoding with byte fallback, a leading
blank and otherwise unchanged text are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stackloom.llm.wordhash import U64, WindowHash, chunks, mix
from stackloom.session import ship

VOCABULARY = "piece_bpe_32k.model"
BLANK = 0x2581
#: Text bytes encoded at once; one longer text is encoded alone.
CHUNK_BYTES = 1 << 18
NEVER = np.iinfo(np.int32).max
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``begin[i], begin[i] + 1, ..`` of ``count[i]`` numbers, one after the other."""
    ends = np.cumsum(count)
    return np.repeat(begin - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


class Table:
    """Numbers by 64-bit key, in slots of a power of two with the next free slot on a clash."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, (4 * len(keys)).bit_length())
        self.mask, self.keys, self.values = U64(size - 1), np.full(size, -1, np.int64), np.zeros(size, np.int64)
        left = np.arange(len(keys))
        slot = self.slot(keys)
        while len(left):
            free = self.keys[slot[left]] < 0
            self.keys[slot[left[free]]] = keys[left[free]]  # one of those that want a slot gets it
            got = self.keys[slot[left]] == keys[left]
            self.values[slot[left[got]]] = values[left[got]]
            left = left[~got]
            slot[left] = (slot[left] + 1) & int(self.mask)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(keys.astype(np.uint64)) & self.mask).astype(np.int64)

    def get(self, keys: np.ndarray, missing: int) -> np.ndarray:
        """The values of non-negative ``keys``."""
        slot = self.slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], missing)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & int(self.mask)
            held = self.keys[slot[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out


class Vocabulary:
    """A model's pieces, merges and surfaces as arrays.

    Symbols are piece ids; then numbers for characters that are no pieces but stand in some;
    then, from ``other``, characters that stand in none.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: not a byte-pair encoding with byte fallback and plain pieces")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: changes texts in other ways than by a leading blank")
        self.size = len(model.pieces)
        ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        scores = {p: model.pieces[i].score for p, i in ids.items()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        symbols = dict(ids)
        for p in ids:
            for c in p:
                symbols.setdefault(c, self.size + len(symbols) - len(ids))
        self.other = self.size + len(symbols) - len(ids)
        runs = {p for p in ids if set(p) == {chr(BLANK)} and len(p) > 1}
        worst = {scores[p] for p in runs}
        plain = chr(BLANK) in ids and len(worst) == 1 and all(p in runs or (chr(BLANK) * 2 not in p and scores[p] > min(worst)) for p in ids if len(p) > 1)
        self._blanks: dict[int, list[int]] = {}
        #: Ids of runs of blanks by length, if blanks can be merged last and from the left.
        self.runs = {len(p): ids[p] for p in runs} | {1: ids[chr(BLANK)]} if plain else None

        self.symbol = np.arange(self.other, self.other + 0x110000)
        chars = {s: ord(c) for c, s in symbols.items() if len(c) == 1}
        self.symbol[list(chars.values())] = list(chars)
        #: The characters of symbols from ``size`` to ``other``.
        self.points = [chars[s] for s in range(self.size, self.other)]
        pairs = sorted({(symbols[a], symbols[b]) for p in ids for a, b in zip(p, p[1:])})
        self.together = Table(np.array([a << 32 | b for a, b in pairs], np.int64), np.ones(len(pairs), np.int64))
        merges = [(symbols[p[:k]] << 32 | symbols[p[k:]], order[scores[p]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        key, rank, made = (np.array(x, np.int64) for x in zip(*merges)) if merges else (np.zeros(0, np.int64),) * 3
        self.merges = Table(key, rank << 32 | made)

        self.byte = np.array([next(i for i, p in enumerate(model.pieces) if p.type == BYTE and p.piece == f"<0x{b:02X}>") for b in range(256)])
        self.byte_of = np.full(self.size, -1, np.int64)
        self.byte_of[self.byte] = np.arange(256)
        said = {CONTROL: "", UNKNOWN: model.trainer_spec.unk_surface}
        surface = [bytes([self.byte_of[i]]) if self.byte_of[i] >= 0 else said.get(p.type, p.piece.replace(chr(BLANK), " ")).encode() for i, p in enumerate(model.pieces)]
        self.leads = np.array([p.type == NORMAL and p.piece.startswith(chr(BLANK)) for p in model.pieces])
        self.silent = np.array([p.type == CONTROL for p in model.pieces])
        self.surface_size = np.array(list(map(len, surface)), np.int64)
        self.surface_begin = np.cumsum(self.surface_size) - self.surface_size
        self.surfaces = np.frombuffer(b"".join(surface), np.uint8)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of each pair; :data:`NEVER` where it is no piece. A negative symbol pairs with none."""
        able = np.flatnonzero((left >= 0) & (right >= 0) & (left < self.other) & (right < self.other))
        rank, made = np.full(len(left), NEVER, np.int64), np.zeros(len(left), np.int64)
        found = self.merges.get(left[able] << 32 | right[able], NEVER << 32)
        rank[able], made[able] = found >> 32, found & 0xFFFFFFFF
        return rank, made

    # Encoding

    def merged(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges the words ``symbols[first[w]:first[w + 1]]`` until no pair remains: (symbols, where each word's begin)."""
        n_words = len(first) - 1
        word = np.repeat(np.arange(n_words), np.diff(first))
        done_symbol, done_word = [], []
        rank, made = self.pair(symbols, np.append(symbols[1:], -1))
        rank[first[1:] - 1] = NEVER
        while len(symbols):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lengths = np.diff(np.append(starts, len(word)))
            best = np.minimum.reduceat(rank, starts)
            over = best == NEVER
            if over.any():  # finished words leave
                gone = np.repeat(over, lengths)
                done_symbol.append(symbols[gone])
                done_word.append(word[gone])
                stay = ~gone
                symbols, word, rank, made = symbols[stay], word[stay], rank[stay], made[stay]
                best, lengths = best[~over], lengths[~over]
                if not len(symbols):
                    break
            limit = np.repeat(best, lengths)
            hit = np.flatnonzero(rank == limit)
            # Of neighbouring occurrences every second one, from the left.
            fresh = np.append(True, hit[1:] != hit[:-1] + 1)
            run = np.flatnonzero(fresh)
            place = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[place % 2 == 0]
            # What the merged symbol meets: on the left what is there by then, on the right what is there still.
            new = symbols.copy()
            new[hit] = made[hit]
            dead = np.zeros(len(symbols) + 1, bool)
            dead[hit + 1] = True
            before = hit - 1 - dead[hit - 1]
            left = np.where((hit > 0) & (word[before] == word[hit]), new[before], -1)
            after = np.minimum(hit + 2, len(symbols) - 1)
            right = np.where((hit + 2 < len(symbols)) & (word[after] == word[hit]), symbols[after], -1)
            left_rank, left_made = self.pair(left, made[hit])
            right_rank, right_made = self.pair(made[hit], right)
            bad = (left_rank <= limit[hit]) | (right_rank <= limit[hit])
            if bad.any():  # those words go on with their leftmost pair alone
                first_hit = np.append(True, word[hit[1:]] != word[hit[:-1]])
                keep = first_hit | ~np.isin(word[hit], word[hit[bad]])
                hit, left, left_rank, left_made, right_rank, right_made, before = (x[keep] for x in (hit, left, left_rank, left_made, right_rank, right_made, before))
                dead[:] = False
                dead[hit + 1] = True
            symbols[hit] = made[hit]
            rank[hit], made[hit] = right_rank, right_made
            has = left >= 0
            rank[before[has]], made[before[has]] = left_rank[has], left_made[has]  # after the right ones: both may be one pair
            stay = ~dead[:-1]
            symbols, word, rank, made = symbols[stay], word[stay], rank[stay], made[stay]
        symbols, word = np.concatenate(done_symbol), np.concatenate(done_word)
        return symbols[np.argsort(word, kind="stable")], np.append(0, np.cumsum(np.bincount(word, minlength=n_words)))

    def words(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where the words of the texts ``symbols[first[t]:first[t + 1]]`` begin."""
        cut = np.ones(len(symbols), bool)
        left, right = symbols[:-1], symbols[1:]
        able = np.flatnonzero((left < self.other) & (right < self.other))
        cut[able + 1] = self.together.get(left[able] << 32 | right[able], 0) == 0
        if self.runs:
            blank = symbols == self.runs[1]
            cut[1:] |= blank[1:] & blank[:-1]
        cut[first[:-1][first[:-1] < len(symbols)]] = True
        return np.flatnonzero(cut)

    def blanks(self, n: int) -> list[int]:
        """The pieces of ``n`` blanks: the leftmost two that make a piece become one, until none do."""
        if n not in self._blanks:
            held: list[int] = []
            for _ in range(n):
                held.append(1)
                while len(held) > 1 and held[-2] + held[-1] in self.runs:
                    held[-2:] = [held[-2] + held[-1]]
            self._blanks[n] = [self.runs[k] for k in held]
        return self._blanks[n]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin) of UTF-8 texts."""
        raw = data.tobytes()
        try:
            points = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4").astype(np.int64)
        except UnicodeDecodeError:  # every byte that is no UTF-8 is a replacement character
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            raw = "".join(texts).encode()
            offsets = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
            points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
        begins = np.append(0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))
        first = begins[offsets]
        full = np.diff(first) > 0
        points[points == 0x20] = BLANK
        points = np.insert(points, first[:-1][full], BLANK)
        first = first + np.append(0, np.cumsum(full))
        if not len(points):
            return points, first
        symbols = self.symbol[points]

        begin = self.words(symbols, first)
        size = np.diff(np.append(begin, len(symbols)))
        with np.errstate(over="ignore"):
            codes = mix(symbols.astype(np.uint64) + U64(0x9E3779B97F4A7C15))
        hashes = WindowHash(codes).of(begin, begin + size)
        _, once, which = np.unique(hashes, return_index=True, return_inverse=True)
        same = size[once][which] == size
        if same.all():
            same = symbols[spread(begin[once][which], size)] == symbols
        if not same.all():  # two words of one hash
            once = which = np.arange(len(begin))
        ids, place = self.merged(symbols[spread(begin[once], size[once])], np.append(0, np.cumsum(size[once])))
        count = np.diff(place)[which]
        ids = ids[spread(place[:-1][which], count)]
        first = np.append(0, np.cumsum(count))[np.searchsorted(begin, first)]
        if self.runs:
            ids, first = self.join_blanks(ids, first)
        return self.fall_back(ids, first)

    def join_blanks(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of two blanks or more in a text become the pieces that they merge to."""
        blank = np.append(ids == self.runs[1], False)
        more = blank[1:] & blank[:-1]
        more[first[1:][first[1:] > 0] - 1] = False  # a run ends with its text
        inside = np.append(False, more[:-1]) if len(more) else more
        start = np.flatnonzero(more & ~inside)
        if not len(start):
            return ids, first
        end = np.flatnonzero(~more & inside) + 1
        lengths = end - start
        kinds, which = np.unique(lengths, return_inverse=True)
        parts = [self.blanks(n) for n in kinds.tolist()]
        size = np.array(list(map(len, parts)))
        flat = np.array([x for p in parts for x in p], np.int64)
        counts = np.ones(len(ids), np.int64)
        counts[spread(start, lengths)] = 0
        counts[start] = size[which]
        out = np.repeat(ids, counts)
        ends = np.cumsum(counts)
        out[spread(ends[start] - size[which], size[which])] = flat[spread((np.cumsum(size) - size)[which], size[which])]
        return out, np.append(0, ends)[first]

    def fall_back(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no pieces become their bytes."""
        strange = np.flatnonzero(ids >= self.size)
        if not len(strange):
            return ids, first
        kinds, which = np.unique(ids[strange], return_inverse=True)
        parts = [chr(self.points[s - self.size] if s < self.other else s - self.other).encode() for s in kinds.tolist()]
        size = np.array(list(map(len, parts)))
        flat = self.byte[np.frombuffer(b"".join(parts), np.uint8)]
        counts = np.ones(len(ids), np.int64)
        counts[strange] = size[which]
        out, ends = np.repeat(ids, counts), np.cumsum(counts)
        out[spread(ends[strange] - size[which], size[which])] = flat[spread((np.cumsum(size) - size)[which], size[which])]
        return out, np.append(0, ends)[first]

    # Decoding

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes of all texts, where each text's begin) of the ids ``ids[first[t]:first[t + 1]]``."""
        size, begin = self.surface_size[ids], self.surface_begin[ids]
        # The leading blank goes from the first piece of a text that is no control piece.
        said = np.append(np.flatnonzero(~self.silent[ids]), len(ids))
        opens = said[np.searchsorted(said, first[:-1])]
        opens = opens[opens < first[1:]]
        opens = opens[self.leads[ids[opens]]]
        size[opens] -= 1
        begin[opens] += 1
        out = self.surfaces[spread(begin, size)]
        place = np.append(0, np.cumsum(size))[first]
        try:
            out.tobytes().decode()
            return out, place
        except UnicodeDecodeError:
            return self.repaired(ids, first, begin, size)

    def repaired(self, ids: np.ndarray, first: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`decode` for byte pieces that are no UTF-8: each byte outside a character is a replacement character."""
        texts = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            text, k = b"", a
            while k < b:
                end = k + 1
                while end < b and (self.byte_of[ids[end]] >= 0) == (self.byte_of[ids[k]] >= 0):
                    end += 1
                part = self.surfaces[spread(begin[k:end], size[k:end])].tobytes()
                while part:
                    try:
                        text, part = text + part.decode().encode(), b""
                    except UnicodeDecodeError as e:
                        text, part = text + part[: e.start] + "\ufffd".encode(), part[e.start + 1 :]
                k = end
            texts.append(text)
        return np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum(list(map(len, texts)))).astype(np.int64)


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per Python worker."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Rows ``doc_id, ids`` for every row of ``docs(doc_id, text)``: piece ids without begin or end marks."""
    ship(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1), CHUNK_BYTES):
                ids, first = vocabulary(path).encode(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded(doc_id, ids)`` plus ``decoded``, the text of the ids; null ids give an empty text."""
    ship(encoded.sparkSession)
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            flat = lists.flatten()
            i = 0
            while i < len(lists):  # so many rows as hold a chunk's bytes, or one
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1)
                ids = flat.slice(offsets[i], offsets[j] - offsets[i]).to_numpy(zero_copy_only=False)
                data, place = vocabulary(path).decode(ids, offsets[i : j + 1] - offsets[i])
                texts = pa.StringArray.from_buffers(j - i, pa.py_buffer(place.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists.slice(i, j - i), texts], names=["doc_id", "ids", "decoded"])
                i = j

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
