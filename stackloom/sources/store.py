"""Store directories: discovery, the four files, and their writers.

A store holds ``conf`` (``key: value`` lines), ``strmap`` (``<string> <id>``), ``idsmap``
(``<sid>;<sid>; <id>``) and ``stack.bin`` (binary records); the last three may be zstd frames,
many in a row, the last one cut. ``store_id`` is the directory's name, ``host`` the name of the
directory above.

:func:`load_stores` and :func:`write_stores` use Spark's own readers and writers, so they work on
any file system that Spark knows. Files of up to ``SPLIT_BYTES`` are one row of one task each;
larger ones are cut at the marks of records or frames and read by many tasks. The data sources
in ``stackloom.sources.frames`` read ranges of files through an index instead.
"""

from __future__ import annotations

import functools
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from stackloom.functions.frames import LOST_STRING
from stackloom.functions.timefmt import DAY_MS
from stackloom.operators.history import store_time
from stackloom.session import shared_path, stored

FILES = ("conf", "strmap", "idsmap", "stack.bin")
ZSTD = b"\x28\xb5\x2f\xfd"
#: Record layout (fixed values), little endian: mark, start, end, number of entries, entries, end mark.
HEAD, FOOT = b"\xfa\xfb", b"\xfc\xfd"
ENTRY = np.dtype([("id", "<u4"), ("n", "<u8")])
CONF_KEYS = ("cpu_num", "freq", "record_interval", "kernel_version", "hostname", "mode", "env", "version")
BATCH_ENTRIES, READ_BYTES = 1 << 17, 1 << 20
#: Files above this size are cut into pieces; lines or bytes of records that one zstd frame holds when written.
SPLIT_BYTES, FRAME_LINES, FRAME_BYTES = 1 << 26, 1000, 1 << 20
#: A zstd frame that decoders skip, but for its content of one byte, with which Spark's text writer ends a row.
SKIPPED = b"\x50\x2a\x4d\x18\x01\x00\x00\x00"


def file_path() -> Column:
    """The file of a row as it is named; Spark's own column has it as part of a URI."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def literal(path: str) -> str:
    """A path as it is, without patterns."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def located(df: DataFrame, path: str = "path") -> DataFrame:
    return df.withColumn("store_id", F.element_at(F.split(path, "/"), -2)).withColumn("host", F.element_at(F.split(path, "/"), -3)).withColumn("file", F.element_at(F.split(path, "/"), -1))


def discover_stores(spark: SparkSession, root: str) -> DataFrame:
    """``host, store_id, created, bytes`` of every directory that holds all four files; a name without a time counts as newest."""
    files = located(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")).where(F.col("file").isin(*FILES))
    whole = files.groupBy("host", "store_id").agg(F.count_distinct("file").alias("n"), F.sum("length").alias("bytes")).where(f"n = {len(FILES)}")
    return whole.select("host", "store_id", store_time(F.col("store_id")).alias("created"), "bytes")


def read_conf(spark: SparkSession, path: str, reader: DataFrameReader | None = None) -> DataFrame:
    """``host, store_id, raw, cpu_num, freq, record_interval``: split at the first colon, the last of a repeated key counts."""
    # A conf is one row, as a file is, so the order of its lines is known.
    whole = located((reader or spark.read).text(path, wholetext=True).select("value", file_path().alias("path")))
    lines = whole.select("host", "store_id", F.posexplode(F.split("value", "\r?\n")).alias("_n", "value"))
    parts = F.split("value", ":", 2)
    pairs = lines.where(F.col("value").contains(":")).select("host", "store_id", "_n", F.trim(parts[0]).alias("k"), F.trim(parts[1]).alias("v")).where("k <> ''")
    last = pairs.groupBy("host", "store_id", "k").agg(F.max_by("v", "_n").alias("v"))
    raw = last.groupBy("host", "store_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("raw"))
    return raw.select("*", *[F.try_element_at("raw", F.lit(k)).try_cast("int").alias(k) for k in ("cpu_num", "freq", "record_interval")])


def plain(data: io.BufferedIOBase) -> io.BufferedIOBase:
    """The stream itself, or its content if it starts as zstd; a cut last frame just ends it."""
    import zstandard

    start = data.read(4)
    whole = io.BufferedReader(_Joined(start, data))
    return io.BufferedReader(_Forgiving(zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True))) if start == ZSTD else whole


class _Joined(io.RawIOBase):
    def __init__(self, start: bytes, rest):
        self.start, self.rest = start, rest

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        part, self.start = (self.start, b"") if self.start else (self.rest.read(len(into)) or b"", b"")
        into[: len(part)] = part
        return len(part)


class _Forgiving(io.RawIOBase):
    def __init__(self, inner):
        self.inner = inner

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        import zstandard

        try:
            part = self.inner.read(len(into))
        except zstandard.ZstdError:
            part = b""
        into[: len(part)] = part
        return len(part)


def files(spark: SparkSession, path: str, file: str) -> DataFrame:
    """``path, length`` of all files of that name below ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", file).option("recursiveFileLookup", "true").load(path)


def _contents(spark: SparkSession, path: str, file: str, odd: list[str] = ()) -> DataFrame:
    """Whole files as rows: those that are not cut, and those in ``odd``, which cannot be."""
    small = (F.col("length") <= SPLIT_BYTES) | F.col("path").isin(list(odd))
    return located(files(spark, path, file).where(small)).select("host", "store_id", "content")


#: What the last piece of a block may be: a record like all others, one that only the end of a file may follow, or nothing that is a record.
GOES_ON, ENDS, ODD = 0, 1, 2


def frame_content(value: bytes) -> tuple[bytes, int]:
    """(content of a zstd frame without its mark, what may follow): a cut frame ends its file, and what is no frame, as a mark by chance makes, is odd."""
    import zstandard

    reader = zstandard.ZstdDecompressor().decompressobj()
    try:
        data = reader.decompress(ZSTD + value)
    except zstandard.ZstdError:
        return b"", ODD
    if not reader.eof:
        return data, ENDS
    return data, GOES_ON if not reader.unused_data or reader.unused_data == SKIPPED + b"\n" else ODD


def starts_as_zstd(spark: SparkSession, path: str) -> bool:
    """By the first four bytes, which the driver reads through Spark's file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        return stream.readInt() == int.from_bytes(ZSTD, "big")
    finally:
        stream.close()


def _cut(spark: SparkSession, paths: list[str], mark: bytes) -> DataFrame:
    """``path, block, value``: the bytes between marks of the files, in order within a block; blocks are Spark's splits."""
    text = spark.read.option("lineSep", mark.decode("latin-1")).option("encoding", "ISO-8859-1").text([literal(p) for p in paths])
    return text.select(file_path().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _large(spark: SparkSession, path: str, file: str) -> dict[bool, list[str]]:
    """Paths of the files to cut, by whether they are zstd: only their names and first bytes reach the driver."""
    out: dict[bool, list[str]] = {True: [], False: []}
    for r in files(spark, path, file).where(F.col("length") > SPLIT_BYTES).select("path").collect():
        out[starts_as_zstd(spark, r.path)].append(r.path)
    return out


def _whole_lines(spark: SparkSession, path: str, file: str, odd: list[str] = ()) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, store, content in zip(*(c.to_pylist() for c in batch.columns)):
                data, number, rest = plain(io.BytesIO(content)), 0, b""
                while part := data.read(READ_BYTES):
                    whole, mark, rest = (rest + part).rpartition(b"\n")
                    if mark:
                        yield named(host, store, number, whole)
                        number += whole.count(b"\n") + 1
                if rest:
                    yield named(host, store, number, rest)

    def named(host: str, store: str, number: int, data: bytes) -> pa.RecordBatch:
        lines = [line.rstrip("\r") for line in data.decode("utf-8", "replace").split("\n")]
        n = len(lines)
        columns = [pa.array([host] * n, pa.string()), pa.array([store] * n, pa.string()), pa.array(np.arange(number, number + n)), pa.array(lines, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["host", "store_id", "line_no", "line"])

    rows = _contents(spark, path, file, odd).mapInArrow(run, "host string, store_id string, line_no long, line string")
    return rows.select("host", "store_id", F.struct(F.lit(0).cast("long").alias("block"), F.col("line_no").alias("row")).alias("at"), "line")


def _lines(spark: SparkSession, path: str, file: str) -> DataFrame:
    """``host, store_id, at, line``; ``at`` grows with the place in the file."""
    large, odd, parts = _large(spark, path, file), [], []
    at = F.struct("block", F.monotonically_increasing_id().alias("row")).alias("at")
    if large[False]:
        rows = _cut(spark, large[False], b"\n")
        parts.append(located(rows).select("host", "store_id", at, F.rtrim(F.make_valid_utf8(F.col("value").cast("string")), F.lit("\r")).alias("line")))
    if large[True]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path_, block, value in zip(*(c.to_pylist() for c in batch.columns)):
                    content, after = frame_content(value) if value else (b"", GOES_ON)
                    lines = content.split(b"\n")
                    last = lines.pop()
                    found = [line.decode("utf-8", "replace").rstrip("\r") for line in lines] + ([last.decode("utf-8", "replace")] if last else [])
                    found += [None] * (after if not last else after - 1)  # a cut frame counts as an open line, what is no frame as two
                    yield pa.RecordBatch.from_arrays([pa.array([path_] * len(found), pa.string()), pa.array([block] * len(found), pa.int64()), pa.array(found, pa.string()), pa.array([False] * len(lines) + [True] * (len(found) - len(lines)), pa.bool_())], names=["path", "block", "line", "open"])

        rows = stored(_cut(spark, large[True], ZSTD).mapInArrow(run, "path string, block long, line string, open boolean"), "store-lines")
        # A line that no line end closes is the last of its file, or frames do not end with lines there.
        rows = rows.withColumn("at", at)
        last = rows.groupBy("path").agg(F.max("at").alias("last"), F.max(F.when(F.col("open"), F.col("at"))).alias("first_open"), F.count_if("open").alias("n"))
        odd = [r.path for r in last.where("n > 1 or (n = 1 and first_open <> last)").select("path").collect()]
        parts.append(located(rows.where(~F.col("path").isin(odd))).select("host", "store_id", "at", "line"))
    out = _whole_lines(spark, path, file, odd)
    for part in parts:
        out = out.unionByName(part)
    return out


def read_strmap(spark: SparkSession, path: str) -> DataFrame:
    """``host, store_id, sid, str``: split at the last space; bad ids are skipped, of one id the last line counts."""
    # The last word alone meets an expression; one over the whole line costs several times as much.
    last = F.substring_index("line", " ", -1)
    rows = _lines(spark, path, "strmap").where(F.col("line").contains(" ")).select("host", "store_id", "at", F.regexp_extract(last, r"^(\d+)$", 1).try_cast("int").alias("sid"), F.left("line", F.length("line") - F.length(last) - 1).alias("str"))
    return rows.where("sid is not null").groupBy("host", "store_id", "sid").agg(F.max_by("str", "at").alias("str"))


def read_idsmap(spark: SparkSession, path: str) -> DataFrame:
    """``host, store_id, ids_id, sids``: the list before the last space; an empty list is missing."""
    shape = r"^(.*) (\d+)$"
    rows = _lines(spark, path, "idsmap").where(F.col("line").rlike(shape))
    sids = F.transform(F.filter(F.split(F.regexp_extract("line", shape, 1), ";"), lambda x: x != ""), lambda x: x.try_cast("int"))
    rows = rows.select("host", "store_id", "at", F.regexp_extract("line", shape, 2).try_cast("int").alias("ids_id"), sids.alias("sids")).where("ids_id is not null and size(sids) > 0")
    return rows.groupBy("host", "store_id", "ids_id").agg(F.max_by("sids", "at").alias("sids"))


def walk_records(data: io.BufferedIOBase) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """``record_idx, start_ms, end_ms, entries``; ends at the first bad head, fails at a bad foot."""
    index = 0
    while True:
        head = data.read(26)
        if len(head) < 26 or head[:2] != HEAD:
            return
        start, end, n = np.frombuffer(head, "<u8", 3, 2).tolist()
        body = data.read(n * ENTRY.itemsize + 2)
        if len(body) < n * ENTRY.itemsize + 2:
            return
        if body[-2:] != FOOT:
            raise ValueError(f"record {index}: bad end mark")
        yield index, start, end, np.frombuffer(body, ENTRY, n)
        index += 1


ROW_SCHEMA = pa.schema([("record_idx", pa.int64()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("ids_id", pa.int64()), ("count", pa.int64())])


def entry_rows(records: list[tuple[int, int, int, np.ndarray]]) -> list[pa.Array]:
    """Columns of :data:`ROW_SCHEMA`: for each record a row of its own, with id -1 and the number of entries, then its entries."""
    sizes = [len(r[3]) + 1 for r in records]
    ids = [x for r in records for x in (np.array([-1]), r[3]["id"].astype(np.int64))]
    counts = [x for r in records for x in (np.array([len(r[3])]), r[3]["n"].astype(np.int64))]
    return [pa.array(np.repeat(np.array([r[k] for r in records], np.int64), sizes)) for k in range(3)] + [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (ids, counts)]


def _walked(spark: SparkSession, path: str, odd: list[str]) -> DataFrame:
    """Whole files, each walked by one task: ``host, store_id, record_idx, .., count`` as in :func:`entry_rows`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, store, content in zip(*(c.to_pylist() for c in batch.columns)):
                held, size = [], 0
                for record in walk_records(plain(io.BytesIO(content))):
                    held.append(record)
                    size += len(record[3]) + 1
                    if size > BATCH_ENTRIES:
                        yield named(host, store, held)
                        held, size = [], 0
                yield named(host, store, held)

    def named(host: str, store: str, records: list) -> pa.RecordBatch:
        columns = entry_rows(records)
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.array([host] * n, pa.string()), pa.array([store] * n, pa.string()), *columns], names=["host", "store_id", *ROW_SCHEMA.names])

    return _contents(spark, path, "stack.bin", odd).mapInArrow(run, "host string, store_id string, record_idx long, start_ms long, end_ms long, ids_id long, count long")


def piece_records(value: bytes, packed: bool, first: bool) -> tuple[list[tuple[int, int, np.ndarray]], int]:
    """(records of one piece of a cut file, what may follow).

    A piece of a plain file lies between an end mark with the next record's mark; ``first`` is
    the one at the file's start. A piece of a packed file is a frame without its mark.
    """
    if packed:
        if not value:
            return [], GOES_ON if first else ODD
        data, after = frame_content(value)
        found, at = [], 0
        while data[at : at + 2] == HEAD and len(data) >= at + 26:
            start, end, n = np.frombuffer(data, "<u8", 3, at + 2).tolist()
            stop = at + 26 + n * ENTRY.itemsize
            if data[stop : stop + 2] != FOOT:
                break
            found.append((start, end, np.frombuffer(data, ENTRY, n, at + 26)))
            at = stop + 2
        rest = data[at:]
        cut = len(rest) < 26 or len(rest) < 28 + ENTRY.itemsize * int(np.frombuffer(rest, "<u8", 1, 18)[0])
        return found, after if not rest or after == ODD else ENDS if rest[:2] == HEAD[: len(rest)] and cut else ODD
    if first:
        if value[:2] != HEAD[: len(value)]:
            return [], ODD
        value = value[2:]
    if len(value) < 24:
        return [], ENDS
    start, end, n = np.frombuffer(value, "<u8", 3).tolist()
    more = len(value) - 24 - n * ENTRY.itemsize
    if more < 2 and more != 0:
        return [], ENDS
    if more > 2 or more == 2 and value[-2:] != FOOT:
        return [], ODD
    return [(start, end, np.frombuffer(value, ENTRY, n, 24))], ENDS if more else GOES_ON


def _pieced(spark: SparkSession, paths: list[str], packed: bool) -> tuple[DataFrame | None, list[str]]:
    """(rows of the cut files, paths of those that cannot be cut).

    Record numbers count within a block and are moved by the records of earlier blocks. Marks
    can also stand inside a record by chance, or a record can lie in two frames; then a piece
    is no record, and its file is left to be read whole.
    """
    if not paths:
        return None, []
    names = ["path", "block", *ROW_SCHEMA.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, n, ends, held, size = None, 0, GOES_ON, [], 0

        def rows() -> pa.RecordBatch:
            columns = entry_rows(held)
            k = len(columns[0])
            return pa.RecordBatch.from_arrays([pa.array([place[0]] * k, pa.string()), pa.array([place[1]] * k, pa.int64()), *columns], names=names)

        def closing() -> pa.RecordBatch:  # a row with id -2: records of the block, and how it ends
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*place, n, 0, 0, -2, ends), (pa.string(), *[pa.int64()] * 6))], names=names)

        for batch in batches:
            for path, block, value in zip(*(c.to_pylist() for c in batch.columns)):
                if (path, block) != place:
                    if place:
                        yield rows()
                        yield closing()
                    place, n, ends, held, size, first = (path, block), 0, GOES_ON, [], 0, block == 0
                found, after = piece_records(value, packed, first)
                ends = ODD if ends != GOES_ON else after  # nothing may follow an end
                first = False
                for start, end, entries in found:
                    held.append((n, start, end, entries))
                    n, size = n + 1, size + len(entries) + 1
                if size > BATCH_ENTRIES:
                    yield rows()
                    held, size = [], 0
        if place:
            yield rows()
            yield closing()

    mark = ZSTD if packed else FOOT + HEAD
    found = stored(_cut(spark, paths, mark).mapInArrow(run, "path string, block long, record_idx long, start_ms long, end_ms long, ids_id long, count long"), "stack-pieces")
    w = Window.partitionBy("path").orderBy("block")  # one row per block of a file
    blocks = found.where("ids_id = -2").select("path", "block", "record_idx", F.col("count").alias("ends"))
    blocks = blocks.select("path", "block", "ends", F.coalesce(F.sum("record_idx").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lead("block").over(w).isNull().alias("last"))
    blocks = stored(blocks, "stack-blocks")
    odd = [r.path for r in blocks.where(f"ends = {ODD} or (ends = {ENDS} and not last)").select("path").distinct().collect()]
    rows = found.where(F.col("ids_id") > -2).where(~F.col("path").isin(odd)).join(blocks.select("path", "block", "before"), ["path", "block"])
    rows = located(rows.withColumn("record_idx", F.col("record_idx") + F.col("before")))
    return rows.select("host", "store_id", *ROW_SCHEMA.names), odd


def read_stack_bin(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(records, stack_counts)``: ``host, store_id, record_idx, start_ms, end_ms, entry_len`` and ``.., record_idx, ids_id, count``."""
    large, parts, odd = _large(spark, path, "stack.bin"), [], []
    for packed, paths in large.items():
        rows, left = _pieced(spark, paths, packed)
        parts += [] if rows is None else [rows]
        odd += left
    rows = _walked(spark, path, odd)
    for part in parts:
        rows = rows.unionByName(part)
    rows = stored(rows, "stack-bin")  # files are read once for both results
    index = F.col("record_idx").cast("int").alias("record_idx")
    records = rows.where("ids_id = -1").select("host", "store_id", index, "start_ms", "end_ms", F.col("count").alias("entry_len"))
    return records, rows.where("ids_id <> -1").select("host", "store_id", index, F.col("ids_id").cast("int").alias("ids_id"), "count")


@dataclass
class Stores:
    """Tables of any number of stores; ids and record numbers hold within ``host, store_id``."""

    conf: DataFrame
    strmap: DataFrame
    idsmap: DataFrame
    records: DataFrame
    counts: DataFrame


def load_conf(spark: SparkSession, path: str) -> DataFrame:
    """The ``conf`` of all stores below ``path``."""
    return read_conf(spark, path, spark.read.option("pathGlobFilter", "conf").option("recursiveFileLookup", "true"))


def load_stores(spark: SparkSession, path: str) -> Stores:
    """All stores below ``path`` (a folder of hosts, of stores, or one store; globs are allowed). Each file is read once, whatever uses the tables."""
    strmap, idsmap = stored(read_strmap(spark, path), "strmap"), stored(read_idsmap(spark, path), "idsmap")
    return Stores(load_conf(spark, path), strmap, idsmap, *read_stack_bin(spark, path))


def record_bytes(start_ms: int, end_ms: int, entries: list[tuple[int, int]]) -> bytes:
    return HEAD + np.array([start_ms, end_ms, len(entries)], "<u8").tobytes() + np.array(entries, ENTRY).tobytes() + FOOT


def with_guards(records: DataFrame) -> DataFrame:
    """``records`` plus a guard after each store's last record: no entries, start and end at its end. None is written after 24 hours."""
    last = records.groupBy("host", "store_id").agg(F.max("record_idx").alias("record_idx"), F.max_by("end_ms", "record_idx").alias("end_ms")).where(F.col("end_ms") < DAY_MS)
    kinds = {f.name: f.dataType for f in records.schema}
    guard = {"record_idx": F.col("record_idx") + 1, "start_ms": F.col("end_ms"), "entry_len": F.lit(0)}
    return records.unionByName(last.select(*[guard.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in records.columns]))


def packed_rows(rows: DataFrame, zstd: bool) -> DataFrame:
    """``rows(host, store_id, file, at, piece)``, dealt by file and sorted, as ``.., at, value``: what Spark's text writer makes the file's bytes of.

    The writer ends a row with a line feed. Of a plain file the pieces are lines without theirs;
    of a packed one a value is a frame of several pieces, followed by one that decoders skip, whose
    content is that line feed. A task holds one frame at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        held, size, place = [], 0, None

        def frame() -> pa.RecordBatch:
            value = zstandard.ZstdCompressor().compress(b"".join(held)) + SKIPPED
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*place, value), (*[pa.string()] * 3, pa.int64(), pa.binary()))], names=["host", "store_id", "file", "at", "value"])

        for batch in batches:
            for host, store, file, at, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if held and ((host, store, file) != place[:3] or size >= FRAME_BYTES or len(held) >= FRAME_LINES):
                    yield frame()
                    held, size = [], 0
                if not held:
                    place = (host, store, file, at)
                held.append(piece)
                size += len(piece)
        if held:
            yield frame()

    rows = rows.select("host", "store_id", "file", "at", "piece")
    return rows.mapInArrow(run, "host string, store_id string, file string, at long, value binary") if zstd else rows.withColumnRenamed("piece", "value")


def written_records(records: DataFrame, counts: DataFrame) -> DataFrame:
    """``host, store_id, record_idx, raw``: each record's bytes, its entries in order of their ids."""
    keys = ["host", "store_id", "record_idx"]
    entries = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("ids_id").cast("long").alias("id"), F.col("count").alias("n")))).alias("entries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for start, end, own in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)):
                table = np.zeros(len(own) if own.is_valid else 0, ENTRY)
                if len(table):
                    table["id"], table["n"] = (own.values.field(k).to_numpy() for k in ("id", "n"))
                raw.append(HEAD + np.array([start, end, len(table)], "<u8").tobytes() + table.tobytes() + FOOT)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raw, pa.binary())], names=[*keys, "raw"])

    return records.select(*keys, "start_ms", "end_ms").join(entries, keys, "left").mapInArrow(run, "host string, store_id string, record_idx int, raw binary")


def write_stores(stores: Stores, path: str, zstd: bool | Column = True) -> None:
    """The four files of each store below ``path/host/store_id``, on any file system that Spark writes; ``zstd`` may be a condition on ``host, store_id``.

    Spark's text writer makes the files in a folder beside them, one task per file with its rows
    sorted and streamed; its committer sees to lost and repeated tasks. Stores are dealt to as many
    tasks as shuffles have, however few bytes they are, as each file takes its time. Each kind of
    file is a job; with a condition, all kinds whose rows end alike are one. Only when all are there the driver renames them into
    place. If the job fails, nothing is left.
    """
    keys = ["host", "store_id"]
    spark = stores.conf.sparkSession
    conf = stores.conf.select(*keys, F.posexplode(conf_pairs(F.col("raw"))).alias("at", "line"))
    strings = stores.strmap.select(*keys, F.col("sid").alias("at"), F.concat("str", F.lit(" "), F.col("sid").cast("string")).alias("line"))
    stacks = stores.idsmap.select(*keys, F.col("ids_id").alias("at"), F.concat(F.array_join(F.col("sids").cast("array<string>"), ";"), F.lit("; "), F.col("ids_id").cast("string")).alias("line"))
    packed = F.lit(zstd) if isinstance(zstd, bool) else F.coalesce(zstd, F.lit(False))

    def pieces(df: DataFrame, file: str, piece: Column) -> DataFrame:
        return df.select(*keys, F.lit(file).alias("file"), F.col("at").cast("long").alias("at"), piece.alias("piece"))

    def lines(df: DataFrame, file: str, end: str = "") -> DataFrame:
        return pieces(df, file, F.concat("line", F.lit(end)).cast("binary"))

    def records(chosen: Column, piece: str) -> DataFrame:
        rows = written_records(stores.records.where(chosen), stores.counts.where(chosen)).withColumnRenamed("record_idx", "at")
        return pieces(rows, "stack.bin", F.expr(piece))

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    order = [*keys, "file", "at"]

    def dealt(rows: DataFrame, zstd: bool) -> DataFrame:
        return packed_rows(rows.repartition(tasks, *keys, "file").sortWithinPartitions(*order), zstd)

    staged = f"{path}/.writing-{shared_path(spark, 'x').rpartition('-')[2]}"
    listed = [(strings, "strmap"), (stacks, "idsmap")]
    jobs = {"\n": [dealt(lines(conf, "conf"), False)]}
    if zstd is True:
        jobs["\n"] += [dealt(rows, True) for rows in (*[lines(df, file, "\n") for df, file in listed], records(packed, "raw"))]
    elif zstd is False:
        jobs["\n"] += [dealt(lines(df, file), False) for df, file in listed]
    else:
        of_lines = [lines(df.where(packed), file, "\n") for df, file in listed]
        jobs["\n"].append(dealt(of_lines[0].unionByName(of_lines[1]).unionByName(records(packed, "raw")), True))
        of_lines = [lines(df.where(~packed), file) for df, file in listed]
        jobs["\n"].append(dealt(of_lines[0].unionByName(of_lines[1]), False))
    if zstd is not True:
        # A plain record's last byte is what the writer ends the row with.
        jobs[FOOT[-1:].decode("latin-1")] = [dealt(records(~packed, "substring(raw, 1, length(raw) - 1)"), False)]
    try:
        for end, parts in jobs.items():
            for rows in parts if isinstance(zstd, bool) else [functools.reduce(DataFrame.unionByName, parts)]:
                values = rows.sortWithinPartitions(*order).select(*keys, "file", F.col("value").cast("string").alias("value"))
                values.write.partitionBy(*keys, "file").option("lineSep", end).option("encoding", "ISO-8859-1").mode("append").text(staged)
        _put_in_place(spark, staged, path)
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(staged)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _put_in_place(spark: SparkSession, staged: str, path: str) -> None:
    """Renames ``staged/host=../store_id=../file=../part-..`` to ``path/host/store_id/file``, several at a time; replaces files that are there."""
    from concurrent.futures import ThreadPoolExecutor
    from urllib.parse import unquote

    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(staged)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    moves = {}
    for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{staged}/*/*/*/part-*")) or []:  # listFiles would ask for each file's owner and place
        at = found.getPath().toString()
        host, store, file = (unquote(p.partition("=")[2]) for p in at.split("/")[-4:-1])
        moves.setdefault(f"{path}/{host}/{store}", []).append((at, file))

    def move(folder: str) -> None:
        place = jvm.org.apache.hadoop.fs.Path(folder)
        old = fs.exists(place)
        if not old:
            fs.mkdirs(place)
        for at, file in moves[folder]:
            target = jvm.org.apache.hadoop.fs.Path(place, file)
            if old:
                fs.delete(target, False)
            if not fs.rename(jvm.org.apache.hadoop.fs.Path(at), target):
                raise OSError(f"cannot rename {at} to {folder}/{file}")

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(move, moves))


def conf_pairs(raw: Column) -> Column:
    """The lines of the known keys of a conf map, in fixed order."""
    return F.filter(F.array(*[F.concat(F.lit(f"{k}: "), F.try_element_at(raw, F.lit(k))) for k in CONF_KEYS]), lambda x: x.isNotNull())


def conf_lines(conf: DataFrame) -> DataFrame:
    """``value``: the known keys of ``conf(raw)`` in fixed order."""
    return conf.select(F.explode(conf_pairs(F.col("raw"))).alias("value"))


def write_tables(strmap: DataFrame, idsmap: DataFrame, records: DataFrame, counts: DataFrame, path: str) -> None:
    """The store as Parquet tables, partitioned by host; appended to, so that a delta can be written per interval."""
    for name, df in (("strmap", strmap), ("idsmap", idsmap), ("records", records), ("stack_counts", counts)):
        df.write.mode("append").partitionBy("host").parquet(f"{path}/{name}")


def split_store(records: DataFrame, counts: DataFrame, idsmap: DataFrame, strmap: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(strmap, idsmap, stack_counts)`` of the chosen ``records`` with fresh compact ids per store.

    Entries of unknown stacks are dropped, unknown strings replaced by a marker.
    """
    keys = ["host", "store_id"]
    kept = stored(counts.join(records.select(*keys, "record_idx"), [*keys, "record_idx"], "left_semi").join(idsmap.select(*keys, "ids_id"), [*keys, "ids_id"], "left_semi"), "split-counts")
    stacks = idsmap.join(kept.select(*keys, "ids_id").distinct(), [*keys, "ids_id"])
    parts = stacks.select(*keys, "ids_id", F.posexplode("sids").alias("pos", "sid")).join(strmap, [*keys, "sid"], "left").withColumn("str", F.coalesce("str", F.lit(LOST_STRING)))
    strings = parts.groupBy(*keys, "str").agg(F.min("sid").alias("_s")).withColumn("new_sid", F.row_number().over(Window.partitionBy(*keys).orderBy("_s", "str"))).drop("_s")
    strings = stored(strings, "split-strings")
    listed = parts.join(strings, [*keys, "str"]).groupBy(*keys, "ids_id").agg(F.sort_array(F.collect_list(F.struct("pos", "new_sid")))["new_sid"].alias("sids"))
    listed = stored(listed.withColumn("new_id", F.row_number().over(Window.partitionBy(*keys).orderBy("ids_id"))), "split-stacks")
    renumbered = kept.join(listed.select(*keys, "ids_id", "new_id"), [*keys, "ids_id"]).select(*keys, "record_idx", F.col("new_id").alias("ids_id"), "count")
    return strings.select(*keys, F.col("new_sid").alias("sid"), "str"), listed.select(*keys, F.col("new_id").alias("ids_id"), "sids"), renumbered
