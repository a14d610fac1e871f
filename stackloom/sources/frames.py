"""Data sources of store folders: ranges of ``stack.bin`` files by an index, and a stream that follows growing ones.

A file is a row of chunks: the frames of a packed file, or runs of records of a plain one. The
index has one row per chunk with its place, its first record's number and its times; it is made
by a Spark job (one task per file) and kept as a Parquet table. Reading goes through the index:
filters on host, store and time leave out chunks before anything is read, and chunks of one file
go to many tasks.

Executors open the files themselves, by any file system of Arrow (local, S3, GCS, HDFS with its
native library). ``stackloom.sources.store`` reads what only Spark can open.
"""

from __future__ import annotations

import fnmatch
import io
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from stackloom.session import ship
from stackloom.sources.store import ENTRY, FILES, FOOT, HEAD, ZSTD, plain

#: Bytes of chunks that one task reads, and of records that a chunk of a plain file holds.
TASK_BYTES, CHUNK_BYTES = 1 << 26, 1 << 22
#: Bytes that opening a file counts as, and the tasks that many small files are dealt to unless an option says otherwise.
OPEN_BYTES, TASKS = 1 << 16, 200
ENTRIES = "host string, store_id string, record_idx int, start_ms bigint, end_ms bigint, ids_id int, count bigint"
INDEX = "host string, store_id string, path string, packed boolean, at bigint, bytes bigint, first_record bigint, records bigint, first_ms bigint, last_ms bigint"


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and the path within it; an error names a scheme that Arrow does not know."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return pyarrow.fs.LocalFileSystem(), path
    try:
        return pyarrow.fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as e:
        raise ValueError(f"{path}: executors cannot open this file system; read it by stackloom.sources.store.load_stores") from e


def store_folders(path: str) -> dict[str, int]:
    """The folders below ``path`` (which may hold globs in its names) that have all four files, in order, and the bytes of their records."""
    fs, root = opened(path)
    fixed = root.rstrip("/")
    while any(c in fixed for c in "*?["):
        fixed = fixed.rpartition("/")[0]
    found: dict[str, dict[str, int]] = {}
    for f in fs.get_file_info(pyarrow.fs.FileSelector(fixed, recursive=True)):
        folder, _, name = f.path.rpartition("/")
        if name in FILES:
            found.setdefault(folder, {})[name] = f.size or 0
    wanted = root.rstrip("/").split("/")

    def below(folder: str) -> bool:
        names = folder.split("/")
        return len(names) >= len(wanted) and all(fnmatch.fnmatchcase(a, b) for a, b in zip(names, wanted))

    return {f: names["stack.bin"] for f, names in sorted(found.items()) if len(names) == len(FILES) and below(f)}


def grouped(sized: list[tuple], tasks: int) -> list[list]:
    """The things of ``(thing, bytes)`` in groups of neighbours, one per task: about ``tasks`` of equal bytes, or more where that would be above ``TASK_BYTES``.

    A file counts as ``OPEN_BYTES`` more than it holds, for the time that opening it takes. There is always one group.
    """
    most = min(TASK_BYTES, -(-sum(n + OPEN_BYTES for _, n in sized) // max(tasks, 1)))
    groups, size = [[]], 0
    for thing, n in sized:
        if groups[-1] and size + n + OPEN_BYTES > most:
            groups.append([])
            size = 0
        groups[-1].append(thing)
        size += n + OPEN_BYTES
    return groups


def task_number(spark: SparkSession) -> int:
    """How many tasks many small files are dealt to."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def frame_ends(f: pa.NativeFile, at: int, size: int) -> Iterator[int]:
    """Where the zstd frames from ``at`` on end, by the headers of their blocks; a cut last frame has no end."""
    while at + 5 <= size:
        f.seek(at)
        head = f.read(18)
        if head[:4] != ZSTD:
            if head[1:4] != b"\x2a\x4d\x18" or len(head) < 8:
                return  # neither a frame nor one to skip
            at += 8 + int.from_bytes(head[4:8], "little")
            if at > size:
                return
            yield at
            continue
        flags = head[4]
        single = flags >> 5 & 1
        at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
        last = 0
        while not last:
            if at + 3 > size:
                return
            f.seek(at)
            block = int.from_bytes(f.read(3), "little")
            last, kind = block & 1, block >> 1 & 3
            at += 3 + (1 if kind == 1 else block >> 3)
        at += 4 * (flags >> 2 & 1)
        if at > size:
            return
        yield at


def walked(data: bytes) -> tuple[list[tuple[int, int, np.ndarray]], int]:
    """(whole records at the start of ``data``, the bytes they take); a bad end mark is an error."""
    found, at = [], 0
    while data[at : at + 2] == HEAD and len(data) >= at + 26:
        start, end, n = np.frombuffer(data, "<u8", 3, at + 2).tolist()
        stop = at + 28 + n * ENTRY.itemsize
        if len(data) < stop:
            break
        if data[stop - 2 : stop] != FOOT:
            raise ValueError(f"record {len(found)} of the chunk: bad end mark")
        found.append((start, end, np.frombuffer(data, ENTRY, n, at + 26)))
        at = stop
    return found, at


def chunks_of(f: pa.NativeFile, size: int, at: int = 0, packed: bool | None = None) -> Iterator[tuple[bool, int, int, list[tuple[int, int, np.ndarray]]]]:
    """``(packed, at, bytes, records)`` of the file from ``at`` on, one chunk in memory.

    A chunk of a packed file is as many frames as end with a whole record, mostly one. The walk
    ends at a cut tail or the first bad head.
    """
    f.seek(0)
    packed = f.read(4) == ZSTD if packed is None else packed
    if packed:
        begin = at
        for end in frame_ends(f, at, size):
            f.seek(begin)
            data = plain(io.BytesIO(f.read(end - begin))).read()
            records, used = walked(data)
            if used == len(data):
                yield True, begin, end - begin, records
                begin = end
            elif data[used : used + 2] != HEAD[: len(data) - used]:
                if records:
                    yield True, begin, end - begin, records
                return
        return
    while at < size:
        want = CHUNK_BYTES
        while True:
            f.seek(at)
            data = f.read(want)
            records, used = walked(data)
            if records or at + len(data) >= size or data[:2] != HEAD or len(data) < 26:
                break
            want = 28 + ENTRY.itemsize * int(np.frombuffer(data, "<u8", 1, 18)[0])  # one record above the size of a chunk
            if at + want > size:
                return
        if not records:
            return
        yield False, at, used, records
        at += used


class FrameIndex(DataSource):
    """``spark.read.format("profile_frames").load(path)``: the index of the ``stack.bin`` files below ``path``, small files together in at most about ``tasks`` tasks."""

    @classmethod
    def name(cls) -> str:
        return "profile_frames"

    def schema(self) -> str:
        return INDEX

    def reader(self, schema) -> DataSourceReader:
        return FrameIndexReader(self.options["path"], int(self.options.get("tasks", TASKS)))


class FrameIndexReader(DataSourceReader):
    def __init__(self, path: str, tasks: int):
        self.path, self.tasks = path, tasks

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(group) for group in grouped(list(store_folders(self.path).items()), self.tasks)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, _ = opened(self.path)
        for folder in partition.value:
            host, store = folder.rsplit("/", 2)[1:]
            path, number = f"{folder}/stack.bin", 0
            with fs.open_input_file(path) as f:
                for packed, at, size, records in chunks_of(f, f.size()):
                    times = [r[0] for r in records], [r[1] for r in records]
                    yield host, store, path, packed, at, size, number, len(records), min(times[0], default=None), max(times[1], default=None)
                    number += len(records)


def write_index(spark: SparkSession, path: str, index: str) -> None:
    """Indexes all stores below ``path`` into the Parquet table ``index``."""
    ship(spark)
    spark.dataSource.register(FrameIndex)
    spark.read.format("profile_frames").option("tasks", task_number(spark)).load(path).write.mode("overwrite").parquet(index)


class StoreSource(DataSource):
    """``spark.read.format("profile_store").option("index", index).load(path)``: entries of all records of the stores below ``path``.

    Without an index a file is walked from its start by one task. Small files, or their chunks, go together in at most about ``tasks`` tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "profile_store"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> DataSourceReader:
        return StoreReader(self.options["path"], self.options.get("index"), int(self.options.get("tasks", TASKS)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StoreTail(self.options["path"], self.options.get("guarded") == "true")


class StoreReader(DataSourceReader):
    def __init__(self, path: str, index: str | None, tasks: int = TASKS):
        self.path, self.index, self.tasks, self.filters = path, index, tasks, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on host, store and times choose chunks; Spark still applies them all to the rows."""
        self.filters = [(f.attribute[0], f) for f in filters if isinstance(f, (EqualTo, In, LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)) and f.attribute[0] in ("host", "store_id", "start_ms", "end_ms")]
        yield from filters

    def wanted(self) -> ds.Expression | None:
        """Which rows of the index can hold rows that pass the filters; times lie between a chunk's first and last."""
        found = None
        for name, f in self.filters:
            low, high = (ds.field(name),) * 2 if name in ("host", "store_id") else (ds.field("first_ms"), ds.field("last_ms"))
            if isinstance(f, EqualTo):
                one = (low <= f.value) & (high >= f.value)
            elif isinstance(f, In):
                values = list(f.value)
                one = low.isin(values) if name in ("host", "store_id") else (low <= max(values)) & (high >= min(values))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                one = low < f.value if isinstance(f, LessThan) else low <= f.value
            else:
                one = high > f.value if isinstance(f, GreaterThan) else high >= f.value
            found = one if found is None else found & one
        return found

    def partitions(self) -> list[InputPartition]:
        if self.index is None:
            kept = {name: f for name, f in self.filters if isinstance(f, EqualTo) and name in ("host", "store_id")}
            folders = [(f, n) for f, n in store_folders(self.path).items() if all(f.rsplit("/", 2)[1 if k == "host" else 2] == x.value for k, x in kept.items())]
            return [InputPartition((None, group)) for group in grouped([(f"{f}/stack.bin", n) for f, n in folders], self.tasks)]
        fs, where = opened(self.index)
        rows = ds.dataset(where, filesystem=fs, format="parquet").to_table(columns=["path", "packed", "at", "bytes", "first_record"], filter=self.wanted()).sort_by([("path", "ascending"), ("at", "ascending")])
        runs: list[tuple[list, int]] = []  # chunks of one file that one task reads, and their bytes
        for chunk in zip(*(c.to_pylist() for c in rows.columns)):
            if not runs or runs[-1][0][-1][0] != chunk[0] or runs[-1][1] + chunk[3] > TASK_BYTES:
                runs.append(([], 0))
            runs[-1][0].append(chunk)
            runs[-1] = runs[-1][0], runs[-1][1] + chunk[3]
        return [InputPartition((self.index, [chunk for run in group for chunk in run])) for group in grouped(runs, self.tasks)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        """A batch per record."""
        (index, places), (fs, _) = partition.value, opened(self.path)
        if index is None:
            for path in places:
                number = 0
                with fs.open_input_file(path) as f:
                    for *_, records in chunks_of(f, f.size()):
                        yield from batches(path, number, records)
                        number += len(records)
            return
        for path, chunks in itertools.groupby(places, lambda chunk: chunk[0]):
            with fs.open_input_file(path) as f:
                for _, packed, at, size, first in chunks:
                    f.seek(at)
                    data = f.read(size)
                    yield from batches(path, first, walked(plain(io.BytesIO(data)).read() if packed else data)[0])


def batches(path: str, number: int, records: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Entries of records that count from ``number``."""
    host, store = path.rsplit("/", 3)[1:3]
    for i, (start, end, entries) in enumerate(records, number):
        n = len(entries)
        columns = [pa.array([host] * n, pa.string()), pa.array([store] * n, pa.string()), pa.array(np.full(n, i, np.int32)), pa.array(np.full(n, start)), pa.array(np.full(n, end)), pa.array(entries["id"].astype(np.int32)), pa.array(entries["n"].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ENTRIES.split(", ")])


class StoreTail(DataSourceStreamReader):
    """``spark.readStream.format("profile_store").load(path)``: records that are appended to the stores below ``path``, once each.

    The offset is, per store, how many bytes of the file have been read and the records in them.
    A batch goes up to the last whole record that was there when it was planned; a frame or
    record that is cut then waits for its rest. Files that have not grown are not opened. With the option ``guarded`` the records after a
    store's last guard wait, too, as a guard says that those before it are complete.
    """

    def __init__(self, path: str, guarded: bool = False):
        self.path, self.guarded = path, guarded
        self.planned: dict[str, list[int]] = {}
        self.sizes: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"stores": {}}

    def latestOffset(self) -> dict:
        fs, _ = opened(self.path)
        for folder, size in store_folders(self.path).items():
            at, number = self.planned.get(folder, [0, 0])
            if size == at or size == self.sizes.get(folder):
                continue  # nothing new since the last look
            self.sizes[folder] = size
            with fs.open_input_file(f"{folder}/stack.bin") as f:
                done, count = at, number
                for packed, begin, size, records in chunks_of(f, f.size(), at):
                    last = len(records)
                    while self.guarded and last and (records[last - 1][0] != records[last - 1][1] or len(records[last - 1][2])):
                        last = 0 if packed else last - 1  # a frame is read as a whole
                    if last:
                        done, number = begin + (size if last == len(records) else sum(28 + len(e) * ENTRY.itemsize for *_, e in records[:last])), count + last
                    count += len(records)
            self.planned[folder] = [done, number]
        return {"stores": {f: f"{a} {n}" for f, (a, n) in self.planned.items()}}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before = {f: list(map(int, v.split())) for f, v in start["stores"].items()}
        after = {f: list(map(int, v.split())) for f, v in end["stores"].items()}
        for f, v in after.items():  # after a restart planning goes on from the checkpoint
            self.planned[f] = max(self.planned.get(f, [0, 0]), v)
        return [InputPartition((f, before.get(f, [0, 0]), v)) for f, v in after.items() if v > before.get(f, [0, 0])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        folder, (at, number), (end, _) = partition.value
        fs, _ = opened(self.path)
        with fs.open_input_file(f"{folder}/stack.bin") as f:
            for *_, records in chunks_of(f, end, at):
                yield from batches(f"{folder}/stack.bin", number, records)
                number += len(records)


def read_stores(spark: SparkSession, path: str, index: str | None = None) -> DataFrame:
    """Entries of the stores below ``path``; with an index only chunks that filters on host, store and times let through are read."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoreSource)
    reader = spark.read.format("profile_store").option("tasks", task_number(spark))
    return (reader.option("index", index) if index else reader).load(path)


def tail_stores(spark: SparkSession, path: str, guarded: bool = False) -> DataFrame:
    """A stream of the entries that the stores below ``path`` get."""
    ship(spark)
    spark.dataSource.register(StoreSource)
    return spark.readStream.format("profile_store").option("guarded", str(guarded).lower()).load(path)
