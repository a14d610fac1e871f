"""Stores as Parquet tables that intervals are appended to, each exactly once.

Tables are partitioned by day; a day's files are cut by size and ordered by host, so a filter on
hosts passes over row groups by their statistics, and the number of files grows with the data, not
with the hosts. A batch is written beside them by Spark, then its files are renamed into the
partitions under names that begin with the batch. A ledger has two marks
per batch: its *intent*, with the partitions it goes to, before the first rename, and *done*
after the last. A batch that is done is skipped when it comes again. One that has an intent
alone was interrupted: its files are removed from the partitions of the intent and it is
written anew. Readers leave out files of batches that are not done. So a job that dies at any
point and is repeated, as Structured Streaming does with a micro-batch, leaves each row once.

What a batch is compared with are only the partitions of its own days, and the rows of its hosts there.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackloom.operators.dictionary import merge_ids
from stackloom.operators.history import store_time
from stackloom.session import stored
from stackloom.sources.store import Stores

KEYS = ["host", "store_id"]
#: Files renamed at a time, and tasks per core that list folders.
MOVES, LISTS = 16, 4
SCHEMAS = {
    "strmap": "host string, store_id string, sid int, str string",
    "idsmap": "host string, store_id string, ids_id int, sids array<int>",
    "records": "host string, store_id string, record_idx int, start_ms bigint, end_ms bigint, entry_len bigint",
    "stack_counts": "host string, store_id string, record_idx int, ids_id int, count bigint",
}


def day_of(store_id: Column) -> Column:
    """The day in a store's name; ``none`` where it has none."""
    return F.coalesce(F.date_format(store_time(store_id), "yyyy-MM-dd"), F.lit("none"))


class Ledger:
    """The two marks of each batch at ``path/_ledger``, as small files on any file system of Spark."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.jvm_path = spark._jvm.org.apache.hadoop.fs.Path  # looked up once: each name on the way is a call
        self.fs = self.place("").getFileSystem(spark._jsc.hadoopConfiguration())

    def place(self, name: str):
        return self.jvm_path(f"{self.path}/{name}" if name else self.path)

    def has(self, batch: str, mark: str) -> bool:
        return self.fs.exists(self.place(f"_ledger/{batch}.{mark}"))

    def write(self, batch: str, mark: str, content: dict) -> None:
        """Renamed into place, so that a mark is there in full or not at all."""
        half, whole = self.place(f"_ledger/.{batch}.{mark}.{uuid.uuid4().hex}"), self.place(f"_ledger/{batch}.{mark}")
        stream = self.fs.create(half, True)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        self.fs.delete(whole, False)
        self.fs.rename(half, whole)

    def read(self, batch: str, mark: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/_ledger/{batch}.{mark}", wholetext=True).first().value)

    def open_batches(self) -> list[str]:
        """Batches with an intent alone."""
        if not self.fs.exists(self.place("_ledger")):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self.place("_ledger"))]
        done = {n.removesuffix(".done") for n in names if n.endswith(".done")}
        return sorted(b for n in names if n.endswith(".intent") and not n.startswith(".") and (b := n.removesuffix(".intent")) not in done)


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Many folders are listed by some tasks per core, not by a task each."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), LISTS * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``host, .., day`` of one table, without the files of batches that are not done; a table that is not there is empty."""
    ledger = Ledger(spark, path)
    schema = f"{SCHEMAS[name]}, day string"
    if not ledger.fs.exists(ledger.place(name)):
        return spark.createDataFrame([], schema)
    with few_listing_tasks(spark):
        rows = spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    for batch in ledger.open_batches():
        rows = rows.where(~F.col("_metadata.file_name").startswith(f"{batch}-"))
    return rows


def read_tables(spark: SparkSession, path: str) -> Stores:
    """The tables as :class:`Stores`, without ``conf``."""
    return Stores(None, *[read_table(spark, path, n).drop("day") for n in SCHEMAS])


def commit(spark: SparkSession, path: str, batch: str, tables: dict[str, DataFrame]) -> bool:
    """Adds ``tables(host, store_id, ..)`` as one batch; whether it was not done before.

    Tables are written at the same time and files renamed several at a time, so neither a small table of
    many days nor the number of files holds the others up.
    """
    if not re.fullmatch(r"[A-Za-z0-9_]+", batch):
        raise ValueError(f"{batch}: letters, digits and _ only")
    ledger = Ledger(spark, path)
    if ledger.has(batch, "done"):
        return False
    if ledger.has(batch, "intent"):
        for folder in ledger.read(batch, "intent")["folders"]:
            for f in ledger.fs.globStatus(ledger.place(f"{folder}/{batch}-*")) or []:
                ledger.fs.delete(f.getPath(), False)
    staged = f"_staged/{batch}-{uuid.uuid4().hex}"

    def write(name: str) -> list[tuple[str, str]]:
        rows = tables[name].withColumn("day", day_of(F.col("store_id"))).select("day", *[c.split()[0] for c in SCHEMAS[name].split(", ")])
        # Rows of a day go together, cut and joined to parts of the size that Spark's adaptive execution aims at.
        rows.hint("rebalance", "day").sortWithinPartitions("day", "host").write.partitionBy("day").parquet(f"{path}/{staged}/{name}")
        found = [f.getPath().toString() for f in ledger.fs.globStatus(ledger.place(f"{staged}/{name}/*/part-*")) or []]
        return [(at, f"{name}/{folder}/{batch}-{own}") for at in found for *_, folder, own in [at.split("/")]]

    with ThreadPoolExecutor(max(len(tables), 1)) as pool:
        # Jobs of these threads belong to the caller's group, so a stream that is stopped ends them; each has properties of its own.
        running = {name: pool.submit(inheritable_thread_target(spark)(write), name) for name in tables}
        written = {name: r.result() for name, r in running.items()}
    counts = {name: len(moves) for name, moves in written.items()}
    moves = [m for own in written.values() for m in own]
    folders = sorted({target.rpartition("/")[0] for _, target in moves})
    ledger.write(batch, "intent", {"folders": folders, "files": counts})
    with ThreadPoolExecutor(MOVES) as pool:
        list(pool.map(lambda folder: ledger.fs.mkdirs(ledger.place(folder)), folders))
        list(pool.map(lambda m: move(ledger, *m), moves))
    ledger.write(batch, "done", {"files": counts})
    ledger.fs.delete(ledger.place(staged), True)
    return True


def move(ledger: Ledger, at: str, target: str) -> None:
    """Renames one file into a folder that is there."""
    if not ledger.fs.rename(ledger.jvm_path(at), ledger.place(target)):
        raise OSError(f"cannot rename {at} to {target}")


def stores_of(rows: DataFrame) -> DataFrame:
    """``host, store_id`` of a batch, written, so that Spark knows how small they are: stored rows meet them where they are and are not dealt by host."""
    return stored(rows.select(*KEYS).distinct(), "batch-stores")


def days_of(rows: DataFrame) -> list[str]:
    """The days of a batch's stores, one or two for an interval."""
    return [r.day for r in rows.select(day_of(F.col("store_id")).alias("day")).distinct().collect()]


def stored_rows(spark: SparkSession, path: str, name: str, days: list[str], hosts: DataFrame) -> DataFrame:
    """Rows that a batch is compared with: of its days by the names of folders, of its hosts by a join."""
    return read_table(spark, path, name).where(F.col("day").isin(days)).join(hosts, "host", "left_semi").drop("day")


def append_tables(stores: Stores, path: str, batch: str) -> bool:
    """Adds what the tables do not hold yet: of dictionaries new ids, of records and counts those of new records. ``batch`` names the call; the same name again adds nothing."""
    spark = stores.records.sparkSession
    if Ledger(spark, path).has(batch, "done"):
        return False
    own_stores = stores_of(stores.strmap)
    days, hosts = days_of(own_stores), own_stores.select("host").distinct()
    tables = {}
    for name, df, own in (("strmap", stores.strmap, "sid"), ("idsmap", stores.idsmap, "ids_id"), ("records", stores.records, "record_idx"), ("stack_counts", stores.counts, "record_idx")):
        old = stored_rows(spark, path, name, days, hosts).select(*KEYS, own).distinct()
        tables[name] = df.join(old, [*KEYS, own], "left_anti")
    return commit(spark, path, batch, tables)


def interval_tables(buckets: DataFrame, path: str) -> dict[str, DataFrame]:
    """New rows of all tables for ``buckets(host, store_id, start_ms, end_ms, meta, frames, count)``.

    Strings and stacks that a store has keep their ids, new ones go on from its greatest; records
    are numbered on from its last. Intervals of a store that come twice in a batch are one record.
    Lists of frames, which many processes share, are looked up once each; a row then meets the ids of
    its list and of its ``meta``, and from there on has numbers in place of texts.
    """
    spark = buckets.sparkSession
    sums = stored(buckets.groupBy(*KEYS, "start_ms", "end_ms", "meta", "frames").agg(F.sum("count").alias("count")), "interval-sums")
    own_stores = stores_of(sums)
    days, hosts = days_of(own_stores), own_stores.select("host").distinct()

    def old(name: str) -> DataFrame:
        return stored_rows(spark, path, name, days, hosts)

    lists = stored(sums.select(*KEYS, "frames").distinct().withColumn("_list", F.monotonically_increasing_id()), "interval-lists")
    parts = lists.select(*KEYS, "_list", F.posexplode("frames").alias("pos", "str"))
    texts = parts.select(*KEYS, "str").unionByName(sums.select(*KEYS, F.col("meta").alias("str")))
    strings = stored(merge_ids(texts, old("strmap"), "str", "sid", KEYS), "interval-strings")
    called = parts.join(strings, [*KEYS, "str"]).groupBy(*KEYS, "_list").agg(F.sort_array(F.collect_list(F.struct("pos", "sid")))["sid"].alias("_sids"))
    # An empty list has no parts.
    called = stored(lists.join(called, [*KEYS, "_list"], "left").select(*KEYS, "frames", F.coalesce("_sids", F.array().cast("array<int>")).alias("_sids")), "interval-called")
    metas = strings.select(*KEYS, F.col("str").alias("meta"), F.col("sid").alias("_meta"))
    numbered = sums.join(called, [*KEYS, "frames"]).join(metas, [*KEYS, "meta"])
    numbered = stored(numbered.select(*KEYS, "start_ms", "end_ms", F.array_prepend("_sids", F.col("_meta")).alias("sids"), "count"), "interval-numbered")
    ids = stored(merge_ids(numbered, old("idsmap"), "sids", "ids_id", KEYS), "interval-ids")
    last = old("records").groupBy(*KEYS).agg(F.max("record_idx").alias("_last"))
    spans = sums.groupBy(*KEYS, "start_ms", "end_ms").agg(F.count("*").alias("entry_len"))
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy("start_ms", "end_ms"))  # one row per interval of a store in this batch
    records = spans.withColumn("_n", place).join(last, KEYS, "left").withColumn("record_idx", (F.col("_n") + F.coalesce("_last", F.lit(-1))).cast("int")).drop("_n", "_last")
    records = stored(records, "interval-records")
    counts = numbered.join(records, [*KEYS, "start_ms", "end_ms"]).join(ids, [*KEYS, "sids"]).select(*KEYS, "record_idx", "ids_id", "count")
    return {"strmap": strings.where("is_new").drop("is_new"), "idsmap": ids.where("is_new").drop("is_new"), "records": records, "stack_counts": counts}


def interval_sink(path: str, name: str = "stream") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends each micro-batch of buckets (as in :func:`interval_tables`) to the tables once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        key = f"{name}_{batch_id}"
        if not Ledger(batch.sparkSession, path).has(key, "done"):
            commit(batch.sparkSession, path, key, interval_tables(batch, path))

    return write
