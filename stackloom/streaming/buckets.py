"""One-second buckets of samples with a hold time, in two forms.

:func:`second_counts` is the built-in watermark aggregation, which drops late rows.
:func:`clamped_counts` keeps them: a row older than the oldest open second is added to that
second. It is keyed by host, and each batch is summed per second and stack before it meets the
state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.types import LongType, StringType, StructField, StructType

HOLD_S = 10
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT_SCHEMA = "host string, start_ms bigint, end_ms bigint, stack string, count bigint, clamped bigint, flushed bigint, pending bigint, pending_weight bigint, batch bigint"


def second_counts(samples: DataFrame, hold: str = "10 seconds", seconds: int = 1) -> DataFrame:
    """Per host, window and stack the sum of ``cnt`` of ``samples(host, ts, stack, cnt)``."""
    w = F.window("ts", f"{seconds} seconds")
    return samples.withWatermark("ts", hold).groupBy("host", w.alias("w"), "stack").agg(F.sum("cnt").alias("count")).select("host", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "stack", "count")


#: Rows of a batch that are summed at once, and the seconds of a block of sums, as a power of two.
SUM_ROWS, BLOCK_BITS = 1 << 19, 14


def summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """``(seconds, codes, counts)`` of all parts, ordered and summed."""
    second, code, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((code, second))
    second, code, n = second[order], code[order], n[order]
    first = np.flatnonzero(np.r_[True, (second[1:] != second[:-1]) | (code[1:] != code[:-1])])
    return second[first], code[first], np.add.reduceat(n, first)


class Sums:
    """Counts of a batch per second and stack in flat columns, kept in blocks of seconds, so that beside them no more than a block and ``SUM_ROWS`` rows are held."""

    def __init__(self):
        self.codes, self.fresh, self.size, self.blocks = {}, [], 0, {}

    def add(self, second: pd.Series, stack: pd.Series, n: pd.Series) -> None:
        if not len(second):
            return
        code, names = pd.factorize(stack)
        own = np.array([self.codes.setdefault(name, len(self.codes)) for name in names], np.int32)
        self.fresh.append((second.to_numpy(np.int64), own[code], n.to_numpy(np.int64)))
        self.size += len(code)
        if self.size >= SUM_ROWS:
            self.settle()

    def settle(self) -> None:
        if not self.fresh:
            return
        columns = summed(self.fresh)
        self.fresh, self.size = [], 0
        cuts = np.flatnonzero(np.diff(columns[0] >> BLOCK_BITS)) + 1
        for part in zip(*(np.split(x, cuts) for x in columns)):
            runs = self.blocks.setdefault(int(part[0][0]) >> BLOCK_BITS, [])
            runs.append(tuple(x.copy() for x in part))
            if len(runs) == 8:
                runs[:] = [summed(runs)]

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(seconds, stacks, counts)`` block by block, which are given up."""
        self.settle()
        names = np.array(list(self.codes), object)
        for block in sorted(self.blocks):
            second, code, n = summed(self.blocks.pop(block))
            yield second, names[code], n


def out_rows(n: int, **columns) -> pd.DataFrame:
    """``n`` rows of ``OUT_SCHEMA``; columns not given are null."""
    kinds = {c.split()[0]: "Int64" if c.endswith("bigint") else object for c in OUT_SCHEMA.split(", ")}
    return pd.DataFrame({c: pd.Series(columns.get(c), range(n), kind) for c, kind in kinds.items()})


class ClampingProcessor(StatefulProcessor):
    """State per host: open (second, stack) counts, and (greatest time, oldest open second, clamped weight, flushed seconds, batches).

    A second is closed when it lies more than the hold before ``max(greatest time seen, clock)``.
    The clock is the host's wall clock in record time: what a control row says, and with
    ``clock_offset_ms`` also the processing time less that offset (0 for samples stamped with
    the epoch), which a timer compares again every ``tick_ms`` while seconds are open. So an idle
    host is flushed without rows of its own. A batch is summed per second and stack before it
    meets the state.
    """

    def __init__(self, tick_ms: int = 0, hold_s: int = HOLD_S, clock_offset_ms: int | None = None):
        self.tick_ms, self.hold_s, self.clock_offset_ms = tick_ms, hold_s, clock_offset_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        key = StructType([StructField("sec", LongType()), StructField("stack", StringType())])
        self.counts = handle.getMapState("counts", key, StructType([StructField("n", LongType())]))
        self.marks = handle.getValueState("marks", StructType([StructField(n, LongType()) for n in ("max_ms", "oldest", "clamped", "flushed", "batches")]))

    def now(self, timerValues) -> int:
        """The wall clock in record time, or 0 where only rows move it."""
        return timerValues.getCurrentProcessingTimeInMs() - self.clock_offset_ms if self.tick_ms and self.clock_offset_ms is not None else 0

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        max_ms, oldest, clamped, flushed, batches = self.marks.get() if self.marks.exists() else (0, 0, 0, 0, 0)
        flush_all, sums = False, Sums()
        for part in rows:
            control, times = part["stack"].isna(), part["record_ms"].dropna()
            flush_all |= bool((control & part["record_ms"].isna()).any())
            max_ms = max(max_ms, int(times.max()) if len(times) else 0)
            part = part[~control]
            second, n = (part["record_ms"] // 1000).astype("int64"), part["cnt"].fillna(0).astype("int64")
            clamped += int(n[second < oldest].sum())
            sums.add(second.clip(lower=oldest), part["stack"], n)
        yield from self.emitted(key, sums, max_ms, max(max_ms, self.now(timerValues)), oldest, clamped, flushed, batches, flush_all)
        self.wait(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        max_ms, *rest = self.marks.get()
        yield from self.emitted(key, Sums(), max_ms, max(max_ms, self.now(timerValues)), *rest, False)
        self.wait(timerValues)

    def wait(self, timerValues) -> None:
        """One timer, as long as seconds are open."""
        if self.tick_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if next(iter(self.counts.keys()), None) is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.tick_ms)

    def emitted(self, key, sums: Sums, max_ms: int, clock_ms: int, oldest: int, clamped: int, flushed: int, batches: int, flush_all: bool) -> Iterator[pd.DataFrame]:
        """The open seconds before the clock's less the hold, or all, which are then closed, and a row of statistics. Flushing all does not move the oldest open second.

        Only what stays open meets the state, which so holds no more than the seconds of the hold.
        """
        limit, batches = clock_ms // 1000 - self.hold_s, batches + 1
        held = {(at[0], at[1]): value[0] for at, value in list(self.counts.iterator())}
        if held:
            sums.add(*(pd.Series(x) for x in ([at[0] for at in held], [at[1] for at in held], list(held.values()))))
        open_ = {}
        for second, stack, n in sums.parts():
            closed = np.full(len(second), True) if flush_all else second < limit
            open_.update(zip(zip(second[~closed].tolist(), stack[~closed]), n[~closed].tolist()))
            flushed += len(np.unique(second[closed]))
            start = second[closed] * 1000
            yield out_rows(len(start), host=key[0], start_ms=start, end_ms=start + 1000, stack=stack[closed], count=n[closed], clamped=clamped, batch=batches)
        for at in held.keys() - open_.keys():
            self.counts.removeKey(at)
        for at, n in open_.items():
            if held.get(at) != n:
                self.counts.updateValue(at, (n,))
        self.marks.update((max_ms, max(oldest, limit), clamped, flushed, batches))
        yield out_rows(1, host=key[0], clamped=clamped, flushed=flushed, pending=len({at[0] for at in open_}), pending_weight=sum(open_.values()), batch=batches)

    def close(self) -> None:
        pass


def clamped_counts(samples: DataFrame, tick_ms: int = 0, hold_s: int = HOLD_S, clock_offset_ms: int | None = None) -> DataFrame:
    """Emitted buckets of ``samples(host, record_ms, stack, cnt)``, late rows clamped, and after each batch a row of statistics. Needs the RocksDB state store.

    A row without a stack is a control row: with a time it moves the host's clock, without one it
    asks for everything open of its host. With ``tick_ms`` the wall clock moves it as well, see
    :class:`ClampingProcessor`.
    """
    return samples.groupBy("host").transformWithStateInPandas(ClampingProcessor(tick_ms, hold_s, clock_offset_ms), OUT_SCHEMA, "append", "ProcessingTime" if tick_ms else "none")


def clock_rows(hosts: DataFrame, now_ms: int) -> DataFrame:
    """Control rows that tell each of ``hosts(host)`` the wall clock, for a feed that carries its own clock."""
    none = F.lit(None)
    return hosts.select("host", F.lit(now_ms).cast("long").alias("record_ms"), none.cast("string").alias("stack"), none.cast("long").alias("cnt"))


#: What :func:`observed` counts per micro-batch.
METRICS = ("buckets", "weight", "batches", "pending", "pending_weight")


def observed(emitted: DataFrame, name: str = "wheel") -> DataFrame:
    """``emitted`` with metrics that Spark gathers as rows pass: emitted buckets and weight, and what is still open of the hosts that this batch touched."""
    is_bucket = F.col("stack").isNotNull()
    return emitted.observe(
        name,
        F.count_if(is_bucket).alias("buckets"),
        F.coalesce(F.sum(F.when(is_bucket, F.col("count"))), F.lit(0)).cast("long").alias("weight"),
        F.count_if(~is_bucket).alias("batches"),
        F.coalesce(F.sum("pending"), F.lit(0)).cast("long").alias("pending"),
        F.coalesce(F.sum("pending_weight"), F.lit(0)).cast("long").alias("pending_weight"),
    )


class MetricsListener(StreamingQueryListener):
    """Keeps the observed metrics of each micro-batch; add it by ``spark.streams.addListener``.

    ``rows`` has one tuple ``(run, batch, *METRICS)`` per micro-batch, a few numbers each.
    """

    def __init__(self, name: str = "wheel"):
        self.name, self.rows, self.ended = name, [], set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.rows.append((str(event.progress.runId), event.progress.batchId, *[row[m] for m in METRICS]))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def stored(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "run string, batch long, " + ", ".join(f"{m} long" for m in METRICS))


def only_buckets(emitted: DataFrame) -> DataFrame:
    return emitted.where("stack is not null").select("host", "start_ms", "end_ms", "stack", "count")


def wheel_statistics(emitted: DataFrame) -> DataFrame:
    """Per host flushed seconds, clamped weight, and the seconds and weight still open, after its last batch."""
    last = emitted.where("stack is null").groupBy("host").agg(F.max_by(F.struct("flushed", "clamped", "pending", "pending_weight"), "batch").alias("s"))
    return last.select("host", "s.*")


def run_once(stream: DataFrame, output: str, checkpoint: str) -> str:
    """Runs a stream over all input there is and ends; its run id."""
    query = stream.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return str(query.runId)
