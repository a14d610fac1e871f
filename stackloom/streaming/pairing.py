"""Streams that pair a row with the one before it: IRQ-off gaps per CPU, off-CPU times per thread.

A key's rows of one micro-batch, a few numbers each, are put in time order and paired by whole
columns, chunk by chunk; the state is the last row of a key only. The reader's
``maxFilesPerTrigger`` bounds a micro-batch, and so the rows of a key that a task sorts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from stackloom.operators.stats import GAP_FACTOR

GAP_SCHEMA = "tick_id bigint, host string, cpu bigint, diff_us bigint"
OFF_SCHEMA = "event_id bigint, tid bigint, blocked_us bigint"
#: Rows of a key that a sorted chunk of a micro-batch holds.
CHUNK_ROWS = 100_000


def chunked(rows: Iterator[pd.DataFrame], order: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of a key in ``order``.

    A key's rows come in Arrow batches of a bounded size. They are sorted where they fit into one
    chunk. A larger key is sorted by merging its batches' sorted columns, of numbers and flags
    alone, and given out in chunks.
    """
    parts = [p.sort_values(order, kind="stable") for p in rows]
    if not parts:
        return
    whole = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    if len(parts) > 1:
        whole = whole.iloc[np.lexsort([whole[c].to_numpy() for c in reversed(order)])]
    for i in range(0, len(whole), CHUNK_ROWS):
        yield whole.iloc[i : i + CHUNK_ROWS]


class GapProcessor(StatefulProcessor):
    """State per (host, cpu): the last tick's time, none after a throttled tick."""

    def __init__(self, period_us: int):
        self.period_us = period_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("us", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        for part in chunked(rows, ["ts_us", "tick_id"]):
            us, throttled = part["ts_us"].to_numpy(np.int64), part["throttled"].to_numpy(bool)
            before = np.append(0 if last is None else last, us[:-1])
            known = np.append(last is not None, ~throttled[:-1])  # a throttled tick leaves no baseline
            gap = us - before
            found = known & ~throttled & (gap * 10 > round(GAP_FACTOR * 10) * self.period_us)
            last = None if throttled[-1] else int(us[-1])
            if found.any():
                yield pd.DataFrame({"tick_id": part["tick_id"].to_numpy()[found], "host": key[0], "cpu": key[1], "diff_us": gap[found] - self.period_us})
        if last is None:
            self.last.clear()
        else:
            self.last.update((last,))

    def close(self) -> None:
        pass


def irqoff_stream(ticks: DataFrame, period_us: int) -> DataFrame:
    ticks = ticks.select("host", "cpu", "tick_id", "ts_us", "throttled")
    return ticks.groupBy("host", "cpu").transformWithStateInPandas(GapProcessor(period_us), GAP_SCHEMA, "append", "none")


class OffCpuProcessor(StatefulProcessor):
    """State per thread: the time of its open switch-out, forgotten after ``ttl_ms`` if that is set."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.out = handle.getValueState("out", StructType([StructField("us", LongType())]), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        began = self.out.get()[0] if self.out.exists() else None
        for part in chunked(rows, ["ts_us", "event_id"]):
            us, out = part["ts_us"].to_numpy(np.int64), part["is_out"].to_numpy(bool)
            before = np.append(0 if began is None else began, us[:-1])
            opened = np.append(began is not None, out[:-1])  # a second switch-out replaces the first, a second switch-in finds none
            found = ~out & opened & (us > before)
            began = int(us[-1]) if out[-1] else None
            if found.any():
                yield pd.DataFrame({"event_id": part["event_id"].to_numpy()[found], "tid": key[-1], "blocked_us": (us - before)[found]})
        if began is None:
            self.out.clear()
        else:
            self.out.update((began,))

    def close(self) -> None:
        pass


def off_cpu_stream(switches: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """``event_id, tid, blocked_us`` for ``switches(host?, event_id, tid, ts_us, kind)``; thread ids hold within a host.

    A stream that never ends should set ``ttl_ms``; a run over what there is cannot, as it would wait for the time to pass.
    """
    keys = [k for k in ("host", "tid") if k in switches.columns]
    rows = switches.select(*keys, "event_id", "ts_us", (F.col("kind") == "out").alias("is_out"))
    return rows.groupBy(*keys).transformWithStateInPandas(OffCpuProcessor(ttl_ms), OFF_SCHEMA, "append", "ProcessingTime" if ttl_ms else "none")
