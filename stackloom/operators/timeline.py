"""Record cleaning, range selection and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.functions.timefmt import DAY_MS
from stackloom.operators.dictionary import store_keys


def by_store(records: DataFrame, *aggregates: Column) -> DataFrame:
    """``records`` plus aggregates of their store (of all records if there is no ``host`` or ``store_id``)."""
    keys = store_keys(records)
    sums = records.groupBy(*keys).agg(*aggregates)
    return records.join(sums, keys) if keys else records.crossJoin(F.broadcast(sums))  # one row


def clean_records(records: DataFrame, mode: str = "viewer") -> DataFrame:
    """``records(host, store_id, record_idx, start_ms, end_ms, entry_len)`` as the two readers see them, store by store.

    Both move records past midnight by a day. The viewer also drops guards (no entries, start =
    end) and the last record, unless the file ended in a guard.
    """
    bounds = by_store(records, F.min_by("start_ms", "record_idx").alias("_first"), F.max("record_idx").alias("_last"))
    wrap = F.when(F.col("end_ms") < F.col("_first"), DAY_MS).otherwise(0)
    start = F.when(F.col("start_ms") < F.col("_first"), F.col("start_ms") + wrap).otherwise(F.col("start_ms"))
    moved = bounds.withColumns({"start_ms": start, "end_ms": F.col("end_ms") + wrap})
    if mode == "viewer":
        moved = moved.where(((F.col("entry_len") > 0) | (F.col("start_ms") < F.col("end_ms"))) & (F.col("record_idx") < F.col("_last")))
    return moved.select(*records.columns)


def record_at(records: DataFrame, ms: int) -> DataFrame:
    """``host, store_id, record_idx``: each store's first record that ends at ``ms`` or later, else its last."""
    found = records.groupBy(*store_keys(records)).agg(F.min(F.when(F.col("end_ms") >= ms, F.col("record_idx"))).alias("_hit"), F.max("record_idx").alias("_last"))
    return found.select(*store_keys(records), F.coalesce("_hit", "_last").alias("record_idx"))


def range_end(records: DataFrame, ms: int) -> DataFrame:
    """``host, store_id, range_end``: how many of each store's records start before ``ms``, the exclusive end."""
    return records.groupBy(*store_keys(records)).agg(F.count_if(F.col("start_ms") < ms).alias("range_end"))


def select_range(records: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """The viewer's range of each store; never empty."""
    a, b = min(start_ms, end_ms), max(start_ms, end_ms)
    hit, last = F.min(F.when(F.col("end_ms") >= a, F.col("record_idx"))), F.max("record_idx")
    bounds = by_store(records, F.coalesce(hit, last).alias("_from"), F.count_if(F.col("start_ms") < b).alias("_to"))
    return bounds.where((F.col("record_idx") >= F.col("_from")) & (F.col("record_idx") < F.greatest("_to", F.col("_from") + 1))).select(*records.columns)


def select_export_range(records: DataFrame, start_ms: int | None, end_ms: int | None, output_num: int | None = None) -> DataFrame:
    """The export's range of each store, both ends inclusive; raises where the export does for any store."""
    if output_num is not None and output_num <= 0:
        raise ValueError("output_num must be positive")
    if start_ms is not None and end_ms is not None and start_ms > end_ms:
        raise ValueError("reversed range")
    first, last = F.min("start_ms"), F.max("end_ms")
    s = by_store(records, F.greatest(first, F.lit(start_ms)).alias("_s"), F.least(last, F.lit(end_ms)).alias("_e"), F.min("record_idx").alias("_first"), F.max("record_idx").alias("_last"))
    hits = by_store(s, F.min(F.when((F.col("start_ms") <= F.col("_s")) & (F.col("end_ms") >= F.col("_s")), F.col("record_idx"))).alias("_hit"))
    found = hits.withColumn("_from", F.coalesce("_hit", "_first"))
    ends = by_store(found, F.min(F.when((F.col("record_idx") >= F.col("_from")) & (F.col("end_ms") >= F.col("_e")), F.col("record_idx"))).alias("_stop"))
    ends = ends.withColumn("_to", F.coalesce("_stop", "_last"))
    state = ends.agg(F.count("*").alias("n"), F.count_if(F.col("_hit").isNull()).alias("missed"), F.min(F.col("_to") - F.col("_from") + 1).alias("fewest")).first()
    if not state.n:
        raise ValueError("no valid records")
    if state.missed and (start_ms is not None or end_ms is not None):
        raise ValueError("no records in range")
    if output_num is not None and state.fewest < output_num:
        raise ValueError("not found enough records")
    stop = F.col("_to") if output_num is None else F.col("_from") + output_num - 1
    return ends.where((F.col("record_idx") >= F.col("_from")) & (F.col("record_idx") <= stop)).select(*records.columns)


def time_range(records: DataFrame) -> DataFrame:
    """``host, store_id, first_ms, last_ms, n_records, duration_ms`` of each store."""
    out = records.groupBy(*store_keys(records)).agg(F.min_by("start_ms", "record_idx").alias("first_ms"), F.max_by("end_ms", "record_idx").alias("last_ms"), F.count("*").alias("n_records"))
    return out.withColumn("duration_ms", F.col("last_ms") - F.col("first_ms"))


def record_times(samples: DataFrame, keys: list[str], now_ms: str = "now_ms", ns: str = "ns") -> DataFrame:
    """``samples`` plus ``record_ms``: the wall clock of an anchor plus the nanoseconds since it.

    The first sample of a key is its anchor. Where the wall clock goes back (a new day), a new
    anchor begins; a time outside the day is replaced by the sample's own wall clock.
    """
    w = Window.partitionBy(*keys).orderBy(ns)
    back = F.coalesce(F.col(now_ms) < F.lag(now_ms).over(w), F.lit(False))
    run = samples.withColumn("_back", back).withColumn("_run", F.sum(F.col("_back").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "_run").orderBy(ns).rowsBetween(Window.unboundedPreceding, 0)
    ms = F.first(now_ms).over(inside) + F.floor((F.col(ns) - F.first(ns).over(inside)) / 1000000)
    timed = run.withColumn("_ms", ms.cast("long"))
    return timed.withColumn("record_ms", F.when((F.col("_ms") >= 0) & (F.col("_ms") < DAY_MS), F.col("_ms")).otherwise(F.col(now_ms))).drop("_back", "_run", "_ms")


def ms_of_day(ts: Column) -> Column:
    """Milliseconds since the local midnight of a time, as records count them."""
    return F.timestamp_diff("MILLISECOND", F.date_trunc("DAY", ts), ts)


def day_spans(samples: DataFrame, ts: str = "ts", keys: list[str] | None = None) -> DataFrame:
    """``keys.., day, n, first_ms, last_ms``: how samples fall into the stores of their days, which begin anew at midnight."""
    ms = ms_of_day(F.col(ts))
    return samples.groupBy(*keys or [], F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"))


def anchored_ms(samples: DataFrame, keys: list[str], us: str = "us") -> DataFrame:
    """``samples`` plus ``record_ms`` from the first sample of each key and the microseconds since it, without windows: for feeds whose clocks do not go back."""
    first = samples.groupBy(*keys).agg(F.min(us).alias("_first"))
    ms = F.floor(F.col("_first") / 1000) + F.floor((F.col(us) - F.col("_first")) / 1000)
    return samples.join(first, keys).withColumn("record_ms", ms.cast("long")).drop("_first")


def union_records(records: DataFrame, created: DataFrame) -> DataFrame:
    """``host, record_idx, start_ms, end_ms, .., store_id``: the records of each host's stores as one history.

    Records are numbered anew from 0 in order of ``created(host, store_id, created)``, and times
    count from the epoch (session time zone) instead of from the store's midnight.
    """
    midnight = F.unix_millis(F.date_trunc("day", F.col("created").cast("timestamp")))
    joined = records.join(created, ["host", "store_id"]).withColumn("_day", midnight)
    w = Window.partitionBy("host").orderBy("created", "store_id", "record_idx")
    placed = joined.withColumn("record_idx", (F.row_number().over(w) - 1).cast("long"))
    return placed.withColumns({c: (F.col(c) + F.col("_day")).cast("long") for c in ("start_ms", "end_ms")}).drop("_day", "created")


def shift_window(start: int, end: int, lo: int, hi: int, forward: bool) -> tuple[int, int]:
    """The window moved by its own length, kept within ``lo..hi``."""
    length = end - start
    start = min(max(start + (length if forward else -length), lo), max(lo, hi - length))
    return start, min(hi, start + length)


def chart_bounds(start: int, lo: int, hi: int, span: int = 600_000) -> tuple[int, int]:
    """A fixed window from the selection's start, moved, not stretched, at the ends of the data."""
    begin = max(lo, min(start, hi - span))
    return begin, min(hi, begin + span)


def curves(records: DataFrame, facts: DataFrame, freq: int, interval: int) -> DataFrame:
    """Per record total and kernel samples over ``freq * interval``; records without samples show 0.

    ``facts(record_ts, cnt, has_kernel)`` are summed first, then joined to all records.
    """
    sums = facts.groupBy("record_ts").agg(F.sum("cnt").alias("all"), F.sum(F.when(F.col("has_kernel"), F.col("cnt")).otherwise(0)).alias("sys"))
    joined = records.join(sums, "record_ts", "left")
    return joined.select("record_idx", *[F.round(F.coalesce(c, F.lit(0)) / float(freq * interval), 9).alias(n) for c, n in (("all", "cpu"), ("sys", "sys"))])
