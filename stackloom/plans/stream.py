"""Streaming queries, run over the table once, and their batch twins."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from stackloom.plans.catalog import query
from stackloom.session import shared_path, stored
from stackloom.sources.views import samples, table, with_views
from stackloom.plans.address import OFF_CPU_SQL
from stackloom.plans.aggregate import GAPS_SQL, PERIOD_US
from stackloom.streaming import buckets, pairing


#: Files of a micro-batch, which bound what a task sorts of one key.
MAX_FILES = 8


def sample_stream(spark, d):
    """The samples of ``events`` as a stream."""
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("maxFilesPerTrigger", MAX_FILES).parquet(f"{d}/events.parquet*")
    user = F.col("user_id").cast("long")
    return stream.select(F.concat(F.lit("h"), (user % 4).cast("string")).alias("host"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stack"), F.lit(1).cast("long").alias("cnt"), "event_id")


WINDOW = ", w as (select host, date_trunc('{unit}', ts) as s, comm as stack, cast(sum(cnt) as bigint) as count, max(max(ts)) over () as top from samples group by 1, 2, 3) select host, strftime(s, '%Y-%m-%d %H:%M:%S') as start, stack, count from w where s + interval 1 {unit} <= top - interval 10 second"


def windowed(spark, d, seconds):
    out = shared_path(spark, "stream")
    counts = buckets.second_counts(sample_stream(spark, d), "10 seconds", seconds)
    buckets.run_once(counts, f"{out}/data", f"{out}/checkpoint")
    return spark.read.schema(counts.schema).parquet(f"{out}/data").select("host", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "stack", "count")


@query("w1_second_windows", with_views(WINDOW.format(unit="second"), "samples"))
def w1(spark, d):
    return windowed(spark, d, 1)


@query("w7_interval_records", with_views(WINDOW.format(unit="hour"), "samples"))
def w7(spark, d):
    return windowed(spark, d, 3600)


@query("w3_clamped_buckets", with_views(", m as (select host, epoch_us(ts) // 1000 as ms, comm as stack, cnt from samples), t as (select host, max(ms) // 1000 - 10 as top from m group by host) select host, cast(ms // 1000 * 1000 as bigint) as start_ms, stack, cast(sum(cnt) as bigint) as count from m join t using (host) where ms // 1000 < top group by 1, 2, 3", "samples"))
def w3(spark, d):
    return buckets.only_buckets(collected(spark, buckets.clamped_counts(wheel_input(sample_stream(spark, d))), buckets.OUT_SCHEMA)).select("host", "start_ms", "stack", "count")


def wheel_input(stream):
    return stream.select("host", F.floor(F.unix_micros("ts") / 1000).cast("long").alias("record_ms"), "stack", "cnt")


def in_turns(spark, parts, listener=None):
    """What the wheel emits when the parts arrive one after the other, each as a run of the same stream; waits for a ``listener`` of its metrics."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", buckets.ROCKSDB)
    path = shared_path(spark, "turns")
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{path}/in")
        emitted = buckets.clamped_counts(stream)
        run = buckets.run_once(emitted if listener is None else buckets.observed(emitted), f"{path}/out", f"{path}/checkpoint")
        for _ in range(300):  # events reach a listener shortly after the run
            if listener is None or run in listener.ended:
                break
            time.sleep(0.1)
    return spark.read.schema(buckets.OUT_SCHEMA).parquet(f"{path}/out")


def wheel_samples(spark, d):
    return samples(spark, d).select("sample_id", "host", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("record_ms"), F.col("comm").alias("stack"), "cnt")


LATE = ", m as (select host, epoch_us(ts) // 1000 as ms, sample_id % 10 = 0 as late, comm as stack, cnt from samples), t as (select host, coalesce(max(ms) filter (where not late) // 1000 - 10, 0) as oldest, max(ms) // 1000 - 10 as top from m group by host), c as (select host, case when late then greatest(ms // 1000, oldest) else ms // 1000 end as sec, late and ms // 1000 < oldest as is_clamped, stack, cnt, oldest, top from m join t using (host))"


@query("w3_late_rows", with_views(LATE + " select host, cast(sec * 1000 as bigint) as start_ms, stack, cast(sum(cnt) as bigint) as count from c where sec < top group by 1, 2, 3", "samples"))
def w3l(spark, d):
    """A tenth of the samples comes after all others, most of them late."""
    s, late = wheel_samples(spark, d), F.col("sample_id") % 10 == 0
    emitted = in_turns(spark, [s.where(~late).drop("sample_id"), s.where(late).drop("sample_id")])
    return buckets.only_buckets(emitted).groupBy("host", "start_ms", "stack").agg(F.sum("count").cast("long").alias("count"))


@query("w5_flush_all", with_views(" select host, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') as start, comm as stack, cast(sum(cnt) as bigint) as count from samples group by 1, 2, 3", "samples"))
def w5(spark, d):
    """Everything is emitted once a control row of each host asks for it."""
    s = wheel_samples(spark, d).drop("sample_id")
    control = s.select("host").distinct().select("host", F.lit(None).cast("long").alias("record_ms"), F.lit(None).cast("string").alias("stack"), F.lit(None).cast("long").alias("cnt"))
    rows = buckets.only_buckets(in_turns(spark, [s, control]))
    return rows.select("host", F.date_format(F.timestamp_millis("start_ms"), "yyyy-MM-dd HH:mm:ss").alias("start"), "stack", "count")


def collected(spark, stream, schema):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", buckets.ROCKSDB)
    out = shared_path(spark, "stream")
    buckets.run_once(stream, f"{out}/data", f"{out}/checkpoint")
    return spark.read.schema(schema).parquet(f"{out}/data")


@query("w8_irqoff_stream", GAPS_SQL)
def w8(spark, d):
    ticks = sample_stream(spark, d).select(F.col("event_id").alias("tick_id"), "host", (F.col("event_id") % 8).cast("long").alias("cpu"), F.unix_micros("ts").alias("ts_us"), (F.col("stack") == "purchase").alias("throttled"))
    return collected(spark, pairing.irqoff_stream(ticks, PERIOD_US), pairing.GAP_SCHEMA)


@query("w9_off_cpu_stream", OFF_CPU_SQL)
def w9(spark, d):
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("maxFilesPerTrigger", MAX_FILES).parquet(f"{d}/events.parquet*")
    switches = stream.select("event_id", F.col("user_id").cast("long").alias("tid"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.when(F.col("event_type").isin("view", "click"), "out").otherwise("in").alias("kind"))
    return collected(spark, pairing.off_cpu_stream(switches), pairing.OFF_SCHEMA)


@query("w4_idle_flush", with_views(", m as (select host, epoch_us(ts) // 1000 as ms, comm as stack, cnt from samples), t as (select max(ms) as now from m), h as (select host, max(ms) as top from m group by host), c as (select host, ms // 1000 as sec, stack, cnt, greatest(top, case when host in ('h0', 'h1') then now + 15000 else 0 end) // 1000 - 10 as lim from m join h using (host), t) select host, cast(sec * 1000 as bigint) as start_ms, stack, cast(sum(cnt) as bigint) as count from c where sec < lim group by 1, 2, 3", "samples"))
def w4(spark, d):
    """All samples, then nothing but the wall clock of two hosts, 15 seconds on: their last seconds are flushed, those of the others stay open."""
    s = stored(wheel_samples(spark, d).drop("sample_id"), "wheel-samples")
    now = s.agg(F.max("record_ms")).first()[0] or 0
    clock = buckets.clock_rows(s.select("host").distinct().where("host in ('h0', 'h1')"), now + 15_000)
    return buckets.only_buckets(in_turns(spark, [s, clock])).select("host", "start_ms", "stack", "count")


#: A known case: samples (ms, stack, count), clock rows (ms) and a flush, hold 10 s, replayed for each host at the second of its first sample.
STEPS = [[(1000, "1", 3), (2000, "2", 4)], [(11_000, None, None)], [(12_000, None, None)], [(1500, "1", 5), (2500, "2", 7)], [(13_000, None, None)], [(4000, "1", 9)], [(None, None, None)]]


@query("w2_joint_clock", with_views(", f as (select host, min(epoch_us(ts)) // 1000000 as s0 from samples group by host), x as (select unnest([1, 2, 2, 4]) as sec, unnest(['1', '1', '2', '1']) as stack, unnest([3, 5, 11, 9]) as n, unnest([12000, 13000, 13000, 13000]) as clock) select host, cast((s0 + sec) * 1000 as bigint) as start_ms, stack, cast(n as bigint) as count, cast(case when sec = 4 then 5 else 0 end + case when sec = 2 then 5 else 0 end as bigint) as clamped from f, x", "samples"))
def w2(spark, d):
    """Seconds close by the wall clock where no sample has come that far, late samples are clamped, the rest is flushed: each step is a batch."""
    first = stored(wheel_samples(spark, d).groupBy("host").agg((F.floor(F.min("record_ms") / 1000) * 1000).cast("long").alias("s0")), "wheel-first")
    parts = []
    for step in STEPS:
        rows = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("string").alias("b"), F.lit(c).cast("long").alias("c")) for a, b, c in step]))
        parts.append(first.select("host", "s0", rows.alias("r")).select("host", (F.col("s0") + F.col("r.a")).alias("record_ms"), F.col("r.b").alias("stack"), F.col("r.c").alias("cnt")))
    return in_turns(spark, parts).where("stack is not null").select("host", "start_ms", "stack", "count", "clamped")


@query("w10_observed", with_views(", m as (select host, epoch_us(ts) // 1000000 as sec, comm as stack, cnt from samples where sample_id % 10 <> 0), t as (select host, max(sec) - 10 as lim from m group by host) select cast(0 as bigint) as batch, count(distinct (host, sec, stack)) filter (where sec < lim) as buckets, cast(coalesce(sum(cnt) filter (where sec < lim), 0) as bigint) as weight, count(distinct (host, sec)) filter (where sec >= lim) as pending, cast(coalesce(sum(cnt) filter (where sec >= lim), 0) as bigint) as pending_weight from m join t using (host)", "samples"))
def w10o(spark, d):
    """What a listener stored of the first batch by ``observe``; a test compares every batch with the state's own rows."""
    s, late = wheel_samples(spark, d), F.col("sample_id") % 10 == 0
    listener = buckets.MetricsListener()
    spark.streams.addListener(listener)
    try:
        in_turns(spark, [s.where(~late).drop("sample_id"), s.where(late).drop("sample_id")], listener)
    finally:
        spark.streams.removeListener(listener)
    return listener.stored(spark).where("batch = 0 and buckets > 0").select("batch", "buckets", "weight", "pending", "pending_weight")


@query("w10_wheel_statistics", with_views(LATE + " select host, count(distinct sec) filter (where sec < top) as flushed, cast(coalesce(sum(cnt) filter (where is_clamped), 0) as bigint) as clamped, count(distinct sec) filter (where sec >= top) as pending, cast(coalesce(sum(cnt) filter (where sec >= top), 0) as bigint) as pending_weight from c group by host", "samples"))
def w10(spark, d):
    s, late = wheel_samples(spark, d), F.col("sample_id") % 10 == 0
    return buckets.wheel_statistics(in_turns(spark, [s.where(~late).drop("sample_id"), s.where(late).drop("sample_id")]))
