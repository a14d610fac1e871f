"""Queries on records, times and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackloom.functions import frames, timefmt
from stackloom.operators import stats, timeline
from stackloom.plans.catalog import query
from stackloom.sources.views import FREQ, RECORD_INTERVAL, records, samples, table, with_views

RECORDS_MS = ", r as (select cast(record_idx as bigint) as record_idx, cast(record_idx * 3600000 as bigint) as start_ms, cast(record_idx * 3600000 + 3600000 as bigint) as end_ms from records)"


def records_ms(spark, d):
    start = F.col("record_idx") * 3600000
    return records(spark, d).select("record_idx", start.alias("start_ms"), (start + 3600000).alias("end_ms"))


@query("s7_clean_records", "with r as (select cast(o_custkey as bigint) as store_id, row_number() over (partition by o_custkey order by o_orderkey) as record_idx, o_orderkey % 1000 as start_ms, o_orderkey % 1000 + o_orderkey % 3 as end_ms, o_orderkey % 2 as entry_len from orders), f as (select *, first_value(start_ms) over (partition by store_id order by record_idx) as f, row_number() over (partition by store_id order by record_idx desc) as back from r), m as (select store_id, record_idx, back, entry_len, case when end_ms < f and start_ms < f then start_ms + 86400000 else start_ms end as start_ms, case when end_ms < f then end_ms + 86400000 else end_ms end as end_ms from f) select store_id, cast(record_idx as bigint) as record_idx, cast(start_ms as bigint) as start_ms, cast(end_ms as bigint) as end_ms from m where back > 1 and not (entry_len = 0 and start_ms = end_ms)")
def s7(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    start = (F.col("o_orderkey") % 1000).cast("long")
    r = o.select(F.col("o_custkey").cast("long").alias("store_id"), F.row_number().over(w).cast("long").alias("record_idx"), start.alias("start_ms"), (start + F.col("o_orderkey") % 3).cast("long").alias("end_ms"), (F.col("o_orderkey") % 2).alias("entry_len"))
    return timeline.clean_records(r).drop("entry_len")


@query("t1_parse_time", with_views(" select sample_id, (k % 24 * 3600 + k % 60 * 60 + k % 50) * 1000 + k % 10 * 100 as ms from samples", "samples"))
def t1(spark, d):
    text = F.format_string("%d:%02d:%d.%d", F.col("k") % 24, F.col("k") % 60, F.col("k") % 50, F.col("k") % 10)
    return samples(spark, d).select("sample_id", timefmt.time_ms(text).alias("ms"))


@query("t3_format_ms", with_views(", m as (select sample_id, k * 1234567 as ms from samples) select sample_id, case when ms >= 86400000 then '+' || (ms // 86400000) || 'd ' else '' end || lpad(cast(ms % 86400000 // 3600000 as varchar), 2, '0') || ':' || lpad(cast(ms // 60000 % 60 as varchar), 2, '0') || ':' || lpad(cast(ms // 1000 % 60 as varchar), 2, '0') || '.' || lpad(cast(ms % 1000 as varchar), 3, '0') as text from m", "samples"))
def t3(spark, d):
    return samples(spark, d).select("sample_id", timefmt.format_ms(F.col("k") * 1234567, days=True).alias("text"))


@query("t4_record_at", with_views(RECORDS_MS + " select coalesce((select min(record_idx) from r where end_ms >= 100000000), (select max(record_idx) from r)) as record_idx", "records"))
def t4(spark, d):
    return timeline.record_at(records_ms(spark, d), 100_000_000)


@query("t5_range_end", with_views(RECORDS_MS + " select count(*) filter (where start_ms < 100000000) as range_end from r", "records"))
def t5(spark, d):
    return timeline.range_end(records_ms(spark, d), 100_000_000)


#: Records of several stores with the same names on several hosts.
BY_STORE = "with r as (select 'h' || cast(o_custkey % 4 as varchar) as host, 'cpa_' || cast(o_custkey // 4 % 10 as varchar) as store_id, row_number() over (partition by o_custkey % 4, o_custkey // 4 % 10 order by o_orderkey) as record_idx, o_orderkey as start_ms, o_orderkey + o_orderkey % 3 as end_ms, o_orderkey % 2 as entry_len from orders)"


def store_records(spark, d):
    from pyspark.sql import Window

    number = F.floor(F.col("o_custkey") / 4) % 10
    keyed = table(spark, d, "orders").select(F.concat(F.lit("h"), (F.col("o_custkey") % 4).cast("string")).alias("host"), F.concat(F.lit("cpa_"), number.cast("string")).alias("store_id"), F.col("o_orderkey").cast("long").alias("start_ms"))
    index = F.row_number().over(Window.partitionBy("host", "store_id").orderBy("start_ms")).cast("long")
    return keyed.select("host", "store_id", index.alias("record_idx"), "start_ms", (F.col("start_ms") + F.col("start_ms") % 3).alias("end_ms"), (F.col("start_ms") % 2).alias("entry_len"))


@query("s7_clean_records_by_host", BY_STORE + " select host, store_id, record_idx, cast(start_ms as bigint) as start_ms, cast(end_ms as bigint) as end_ms from (select *, max(record_idx) over (partition by host, store_id) as last from r) where record_idx < last and not (entry_len = 0 and start_ms = end_ms)")
def s7h(spark, d):
    return timeline.clean_records(store_records(spark, d)).drop("entry_len")


@query("t4_record_at_by_store", BY_STORE + " select host, store_id, coalesce(min(record_idx) filter (where end_ms >= 5000), max(record_idx)) as record_idx from r group by 1, 2")
def t4s(spark, d):
    return timeline.record_at(store_records(spark, d), 5000)


@query("t6_select_range_by_store", BY_STORE + ", b as (select host, store_id, coalesce(min(record_idx) filter (where end_ms >= 5000), max(record_idx)) as a, count(*) filter (where start_ms < 9000) as z from r group by 1, 2) select host, store_id, record_idx, cast(start_ms as bigint) as start_ms, cast(end_ms as bigint) as end_ms from r join b using (host, store_id) where record_idx >= a and record_idx < greatest(z, a + 1)")
def t6s(spark, d):
    return timeline.select_range(store_records(spark, d), 9000, 5000).drop("entry_len")


@query("t8_time_range_by_store", BY_STORE + " select host, store_id, cast(min_by(start_ms, record_idx) as bigint) as first_ms, cast(max_by(end_ms, record_idx) as bigint) as last_ms, count(*) as n_records, cast(max_by(end_ms, record_idx) - min_by(start_ms, record_idx) as bigint) as duration_ms from r group by 1, 2")
def t8s(spark, d):
    return timeline.time_range(store_records(spark, d))


@query("t2_parse_range", with_views(RECORDS_MS + " select * from r where record_idx >= 27 and record_idx < 56", "records"))
def t2(spark, d):
    return timeline.select_range(records_ms(spark, d), *timefmt.parse_range("55:33:20..27:46:40"))


@query("t9_shift_window", with_views(RECORDS_MS + " select * from r where record_idx >= 55 and record_idx < 84", "records"))
def t9(spark, d):
    r = records_ms(spark, d)
    span = r.agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b")).first()
    return timeline.select_range(r, *timeline.shift_window(100_000_000, 200_000_000, span.a, span.b, True))


@query("t6_select_range", with_views(RECORDS_MS + " select * from r where record_idx >= 27 and record_idx < 56", "records"))
def t6(spark, d):
    return timeline.select_range(records_ms(spark, d), 100_000_000, 200_000_000)


@query("t7_select_export_range", with_views(RECORDS_MS + " select * from r where record_idx between 27 and 55", "records"))
def t7(spark, d):
    return timeline.select_export_range(records_ms(spark, d), 100_000_000, 200_000_000)


@query("t8_time_range", with_views(RECORDS_MS + " select min(start_ms) as first_ms, max(end_ms) as last_ms, count(*) as n_records, max(end_ms) - min(start_ms) as duration_ms from r", "records"))
def t8(spark, d):
    return timeline.time_range(records_ms(spark, d))


@query("t10_chart_bounds", with_views(RECORDS_MS + " select record_idx, start_ms, end_ms from r where end_ms > 1000000000 and start_ms < 1000600000", "records"))
def t10(spark, d):
    r = records_ms(spark, d)
    span = r.agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b")).first()
    a, b = timeline.chart_bounds(1_000_000_000, span.a, span.b)
    return r.where((F.col("end_ms") > a) & (F.col("start_ms") < b))


@query("t11_record_ms", with_views(", a as (select host, min(ts) as first from samples group by host) select sample_id, epoch_us(first) // 1000 + (epoch_us(ts) - epoch_us(first)) // 1000 as record_ms from samples join a using (host)", "samples"))
def t11(spark, d):
    s = samples(spark, d).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return timeline.anchored_ms(s, ["host"]).select("sample_id", "record_ms")


@query("t12_day_split", with_views(" select strftime(ts, '%Y-%m-%d') as day, count(*) as n, min((epoch_us(ts) - epoch_us(date_trunc('day', ts))) // 1000) as first_ms, max((epoch_us(ts) - epoch_us(date_trunc('day', ts))) // 1000) as last_ms from samples group by 1", "samples"))
def t12(spark, d):
    return timeline.day_spans(samples(spark, d))


@query("t13_format_duration", with_views(" select sample_id, case when k < 100 then k || 'ms' when k * 640 < 60000 then printf('%.2fs', k * 640 / 1000.0::double) else printf('%.1fs', k * 640 / 1000.0::double) end as text from samples", "samples"))
def t13(spark, d):
    ms = F.when(F.col("k") < 100, F.col("k")).otherwise(F.col("k") * 640)
    return samples(spark, d).select("sample_id", timefmt.format_duration(ms).alias("text"))


@query("t11_record_times", with_views(", c as (select sample_id, host, epoch_us(ts) // 1000 % 86400000 as now_ms, epoch_us(ts) * 1000 as ns, cast(ts as date) as day from samples), a as (select *, first_value(now_ms) over w as a_ms, first_value(ns) over w as a_ns from c window w as (partition by host, day order by ns, sample_id)) select sample_id, cast(case when a_ms + (ns - a_ns) // 1000000 < 86400000 then a_ms + (ns - a_ns) // 1000000 else now_ms end as bigint) as record_ms from a", "samples"))
def t11r(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    s = samples(spark, d).select("sample_id", "host", (F.floor(us / 1000) % 86400000).cast("long").alias("now_ms"), (us * 1000).alias("ns"))
    return timeline.record_times(s, ["host"]).select("sample_id", "record_ms")


CURVE = f", c as (select date_trunc('hour', ts) as record_ts, sum(cnt) as a, sum(case when comm = 'error' then cnt else 0 end) as s from samples where cpu < 2 group by 1), curve as (select cast(record_idx as bigint) as record_idx, round(coalesce(a, 0) / {FREQ * RECORD_INTERVAL}.0::double, 9) as cpu, round(coalesce(s, 0) / {FREQ * RECORD_INTERVAL}.0::double, 9) as sys from records left join c using (record_ts))"


def curve(spark, d):
    s = samples(spark, d).where("cpu < 2").select(F.date_trunc("hour", "ts").alias("record_ts"), "cnt", frames.has_kernel(F.col("frames")).alias("has_kernel"))
    return timeline.curves(records(spark, d), s, FREQ, RECORD_INTERVAL)


@query("a7_cpu_curve", with_views(CURVE + " select record_idx, cpu, sys from curve", "samples", "records"))
def a7(spark, d):
    return curve(spark, d)


@query("a10_trend_buckets", with_views(CURVE + ", n as (select count(*) as n from records) select cast(floor(record_idx * 80 / n) as bigint) as bucket, max(cpu) as peak from curve, n group by 1", "samples", "records"))
def a10(spark, d):
    c = curve(spark, d)
    n = records(spark, d).agg(F.count("*").alias("n"))
    return stats.trend_buckets(c.crossJoin(F.broadcast(n)), "record_idx", "cpu", F.col("n"), 80)  # one row
