"""Queries that write stores of the given events to the shared folder and read them back.

A store is a host's day: hourly records, dictionaries with ids of their own, a guard after the
last record unless the day is over. Hosts have stores of the same names. Half of the hosts write
zstd frames, the others plain files.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from stackloom.functions import metadata
from stackloom.operators import dictionary, flame, profile, timeline
from stackloom.plans.catalog import query
from stackloom.plans.decode import METAS, stack_text, with_meta
from stackloom.session import exists, shared_path, stored
from stackloom.sources import frames, store, text
from stackloom.sources import tables as store_tables
from stackloom.streaming import buckets
from stackloom.sources.views import CPU_NUM, FREQ, RECORD_INTERVAL, samples, table, with_views

KEYS = ["host", "store_id"]
HOUR = 3_600_000


def tables(spark, d) -> store.Stores:
    """The stores' tables before they are written."""
    s = with_meta(spark, d).withColumn("store_id", F.concat(F.lit("cpa_"), F.date_format("ts", "yyMMdd"))).withColumn("hour", F.hour("ts"))
    sums = stored(s.groupBy(*KEYS, "hour", "meta", "frames").agg(F.sum("cnt").alias("count")), "store-sums")
    stacks = sums.select(*KEYS, "meta", "frames").distinct()
    strings = stacks.select(*KEYS, F.explode(F.array_prepend("frames", F.col("meta"))).alias("str")).distinct()
    strmap = stored(strings.withColumn("sid", F.row_number().over(Window.partitionBy(*KEYS).orderBy("str"))), "store-strmap")
    numbered = stored(stacks.withColumn("ids_id", F.row_number().over(Window.partitionBy(*KEYS).orderBy("meta", "frames"))), "store-stacks")
    parts = numbered.select(*KEYS, "ids_id", F.posexplode(F.array_prepend("frames", F.col("meta"))).alias("pos", "str")).join(strmap, [*KEYS, "str"])
    idsmap = parts.groupBy(*KEYS, "ids_id").agg(F.sort_array(F.collect_list(F.struct("pos", "sid")))["sid"].alias("sids"))
    index = (F.dense_rank().over(Window.partitionBy(*KEYS).orderBy("hour")) - 1).alias("record_idx")
    hours = sums.groupBy(*KEYS, "hour").agg(F.count("*").alias("entry_len")).select(*KEYS, "hour", "entry_len", index)
    records = hours.select(*KEYS, "record_idx", (F.col("hour") * HOUR).cast("long").alias("start_ms"), (F.col("hour") * HOUR + HOUR).cast("long").alias("end_ms"), "entry_len")
    counts = sums.join(hours, [*KEYS, "hour"]).join(numbered, [*KEYS, "meta", "frames"]).select(*KEYS, "record_idx", "ids_id", "count")
    raw = F.create_map(*[F.lit(str(x)) for x in ("cpu_num", CPU_NUM, "freq", FREQ, "record_interval", RECORD_INTERVAL)], F.lit("hostname"), F.col("host"), F.lit("mode"), F.lit("cpa: all"))
    return store.Stores(sums.select(*KEYS).distinct().withColumn("raw", raw), strmap, idsmap, store.with_guards(records), counts)


def zstd_host() -> Column:
    return F.col("host").isin("h0", "h2")


def written(spark, d) -> str:
    """A folder with the stores; made once per application and input, and again if it has been removed."""
    made = written.__dict__.setdefault("made", {})
    key = spark.sparkContext.applicationId, d
    if key not in made or not exists(spark, made[key]):
        path, whole = shared_path(spark, "stores"), tables(spark, d)
        store.write_stores(whole, path, zstd_host())
        made[key] = path
    return made[key]


def loaded(spark, d) -> store.Stores:
    return store.load_stores(spark, f"{written(spark, d)}/")


STORE = METAS + ", st as (select *, 'cpa_' || strftime(ts, '%y%m%d') as store_id, hour(ts) as hour from metas)"
HOURS = STORE + ", hours as (select host, store_id, hour, dense_rank() over (partition by host, store_id order by hour) - 1 as record_idx, count(distinct (meta, frames)) as entry_len from st group by 1, 2, 3)"
STRMAP = STORE + ", strmap as (select host, store_id, str, row_number() over (partition by host, store_id order by str) as sid from (select distinct host, store_id, unnest(list_prepend(meta, frames)) as str from st))"
STACKS = STORE + ", stacks as (select host, store_id, meta, frames, row_number() over (partition by host, store_id order by meta, frames) as ids_id from (select distinct host, store_id, meta, frames from st))"
#: What the viewer keeps: the last record goes unless a guard follows, which a record that ends the day has not.
KEPT = HOURS + ", kept as (select host, store_id, hour, record_idx from hours where hour < 23)"


@query("s1_discover_stores", with_views(STORE + " select distinct host, store_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as created from st", "samples"))
def s1(spark, d):
    return store.discover_stores(spark, written(spark, d)).select("host", "store_id", F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("s2_read_conf", with_views(STORE + f" select distinct host, store_id, {CPU_NUM} as cpu_num, {FREQ} as freq, {RECORD_INTERVAL} as record_interval, host as hostname, 'cpa: all' as mode from st", "samples"))
def s2(spark, d):
    conf = store.load_conf(spark, f"{written(spark, d)}/")
    return conf.select("host", "store_id", "cpu_num", "freq", "record_interval", F.col("raw.hostname").alias("hostname"), F.col("raw.mode").alias("mode"))


@query("s3_read_strmap", with_views(STRMAP + " select host, store_id, sid, str from strmap", "samples"))
def s3(spark, d):
    return store.read_strmap(spark, written(spark, d)).select("host", "store_id", F.col("sid").cast("long").alias("sid"), "str")


@query("s4_read_idsmap", with_views(STRMAP + STACKS.removeprefix(STORE) + ", parts as (select host, store_id, ids_id, unnest(list_prepend(meta, frames)) as str, unnest(range(1, len(frames) + 2)) as pos from stacks) select host, store_id, ids_id, string_agg(sid::varchar, ';' order by pos) as sids from parts join strmap using (host, store_id, str) group by 1, 2, 3", "samples"))
def s4(spark, d):
    return store.read_idsmap(spark, written(spark, d)).select("host", "store_id", F.col("ids_id").cast("long").alias("ids_id"), F.array_join(F.col("sids").cast("array<string>"), ";").alias("sids"))


@query("s5_read_stack_bin", with_views(HOURS + STACKS.removeprefix(STORE) + f" select st.host, st.store_id, cast(record_idx as bigint) as record_idx, cast(hour * {HOUR} as bigint) as start_ms, ids_id, cast(sum(cnt) as bigint) as count from st join hours using (host, store_id, hour) join stacks using (host, store_id, meta, frames) group by all", "samples"))
def s5(spark, d):
    records, counts = store.read_stack_bin(spark, written(spark, d))
    joined = counts.join(records, [*KEYS, "record_idx"])
    return joined.select("host", "store_id", F.col("record_idx").cast("long").alias("record_idx"), "start_ms", F.col("ids_id").cast("long").alias("ids_id"), "count")


@query("s5_records_and_guards", with_views(HOURS + f", last as (select host, store_id, max(hour) as hour, max(record_idx) + 1 as record_idx from hours group by 1, 2) select host, store_id, cast(record_idx as bigint) as record_idx, cast(hour * {HOUR} as bigint) as start_ms, cast(hour * {HOUR} + {HOUR} as bigint) as end_ms, entry_len from hours union all select host, store_id, record_idx, hour * {HOUR} + {HOUR}, hour * {HOUR} + {HOUR}, 0 from last where hour < 23", "samples"))
def s5g(spark, d):
    records = store.read_stack_bin(spark, written(spark, d))[0]
    return records.select("host", "store_id", F.col("record_idx").cast("long").alias("record_idx"), "start_ms", "end_ms", "entry_len")


@query("w6_guard_records", with_views(HOURS + f" select host, store_id, cast(max(record_idx) + 1 as bigint) as record_idx, cast(max(hour) * {HOUR} + {HOUR} as bigint) as at_ms from hours group by 1, 2 having max(hour) < 23", "samples"))
def w6(spark, d):
    records = tables(spark, d).records
    return records.where("entry_len = 0 and start_ms = end_ms").select("host", "store_id", F.col("record_idx").cast("long").alias("record_idx"), F.col("start_ms").alias("at_ms"))


@query("s6_zstd_or_plain", with_views(STORE + " select host, host in ('h0', 'h2') as packed, cast(sum(cnt) as bigint) as n from st group by 1, 2", "samples"))
def s6(spark, d):
    path = written(spark, d)
    marks = store.located(spark.read.format("binaryFile").option("pathGlobFilter", "strmap").option("recursiveFileLookup", "true").load(path).select("path", F.substring("content", 1, 4).alias("mark")))
    packed = marks.groupBy("host").agg(F.every(F.col("mark") == F.lit(store.ZSTD)).alias("packed"))
    counts = store.read_stack_bin(spark, path)[1].groupBy("host").agg(F.sum("count").cast("long").alias("n"))
    return packed.join(counts, "host").select("host", "packed", "n")


@query("s8_read_folded", with_views(METAS + " select meta, comm, cast(pid as bigint) as pid, array_to_string(frames, ';') as stack, cast(sum(cnt) as bigint) as samples from metas group by 1, 2, 3, 4", "samples"))
def s8(spark, d):
    path = shared_path(spark, "folded")
    s = with_meta(spark, d)
    text.write_folded(flame.folded_lines(flame.folded_stacks(s, F.array_prepend("frames", F.col("meta")))), path)
    rows = text.read_folded(spark, path).where("_corrupt is null")
    raw = metadata.generate_metadata(*[F.col(f"meta.{c}") for c in ("comm", "group_comm", "cgroup_id", "cpu", "pid", "env")])
    return rows.select(raw.alias("meta"), F.col("meta.comm").alias("comm"), F.col("meta.pid").cast("long").alias("pid"), stack_text(F.col("stack")).alias("stack"), "samples")


@query("s10_write_tables", with_views(STORE + " select host, store_id, count(distinct (meta, frames)) as stacks, cast(sum(cnt) as bigint) as n from st group by 1, 2", "samples"))
def s10(spark, d):
    path, s = shared_path(spark, "store-tables"), loaded(spark, d)
    late = F.col("record_idx") >= 12
    for new in (~late, late):  # two intervals: the second appends what the first has not written
        records, counts = s.records.where(new), s.counts.where(new)
        for _ in range(2):  # a repeated call adds nothing
            store_tables.append_tables(store.Stores(s.conf, s.strmap, s.idsmap, records, counts), path, "late" if new is late else "early")
    whole = store_tables.read_tables(spark, path)
    counts, stacks = whole.counts, whole.idsmap
    return counts.groupBy(*KEYS).agg(F.sum("count").cast("long").alias("n")).join(stacks.groupBy(*KEYS).agg(F.count("*").alias("stacks")), KEYS).select(*KEYS, "stacks", "n")


@query("s10_interval_sink", with_views(HOURS + f" select host, store_id, cast(record_idx as bigint) as record_idx, cast(hour * {HOUR} as bigint) as start_ms, array_to_string(list_prepend(meta, frames), ';') as stack, cast(sum(cnt) as bigint) as n from st join hours using (host, store_id, hour) group by 1, 2, 3, 4, 5", "samples"))
def s10i(spark, d):
    """Hourly buckets come as a stream, twelve hours of all days in a batch; a batch is also sent twice."""
    path = shared_path(spark, "interval-sink")
    s = with_meta(spark, d).withColumn("store_id", F.concat(F.lit("cpa_"), F.date_format("ts", "yyMMdd"))).withColumn("hour", F.hour("ts"))
    start = (F.col("hour") * HOUR).cast("long")
    hours = s.groupBy(*KEYS, start.alias("start_ms"), (start + HOUR).alias("end_ms"), "meta", "frames").agg(F.sum("cnt").alias("count"))
    buckets = stored(hours, "hour-buckets")
    for i in range(2):
        buckets.where(F.floor(F.col("start_ms") / (12 * HOUR)) == i).write.mode("append").parquet(f"{path}/feed")
        stream = spark.readStream.schema(buckets.schema).parquet(f"{path}/feed")
        sink = store_tables.interval_sink(f"{path}/tables")
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    sink(buckets, 1)
    whole = store_tables.read_tables(spark, f"{path}/tables")
    stacks = dictionary.decode_shared(whole.idsmap, whole.strmap).select(*KEYS, "ids_id", stack_text(F.col("parts")).alias("stack"))
    rows = whole.counts.join(whole.records, [*KEYS, "record_idx"]).join(stacks, [*KEYS, "ids_id"])
    return rows.select(*KEYS, F.col("record_idx").cast("long").alias("record_idx"), "start_ms", "stack", F.col("count").alias("n"))


@query("s11_split_store", with_views(HOURS + " select host, store_id, array_to_string(list_prepend(meta, frames), ';') as stack, cast(sum(cnt) as bigint) as n from st join hours using (host, store_id, hour) where record_idx between 3 and 7 group by 1, 2, 3", "samples"))
def s11(spark, d):
    s = loaded(spark, d)
    strmap, idsmap, counts = store.split_store(s.records.where("record_idx between 3 and 7"), s.counts, s.idsmap, s.strmap)
    part = store.Stores(s.conf, strmap, idsmap, s.records, counts)
    sums = counts.groupBy(*KEYS, "ids_id").agg(F.sum("count").cast("long").alias("cnt"))
    rows = profile.decoded(sums, part, "export")
    return rows.select(*KEYS, stack_text(F.array_prepend("frames", F.col("raw"))).alias("stack"), F.col("cnt").alias("n"))


@query("s12_write_conf", with_views(STORE + f", h as (select host, count(distinct store_id) as n from st group by 1) select unnest(['cpu_num: {CPU_NUM}', 'freq: {FREQ}', 'record_interval: {RECORD_INTERVAL}', 'hostname: ' || host, 'mode: cpa: all']) as value, unnest([n, n, n, n, n]) as n from h", "samples").replace("select unnest(['cpu_num", "select value, cast(sum(n) as bigint) as n from (select unnest(['cpu_num") + ") group by 1")
def s12(spark, d):
    return store.conf_lines(store.load_conf(spark, f"{written(spark, d)}/")).groupBy("value").agg(F.count("*").alias("n"))


@query("s13_read_sample_stream", with_views(" select host, comm, count(*) as n, cast(sum(k) as bigint) as weight from samples where k % 5 <> 0 group by 1, 2", "samples"))
def s13(spark, d):
    path = shared_path(spark, "sample-feed")
    null = F.lit(None)
    s = samples(spark, d)
    feed = s.select(
        F.when(F.col("k") % 5 != 0, F.col("host")).alias("host"), F.col("ts").cast("timestamp").alias("ts"), null.cast("bigint").alias("record_ms"), F.col("pid").cast("int").alias("pid"), F.col("pid").cast("int").alias("tid"), F.col("cpu").cast("int").alias("cpu"),
        F.col("cgroup_id").cast("decimal(20,0)").alias("cgroup_id"), "comm", "group_comm", "env", F.col("frames").alias("user_frames"), F.array().cast("array<string>").alias("kernel_frames"), F.col("k").alias("weight"),
    )
    feed.write.parquet(f"{path}/in")
    stream = text.read_sample_stream(spark, f"{path}/in", max_files=2).select("host", "comm", "weight")
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out").groupBy("host", "comm").agg(F.count("*").alias("n"), F.sum("weight").cast("long").alias("weight"))


@query("s13_tail_stores", with_views(HOURS + " select st.host, st.store_id, cast(record_idx as bigint) as record_idx, cast(sum(cnt) as bigint) as n, count(distinct (meta, frames)) as entries from st join hours using (host, store_id, hour) group by 1, 2, 3", "samples"))
def s13t(spark, d):
    """A stream over store folders that grow between two runs: the records of half a day, then of all of it."""
    path, whole = shared_path(spark, "growing"), tables(spark, d)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", buckets.ROCKSDB)
    records = stored(whole.records.where("entry_len > 0"), "growing-records")
    for until in (12, 24):
        part = records.where(F.col("start_ms") < until * HOUR)
        counts = whole.counts.join(part.select(*KEYS, "record_idx"), [*KEYS, "record_idx"], "left_semi")
        store.write_stores(store.Stores(whole.conf, whole.strmap, whole.idsmap, part, counts), f"{path}/stores", zstd=False)
        run = frames.tail_stores(spark, f"{path}/stores").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").start()
        run.processAllAvailable()
        run.stop()
    rows = spark.read.parquet(f"{path}/out")
    return rows.groupBy(*KEYS, F.col("record_idx").cast("long").alias("record_idx")).agg(F.sum("count").cast("long").alias("n"), F.count("*").alias("entries"))


@query("s14_read_kallsyms", "select cast(18446744071562067968 + p_partkey * 4096::hugeint as varchar) as addr, case when p_partkey % 2 = 0 then 'T' else 't' end as kind, 'sym_' || p_partkey as sym from part where p_partkey % 5 <> 0")
def s14(spark, d):
    path = shared_path(spark, "kallsyms")
    over = F.col("p_partkey") * 4096 - F.lit(2147483648).cast("long")
    address = F.concat(F.when(over >= 0, "1").otherwise(""), F.lower(F.lpad(F.hex(over), 16, "0")))  # 0xffffffff80000000 and up, also past 64 bits
    line = F.concat(address, F.lit(" "), F.when(F.col("p_partkey") % 2 == 0, "T").otherwise("t"), F.lit(" sym_"), F.col("p_partkey").cast("string"), F.lit("\t[module]"))
    table(spark, d, "part").select(F.when(F.col("p_partkey") % 5 != 0, line).otherwise("not a symbol").alias("value")).write.text(path)
    found = text.read_kallsyms(spark, path)
    return found.select(F.col("addr").cast("string").alias("addr"), "kind", "sym")


@query("s16_split_callchain", with_views(" select sample_id, case when k % 3 = 0 then '' else array_to_string(list_transform(range(0, least(k % 7, 4)), lambda i: (18446744071562067968 + (k + i) * 16::hugeint)::varchar), ';') end as kernel, array_to_string(list_transform(range(0, least(k % 9, 4)), lambda i: (4096 + (k + i) * 8)::varchar), ';') as user_part from samples", "samples"))
def s16(spark, d):
    def chain(n, base, step):
        return F.transform(F.slice(F.sequence(F.lit(0), F.lit(9)), F.lit(1), n.cast("int")), lambda i: (F.lit(base).cast(text.ADDRESS) + (F.col("k") + i) * step).cast(text.ADDRESS))

    def mark(value):
        return F.array(F.lit(str(value)).cast(text.ADDRESS))

    kernel = F.when(F.col("k") % 3 == 0, F.array().cast(f"array<{text.ADDRESS}>")).otherwise(F.concat(mark(text.KERNEL_CONTEXT), chain(F.col("k") % 7, "18446744071562067968", 16)))
    ips = F.concat(kernel, mark(text.USER_CONTEXT), chain(F.col("k") % 9, "4096", 8))
    parts = samples(spark, d).select("sample_id", text.split_callchain(ips, 4).alias("c"))
    return parts.select("sample_id", *[F.array_join(F.col(f"c.{c}").cast("array<string>"), ";").alias(n) for c, n in (("kernel", "kernel"), ("user", "user_part"))])


@query("s17_data_source", with_views(HOURS + " select st.host, st.store_id, cast(record_idx as bigint) as record_idx, cast(sum(cnt) as bigint) as n from st join hours using (host, store_id, hour) group by 1, 2, 3", "samples"))
def s17(spark, d):
    rows = frames.read_stores(spark, f"{written(spark, d)}/*/*")
    return rows.groupBy(*KEYS, F.col("record_idx").cast("long").alias("record_idx")).agg(F.sum("count").cast("long").alias("n"))


@query("s17_pruned_by_index", with_views(HOURS + f" select st.host, st.store_id, cast(record_idx as bigint) as record_idx, cast(sum(cnt) as bigint) as n from st join hours using (host, store_id, hour) where host in ('h0', 'h1') and hour between 6 and 8 group by 1, 2, 3", "samples"))
def s17i(spark, d):
    """Three hours of two hosts, one with packed and one with plain files; other chunks are not opened."""
    path, index = written(spark, d), shared_path(spark, "frame-index")
    frames.write_index(spark, path, index)
    rows = frames.read_stores(spark, path, index).where(f"host in ('h0', 'h1') and start_ms >= {6 * HOUR} and end_ms <= {9 * HOUR}")
    return rows.groupBy(*KEYS, F.col("record_idx").cast("long").alias("record_idx")).agg(F.sum("count").cast("long").alias("n"))


FOLDED = " select env || ';' || group_comm || ';' || array_to_string(frames, ';') || ';' as stack, cast(sum(cnt) as bigint) as samples from st join {records} using (host, store_id, hour) where {condition} group by 1"


@query("p1_folded_profile", with_views(KEPT + FOLDED.format(records="kept", condition="cpu < 4"), "samples"))
def p1(spark, d):
    """Stores to folded stacks as the viewer shows them, filtered by CPU."""
    return profile.folded_profile(loaded(spark, d), F.array("env", "group_comm"), condition=F.col("cpu") < 4)


@query("p2_folded_profile_export", with_views(HOURS + ", ends as (select host, store_id, min(hour) filter (where hour + 1 >= least(z + 1, 9.5)) as stop from (select *, max(hour) over (partition by host, store_id) as z from hours) group by 1, 2), chosen as (select host, store_id, hour from hours join ends using (host, store_id) where hour <= stop)" + FOLDED.format(records="chosen", condition="pid % 3 = 1"), "samples"))
def p2(spark, d):
    """The export's range of each store, up to half past nine, filtered by process."""
    s = loaded(spark, d)
    whole = store.Stores(s.conf, s.strmap, s.idsmap, s.records.where("entry_len > 0"), s.counts)
    return profile.folded_profile(whole, F.array("env", "group_comm"), end_ms=int(9.5 * HOUR), condition=F.col("pid") % 3 == 1, mode="export")


@query("r8_union_history", with_views(HOURS + f" select host, cast(row_number() over (partition by host order by store_id, record_idx) - 1 as bigint) as record_idx, cast(epoch_ms(strptime(substr(store_id, 5), '%y%m%d')) + hour * {HOUR} as bigint) as start_ms, cast(entry_len as bigint) as entry_len from hours", "samples"))
def r8h(spark, d):
    s = loaded(spark, d)
    created = store.discover_stores(spark, written(spark, d)).select(*KEYS, "created")
    whole = timeline.union_records(s.records.where("entry_len > 0"), created)
    return whole.select("host", "record_idx", "start_ms", "entry_len")
