"""Queries that join by address or by time."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackloom.operators import symbols as sym
from stackloom.plans.catalog import query
from stackloom.sources.views import exits, ips, maps, samples, switches, symbols, table, with_views

RESOLVED = " select ip, case when addr is null then '0x' || lower(to_hex(ip)) || '_[k]' else sym || '_[k]+' || (ip - addr) end as symbol from ips asof left join symbols on ip >= addr"


@query("j1_symbol_asof", with_views(RESOLVED, "ips", "symbols"))
def j1(spark, d):
    return sym.resolve(ips(spark, d), symbols(spark, d))


@query("j1_symbol_asof_sorted", with_views(RESOLVED, "ips", "symbols"))
def j1s(spark, d):
    found = sym.floor_join(ips(spark, d), symbols(spark, d), "ip", "addr", block=50_000)
    return found.select("ip", sym.symbol_text(F.col("ip"), F.col("addr"), F.col("sym")).alias("symbol"))


@query("j2_half_open_intervals", with_views(", t as (select addr, least(addr + 500, coalesce(lead(addr) over (order by addr), addr + 500)) as stop, sym from symbols) select ip, case when ip < stop then sym end as sym from ips asof left join t on ip >= addr", "ips", "symbols"))
def j2(spark, d):
    table_ = sym.half_open_intervals(symbols(spark, d), "addr").withColumn("stop", F.least("stop", F.col("addr") + 500))
    return sym.interval_join(ips(spark, d), table_, "ip", "addr", "stop").select("ip", "sym")


POINTS = ", points as (select distinct l_orderkey + l_linenumber as p from lineitem)"


@query("j3_closed_intervals", with_views(POINTS + ", hit as (select p, map_id, first, last, row_number() over (partition by p order by last - first, first, map_id) as r from points join maps on p between first and last) select cast(p as bigint) as p, map_id, first, last from hit where r = 1", "maps"))
def j3(spark, d):
    points = table(spark, d, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber")).cast("long").alias("p")).distinct()
    return sym.closed_interval_join(points, maps(spark, d), "p")


@query("j4_address_module", with_views(", m as (select cast(l_partkey as bigint) % 5 as pid, 0 as z), q as (select distinct ip % 3 as pid, ip from ips), t as (select addr % 2000 // 1000 as pid, addr, sym from symbols) select q.pid, ip, coalesce(case when ip < addr + 900 then sym end, 'anon exec segment') as module from q asof left join t on q.pid = t.pid and ip >= addr", "ips", "symbols").replace("m as (select cast(l_partkey as bigint) % 5 as pid, 0 as z), ", ""))
def j4(spark, d):
    points = ips(spark, d).withColumn("pid", F.col("ip") % 3)
    table_ = symbols(spark, d).withColumn("pid", F.floor(F.col("addr") % 2000 / 1000).cast("long"))
    found = sym.floor_join(points, table_, "ip", "addr", keys=["pid"])
    return found.select("pid", "ip", F.coalesce(F.when(F.col("ip") < F.col("addr") + 900, F.col("sym")), F.lit("anon exec segment")).alias("module"))


@query("j7_process_generations", with_views(", e as (select host, pid, ts, 1 as is_sample, sample_id from samples union all select host, pid, exit_ts, 0, null from exits), g as (select *, sum(1 - is_sample) over (partition by host, pid order by ts, is_sample desc rows unbounded preceding) as generation from e) select sample_id, cast(generation as bigint) as generation from g where is_sample = 1", "samples", "exits"))
def j7(spark, d):
    return sym.generations(samples(spark, d), exits(spark, d))


@query("j8_symbol_versions", "with s as (select p_size % 5 as host, v as version, p_partkey as addr, case when v = 2 and p_size % 5 = 1 then p_name || '2' else p_name end as sym from part, (values (1), (2), (3)) t(v)), d as (select host, version, count(*) as n_symbols, string_agg(addr || sym, ',' order by addr) as c from s group by 1, 2) select cast(host as bigint) as host, cast(version as bigint) as version, n_symbols, coalesce(c <> lag(c) over (partition by host order by version), true) as changed from d")
def j8(spark, d):
    host = (F.col("p_size") % 5).cast("long")
    versions = table(spark, d, "part").select(host.alias("host"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("version"), F.col("p_partkey").alias("addr"), F.col("p_name").alias("sym"))
    versions = versions.withColumn("sym", F.when((F.col("version") == 2) & (F.col("host") == 1), F.concat("sym", F.lit("2"))).otherwise(F.col("sym")))
    return sym.snapshot_changes(versions, "version", ["host"], ["addr", "sym"])


#: Four hosts' symbol tables at four times, six days apart: the second equals the first, odd hosts have other names from the third on, the fourth lacks some addresses.
SNAPSHOTS = ", t0 as (select min(ts) as t0 from samples), snapshots as (select 'h' || h as host, t0 + to_days((1 + v * 6)::integer) as taken, addr + h * 100 as addr, sym || case when v >= 2 and h % 2 = 1 then '#2' else '' end as sym from symbols, t0, range(0, 4) a(h), range(0, 4) b(v) where not (v = 3 and addr % 7000 = 0)), points as (select distinct host, ts, (sample_id % 1500) * 1000 + k * 13 as ip from samples), versions as (select distinct host, taken from snapshots)"


def snapshots(spark, d):
    first = samples(spark, d).agg(F.min("ts").alias("t0"))  # one row
    host, version = (F.explode(F.sequence(F.lit(0), F.lit(3))) for _ in range(2))
    rows = symbols(spark, d).crossJoin(F.broadcast(first)).withColumn("h", host).withColumn("v", version).where(~((F.col("v") == 3) & (F.col("addr") % 7000 == 0)))
    taken = F.unix_micros(F.col("t0").cast("timestamp")) + (F.col("v") * 6 + 1).cast("long") * 86_400_000_000
    name = F.when((F.col("v") >= 2) & (F.col("h") % 2 == 1), F.concat("sym", F.lit("#2"))).otherwise(F.col("sym"))
    return rows.select(F.concat(F.lit("h"), F.col("h").cast("string")).alias("host"), taken.alias("taken"), (F.col("addr") + F.col("h") * 100).alias("addr"), name.alias("sym"))


def timed_ips(spark, d):
    return samples(spark, d).select("host", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.col("sample_id") % 1500 * 1000 + F.col("k") * 13).alias("ip"))


@query("j8_symbols_at_time", with_views(SNAPSHOTS + ", placed as (select p.*, v.taken from points p asof left join versions v on p.host = v.host and p.ts >= v.taken) select p.host, epoch_us(p.ts) as at, p.ip, case when s.addr is null then '0x' || lower(to_hex(p.ip)) || '_[k]' else sym || '_[k]+' || (p.ip - s.addr) end as symbol from placed p asof left join snapshots s on p.host = s.host and p.taken = s.taken and p.ip >= s.addr", "samples", "symbols"))
def j8_at(spark, d):
    return sym.resolve_at(timed_ips(spark, d), snapshots(spark, d)).select("host", "at", "ip", "symbol")


@query("j1_symbols_of_hosts", with_views(SNAPSHOTS + ", p as (select distinct host, ip from points), s as (select * from snapshots where taken = (select min(taken) from versions)) select p.host, p.ip, case when addr is null then '0x' || lower(to_hex(p.ip)) || '_[k]' else sym || '_[k]+' || (p.ip - addr) end as symbol from p asof left join s on p.host = s.host and p.ip >= s.addr", "samples", "symbols"))
def j1_hosts(spark, d):
    table_ = snapshots(spark, d)
    first = table_.agg(F.min("taken").alias("first"))  # one row
    return sym.resolve(timed_ips(spark, d), table_.join(F.broadcast(first), F.col("taken") == F.col("first")), ["host"])


@query("m6_names_by_lifetime", with_views(", names as (select host, pid, exit_ts as valid_from, case when pid % 4 = 0 then null else 'run-' || (epoch_us(exit_ts) % 1000) end as comm from exits), n as (select host, pid, valid_from, any_value(comm) as comm from names group by 1, 2, 3), p as (select distinct host, pid, ts from samples) select p.host, p.pid, epoch_us(ts) as at, case when valid_from is null then '<exit task>' else coalesce(comm, '<err read comm>') end as comm from p asof left join n on p.host = n.host and p.pid = n.pid and p.ts >= n.valid_from", "samples", "exits"))
def m6_lifetime(spark, d):
    """Each exit of a process is followed by one of another name."""
    us = F.unix_micros(F.col("exit_ts").cast("timestamp"))
    names = exits(spark, d).select("host", "pid", us.alias("valid_from"), F.when(F.col("pid") % 4 != 0, F.concat(F.lit("run-"), (us % 1000).cast("string"))).alias("comm"))
    return sym.process_names(samples(spark, d).select("host", "pid", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")), names)


@query("s15_merge_maps", "with l as (select o_custkey % 4 as host, o_custkey as pid, o_orderkey as line_no, o_totalprice::bigint as start, o_totalprice::bigint + 100 as stop, o_orderstatus as perm, o_orderpriority as path from orders), f as (select *, case when lag(perm) over w = perm and lag(path) over w = path then 0 else 1 end as new from l window w as (partition by host, pid order by line_no)), i as (select *, sum(new) over (partition by host, pid order by line_no rows unbounded preceding) as island from f) select cast(host as bigint) as host, cast(pid as bigint) as pid, min(line_no) as start, max(line_no) + 1 as stop, any_value(perm) as perm, any_value(path) as path from i group by host, pid, island")
def s15(spark, d):
    o = table(spark, d, "orders")
    lines = o.select((F.col("o_custkey") % 4).cast("long").alias("host"), F.col("o_custkey").cast("long").alias("pid"), F.col("o_orderkey").alias("line_no"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 1).alias("stop"), F.col("o_orderstatus").alias("perm"), F.col("o_orderpriority").alias("path"))
    return sym.merge_maps(lines)


OFF_CPU_SQL = with_views(", l as (select *, lag(kind) over w as before, lag(ts) over w as out_ts from switches window w as (partition by tid order by ts, event_id)) select event_id, tid, epoch_us(ts) - epoch_us(out_ts) as blocked_us from l where kind = 'in' and before = 'out' and ts > out_ts", "switches")


@query("w9_off_cpu", OFF_CPU_SQL)
def w9(spark, d):
    return sym.off_cpu(switches(spark, d))
