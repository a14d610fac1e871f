"""Queries on dictionaries, metadata, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackloom.functions import cpuset, frames, metadata
from stackloom.operators import dictionary, filters, flame
from stackloom.plans.catalog import query
from stackloom.session import stored
from stackloom.sources.views import samples, table, ticks, with_views

META_SQL = "substr(rpad(comm, 15, ' '), 1, 15) || substr(rpad(group_comm, 15, ' '), 1, 15) || '-' || cgroup_id || '-' || cpu || '-' || pid || '|' || env"


def with_meta(spark, d):
    c = [F.col(n) for n in ("comm", "group_comm", "cgroup_id", "cpu", "pid", "env")]
    return samples(spark, d).withColumn("meta", metadata.generate_metadata(*c))


def stack_text(column):
    return F.array_join(column, ";")


METAS = ", metas as (select *, " + META_SQL + " as meta from samples)"
STRINGS = METAS + ", strings as (select str, row_number() over (order by str) as sid from (select distinct unnest(list_prepend(meta, frames)) as str from metas))"


@query("d1_intern_strings", with_views(STRINGS + " select str, cast(sid as bigint) as sid from strings", "samples"))
def d1(spark, d):
    return dictionary.intern_strings(with_meta(spark, d))


@query("d2_intern_stacks", with_views(METAS + ", uses as (select meta, frames, count(*) as uses from metas group by 1, 2) select array_to_string(list_prepend(meta, frames), ';') as stack, uses, cast(row_number() over (order by meta, frames) as bigint) as ids_id from uses", "samples"))
def d2(spark, d):
    s = with_meta(spark, d)
    uses = s.groupBy("meta", "frames").agg(F.count("*").alias("uses"))
    return uses.join(dictionary.intern_stacks(s), ["meta", "frames"]).select(stack_text(F.array_prepend("frames", F.col("meta"))).alias("stack"), "uses", "ids_id")


def encoded(spark, d):
    s = with_meta(spark, d)
    strings = dictionary.intern_strings(s)
    return dictionary.encode_stacks(dictionary.intern_stacks(s), strings), strings


@query("d3_decode_stacks", with_views(METAS + " select distinct array_to_string(list_prepend(meta, frames), ';') as stack from metas", "samples"))
def d3(spark, d):
    stacks, strings = encoded(spark, d)
    return dictionary.decode_stacks(stacks, strings).select(stack_text(F.col("parts")).alias("stack"))


@query("d4_lost_string_id", with_views(STRINGS + ", stacks as (select distinct list_prepend(meta, frames) as p from metas), parts as (select p, unnest(p) as str, unnest(range(1, len(p) + 1)) as pos from stacks), marked as (select p, pos, case when sid % 7 = 0 then '<# STRMAP LOST ID #>' else parts.str end as str from parts join strings using (str)) select stack, count(*) as n from (select p, string_agg(str, ';' order by pos) as stack from marked group by p) group by stack", "samples"))
def d4(spark, d):
    stacks, strings = encoded(spark, d)
    decoded = dictionary.decode_stacks(stacks, strings.where("sid % 7 <> 0"), "export")
    return decoded.groupBy(stack_text(F.col("parts")).alias("stack")).agg(F.count("*").alias("n"))


@query("d4_lost_string_id_viewer", with_views(STRINGS + ", stacks as (select distinct list_prepend(meta, frames) as p from metas), parts as (select p, unnest(p) as str, unnest(range(1, len(p) + 1)) as pos from stacks), marked as (select p, pos, parts.str from parts join strings using (str) where sid % 7 <> 0) select stack, count(*) as n from (select p, string_agg(str, ';' order by pos) as stack from marked group by p) group by stack", "samples"))
def d4v(spark, d):
    stacks, strings = encoded(spark, d)
    decoded = dictionary.decode_stacks(stacks, strings.where("sid % 7 <> 0"), "viewer")
    return decoded.groupBy(stack_text(F.col("parts")).alias("stack")).agg(F.count("*").alias("n"))


@query("d5_lost_stack_id", with_views(" select case when k % 5 = 0 then 'lost' else 'known' end as state, count(*) as n, cast(sum(cnt) as bigint) as weight from samples group by 1", "samples"))
def d5(spark, d):
    s = samples(spark, d)
    known = s.where("k % 5 <> 0").select("k").distinct()
    report = dictionary.lost_stacks(s.withColumnRenamed("k", "ids_id").select("ids_id", "cnt"), known.withColumnRenamed("k", "ids_id"), "cnt")
    return report.select("state", "n", "weight")


@query("d6_dictionary_delta", with_views(METAS + ", strs as (select distinct ts < (select min(ts) + interval 15 day from samples) as is_old, unnest(list_prepend(meta, frames)) as str from metas) select distinct str from strs where not is_old and str not in (select str from strs where is_old)", "samples"))
def d6(spark, d):
    s = with_meta(spark, d)
    cut = s.agg((F.min("ts") + F.expr("interval 15 days")).alias("cut"))
    parts = s.crossJoin(F.broadcast(cut)).select((F.col("ts") < F.col("cut")).alias("is_old"), F.explode(F.array_prepend("frames", F.col("meta"))).alias("str"))  # one row
    return dictionary.dictionary_delta(parts.where("not is_old"), parts.where("is_old"))


@query("d6_stable_ids", with_views(METAS.replace("metas as", "all_metas as") + ", x as (select s, min(late) as late from (select unnest(list_prepend(meta, frames)) as s, sample_id % 10 >= 7 as late from all_metas) group by s) select s as str, row_number() over (order by late, s) as sid, late as is_new from x", "samples"))
def d6_stable(spark, d):
    """Seven tenths of the samples make a dictionary; the rest adds to it."""
    s, late = with_meta(spark, d), F.col("sample_id") % 10 >= 7
    strings = s.select(late.alias("late"), F.explode(F.array_prepend("frames", F.col("meta"))).alias("str"))
    first = stored(dictionary.dense_ids(strings.where("not late"), "str", "sid"), "first-ids")
    added = dictionary.merge_ids(strings.where("late"), first, "str", "sid").where("is_new")
    again = dictionary.merge_ids(strings, first.unionByName(added.drop("is_new")), "str", "sid")
    assert again.where("is_new").isEmpty()  # a repeated run finds everything stored
    return first.withColumn("is_new", F.lit(False)).unionByName(added)


@query("d7_dictionary_size", with_views(METAS + ", strs as (select distinct unnest(list_prepend(meta, frames)) as str from metas), stacks as (select distinct list_prepend(meta, frames) as p from metas) select cast((select sum(octet_length(encode(str))) from strs) as bigint) as string_bytes, cast((select sum(len(p) * 4) from stacks) as bigint) as list_bytes", "samples"))
def d7(spark, d):
    s = with_meta(spark, d)
    parts = s.select(F.array_prepend("frames", F.col("meta")).alias("p")).distinct()
    strings = s.select(F.explode(F.array_prepend("frames", F.col("meta"))).alias("str")).distinct()
    return strings.agg(dictionary.string_bytes(F.col("str")).alias("string_bytes")).crossJoin(parts.agg(dictionary.list_bytes(F.col("p")).alias("list_bytes")))


@query("d8_has_kernel", with_views(" select array_to_string(frames, ';') as stack, bool_or(len(list_filter(frames, lambda f: contains(f, '_[k]'))) > 0) as has_kernel, count(*) as n from samples group by 1", "samples"))
def d8(spark, d):
    stacks = samples(spark, d).groupBy("frames").agg(F.count("*").alias("n"))
    return stacks.select(stack_text(F.col("frames")).alias("stack"), frames.has_kernel(F.col("frames")).alias("has_kernel"), "n")


@query("m1_parse_metadata", with_views(METAS + " select distinct meta, comm, substr(group_comm, 1, 15) as group_comm, cgroup_id, cpu, pid, env from metas", "samples"))
def m1(spark, d):
    parsed = with_meta(spark, d).select("meta").distinct().withColumn("m", metadata.parse_metadata(F.col("meta")))
    return parsed.select("meta", "m.comm", "m.group_comm", F.col("m.cgroup_id").cast("long").alias("cgroup_id"), F.col("m.cpu").cast("long").alias("cpu"), "m.pid", "m.env")


@query("m2_generate_metadata", with_views(METAS + " select sample_id, meta from metas", "samples"))
def m2(spark, d):
    return with_meta(spark, d).select("sample_id", "meta")


@query("m3_select_env", "select event_id as sample_id, case when user_id % 11 = 0 then 'SYSTEM' when user_id % 3 = 0 then 'z' || user_id when user_id % 3 = 1 then event_type else 'SYSTEM' end as env from events")
def m3(spark, d):
    e = table(spark, d, "events")
    user = F.col("user_id").cast("string")
    environ = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("A=1\0ZONE=z"), user, F.lit("\0POD="), "event_type")).when(F.col("user_id") % 3 == 1, F.concat(F.lit("B=\0POD="), "event_type", F.lit("\0ZONE=z"), user)).otherwise("PATH=/bin\0HOME=/")
    return e.select(F.col("event_id").alias("sample_id"), metadata.select_env(environ, ["POD", "ZONE"], F.col("user_id") % 11 == 0).alias("env"))


@query("m4_kernel_group_name", with_views(" select sample_id, case when pid % 9 = 0 then '[kernel]' else group_comm end as group_comm from samples", "samples"))
def m4(spark, d):
    return samples(spark, d).select("sample_id", metadata.group_name(F.col("group_comm"), F.col("pid") % 9 == 0).alias("group_comm"))


@query("m5_should_unwind_user", with_views(" select sample_id, case when env in ('pod-1', 'pod-3') then len(frames) else 0 end as user_depth from samples", "samples"))
def m5(spark, d):
    keep = metadata.should_unwind_user(F.col("env"), True, ["pod-1", "pod-3"])
    return samples(spark, d).select("sample_id", F.when(keep, F.size("frames")).otherwise(0).cast("long").alias("user_depth"))


@query("m6_process_name", with_views(" select sample_id, coalesce(c_name, '<exit task>') as name from samples left join (select c_custkey, min(c_name) as c_name from customer group by 1) c on c_custkey = pid", "samples"))
def m6(spark, d):
    names = table(spark, d, "customer").groupBy(F.col("c_custkey").cast("long").alias("pid")).agg(F.min("c_name").alias("c_name"))
    return samples(spark, d).join(names, "pid", "left").select("sample_id", metadata.process_name(F.col("c_name")).alias("name"))


@query("m6_process_name_unreadable", with_views(" select sample_id, case when k % 4 = 0 then '<err read comm>' when pid % 3 = 0 then '<exit task>' else comm end as name from samples", "samples"))
def m6u(spark, d):
    return samples(spark, d).select("sample_id", metadata.process_name(F.when(F.col("pid") % 3 != 0, F.col("comm")), F.col("k") % 4 != 0).alias("name"))


@query("m7_export_labels", with_views(" select sample_id, env || ';' || group_comm || ':' || pid || ';' || comm as label from samples", "samples"))
def m7(spark, d):
    return samples(spark, d).select("sample_id", stack_text(metadata.export_labels(pid=True, thread=True)).alias("label"))


@query("m8_viewer_labels", with_views(" select sample_id, env || ';CGID ' || cgroup_id || ';CPU ' || lpad(cast(cpu as varchar), 4, ' ') || ';' || group_comm || ':' || pid || ';' || comm as label from samples", "samples"))
def m8(spark, d):
    return samples(spark, d).select("sample_id", stack_text(metadata.viewer_labels(env=True, cgroup=True, cpu=True, group=True, pid=True, comm=True)).alias("label"))


TOGGLES = ("env", "cgroup", "cpu", "group", "pid", "comm")


@query("m8_viewer_toggles", with_views(", t as (select unnest(range(0, 64)) as t), one as (select env, cgroup_id, cpu, group_comm, pid, comm, count(*) as n from samples group by all) select t as toggles, array_to_string(list_filter([case when t & 1 > 0 then env end, case when t & 2 > 0 then 'CGID ' || cgroup_id end, case when t & 4 > 0 then 'CPU ' || lpad(cast(cpu as varchar), 4, ' ') end, case when t & 16 > 0 and t & 8 > 0 then group_comm || ':' || pid when t & 16 > 0 then pid::varchar when t & 8 > 0 then comm end, case when t & 32 > 0 then comm end], lambda x: x is not null), ';') as label, cast(sum(n) as bigint) as n from one, t group by 1, 2", "samples"))
def m8t(spark, d):
    s = samples(spark, d).groupBy("env", "cgroup_id", "cpu", "group_comm", "pid", "comm").agg(F.count("*").alias("n"))
    s = s.repartition("pid")  # most labels are of one process, so they are summed in full before they are shuffled
    each = [F.struct(F.lit(t).cast("long").alias("toggles"), stack_text(metadata.viewer_labels(**{name: bool(t >> i & 1) for i, name in enumerate(TOGGLES)})).alias("label")) for t in range(64)]
    rows = s.select("n", F.explode(F.array(*each)).alias("t")).select("t.toggles", "t.label", "n")
    return rows.groupBy("toggles", "label").agg(F.sum("n").cast("long").alias("n"))


@query("f1_viewer_filters", with_views(" select sample_id from samples where cpu in (0, 1, 2, 3) and env = 'pod-2' and group_comm <> 'app3'", "samples"))
def f1(spark, d):
    chosen = filters.ViewerFilter().set("cpu 0-3").set("pod pod-2").set("commv app3")
    return samples(spark, d).where(chosen.condition()).select("sample_id")


@query("f2_export_filters", with_views(" select sample_id from samples where cgroup_id = 4 and cpu in (0, 2, 4, 6) and starts_with(group_comm, 'app')", "samples"))
def f2(spark, d):
    return samples(spark, d).where(filters.export_filter(cgroup=4, cpus={0, 2, 4, 6}, comm="app")).select("sample_id")


@query("f3_parse_cpu_set", "select o_orderkey, array_to_string(list_sort(list_distinct(list_concat(range(least(a, b), greatest(a, b) + 1), [c]))), ',') as cpus from (select o_orderkey, o_custkey % 8 as a, o_orderkey % 8 as b, o_custkey % 13 as c from orders)")
def f3(spark, d):
    text = F.concat((F.col("o_custkey") % 8).cast("string"), F.lit("-"), (F.col("o_orderkey") % 8).cast("string"), F.lit(", "), (F.col("o_custkey") % 13).cast("string"), F.lit(",x"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(cpuset.cpu_set(text).cast("array<string>"), ",").alias("cpus"))


@query("f4_format_cpu_set", with_views(", d as (select distinct pid, cpu from samples), i as (select *, cpu - row_number() over (partition by pid order by cpu) as g from d), r as (select pid, min(cpu) as a, max(cpu) as b from i group by pid, g) select pid, string_agg(case when a = b then a::varchar else a || '-' || b end, ',' order by a) as cpu_set from r group by pid", "samples"))
def f4(spark, d):
    return cpuset.format_cpu_set(samples(spark, d), ["pid"])


@query("f5_filter_commands", with_views(" select sample_id from samples where cpu in (0, 1, 2, 3) and group_comm <> 'app3' and pid <> 17", "samples"))
def f5(spark, d):
    chosen = filters.ViewerFilter()
    for command in ("cpu 0-3", "pod pod-2", "commv app3", "pidv 17"):
        chosen = chosen.set(command)
    return samples(spark, d).where(chosen.unset("pod").condition()).select("sample_id")


@query("f6_kernel_only", with_views(" select sample_id from samples where array_to_string(frames, ';') like '%\\_[k]%' escape '\\'", "samples"))
def f6(spark, d):
    return samples(spark, d).where(frames.has_kernel(F.col("frames"))).select("sample_id")


@query("f7_hash_rows", with_views(" select sample_id, array_to_string(list_filter(list_transform(frames, lambda f: case when contains(f, 'handler_3') then '#' || f else f end), lambda f: not starts_with(f, '#')), ';') as stack from samples where k % 10 <> 7", "samples"))
def f7(spark, d):
    s = samples(spark, d).withColumn("meta", F.when(F.col("k") % 10 == 7, F.lit("#lost")).otherwise(F.col("comm")))
    marked = F.transform("frames", lambda f: F.when(f.contains("handler_3"), F.concat(F.lit("#"), f)).otherwise(f))
    return s.where(~F.col("meta").startswith("#")).select("sample_id", stack_text(frames.without_hash(marked)).alias("stack"))


@query("f8_unparseable_metadata", with_views(" select mode, count(*) as n from samples, (values ('export'), ('tree'), ('curve')) m(mode) where case when k % 6 = 0 then mode <> 'tree' else cpu < 4 end group by mode", "samples"))
def f8(spark, d):
    ok, condition = F.col("k") % 6 != 0, F.col("cpu") < 4
    s = samples(spark, d)
    kept = F.array_compact(F.array(*[F.when(filters.unparseable_policy(ok, condition, m), F.lit(m)) for m in ("export", "tree", "curve")]))
    return s.select(F.explode(kept).alias("mode")).groupBy("mode").agg(F.count("*").alias("n"))


@query("f9_capture_filter", with_views(" select sample_id from samples where pid = 17 or comm = 'error'", "samples"))
def f9(spark, d):
    return samples(spark, d).where(filters.capture_filter(pid=17, comm="error", tid="pid")).select("sample_id")


@query("f10_idle_skip", with_views(" select cpu, count(*) as n from samples where pid <> 0 group by cpu", "samples"))
def f10(spark, d):
    return samples(spark, d).where(filters.not_idle(F.col("pid"))).groupBy("cpu").agg(F.count("*").alias("n"))


@query("f11_zero_counts", with_views(" select comm, cast(sum(k) as bigint) as weight, count(*) as n from samples where k <> 0 group by comm", "samples"))
def f11(spark, d):
    return samples(spark, d).where(filters.counted(F.col("k"))).groupBy("comm").agg(F.sum("k").cast("long").alias("weight"), F.count("*").alias("n"))


@query("f12_contains_ordered", with_views(" select sample_id from samples where array_to_string(frames, ';') like '%main%;%handler\\_1%' escape '\\'", "samples"))
def f12(spark, d):
    return samples(spark, d).where(frames.contains_ordered(F.col("frames"), ["main", "handler_1"])).select("sample_id")


@query("f13_markers_are_roots", with_views(" select k % 3 = 0 as at_root, count(*) as n, count(*) filter (where k % 3 = 0) as valid from samples group by 1", "samples"))
def f13(spark, d):
    marker = F.array(F.lit("<# IRQOFF SAMPLE ON CPU 2 #>"))
    at_root = F.col("k") % 3 == 0
    stack = F.when(at_root, F.concat(marker, "frames")).otherwise(F.concat("frames", marker))
    return samples(spark, d).select(at_root.alias("at_root"), frames.markers_are_roots(stack).alias("ok")).groupBy("at_root").agg(F.count("*").alias("n"), F.count_if("ok").alias("valid"))


@query("n2_strip_templates", "select p_partkey, case when p_partkey % 3 = 0 then 'vec(' || p_name || ')' when p_partkey % 3 = 1 then 'operator<<(' || p_name || ')' else p_name || '<int' end as name from part")
def n2(spark, d):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("vec<int, std::pair<a, b> >("), "p_name", F.lit(")"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("operator<<("), "p_name", F.lit(")"))).otherwise(F.concat("p_name", F.lit("<int")))
    return table(spark, d, "part").select("p_partkey", frames.strip_templates(raw).alias("name"))


@query("n2_strip_templates_deep", "select p_partkey, case when p_partkey % 2 = 0 then 'a::b' || p_name else repeat('a<', 20) || p_name || repeat('>', 19) end as name from part")
def n2d(spark, d):
    deep = F.concat(F.repeat(F.lit("a<"), 20), "p_name", F.repeat(F.lit(">"), 19))
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(deep, F.lit(">::b"), "p_name")).otherwise(deep)
    return table(spark, d, "part").select("p_partkey", frames.strip_templates(raw).alias("name"))


@query("n3_strip_templates_plain", "select p_partkey, case when p_partkey % 2 = 0 then p_name || 'd>e' else 'operator' end as name from part")
def n3(spark, d):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("<b<c>>d>e"))).otherwise(F.concat(F.lit("operator<<"), "p_name"))
    return table(spark, d, "part").select("p_partkey", frames.strip_templates_plain(raw).alias("name"))


@query("n4_collapse_hex", "select p_partkey, case when p_partkey % 2 = 0 then '<...> [' || p_brand || ']' else '0xZZ ' || p_brand end as frame from part")
def n4(spark, d):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" 0x"), F.lower(F.hex("p_partkey")), F.lit(" lost ["), "p_brand", F.lit("] more"))).otherwise(F.concat(F.lit("0xZZ "), "p_brand"))
    return table(spark, d, "part").select("p_partkey", frames.collapse_hex(raw).alias("frame"))


@query("n5_collapse_irqoff", with_views(" select tick_id, '<# IRQOFF SAMPLE ON CPU <...> #>' as frame from ticks", "ticks"))
def n5(spark, d):
    return ticks(spark, d).select("tick_id", frames.collapse_irqoff(F.concat(F.lit("<# IRQOFF SAMPLE ON CPU "), F.col("cpu").cast("string"), F.lit(" #>"))).alias("frame"))


@query("n6_normalize_frame", with_views(" select sample_id, array_to_string(frames, ';') || case when k % 2 = 0 then ';<...> [libc.so.6]' else ';<# IRQOFF SAMPLE ON CPU <...> #>' end as stack from samples", "samples"))
def n6(spark, d):
    extra = F.when(F.col("k") % 2 == 0, F.concat(F.lit("  0x"), F.lower(F.hex("k")), F.lit(" [libc.so.6]"))).otherwise(F.concat(F.lit("<# IRQOFF SAMPLE ON CPU "), F.col("cpu").cast("string"), F.lit(" #> ")))
    return samples(spark, d).select("sample_id", stack_text(F.transform(F.concat("frames", F.array(extra)), lambda f: frames.normalize_frame(f))).alias("stack"))


@query("n7_render_user_frame", "select p_partkey, case when p_partkey % 4 = 0 then p_name when p_partkey % 4 = 1 then p_name || ' [/lib/' || p_brand || ']' when p_partkey % 4 = 2 then '0x' || lower(to_hex(p_partkey)) || ' [' || p_brand || ']' else '0x' || lower(to_hex(p_partkey)) || ' [anon exec segment]' end as frame from part")
def n7(spark, d):
    kind = F.col("p_partkey") % 4
    symbol = F.when(kind <= 1, F.col("p_name"))
    module = F.when(kind != 3, F.concat(F.lit("/proc/7/root/lib/"), "p_brand"))
    return table(spark, d, "part").select("p_partkey", frames.render_user_frame(F.col("p_partkey"), symbol, module, kind == 1).alias("frame"))


@query("n8_assemble_stack", with_views(METAS + " select sample_id, array_to_string(list_concat(list_concat([meta], case when k % 4 = 0 then ['<# OFFCPU #>'] else [] end), list_concat(list_reverse(list_filter(frames, lambda f: not contains(f, '_[k]'))), case when k % 2 = 0 and not contains(array_to_string(frames, ';'), '_[k]') then ['kernel_drop_stack_[k]'] else list_reverse(list_filter(frames, lambda f: contains(f, '_[k]'))) end)), ';') as stack from metas", "samples"))
def n8(spark, d):
    markers = F.when(F.col("k") % 4 == 0, F.array(F.lit("<# OFFCPU #>"))).otherwise(F.array().cast("array<string>"))
    user, kernel = F.filter("frames", lambda f: ~f.contains("_[k]")), F.filter("frames", lambda f: f.contains("_[k]"))
    return with_meta(spark, d).select("sample_id", stack_text(frames.assemble_stack(F.col("meta"), markers, user, kernel, F.col("k") % 2 == 0)).alias("stack"))


MARKED = ", x as (select *, case when k % 7 = 0 then 'full' when k % 7 = 1 then 'high' end as pressure, k % 3 = 0 as irqoff, k % 4 = 0 as offcpu, case when k % 2 = 0 then 'D' else 'S' end as state, case when k % 5 = 0 then '<# PROCESS EXIT #>' when k % 5 = 1 then '<# DROP BY LANG TYPE #>' end as reason, env = 'SYSTEM' or pid % 2 = 0 as unwound from metas)"


@query("n8_all_markers", with_views(METAS + MARKED + " select sample_id, array_to_string(list_filter([meta, case pressure when 'full' then '<# PRESSURE FULL DROP SAMPLE #>' when 'high' then '<# PRESSURE HIGH DROP SAMPLE #>' end, case when irqoff then '<# IRQOFF SAMPLE ON CPU ' || cpu || ' #>' end, case when offcpu then '<# OFFCPU SAMPLE: (' || state || ') #>' end] || case when pressure is null and unwound then [reason] || list_reverse(list_filter(frames, lambda f: not contains(f, '_[k]'))) else [] end || case when not contains(array_to_string(frames, ';'), '_[k]') then ['kernel_drop_stack_[k]'] else list_filter(frames, lambda f: contains(f, '_[k]')) end, lambda f: f is not null), ';') as stack from x", "samples"))
def n8_markers(spark, d):
    """Every kind of marker, stop reasons of those unwound, load shedding and pods that are not unwound."""
    k, none = F.col("k"), F.lit(None).cast("string")
    pressure = F.when(k % 7 == 0, F.lit("full")).when(k % 7 == 1, F.lit("high")).otherwise(none)
    markers = frames.sample_markers(pressure, k % 3 == 0, F.col("cpu"), k % 4 == 0, F.when(k % 2 == 0, F.lit("D")).otherwise(F.lit("S")))
    unwound = pressure.isNull() & ((F.col("env") == "SYSTEM") | (F.col("pid") % 2 == 0))
    reason = F.when(k % 5 == 0, F.lit("process_exit")).when(k % 5 == 1, F.lit("language")).otherwise(F.lit("truncated"))
    user = frames.user_part(F.filter("frames", lambda f: ~f.contains("_[k]")), unwound, reason)
    kernel = F.filter("frames", lambda f: f.contains("_[k]"))
    return with_meta(spark, d).select("sample_id", stack_text(frames.assemble_stack(F.col("meta"), markers, user, kernel, F.lit(True))).alias("stack"))


@query("n9_parse_procstack", with_views(" select sample_id, array_to_string(list_reverse(frames), ';') as stack from samples", "samples"))
def n9(spark, d):
    text = F.array_join(F.transform("frames", lambda f: F.concat(F.lit("[<0>] "), f)), "\n")
    return samples(spark, d).select("sample_id", stack_text(frames.parse_procstack(text)).alias("stack"))


@query("n10_hex_to_binary", "select p_partkey, case when p_partkey % 3 = 0 then null else p_name end as text from part")
def n10(spark, d):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.hex("p_name"), F.lit("0"))).otherwise(F.hex("p_name"))
    return table(spark, d, "part").select("p_partkey", F.decode(frames.hex_to_binary(raw), "UTF-8").alias("text"))


@query("n11_list_argument", with_views(" select sample_id, env || '|' || comm as parts from samples", "samples"))
def n11(spark, d):
    return samples(spark, d).select("sample_id", F.array_join(frames.list_argument(F.concat_ws(",", F.lit(""), "env", F.lit(""), "comm", F.lit(""))), "|").alias("parts"))


@query("n12_null_default", with_views(" select sample_id, nullif(case when k % 2 = 0 then 'null' else env end, 'null') as env from samples", "samples"))
def n12(spark, d):
    return samples(spark, d).select("sample_id", frames.null_default(F.when(F.col("k") % 2 == 0, F.lit("null")).otherwise(F.col("env"))).alias("env"))


#: Mangled names by their part's key: text before the part's own name with its length, text after it, and what is shown (``N`` is the name).
MANGLED = [
    ("_ZN2ns", "EPKci+12", "ns::N+12"),
    ("_Z", "IiSt6vectorIiSaIiEEEvT_RKT0_ [lib.so]", "N [lib.so]"),
    ("_ZNKSt", "IcLi3EE4findERKS0_", "std::N::find"),
    ("_ZN", "D2Ev", "N::~N"),
    ("_ZN2ns", "lsERSoN2ns1aIbEE", "ns::N::operator<<"),
    ("_Zq", "", None),
    ("", "", "N"),
    ("_ZZN2ns", "EiENKUliRKS_E0_clEiS0_", "ns::N(int)::{lambda(int, ns const&)#2}::operator()"),
    ("_ZTV", "", "vtable for N"),
    ("_ZN", "cvT_IPKcEEv", "N::operator char const*"),
    ("_ZN2ns", "Ei.isra.0", "ns::N"),
    ("_ZThn8_N", "D1Ev", "non-virtual thunk to N::~N()"),
    ("_ZN", "C1ERKS_+4", "N::N+4"),
    ("_Z", "I" + "P" * 3000 + "iEvv", None),
    ("_ZGVZN12_GLOBAL__N_1", "EvE5count", "guard variable for (anonymous namespace)::N()::count"),
    ("_ZN", "IXadL_Z3barvEEE3bazEv", "N::baz"),
    ("_ZNSt8functionIFv", "EE4swapERS1_", "std::function::swap"),
]


@query("n1_demangle", "with p as (select p_partkey, 'n_' || regexp_replace(p_name, '[^A-Za-z0-9]', '_', 'g') as n from part), k as (select *, p_partkey % " + str(len(MANGLED)) + " as kind from p) select p_partkey, case kind " + " ".join(f"when {i} then replace('{shown}', 'N', n)" if shown is not None else f"when {i} then '{before}' || len(n) || n || '{after}'" for i, (before, after, shown) in enumerate(MANGLED)) + " end as name from k")
def n1(spark, d):
    parts = table(spark, d, "part").withColumn("n", F.concat(F.lit("n_"), F.regexp_replace("p_name", "[^A-Za-z0-9]", "_")))
    sized = F.concat(F.length("n").cast("string"), F.col("n"))
    kinds = [F.concat(F.lit(before), sized if before else F.col("n"), F.lit(after)) for before, after, _ in MANGLED]
    symbol = F.element_at(F.array(*kinds), (F.col("p_partkey") % len(MANGLED) + 1).cast("int"))
    return dictionary.demangled(parts.select("p_partkey", symbol.alias("symbol")), "symbol", "name")


@query("s9_folded_lines", with_views(" select array_to_string(list_concat([env, group_comm], frames), ';') || '; ' || cast(sum(cnt) as bigint) as value from samples group by env, group_comm, frames", "samples"))
def s9(spark, d):
    return flame.folded_lines(flame.folded_stacks(samples(spark, d), F.concat(metadata.export_labels(), "frames")))


@query("j5_fact_dictionary_join", with_views(METAS + ", facts as (select meta, frames, cast(sum(cnt) as bigint) as n from metas group by meta, frames) select meta, array_to_string(frames, ';') as stack, n from facts", "samples"))
def j5(spark, d):
    s = with_meta(spark, d)
    strings, stacks = dictionary.intern_strings(s), dictionary.intern_stacks(s)
    parts = dictionary.decode_stacks(dictionary.encode_stacks(stacks, strings), strings)
    facts = s.groupBy("meta", "frames").agg(F.sum("cnt").cast("long").alias("n")).join(stacks, ["meta", "frames"]).select("ids_id", "n")
    return facts.join(parts, "ids_id").select(F.col("parts")[0].alias("meta"), stack_text(F.slice("parts", F.lit(2), F.size("parts"))).alias("stack"), "n")


@query("j6_semi_anti_join", with_views(" select (select count(*) from samples where pid in (select c_custkey from customer)) as known, (select count(*) from samples where pid not in (select c_custkey from customer)) as unknown", "samples"))
def j6(spark, d):
    s, names = samples(spark, d).select("pid"), table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("pid"))
    return s.join(names, "pid", "left_semi").agg(F.count("*").alias("known")).crossJoin(s.join(names, "pid", "left_anti").agg(F.count("*").alias("unknown")))
