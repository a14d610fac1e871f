"""Queries on sums, trees, histograms and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stackloom.functions import frames, metadata
from stackloom.operators import flame, stats
from stackloom.plans.catalog import query
from stackloom.session import stored
from stackloom.sources.views import CPU_NUM, FREQ, records, samples, table, ticks, with_views

SECONDS = 720 * 3600
PATH_SQL = "list_concat([env, group_comm], frames)"


def path():
    return F.concat(metadata.export_labels(), "frames")


def tree(spark, d):
    return flame.flame_tree(samples(spark, d), path())


TREE = (
    ", paths as (select " + PATH_SQL + " as p, cast(sum(cnt) as bigint) as v from samples group by 1), "
    "levels as (select p, v, unnest(range(0, len(p) + 1)) as depth from paths), "
    "nodes as (select depth, case when depth = 0 then [] else p[1:depth] end as q, cast(sum(v) as bigint) as value from levels group by 1, 2), "
    "tree as (select cast(depth as bigint) as depth, array_to_string(q, ';') as path, case when depth = 0 then 'root' else q[depth] end as name, "
    "case when depth = 1 then '' when depth > 1 then array_to_string(q[1:depth - 1], ';') end as parent, value from nodes)"
)
RANKED = TREE + ", ranked as (select *, cast(row_number() over (partition by depth, parent order by value desc, name) as bigint) as rank from tree where depth > 0)"


@query("a1_sum_by_stack", with_views(" select comm, group_comm, cgroup_id, cpu, pid, env, array_to_string(frames, ';') as stack, cast(sum(cnt) as bigint) as samples from samples group by all", "samples"))
def a1(spark, d):
    keys = ["comm", "group_comm", "cgroup_id", "cpu", "pid", "env"]
    return samples(spark, d).groupBy(*keys, "frames").agg(F.sum("cnt").cast("long").alias("samples")).select(*keys, F.array_join("frames", ";").alias("stack"), "samples")


@query("a2_folded_stacks", with_views(" select array_to_string(" + PATH_SQL + ", ';') || ';' as stack, cast(sum(cnt) as bigint) as samples from samples where cpu < 4 group by 1", "samples"))
def a2(spark, d):
    return flame.folded_stacks(samples(spark, d).where("cpu < 4"), path())


@query("a3_flame_tree", with_views(TREE + " select depth, path, name, parent, value from tree", "samples"))
def a3(spark, d):
    return tree(spark, d).drop("key", "up", "below")


@query("a4_caller_view", with_views(TREE.replace(PATH_SQL, f"list_reverse({PATH_SQL})") + " select depth, path, name, parent, value from tree", "samples"))
def a4(spark, d):
    return flame.flame_tree(samples(spark, d), F.reverse(path())).drop("key", "up", "below")


@query("a5_node_metrics", with_views(TREE + f", r as (select greatest(max(value), 1) as root from tree where depth = 0) select depth, path, name, value, round(value / {FREQ}.0::double, 6) as core_seconds, round(value / {FREQ}.0::double / {SECONDS}.0::double, 9) as cores, round(value / root::double * 100, 6) as view_pct, round(value / {FREQ}.0::double / {SECONDS}.0::double / {CPU_NUM}.0::double * 100, 9) as all_pct from tree, r", "samples"))
def a5(spark, d):
    return flame.node_metrics(tree(spark, d), FREQ, SECONDS, CPU_NUM)


@query("a6_tree_size", with_views(TREE + " select count(*) as nodes, max(depth) as max_depth from tree", "samples"))
def a6(spark, d):
    return tree(spark, d).agg(F.count("*").alias("nodes"), F.max("depth").alias("max_depth"))


@query("a6_depth_under_node", with_views(TREE + " select t.depth, t.path, max(u.depth) - t.depth as deeper from tree t join tree u on t.depth = 0 or u.path = t.path or starts_with(u.path, t.path || ';') where t.depth <= 2 group by 1, 2", "samples"))
def a6u(spark, d):
    """How many levels lie under each of the upper nodes."""
    return tree(spark, d).where("depth <= 2").select("depth", "path", (F.col("below") - F.col("depth")).alias("deeper"))


PERIOD_US = 60_000_000


GAPS_SQL = with_views(f", g as (select *, ts_us - lag(case when not throttled then ts_us end) over (partition by host, cpu order by ts_us, tick_id) as gap from ticks) select tick_id, host, cpu, gap - {PERIOD_US} as diff_us from g where not throttled and gap * 10 > 11 * {PERIOD_US}", "ticks")


@query("a8_irqoff_gaps", GAPS_SQL)
def a8(spark, d):
    return stats.irqoff_gaps(ticks(spark, d), PERIOD_US)


@query("a9_sample_weight", with_views(f" select sample_id, case when comm = 'view' then diff_ns when comm = 'click' then diff_ns // {10**9 // FREQ} + 1 else 1 end as weight from samples", "samples"))
def a9(spark, d):
    return samples(spark, d).select("sample_id", stats.sample_weight(F.col("comm") == "view", F.col("comm") == "click", F.col("diff_ns"), FREQ).alias("weight"))


@query("a11_log2_histogram", with_views(" select cast(length(bin(greatest(diff_ns, 1))) - 1 as bigint) as bin, count(*) as n, min(diff_ns) as min_ns, max(diff_ns) as max_ns, round(avg(diff_ns), 4) as avg_ns from samples group by 1", "samples"))
def a11(spark, d):
    return samples(spark, d).groupBy(stats.log2_bin(F.col("diff_ns")).alias("bin")).agg(F.count("*").alias("n"), F.min("diff_ns").alias("min_ns"), F.max("diff_ns").alias("max_ns"), F.round(F.avg("diff_ns"), 4).alias("avg_ns"))


@query("a12_latency_histogram", with_views(", l as (select date_trunc('day', ts) as day, k * 17 as us from samples) select day, case when us <= 1 then 1 when us <= 4 then 4 when us <= 16 then 16 when us <= 64 then 64 when us <= 256 then 256 when us <= 512 then 512 when us <= 1024 then 1024 when us <= 2048 then 2048 when us <= 4096 then 4096 end as edge_us, count(*) as n, cast(sum(us) as bigint) as sum_us, min(us) as min_us, max(us) as max_us, round(count(*) / 86400.0::double, 9) as per_s from l group by 1, 2", "samples"))
def a12(spark, d):
    rows = samples(spark, d).select(F.date_trunc("day", "ts").alias("day"), (F.col("k") * 17).alias("us"))
    out = rows.groupBy("day", stats.latency_bin(F.col("us")).alias("edge_us")).agg(F.count("*").alias("n"), F.sum("us").cast("long").alias("sum_us"), F.min("us").alias("min_us"), F.max("us").alias("max_us"))
    return out.withColumn("per_s", F.round(F.col("n") / F.lit(86400.0), 9))


@query("a13_lost_events", with_views(" select host, cpu, cast(sum(k % 4) as bigint) as lost, count(*) as reports, 'lost ' || cast(sum(k % 4) as bigint) || ' events on CPU #' || cpu as warning from samples where k % 4 > 0 and comm <> 'signup' group by host, cpu", "samples"))
def a13(spark, d):
    return stats.lost_events(samples(spark, d).where("comm <> 'signup'").select("host", "cpu", (F.col("k") % 4).alias("lost")))


@query("a14_unwind_methods", with_views(", x as (select host, len(list_filter(frames, lambda f: not contains(f, '_[k]'))) as dwarf, k % 6 as fp from samples where env <> 'SYSTEM') select host, count(*) + count(*) filter (where fp > dwarf) as total, count(*) as dwarf, count(*) filter (where fp > dwarf) as fp_better from x group by host", "samples"))
def a14(spark, d):
    levels = samples(spark, d).select("host", metadata.should_unwind_user(F.col("env"), True, [f"pod-{i}" for i in range(7)]).alias("unwinds_user"), F.size(F.filter("frames", lambda f: ~f.contains("_[k]"))).alias("dwarf_levels"), (F.col("k") % 6).alias("fp_levels"))
    return stats.unwind_counters(levels)


@query("a16_sketches_rolled_up", with_views(", e as (select host, count(distinct array_to_string(" + PATH_SQL + ", ';')) as stacks, count(*) as n from samples group by host) select host, n, stacks, true as stacks_near, true as quantiles_near from e", "samples"))
def a16s(spark, d):
    """Sketches per host and day merged per host, beside exact counts: distinct stacks within 4 %, the ranks of quantiles within 3 %."""
    s = samples(spark, d).select("host", F.date_trunc("day", "ts").alias("day"), F.array_join(path(), ";").alias("stack"), "diff_ns")
    ranks = (0.5, 0.9, 0.99)
    daily = stored(stats.sketched(s, ["host", "day"], F.col("stack"), F.col("diff_ns")), "daily-sketches")
    near = stats.rolled_up(daily, ["host"], ranks)
    exact = s.groupBy("host").agg(F.count_distinct("stack").alias("stacks"))
    both = near.join(exact, "host")
    # The true rank of an estimated quantile lies between the shares below it and up to it.
    ranked = s.join(near.select("host", "quantiles"), "host")
    held = [(F.avg((F.col("diff_ns") < F.col("quantiles")[i]).cast("double")) <= r + 0.03) & (F.avg((F.col("diff_ns") <= F.col("quantiles")[i]).cast("double")) >= r - 0.03) for i, r in enumerate(ranks)]
    quantiles = ranked.groupBy("host").agg((held[0] & held[1] & held[2]).alias("quantiles_near"))
    return both.join(quantiles, "host").select("host", "n", "stacks", (F.abs(F.col("distinct") - F.col("stacks")) <= 0.04 * F.col("stacks")).alias("stacks_near"), "quantiles_near")


@query("a15_deeper_stack", with_views(" select sample_id, case when k % 2 = 0 then array_to_string(frames, ';') else array_to_string(list_concat(['start'], frames), ';') end as stack from samples", "samples"))
def a15(spark, d):
    fp = F.when(F.col("k") % 2 == 0, F.slice("frames", 1, 2)).otherwise(F.concat(F.array(F.lit("start")), "frames"))
    return samples(spark, d).select("sample_id", F.array_join(stats.deeper_stack(fp, F.col("frames")), ";").alias("stack"))


@query("a16_distinct_stacks", with_views(" select count(distinct array_to_string(" + PATH_SQL + ", ';')) as stacks from samples", "samples"))
def a16(spark, d):
    return stats.distinct_stacks(samples(spark, d), path())


@query("a17_totals_by_env", with_views(" select env, cast(sum(cnt) as bigint) as samples, round(sum(cnt) / sum(sum(cnt)) over ()::double, 9) as share from samples group by env", "samples"))
def a17(spark, d):
    return stats.totals(samples(spark, d), "env").withColumn("share", F.round("share", 9))


@query("a17_totals_by_frame", with_views(" select frame, cast(sum(cnt) as bigint) as samples from (select cnt, unnest(list_distinct(frames)) as frame from samples) group by frame", "samples"))
def a17f(spark, d):
    return stats.totals_by_frame(samples(spark, d))


@query("a18_marker_statistics", with_views(" select case when k % 4 = 0 then '<# OFFCPU #>' else '<# IRQOFF SAMPLE ON CPU ' || cpu || ' #>' end as marker, cast(sum(cnt) as bigint) as samples from samples where k % 4 in (0, 1) group by 1", "samples"))
def a18(spark, d):
    marker = F.when(F.col("k") % 4 == 0, F.array(F.lit("<# OFFCPU #>"))).when(F.col("k") % 4 == 1, F.array(F.concat(F.lit("<# IRQOFF SAMPLE ON CPU "), F.col("cpu").cast("string"), F.lit(" #>")))).otherwise(F.array().cast("array<string>"))
    stack = F.concat(marker, "frames")
    return samples(spark, d).select("cnt", F.explode(F.filter(stack, lambda f: f.rlike(frames.MARKER))).alias("marker")).groupBy("marker").agg(F.sum("cnt").cast("long").alias("samples"))


@query("a19_load_shedding", with_views(", q as (select sample_id, k, 100 as quota, (sample_id * 1103515245 + 12345) % 4294967296 // 65536 % 32768 as draw from samples), t as (select *, case when k >= quota - quota // 32 then 32768 when k < quota // 8 then 0 else (k - quota // 8) * 32768 // (quota - quota // 32 - quota // 8) end as threshold from q) select sample_id, cast(threshold as bigint) as threshold, draw >= threshold as kept from t", "samples"))
def a19(spark, d):
    threshold = stats.drop_threshold(F.col("k"), F.lit(100))
    return samples(spark, d).select("sample_id", threshold.alias("threshold"), (stats.generator(F.col("sample_id")) >= threshold).alias("kept"))


@query("a20_oneshot_profile", with_views(" select array_to_string(" + PATH_SQL + ", ';') || ';' as stack, cast(sum(cnt) as bigint) as samples from samples group by 1", "samples"))
def a20(spark, d):
    return flame.folded_stacks(samples(spark, d), path())


@query("r1_sort_stacks", with_views(" select array_to_string(" + PATH_SQL + ", ';') || ';' as stack, cast(sum(cnt) as bigint) as samples from samples group by 1 order by 2 desc, 1", "samples"))
def r1(spark, d):
    return flame.folded_stacks(samples(spark, d), path()).orderBy(F.desc("samples"), "stack")


@query("r2_top_stacks", with_views(" select array_to_string(" + PATH_SQL + ", ';') || ';' as stack, cast(sum(cnt) as bigint) as samples from samples group by 1 order by 2 desc, 1 limit 20", "samples"))
def r2(spark, d):
    return flame.top_stacks(flame.folded_stacks(samples(spark, d), path()), 20)


@query("r2_top_stacks_by_env", with_views(", s as (select env, array_to_string(frames, ';') as stack, cast(sum(cnt) as bigint) as samples from samples group by 1, 2) select env, stack, samples, cast(rank as bigint) as rank from (select *, row_number() over (partition by env order by samples desc, stack) as rank from s) where rank <= 5", "samples"))
def r2e(spark, d):
    sums = samples(spark, d).groupBy("env", F.array_join("frames", ";").alias("stack")).agg(F.sum("cnt").cast("long").alias("samples"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("env").orderBy(F.desc("samples"), "stack")).cast("long")).where("rank <= 5")


@query("r3_children_order", with_views(RANKED + " select depth, path, name, parent, value, rank from ranked", "samples"))
def r3(spark, d):
    return flame.children_order(tree(spark, d)).drop("key", "up", "below")


@query("r4_hot_path", with_views(RANKED + ", ups as (select path, depth, array_to_string(string_split(path, ';')[1:u], ';') as up from (select path, depth, unnest(range(1, depth + 1)) as u from ranked)), w as (select u.path, u.depth, max(r.rank) as worst from ups u join ranked r on r.path = u.up group by 1, 2) select w.depth, w.path, r.name, r.value from w join ranked r using (path) where worst = 1", "samples"))
def r4(spark, d):
    return flame.hot_path(tree(spark, d))


@query("r5_zoom", with_views(TREE + " select depth, path, name, value from tree where path = 'SYSTEM;app0' or starts_with(path, 'SYSTEM;app0;')", "samples"))
def r5(spark, d):
    return flame.zoom(tree(spark, d), "SYSTEM;app0").select("depth", "path", "name", "value")


@query("r6_siblings", with_views(RANKED + " select depth, path, name, coalesce(lag(name) over w, last_value(name) over e) as previous, coalesce(lead(name) over w, first_value(name) over e) as next from ranked window w as (partition by depth, parent order by rank), e as (partition by depth, parent order by rank rows between unbounded preceding and unbounded following)", "samples"))
def r6(spark, d):
    return flame.siblings(tree(spark, d))


@query("r7_layout", with_views(RANKED + ", o as (select *, coalesce(sum(value) over (partition by depth, parent order by rank rows between unbounded preceding and 1 preceding), 0) as shift from ranked), ups as (select path, array_to_string(string_split(path, ';')[1:u], ';') as up from (select path, unnest(range(1, depth + 1)) as u from ranked)), e as (select u.path, cast(sum(o.shift) as bigint) as left_edge from ups u join o on o.path = u.up group by 1) select o.depth, o.path, e.left_edge, o.value as width from o join e using (path)", "samples"))
def r7(spark, d):
    return flame.layout(tree(spark, d))
