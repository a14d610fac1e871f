"""Queries on store history."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackloom.operators import history, profile
from stackloom.plans.catalog import query
from stackloom.sources.views import samples, stores, with_views


@query("r8_union_of_stores", with_views(" select array_to_string(frames, ';') as stack, count(distinct host) as hosts, cast(sum(cnt) as bigint) as samples from samples group by 1", "samples"))
def r8(spark, d):
    return profile.over_hosts(samples(spark, d)).select(F.array_join("frames", ";").alias("stack"), "hosts", "samples")


@query("r11_store_names", with_views(" select sample_id, 'cpa_' || strftime(ts, '%y%m%d') || case when k % 2 = 0 then '_start_' || strftime(ts, '%H%M%S') else '' end as name from samples", "samples"))
def r11(spark, d):
    return samples(spark, d).select("sample_id", history.store_name(F.col("ts"), F.col("ts"), F.col("k") % 2 == 0).alias("name"))


@query("r9_day_retention", with_views(", d as (select cast(ts as date) as day, count(*) as n from samples group by 1) select strftime(day, '%Y-%m-%d') as day, n, day < (select max(day) from d) - 7 as expired from d", "samples"))
def r9(spark, d):
    days = samples(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    last = days.agg(F.max("day").alias("today"))
    plan = history.retention_plan(days.crossJoin(F.broadcast(last)), "day", F.col("today"), 7)  # one row
    return plan.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "expired")


@query("r10_size_quota", with_views(" select name, age, size_mb, cast(sum(size_mb) over (order by age desc rows unbounded preceding) as bigint) as running_mb, sum(size_mb) over (order by age desc rows unbounded preceding) > 5000 - 100 as expired from stores", "stores"))
def r10(spark, d):
    return history.quota_plan(stores(spark, d), "age", 5000).select("name", "age", "size_mb", "running_mb", "expired")


@query("r12_restart_thresholds", with_views(" select name, age * 1000000 > 32 * 1024 * 1024 or size_mb > 150 as restart from stores", "stores"))
def r12(spark, d):
    return stores(spark, d).select("name", history.needs_restart(F.col("age") * 1000000, F.col("size_mb"), 32, 150).alias("restart"))
