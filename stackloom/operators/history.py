"""Retention, quotas and names of stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAME = r"^cpa_(\d{6})(?:_start_(\d{6}))?$"
RESERVE_MB = 100


def store_time(name: Column) -> Column:
    """The time in a store's name; null for other names, which count as newest."""
    ok = name.rlike(NAME)
    clock = F.coalesce(F.nullif(F.regexp_extract(name, NAME, 2), F.lit("")), F.lit("000000"))
    return F.when(ok, F.try_to_timestamp(F.concat(F.lit("20"), F.regexp_extract(name, NAME, 1), clock), F.lit("yyyyMMddHHmmss")))


def retention_plan(stores: DataFrame, day: str, today: Column, days: int) -> DataFrame:
    """``expired``: the store's day lies more than ``days`` before today."""
    return stores.withColumn("expired", F.col(day) < F.date_sub(today, days))


def quota_plan(stores: DataFrame, age: str, max_mb: int, keys: list[str] | None = None) -> DataFrame:
    """``expired``: oldest first, until the rest fits ``max_mb`` less the reserve. Larger ``age`` is newer."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc(age)).rowsBetween(Window.unboundedPreceding, 0)
    return stores.withColumn("running_mb", F.sum("size_mb").over(w).cast("long")).withColumn("expired", F.col("running_mb") > max_mb - RESERVE_MB)


def new_store_quota(left_mb: int, max_mb: int, days: int) -> int:
    return min(left_mb, max_mb // days)


def store_name(day: Column, time: Column, day_exists: Column) -> Column:
    base = F.concat(F.lit("cpa_"), F.date_format(day, "yyMMdd"))
    return F.when(day_exists, F.concat(base, F.lit("_start_"), F.date_format(time, "HHmmss"))).otherwise(base)


def needs_restart(dictionary_bytes: Column, store_mb: Column, max_cache_mb: int, quota_mb: int) -> Column:
    return (dictionary_bytes > max_cache_mb * 1024 * 1024) | (store_mb > quota_mb)
