"""From loaded stores to decoded stacks and folded profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.functions.frames import without_hash
from stackloom.functions.metadata import parse_metadata
from stackloom.operators import flame, timeline
from stackloom.operators.dictionary import decode_stacks
from stackloom.operators.filters import counted, unparseable_policy
from stackloom.sources.store import Stores

KEYS = ["host", "store_id"]


def stack_sums(counts: DataFrame, records: DataFrame) -> DataFrame:
    """``host, store_id, ids_id, cnt``: entries of the given records summed per stack, before any dictionary is joined."""
    kept = counts.where(counted(F.col("count"))).join(records.select(*KEYS, "record_idx"), [*KEYS, "record_idx"], "left_semi")
    return kept.groupBy(*KEYS, "ids_id").agg(F.sum("count").alias("cnt"))


def decoded(sums: DataFrame, stores: Stores, mode: str = "viewer") -> DataFrame:
    """``host, store_id, ids_id, cnt, raw, meta_ok, comm, .., env, frames`` for ``sums``; entries of unknown stacks are dropped."""
    used = stores.idsmap.join(sums.select(*KEYS, "ids_id"), [*KEYS, "ids_id"], "left_semi")
    stacks = decode_stacks(used, stores.strmap, mode)
    rows = sums.join(stacks, [*KEYS, "ids_id"]).withColumn("raw", F.get("parts", F.lit(0))).withColumn("_m", parse_metadata(F.col("raw")))
    frames = without_hash(F.slice("parts", F.lit(2), F.greatest(F.size("parts"), F.lit(1))))
    return rows.select(*KEYS, "ids_id", "cnt", "raw", F.col("_m.ok").alias("meta_ok"), *[F.col(f"_m.{c}").alias(c) for c in ("comm", "group_comm", "cgroup_id", "cpu", "pid", "env")], frames.alias("frames"))


def over_hosts(samples: DataFrame, frames: str = "frames", count: str = "cnt") -> DataFrame:
    """``frames, hosts, samples``: stacks of many hosts as one profile, each summed per host before, and on how many hosts each occurs."""
    sums = samples.groupBy(frames, "host").agg(F.sum(count).alias("_n"))
    return sums.groupBy(frames).agg(F.count("*").alias("hosts"), F.sum("_n").cast("long").alias("samples"))


def folded_profile(stores: Stores, labels: Column, start_ms: int | None = None, end_ms: int | None = None, condition: Column | None = None, mode: str = "viewer") -> DataFrame:
    """``stack, samples`` over all stores: clean, choose a range of each, sum, decode, filter, and sum the stacks with their ``labels`` before them."""
    records = timeline.clean_records(stores.records, mode)
    if mode == "export":
        records = timeline.select_export_range(records, start_ms, end_ms)
    elif start_ms is not None and end_ms is not None:
        records = timeline.select_range(records, start_ms, end_ms)
    rows = decoded(stack_sums(stores.counts, records), stores, mode)
    keep = unparseable_policy(F.col("meta_ok"), F.lit(True) if condition is None else condition, "tree" if mode == "viewer" else mode)
    return flame.folded_stacks(rows.where(keep), F.concat(labels, "frames"))
