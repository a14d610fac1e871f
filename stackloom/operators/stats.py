"""Histograms, weights, load shedding and IRQ-off gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper edges of latency bins, and the factor of a period from which a gap counts (fixed values).
LATENCY_EDGES_US = (1, 4, 16, 64, 256, 512, 1024, 2048, 4096)
GAP_FACTOR = 1.1


def log2_bin(value: Column) -> Column:
    """``floor(log2(max(value, 1)))``, exact, from the bit length."""
    return (F.length(F.bin(F.greatest(value, F.lit(1)))) - 1).cast("long")


def latency_bin(us: Column) -> Column:
    """The first edge at or above the value; null above the last."""
    out = F.lit(None).cast("long")
    for edge in reversed(LATENCY_EDGES_US):
        out = F.when(us <= edge, F.lit(edge).cast("long")).otherwise(out)
    return out


def irqoff_gaps(ticks: DataFrame, period_us: int) -> DataFrame:
    """Ticks with ``diff_us``, the gap to the CPU's tick before minus one period, where the gap is over 1.1 periods.

    A throttled tick leaves no baseline for the next one.
    """
    w = Window.partitionBy("host", "cpu").orderBy("ts_us", "tick_id")
    gap = F.col("ts_us") - F.lag(F.when(~F.col("throttled"), F.col("ts_us"))).over(w)
    return ticks.withColumn("gap", gap).where(~F.col("throttled") & (F.col("gap") * 10 > 11 * period_us)).select("tick_id", "host", "cpu", (F.col("gap") - period_us).alias("diff_us"))


def sample_weight(is_offcpu: Column, is_irqoff: Column, diff_ns: Column, freq: int) -> Column:
    """1; blocked nanoseconds off CPU; whole periods plus one for IRQ-off."""
    period = 10**9 // freq
    return F.when(is_offcpu, diff_ns).when(is_irqoff, F.floor(diff_ns / F.lit(period)).cast("long") + 1).otherwise(F.lit(1).cast("long"))


def drop_threshold(queued: Column, quota: Column) -> Column:
    """Load shedding in 1/32768: none below quota/8, full from quota - quota/32, linear between; quota 0 drops all."""
    low, high = F.floor(quota / 8), quota - F.floor(quota / 32)
    ramp = F.floor((queued - low) * 32768 / (high - low))
    return F.when((quota == 0) | (queued >= high), 32768).when(queued < low, 0).otherwise(ramp).cast("long")


def generator(value: Column) -> Column:
    """A 15-bit number from an id by the linear congruential step (multiplier, increment and mask are fixed values)."""
    return F.shiftright((value * 1103515245 + 12345) % 4294967296, 16).bitwiseAND(F.lit(32767)).cast("long")


def trend_buckets(curve: DataFrame, index: str, value: str, n: Column, width: int) -> DataFrame:
    """The maximum of each of ``width`` columns, record ``i`` of ``n`` in column ``floor(i / n * width)``."""
    return curve.groupBy(F.floor(F.col(index) * width / n).cast("long").alias("bucket")).agg(F.max(value).alias("peak"))


def deeper_stack(frame_pointers: Column, call_frames: Column) -> Column:
    """The stack by frame pointers if it has more levels than the one by call frame information, else that one."""
    return F.when(F.size(frame_pointers) > F.size(call_frames), frame_pointers).otherwise(call_frames)


def totals(samples: DataFrame, column: str | Column, count: str = "cnt") -> DataFrame:
    """``column, samples, share`` per value of a dimension, shares of all samples."""
    sums = samples.groupBy(column).agg(F.sum(count).cast("long").alias("samples"))
    total = sums.agg(F.sum("samples").alias("_total"))
    return sums.crossJoin(F.broadcast(total)).withColumn("share", F.col("samples") / F.col("_total")).drop("_total")  # one row


def totals_by_frame(samples: DataFrame, frames: str = "frames", count: str = "cnt") -> DataFrame:
    """``frame, samples``; a frame counts once per stack. Samples are summed per stack before frames are listed."""
    stacks = samples.groupBy(frames).agg(F.sum(count).alias("_n"))
    return stacks.select("_n", F.explode(F.array_distinct(frames)).alias("frame")).groupBy("frame").agg(F.sum("_n").cast("long").alias("samples"))


def distinct_stacks(samples: DataFrame, path: Column, keys: list[str] | None = None) -> DataFrame:
    """``keys.., stacks``: how many different labelled stacks there are, exactly."""
    return samples.groupBy(*keys or []).agg(F.count_distinct(path).alias("stacks"))


def lost_events(reports: DataFrame) -> DataFrame:
    """``host, cpu, lost, reports, warning`` for ``reports(host, cpu, lost)``: what each CPU has lost, with the recorder's warning; CPUs that lost nothing are not listed."""
    sums = reports.where("lost > 0").groupBy("host", "cpu").agg(F.sum("lost").cast("long").alias("lost"), F.count("*").alias("reports"))
    return sums.withColumn("warning", F.format_string("lost %d events on CPU #%d", F.col("lost"), F.col("cpu")))


def unwind_counters(samples: DataFrame) -> DataFrame:
    """``host, total, dwarf, fp_better`` for ``samples(host, unwinds_user, dwarf_levels, fp_levels)``.

    Each sample whose user stack is unwound is unwound by call frame information once, and once
    more by frame pointers where they have more levels.
    """
    better = F.col("fp_levels") > F.col("dwarf_levels")
    sums = samples.where("unwinds_user").groupBy("host").agg(F.count("*").alias("dwarf"), F.count_if(better).alias("fp_better"))
    return sums.select("host", (F.col("dwarf") + F.col("fp_better")).alias("total"), "dwarf", "fp_better")


def sketched(facts: DataFrame, keys: list[str], distinct: Column, value: Column, precision: int = 14, k: int = 400) -> DataFrame:
    """``keys.., n, distinct_sketch, value_sketch``: mergeable summaries of a group, a few kB each.

    ``2**precision`` registers estimate distinct values to about 0.8 %, ``k`` sets quantiles' error
    in rank to about 0.7 %. Kept per host and day they answer for any longer span without the facts.
    """
    return facts.groupBy(*keys).agg(F.count("*").alias("n"), F.hll_sketch_agg(distinct, precision).alias("distinct_sketch"), F.kll_sketch_agg_bigint(value, k).alias("value_sketch"))


def rolled_up(sketches: DataFrame, keys: list[str], ranks: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """``keys.., n, distinct, quantiles`` of the sketches of :func:`sketched` merged by ``keys``."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("d"), F.kll_merge_agg_bigint("value_sketch").alias("v"))
    return merged.select(*keys, "n", F.hll_sketch_estimate("d").alias("distinct"), F.array(*[F.kll_sketch_get_quantile_bigint("v", F.lit(r)) for r in ranks]).alias("quantiles"))
