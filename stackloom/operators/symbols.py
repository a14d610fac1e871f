"""Joins by address and by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.functions.metadata import process_name
from stackloom.operators.dictionary import numbered


def symbol_text(ip: Column, addr: Column, sym: Column) -> Column:
    hexed = F.concat(F.lit("0x"), F.lower(F.hex(ip)), F.lit("_[k]"))
    return F.when(addr.isNull(), hexed).otherwise(F.concat(sym, F.lit("_[k]+"), (ip - addr).cast("string")))


#: Blocks that one window orders to carry values over them, as a power of two; and the microseconds of a time block, as one.
TOP_BITS, TIME_BITS = 20, 26


def carried_on(column: str, how: str, w: Window) -> Column:
    """The sum of the earlier values (``sum``), or the last one that is not null (``last``)."""
    return F.sum(column).over(w) if how == "sum" else F.last(column, ignorenulls=True).over(w)


def earlier_blocks(blocks: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``blocks(keys.., _block, _value)`` to ``keys.., _block, _earlier``: what the blocks before it carry on.

    Blocks are put in groups of a million; a window orders the blocks of one group, another one
    the groups of a key. So a key with many blocks, as a busy host's sparse addresses or a long
    history of one process make, is no single window.
    """
    top = F.floor(F.col("_block") / (1 << TOP_BITS)).cast("long")
    until = (Window.unboundedPreceding, -1)
    near = carried_on("_value", how, Window.partitionBy(*keys, "_top").orderBy("_block").rowsBetween(*until))
    placed = blocks.withColumn("_top", top).withColumn("_near", near)
    whole = F.sum("_value") if how == "sum" else F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_block")))
    tops = blocks.withColumn("_top", top).groupBy(*keys, "_top").agg(whole.alias("_value"))
    tops = tops.select(*keys, "_top", carried_on("_value", how, Window.partitionBy(*keys).orderBy("_top").rowsBetween(*until)).alias("_far"))
    earlier = F.coalesce("_near", F.lit(0)) + F.coalesce("_far", F.lit(0)) if how == "sum" else F.coalesce("_near", "_far")
    return placed.join(tops, [*keys, "_top"]).select(*keys, "_block", earlier.alias("_earlier"))


def floor_join(points: DataFrame, table: DataFrame, point: str, start: str, keys: list[str] | None = None, block: int = 1 << 20) -> DataFrame:
    """``points`` plus the columns of the row of ``table`` with the greatest ``start`` at or below ``point``, of the same ``keys``.

    Points and rows are put in blocks of numbers. Within a block a window carries the last row
    forward; a block's points below its first row take the last row of an earlier block, found
    among one row per block. Distinct points make a block no larger than ``block`` rows of
    each. Points with a null key or number have no row and are not returned.
    """
    keys = keys or []
    extra = [c for c in table.columns if c not in keys]
    held = F.struct(*extra)
    events = points.select(*keys, F.col(point).alias("_at"), F.lit(1).alias("_is_point"), F.lit(None).cast(table.select(held).schema[0].dataType).alias("_row"))
    events = events.unionByName(table.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_is_point"), held.alias("_row"))).withColumn("_block", F.floor(F.col("_at") / block))
    inside = Window.partitionBy(*keys, "_block").orderBy("_at", "_is_point").rowsBetween(Window.unboundedPreceding, 0)
    carried = events.withColumn("_row", F.last("_row", ignorenulls=True).over(inside))
    lasts = events.groupBy(*keys, "_block").agg(F.max_by("_row", F.when(F.col("_row").isNotNull(), F.col("_at"))).alias("_value"))
    joined = carried.where("_is_point = 1").join(earlier_blocks(lasts, keys, "last"), [*keys, "_block"])
    row = F.coalesce("_row", "_earlier")
    return joined.select(*keys, F.col("_at").alias(point), *[row[c].alias(c) for c in extra])


def last_of_address(symbols: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per ``addr`` (of the same ``keys``): the one of the greatest ``line_no``, or of the greatest name where lines are not numbered."""
    return symbols.groupBy(*keys or [], "addr").agg((F.max_by("sym", "line_no") if "line_no" in symbols.columns else F.max("sym")).alias("sym"))


def resolve(ips: DataFrame, symbols: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys.., ip, symbol`` for distinct ``ips(keys.., ip)`` and ``symbols(keys.., addr, sym, line_no?)``; of one address the last symbol counts.

    Addresses of different hosts do not compare, so tables of many hosts need ``keys=["host"]``.
    """
    keys = keys or []
    found = floor_join(ips.select(*keys, "ip").distinct(), last_of_address(symbols, keys), "ip", "addr", keys)
    return found.select(*keys, "ip", symbol_text(F.col("ip"), F.col("addr"), F.col("sym")).alias("symbol"))


def snapshot_versions(snapshots: DataFrame, order: str, keys: list[str], content: list[str]) -> DataFrame:
    """``keys.., valid_from``: the snapshots whose content differs from the one before of the same keys."""
    return snapshot_changes(snapshots, order, keys, content).where("changed").select(*keys, F.col(order).alias("valid_from"))


def resolve_at(points: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``host, at, ip, valid_from, symbol`` for distinct ``points(host, at, ip)`` and ``snapshots(host, taken, addr, sym, line_no?)``.

    A symbol table holds from the snapshot that brought it until one with other content. Each
    time finds its host's table, then each address its symbol in that table; both are as-of
    joins in blocks, with the host in every key. Addresses are looked up once per table, not
    once per time. A time before the host's first snapshot has no table (``valid_from`` is
    null) and its addresses stay numbers.
    """
    points = points.select("host", "at", "ip").distinct()
    versions = snapshot_versions(snapshots, "taken", ["host"], ["addr", "sym"])
    times = floor_join(points.select("host", "at").distinct(), versions, "at", "valid_from", ["host"], 1 << TIME_BITS)
    placed = points.join(times, ["host", "at"])
    table = snapshots.join(versions, [snapshots.host == versions.host, snapshots.taken == versions.valid_from], "left_semi").withColumnRenamed("taken", "valid_from")
    keys = ["host", "valid_from"]
    found = resolve(placed.where("valid_from is not null"), table, keys)
    joined = placed.join(found, [*keys, "ip"], "left")
    return joined.select("host", "at", "ip", "valid_from", F.coalesce("symbol", symbol_text(F.col("ip"), F.lit(None), F.lit(None))).alias("symbol"))


def process_names(samples: DataFrame, names: DataFrame) -> DataFrame:
    """``host, pid, at, comm`` for distinct ``samples(host, pid, at)``: the name that ``names(host, pid, valid_from, comm)`` gives the process at that time.

    A name holds until the process has the next one. A process without a name yet shows the
    marker of an ended one, a name that could not be read (null) the other marker.
    """
    points = samples.select("host", "pid", "at").distinct()
    found = floor_join(points, names.select("host", "pid", "valid_from", "comm"), "at", "valid_from", ["host", "pid"], 1 << TIME_BITS)
    return found.select("host", "pid", "at", process_name(F.when(F.col("valid_from").isNotNull(), F.coalesce("comm", F.lit(""))), F.col("valid_from").isNull() | F.col("comm").isNotNull()).alias("comm"))


def half_open_intervals(table: DataFrame, start: str, keys: list[str] | None = None) -> DataFrame:
    """``table`` plus ``stop``: the next start (of the same ``keys``), or open (null) for the last.

    Rows are numbered in order over ranges and joined with the next number, so no task orders a whole key.
    """
    order = [*(keys or []), start]
    rows = numbered(table, "_n", order)
    after = rows.select((F.col("_n") - 1).alias("_n"), *[F.col(k).alias(f"_{k}") for k in keys or []], F.col(start).alias("stop"))
    same = F.lit(True)
    for k in keys or []:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(after, "_n", "left").select(*table.columns, F.when(same, F.col("stop")).alias("stop"))


def interval_join(points: DataFrame, intervals: DataFrame, point: str, start: str, stop: str) -> DataFrame:
    """``points`` with the row of ``intervals`` that holds them, ``start <= point < stop`` (null: no end); no match gives nulls."""
    found = floor_join(points, intervals, point, start)
    inside = F.col(stop).isNull() | (F.col(point) < F.col(stop))
    return found.select(point, *[F.when(inside, F.col(c)).alias(c) for c in intervals.columns])


def length_class(first: Column, last: Column) -> Column:
    """The power of two above the length of an interval, in steps of three: points are shuffled once per class, and a cell is at most 16 times as long as its intervals."""
    return (F.ceil(F.length(F.bin(last - first)) / 3) * 3).cast("int")


def closed_interval_join(points: DataFrame, intervals: DataFrame, point: str) -> DataFrame:
    """``points`` with the narrowest of the closed ``intervals(first, last, ..)`` that hold them; ties go to the smaller first, then map_id.

    An interval lies in at most two cells of its class of lengths, whatever its length is; a point
    is looked up once for each class that occurs, at most 22.
    """
    levelled = intervals.withColumn("_level", length_class(F.col("first"), F.col("last")))
    cells = F.array_distinct(F.array(F.expr("shiftright(first, _level)"), F.expr("shiftright(last, _level)")))
    levels = F.broadcast(levelled.select("_level").distinct())  # at most 22 rows
    placed = points.crossJoin(levels).withColumn("_cell", F.expr(f"shiftright({point}, _level)"))
    found = placed.join(levelled.withColumn("_cell", F.explode(cells)), ["_level", "_cell"]).where((F.col("first") <= F.col(point)) & (F.col(point) <= F.col("last")))
    best = F.min(F.struct((F.col("last") - F.col("first")).alias("width"), "first", "map_id", "last")).alias("b")
    return found.groupBy(point).agg(best).select(point, "b.map_id", "b.first", "b.last")


def time_block(us: Column) -> Column:
    return F.floor(us / (1 << TIME_BITS)).cast("long")


def generations(samples: DataFrame, exits: DataFrame) -> DataFrame:
    """``sample_id, generation``: the number of exits of the pid strictly before the sample.

    Exits are counted within about a minute of a process; earlier minutes give their number,
    so a busy process is cut over tasks.
    """
    events = samples.select("host", "pid", "ts", F.lit(1).alias("is_sample"), "sample_id").unionByName(exits.select("host", "pid", F.col("exit_ts").alias("ts"), F.lit(0).alias("is_sample"), F.lit(None).cast("long").alias("sample_id")))
    events = events.withColumn("_block", time_block(F.unix_micros(F.col("ts").cast("timestamp"))))
    keys = ["host", "pid"]
    w = Window.partitionBy(*keys, "_block").orderBy("ts", F.desc("is_sample")).rowsBetween(Window.unboundedPreceding, 0)
    counted = events.withColumn("_inside", F.sum(1 - F.col("is_sample")).over(w)).where("is_sample = 1")
    blocks = events.groupBy(*keys, "_block").agg(F.sum(1 - F.col("is_sample")).alias("_value"))
    joined = counted.join(earlier_blocks(blocks, keys, "sum"), [*keys, "_block"])
    return joined.select("sample_id", (F.col("_inside") + F.col("_earlier")).cast("long").alias("generation"))


def snapshot_changes(snapshots: DataFrame, order: str, keys: list[str], content: list[str]) -> DataFrame:
    """Per key and snapshot whether its content differs from the one before; compares order-free digests."""
    digests = snapshots.groupBy(*keys, order).agg(F.sum(F.xxhash64(*content).cast("decimal(38,0)")).alias("_d"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(order)
    same = (F.lag("_d").over(before) == F.col("_d")) & (F.lag("_n").over(before) == F.col("_n"))
    return digests.select(*keys, order, F.col("_n").alias("n_symbols"), (~F.coalesce(same, F.lit(False))).alias("changed"))


def off_cpu(switches: DataFrame) -> DataFrame:
    """``event_id, tid, blocked_us``: a switch-in right after a switch-out of the thread (of its host, if there is one).

    Rows are paired within about a minute of a thread; the first row of a minute is paired with
    the last one of an earlier minute, so a busy thread is cut over tasks.
    """
    keys = [k for k in ("host", "tid") if k in switches.columns]
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = switches.withColumn("_us", us).withColumn("_block", time_block(us)).withColumn("_row", F.struct("kind", "_us"))
    w = Window.partitionBy(*keys, "_block").orderBy("ts", "event_id")
    paired = rows.withColumn("_before", F.lag("_row").over(w))
    lasts = rows.groupBy(*keys, "_block").agg(F.max_by("_row", F.struct("_us", "event_id")).alias("_value"))
    joined = paired.join(earlier_blocks(lasts, keys, "last"), [*keys, "_block"]).withColumn("_out", F.coalesce("_before", "_earlier"))
    found = joined.where("kind = 'in' and _out.kind = 'out' and _us > _out._us")
    return found.select("event_id", "tid", (F.col("_us") - F.col("_out._us")).alias("blocked_us"))


def merge_maps(lines: DataFrame) -> DataFrame:
    """``host, pid, line_no, start, stop, perm, path`` rows merged with the row before if permission and path are equal (islands)."""
    w = Window.partitionBy("host", "pid").orderBy("line_no")
    new = F.when((F.lag("perm").over(w) == F.col("perm")) & (F.lag("path").over(w) == F.col("path")), 0).otherwise(1)
    islands = lines.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("host", "pid", "_island").agg(F.min("start").alias("start"), F.max_by("stop", "line_no").alias("stop"), F.first("perm").alias("perm"), F.first("path").alias("path")).drop("_island")
