"""Dictionaries of strings and stacks: encoding, decoding, deltas and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.functions.frames import LOST_STRING, demangle
from stackloom.session import stored


def numbered(df: DataFrame, name: str, order: list[str] | None = None) -> DataFrame:
    """``df`` with ids from 1 without gaps, in ``order`` if that is given.

    Rows are dealt to ranges and sorted there; ids count within a range from one offset per
    range, so no task orders all rows and a common prefix makes no hot group.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = stored(df.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = held.join(F.broadcast(offsets), part == F.col("_part"))  # one row per partition
    return joined.select(*df.columns, (row + F.col("_before") + 1).cast("long").alias(name))


def dense_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values of a column with ids from 1 in value order."""
    return numbered(df.select(column).distinct(), name, [column])


def intern_strings(stacks: DataFrame) -> DataFrame:
    """``stacks(meta, frames)`` to the dictionary ``str, sid``."""
    return dense_ids(stacks.select(F.explode(F.array_prepend("frames", F.col("meta"))).alias("str")), "str", "sid")


def intern_stacks(stacks: DataFrame) -> DataFrame:
    """Distinct ``stacks(meta, frames)`` with ``ids_id`` from 1; equality is on the whole list."""
    return numbered(stacks.select("meta", "frames").distinct(), "ids_id", ["meta", "frames"])


def encode_stacks(stacks: DataFrame, strings: DataFrame) -> DataFrame:
    """``stacks(ids_id, meta, frames)``, one row per id, as ``ids_id, sids``."""
    parts = stacks.select("ids_id", F.posexplode(F.array_prepend("frames", F.col("meta"))).alias("pos", "str"))
    return parts.join(strings, "str").groupBy("ids_id").agg(F.sort_array(F.collect_list(F.struct("pos", "sid")))["sid"].alias("sids"))


def store_keys(*frames: DataFrame) -> list[str]:
    """Which of ``host, store_id`` all frames have: ids and record numbers hold only within them."""
    return [k for k in ("host", "store_id") if all(k in f.columns for f in frames)]


def decode_stacks(encoded: DataFrame, strings: DataFrame, lost: str = "export") -> DataFrame:
    """``host, store_id, ids_id, parts`` for ``encoded(.., ids_id, sids)`` and ``strings(.., sid, str)``: the strings in order.

    Where both have ``host`` and ``store_id``, ids are looked up within the same store. A lost id
    shows a marker (``export``) or is skipped (``viewer``). Each stack is decoded once.
    """
    keys = store_keys(encoded, strings)
    parts = encoded.select(*keys, "ids_id", F.posexplode("sids").alias("pos", "sid")).join(strings, [*keys, "sid"], "left" if lost == "export" else "inner")
    text = F.coalesce("str", F.lit(LOST_STRING))
    return parts.groupBy(*keys, "ids_id").agg(F.sort_array(F.collect_list(F.struct("pos", text.alias("str"))))["str"].alias("parts"))


def decode_shared(encoded: DataFrame, strings: DataFrame) -> DataFrame:
    """:func:`decode_stacks` where many stacks share all strings but the first: each list of the others is decoded once per store."""
    keys = store_keys(encoded, strings)
    stacks = encoded.select(*keys, "ids_id", F.get("sids", F.lit(0)).alias("sid"), F.slice("sids", 2, F.greatest(F.size("sids"), F.lit(1))).alias("_rest"))
    lists = stored(stacks.select(*keys, "_rest").distinct().withColumn("_list", F.monotonically_increasing_id()), "shared-lists")
    texts = decode_stacks(lists.select(*keys, F.col("_list").alias("ids_id"), F.col("_rest").alias("sids")), strings).withColumnRenamed("ids_id", "_list")
    # An empty list has no parts.
    texts = stored(lists.join(texts, [*keys, "_list"], "left").select(*keys, "_rest", F.coalesce("parts", F.array().cast("array<string>")).alias("_texts")), "shared-texts")
    first = stacks.where(F.col("sid").isNotNull()).join(texts, [*keys, "_rest"]).join(strings, [*keys, "sid"], "left")
    return first.select(*keys, "ids_id", F.array_prepend("_texts", F.coalesce("str", F.lit(LOST_STRING))).alias("parts"))


def lost_stacks(counts: DataFrame, idsmap: DataFrame, weight: str = "count") -> DataFrame:
    """``state, stacks, n, weight`` for ``known`` and ``lost``: entries of ``counts(.., ids_id, weight)`` with and without a stack in the dictionary.

    Entries are summed per stack before they meet the dictionary; within stores where both have their keys.
    """
    keys = [*store_keys(counts, idsmap), "ids_id"]
    sums = counts.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(weight).alias("weight"))
    found = sums.join(idsmap.select(*keys).distinct().withColumn("_known", F.lit(True)), keys, "left")
    state = F.when(F.col("_known"), "known").otherwise("lost")
    return found.groupBy(state.alias("state")).agg(F.count("*").alias("stacks"), F.sum("n").alias("n"), F.sum("weight").cast("long").alias("weight"))


def demangled(strings: DataFrame, symbol: str, name: str) -> DataFrame:
    """``strings`` with the column ``symbol`` replaced by its C++ name, as ``name``.

    A name takes far more time than its bytes tell, so rows are dealt evenly to as many tasks as
    shuffles have, however few files or row groups they come from.
    """
    spark = strings.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return strings.repartition(tasks).withColumn(symbol, demangle(symbol)).withColumnRenamed(symbol, name)


def dictionary_delta(new: DataFrame, old: DataFrame, key: str = "str") -> DataFrame:
    return new.select(key).distinct().join(old, key, "left_anti")


def merge_ids(new: DataFrame, old: DataFrame, value: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """``keys.., value, name, is_new`` for distinct ``new(keys.., value)``: values that ``old(keys.., value, name)`` has keep their id.

    Others get ids from the greatest stored one on, in value order, so ids do not change from
    interval to interval, only appended rows differ, and a repeated run finds everything stored.
    With ``keys`` ids count within them; without, new values are numbered over ranges.
    """
    keys = keys or []
    values = new.select(*keys, value).distinct()
    known = stored(values.join(old.select(*keys, value, name), [*keys, value], "left"), "merge-known")  # both halves below read it
    fresh = known.where(F.col(name).isNull()).select(*keys, value)
    top = old.groupBy(*keys).agg(F.max(name).alias("_top"))
    if keys:
        # As many rows to a window as a key has values in one interval that were not there before.
        ranked = fresh.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).join(top, keys, "left")
    else:
        ranked = numbered(fresh, "_n", [value]).crossJoin(F.broadcast(top))  # one row
    fresh = ranked.select(*keys, value, (F.col("_n") + F.coalesce("_top", F.lit(0))).cast(old.schema[name].dataType).alias(name), F.lit(True).alias("is_new"))
    return known.where(F.col(name).isNotNull()).withColumn("is_new", F.lit(False)).unionByName(fresh)


def string_bytes(column: Column) -> Column:
    return F.sum(F.octet_length(column)).cast("long")


def list_bytes(column: Column) -> Column:
    return F.sum(F.size(column) * 4).cast("long")
