"""CPU sets such as ``0-2, 7,9-8``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_cpu_set(text: str, swap: bool = True) -> set[int] | None:
    """The CPUs of an expression; ranges are inclusive, reversed ones swapped (or empty), bad parts ignored. ``all`` is None."""
    if text.strip() == "all":
        return None
    cpus: set[int] = set()
    for part in text.split(","):
        m = re.fullmatch(r"\s*(\d+)(?:\s*-\s*(\d+))?\s*", part)
        if m:
            a, b = int(m[1]), int(m[2] or m[1])
            cpus.update(range(min(a, b), max(a, b) + 1) if swap or a <= b else ())
    return cpus


def cpu_set(text: Column) -> Column:
    """Column form: a sorted array."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d+(-\d+)?$"))

    def spread(p: Column) -> Column:
        a, b = F.substring_index(p, "-", 1).cast("int"), F.substring_index(p, "-", -1).cast("int")
        return F.sequence(F.least(a, b), F.greatest(a, b))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, spread))))


def format_cpu_set(cpus: DataFrame, keys: list[str], value: str = "cpu") -> DataFrame:
    """Per key the compacted set, such as ``0-3,7``, of ``cpus(keys.., cpu)``: islands of consecutive numbers."""
    w = Window.partitionBy(*keys).orderBy(value)
    islands = cpus.select(*keys, value).distinct().withColumn("_island", F.col(value) - F.row_number().over(w)).groupBy(*keys, "_island").agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    part = F.when(F.col("_a") == F.col("_b"), F.col("_a").cast("string")).otherwise(F.concat(F.col("_a").cast("string"), F.lit("-"), F.col("_b").cast("string")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_a", part.alias("_p")))), lambda x: x["_p"])
    return islands.groupBy(*keys).agg(F.array_join(ordered, ",").alias("cpu_set"))
