"""Helpers that several operators share."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.session import shared_path, ship

#: A word: code points outside space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Keys that :func:`join_hot` may send to all executors, and the parts that each is cut into.
HOT_KEYS, HOT_PARTS = 1000, 100
#: Rows of an intermediate table of edges that one task writes.
TASK_ROWS = 100_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_1``, ``name_2``, .. that no column of ``df`` has in any case of letters."""
    taken, found, i = {c.lower() for c in df.columns}, name, 0
    while found.lower() in taken:
        i += 1
        found = f"{name}_{i}"
    return found


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Inside, shuffle files of a finished job are removed at once instead of at the next garbage collection."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    ship(spark)
    path = shared_path(spark, name)
    with freed_shuffles(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*columns: str | Column) -> tuple[Column, Column]:
    """128 bits that stand for the values of ``columns``, nulls included; equal rows have equal keys.

    The hash passes over nulls, so each value comes with whether it is one.
    """
    values = [F.col(c) if isinstance(c, str) else c for c in columns]
    marked = [x for c in values for x in (c.isNull(), c)]
    return F.xxhash64(*marked), F.xxhash64(F.lit(0x5EED), *marked)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int, how: str = "inner", stored_left: bool = False) -> DataFrame:
    """``left`` joined with ``right(keys.., rows, ..)`` of one row per key, where ``rows`` says how many rows of ``left`` have the key.

    Of ``total`` rows at most ``HOT_KEYS`` keys can have more than ``total / HOT_KEYS`` each.
    These keys are sent to the rows of ``left``, which are dealt out by them and by a hash of
    the row to ``HOT_PARTS`` parts; the key's row of ``right`` goes to each. So no task gets a
    large share, and ``left`` is read and shuffled once. ``how`` is inner or left_semi; a null
    in a key meets nothing.

    Equal rows have one hash. Where ``left`` may have many of them it must be a table from
    :func:`stored`, as it is read: with ``stored_left`` rows are dealt by their place in it,
    which is the same when a task runs again.
    """
    part, hot = unused(left.join(right.limit(0), keys, "inner"), "part"), unused(left, "hot")
    most = max(total // HOT_KEYS, 1)
    heavy = right.where(F.col(rows) > most).select(*keys, F.lit(True).alias(hot))
    row = F.monotonically_increasing_id() if stored_left else F.xxhash64(*[F.col(f"`{c}`") for c in left.columns])
    own = F.when(F.col(hot), F.pmod(row, F.lit(HOT_PARTS))).otherwise(0).cast("long")
    dealt = left.join(F.broadcast(heavy), keys, "left").withColumn(part, own).drop(hot)  # at most HOT_KEYS rows
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col(rows) > most, HOT_PARTS - 1).otherwise(0).cast("long")))
    return dealt.join(right.withColumn(part, parts).drop(rows), [*keys, part], how).drop(part)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Rows ``(node, component)`` for ``edges(a, b)``: the component is its smallest node.

    Alternating large-star and small-star rounds; every round keeps at most as many rows as
    it got. Minima are aggregated with map-side sums, and a hub's neighbours get theirs by
    :func:`join_hot`, so no task gathers them. Nodes without an edge are not returned.
    """
    pairs = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    n = pairs.count()
    if not n:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))

    def kept(df: DataFrame) -> DataFrame:
        return stored(df.coalesce(max(1, -(-n // TASK_ROWS))), name)  # few rows need few tasks

    while True:
        both = pairs.union(pairs.select("b", "a"))
        least = kept(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n")))
        large = kept(join_hot(both.where("b > a"), least, ["a"], "n", n).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        n = large.count()
        least = kept(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        linked = join_hot(large, least, ["a"], "n", n)
        small = linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        pairs = kept(small)
        n = pairs.count()
        # Done if the edges are stars: no node has two roots, and no root has one.
        nodes = pairs.groupBy("a").agg(F.count("*").alias("n"))
        if nodes.where("n > 1").isEmpty() and pairs.select("b").distinct().join(nodes, F.col("b") == nodes["a"], "left_semi").isEmpty():
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
