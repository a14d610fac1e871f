"""Folded stacks and flame trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.session import stored

SEPARATOR = ";"


def folded_stacks(df: DataFrame, path: Column, count: str = "cnt") -> DataFrame:
    """``stack, samples``: counts summed per labelled path, ``;`` after each part."""
    return df.groupBy(F.concat(F.array_join(path, SEPARATOR), F.lit(SEPARATOR)).alias("stack")).agg(F.sum(count).cast("long").alias("samples"))


def prefix_key(path: Column, depth: Column) -> Column:
    """128 bits that stand for the first ``depth`` frames, so that frames may hold any text and a shuffle carries no paths."""
    prefix = F.slice(path, F.lit(1), depth)
    return F.struct(F.xxhash64(depth, prefix).alias("a"), F.xxhash64(F.lit(0x5EED), depth, prefix).alias("b"))


def flame_nodes(df: DataFrame, path: Column, count: str = "cnt") -> tuple[DataFrame, DataFrame]:
    """``(nodes, stacks)``: ``depth, key, up, name, value, below, stack`` and ``stack, p``.

    Each prefix of a path gets the path's count; the root is depth 0. ``up`` is the parent's key,
    ``below`` how deep the tree goes at or under the node, ``stack`` one of the stacks through it.
    Counts are summed per whole path before the prefixes are made, which keeps the second sum small.
    """
    sums = df.groupBy(path.alias("p")).agg(F.sum(count).alias("v"))
    stacks = stored(sums.withColumn("stack", F.monotonically_increasing_id()), "flame-stacks")
    levels = stacks.select("p", "v", "stack", F.explode(F.sequence(F.lit(0), F.size("p"))).alias("depth"))
    above = F.when(F.col("depth") > 0, prefix_key(F.col("p"), F.col("depth") - 1))
    keyed = levels.select("depth", prefix_key(F.col("p"), F.col("depth")).alias("key"), above.alias("up"), F.coalesce(F.get("p", F.col("depth") - 1), F.lit("root")).alias("name"), "v", F.size("p").alias("size"), "stack")
    nodes = keyed.groupBy("key").agg(F.min("depth").cast("long").alias("depth"), F.first("up").alias("up"), F.first("name").alias("name"), F.sum("v").cast("long").alias("value"), F.max("size").cast("long").alias("below"), F.min("stack").alias("stack"))
    return nodes, stacks.select("stack", "p")


def with_paths(nodes: DataFrame, stacks: DataFrame) -> DataFrame:
    """``nodes`` plus their ``path`` and their ``parent``'s as text, each cut from one stack."""
    def upto(d: Column) -> Column:
        return F.array_join(F.slice("p", F.lit(1), F.greatest(d, F.lit(0)).cast("int")), SEPARATOR)

    joined = nodes.join(stacks, "stack")
    return joined.withColumn("path", upto(F.col("depth"))).withColumn("parent", F.when(F.col("depth") > 0, upto(F.col("depth") - 1))).drop("p", "stack")


def flame_tree(df: DataFrame, path: Column, count: str = "cnt") -> DataFrame:
    """``depth, path, name, parent, value`` of all nodes, and their ``key``, ``up`` and ``below`` as in :func:`flame_nodes`."""
    return with_paths(*flame_nodes(df, path, count)).select("depth", "path", "name", "parent", "value", "key", "up", "below")


def node_metrics(tree: DataFrame, freq: int, seconds: float, cpus: int) -> DataFrame:
    """Core-seconds, cores, share of the view and of all CPUs; null where a divisor is 0."""
    root = tree.where("depth = 0").select(F.greatest(F.max("value"), F.lit(1)).alias("root"))
    core_s = F.try_divide(F.col("value").cast("double"), F.lit(float(freq)))
    cores = F.try_divide(core_s, F.lit(float(seconds)))
    with_root = tree.crossJoin(F.broadcast(root))  # one row
    return with_root.select("depth", "path", "name", "value", F.round(core_s, 6).alias("core_seconds"), F.round(cores, 9).alias("cores"), F.round(F.col("value") / F.col("root") * 100, 6).alias("view_pct"), F.round(F.try_divide(cores, F.lit(float(cpus))) * 100, 9).alias("all_pct"))


def children_order(tree: DataFrame) -> DataFrame:
    """Rank of each node below its parent: value descending, then name."""
    return tree.where("depth > 0").withColumn("rank", F.row_number().over(Window.partitionBy("up").orderBy(F.desc("value"), "name")).cast("long"))


def over_ancestors(nodes: DataFrame, column: str) -> DataFrame:
    """``key, total``: the sum of ``column`` over each of ``nodes(key, up, ..)`` and all nodes above it; none for a node with one above it missing.

    Pointers double: a round adds what the node pointed to has summed and takes over its
    pointer, so a tree of depth ``d`` takes ``log2(d)`` rounds of one join.
    """
    state = stored(nodes.select("key", "up", F.col(column).cast("long").alias("total")), "flame-lift")
    while not state.where("up is not null").isEmpty():
        onto = state.select(F.col("key").alias("at"), F.col("up").alias("next"), F.col("total").alias("more"))
        moved = state.where("up is not null").join(onto, F.col("up") == F.col("at")).select("key", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"))
        state = stored(state.where("up is null").union(moved), "flame-lift")
    return state.select("key", "total")


def below_root(nodes: DataFrame) -> DataFrame:
    """Nodes whose pointers end at the first level."""
    return nodes.withColumn("up", F.when(F.col("depth") > 1, F.col("up")))


def hot_path(tree: DataFrame) -> DataFrame:
    """The node of the largest value at each level below the one before it: those that are first below their parent, as is every node above them."""
    first = stored(children_order(tree).where("rank = 1").select("key", "up", "depth", "path", "name", "value"), "flame-first")
    chain = over_ancestors(below_root(first).withColumn("one", F.lit(1)), "one")
    return first.join(chain, "key", "left_semi").select("depth", "path", "name", "value")


def zoom(tree: DataFrame, path: str) -> DataFrame:
    return tree.where((F.col("path") == path) | F.col("path").startswith(path + SEPARATOR))


def siblings(tree: DataFrame) -> DataFrame:
    """The neighbours of each node in its parent's order, wrapping round."""
    w = Window.partitionBy("up").orderBy("rank")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return children_order(tree).select("depth", "path", "name", F.coalesce(F.lag("name").over(w), F.last("name").over(every)).alias("previous"), F.coalesce(F.lead("name").over(w), F.first("name").over(every)).alias("next"))


def layout(tree: DataFrame) -> DataFrame:
    """Left edge and width of each node in sample units: its parent's left edge and the values of the siblings before it."""
    w = Window.partitionBy("up").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    own = stored(children_order(tree).withColumn("shift", F.coalesce(F.sum("value").over(w), F.lit(0))), "flame-own")
    edges = over_ancestors(below_root(own), "shift")
    return own.join(edges, "key").select("depth", "path", F.col("total").alias("left_edge"), F.col("value").alias("width"))


def folded_lines(folded: DataFrame) -> DataFrame:
    """Text lines, largest first; ties in stack order."""
    return folded.orderBy(F.desc("samples"), "stack").select(F.concat("stack", F.lit(" "), F.col("samples").cast("string")).alias("value"))


def top_stacks(folded: DataFrame, n: int) -> DataFrame:
    return folded.orderBy(F.desc("samples"), "stack").limit(n)
