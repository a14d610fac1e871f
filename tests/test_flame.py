"""Trees by prefix keys against plain Python: frames that hold the separator, deep stacks, ties; counters, markers and sketches."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stackloom.functions import frames
from stackloom.operators import flame, stats


@pytest.fixture(scope="module")
def stacks():
    rng = random.Random(1)
    names = ["a", "b", "a;b", "c", ";", "d"]
    rows = [([rng.choice(names) for _ in range(rng.randint(0, 5))], rng.randint(1, 4)) for _ in range(300)]
    return rows + [(["deep"] * 40, 9), (["deep"] * 35 + ["x"], 9)]


@pytest.fixture(scope="module")
def tree(spark, stacks):
    return flame.flame_tree(spark.createDataFrame(stacks, "p array<string>, cnt long"), F.col("p")).cache()


def values(stacks):
    out = Counter()
    for p, n in stacks:
        for d in range(len(p) + 1):
            out[tuple(p[:d])] += n
    return out


def below(nodes):
    """Children of each node in order."""
    out = defaultdict(list)
    for p in nodes:
        if p:
            out[p[:-1]].append(p)
    return {k: sorted(v, key=lambda p: (-nodes[p], p[-1])) for k, v in out.items()}


def test_tree(tree, stacks):
    nodes = values(stacks)
    got = sorted((r.depth, r.path, r.name, r.parent, r.value, r.below) for r in tree.collect() if r.depth)
    assert got == sorted((len(p), ";".join(p), p[-1], ";".join(p[:-1]), n, max(len(q) for q, _ in stacks if tuple(q[: len(p)]) == p)) for p, n in nodes.items() if p)
    assert tree.where("depth = 0").first().value == sum(n for _, n in stacks)
    assert tree.select("key").distinct().count() == len(nodes)


def test_hot_path_and_layout(tree, stacks):
    nodes = values(stacks)
    children = below(nodes)
    at, hot = (), []
    while children.get(at):
        at = children[at][0]
        hot.append((len(at), ";".join(at), nodes[at]))
    assert [(r.depth, r.path, r.value) for r in flame.hot_path(tree).orderBy("depth").collect()] == hot
    left = {(): 0}
    for p in sorted(nodes, key=len):
        x = left[p]
        for c in children.get(p, []):
            left[c], x = x, x + nodes[c]
    got = sorted((r.depth, r.path, r.left_edge, r.width) for r in flame.layout(tree).collect())
    assert got == sorted((len(p), ";".join(p), left[p], n) for p, n in nodes.items() if p)


def test_empty_tree(spark):
    none = flame.flame_tree(spark.createDataFrame([], "p array<string>, cnt long"), F.col("p"))
    assert none.count() == flame.hot_path(none).count() == flame.layout(none).count() == 0


def test_counters(spark):
    lost = stats.lost_events(spark.createDataFrame([("h", 1, 3), ("h", 1, 4), ("h", 2, 0), ("g", 1, 1)], "host string, cpu int, lost long"))
    assert sorted(tuple(r) for r in lost.collect()) == [("g", 1, 1, 1, "lost 1 events on CPU #1"), ("h", 1, 7, 2, "lost 7 events on CPU #1")]
    rows = [("h", True, 3, 4), ("h", True, 3, 3), ("h", False, 0, 9), ("g", True, 0, 1)]
    counted = stats.unwind_counters(spark.createDataFrame(rows, "host string, unwinds_user boolean, dwarf_levels int, fp_levels int"))
    assert sorted(tuple(r) for r in counted.collect()) == [("g", 2, 1, 1), ("h", 3, 2, 1)]


def test_sketches_of_parts_answer_for_the_whole(spark):
    rows = spark.range(60_000).select((F.col("id") % 2).alias("host"), (F.col("id") % 30).alias("day"), (F.col("id") % 7000).alias("stack"), (F.col("id") * 7919 % 50_000).alias("us"))
    near = stats.rolled_up(stats.sketched(rows, ["host", "day"], F.col("stack"), F.col("us")), ["host"]).collect()
    assert {r.n for r in near} == {30_000}
    for r in near:
        assert abs(r.distinct - 3500) < 0.04 * 3500
        assert all(abs(q - p * 50_000) < 0.03 * 50_000 for q, p in zip(r.quantiles, (0.5, 0.9, 0.99)))


def test_markers_of_a_sample(spark):
    rows = [("full", True, True, "process_exit"), ("high", False, True, "language"), (None, True, False, "truncated"), (None, False, False, None)]
    df = spark.createDataFrame([(*r, 3, "D", ["leaf", "root"]) for r in rows], "p string, irq boolean, off boolean, why string, cpu int, state string, user array<string>")
    markers = frames.sample_markers(F.col("p"), F.col("irq"), F.col("cpu"), F.col("off"), F.col("state"))
    got = [r.s for r in df.select(frames.assemble_stack(F.lit("m"), markers, frames.user_part(F.col("user"), F.col("p").isNull() | (F.col("p") == "high"), F.col("why")), F.array().cast("array<string>"), F.lit(True)).alias("s")).collect()]
    assert got[0] == ["m", "<# PRESSURE FULL DROP SAMPLE #>", "<# IRQOFF SAMPLE ON CPU 3 #>", "<# OFFCPU SAMPLE: (D) #>", "kernel_drop_stack_[k]"]
    assert got[1] == ["m", "<# PRESSURE HIGH DROP SAMPLE #>", "<# OFFCPU SAMPLE: (D) #>", "<# DROP BY LANG TYPE #>", "root", "leaf", "kernel_drop_stack_[k]"]
    assert got[2] == ["m", "<# IRQOFF SAMPLE ON CPU 3 #>", "root", "leaf", "kernel_drop_stack_[k]"] and got[3] == ["m", "root", "leaf", "kernel_drop_stack_[k]"]
