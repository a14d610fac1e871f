"""Embedding near-duplicates: all pairs of one label at or above a cosine, by cover trees and dual traversal.

Vectors are scaled to length 1, where a cosine ``c`` is a distance ``sqrt(2 - 2 c)``. Copies are
one class with a count. The classes of a label form a tree of cells: a cell of more than
``block`` classes is split around some of its own, two for each ``block`` but at most ``CENTRES``,
again and again, and each cell keeps its centre and covering radius. Two traversals prune by
covering-radius bounds: one in Spark over pairs of cells, from the roots down, and one inside
each pair of leaf cells, over cover trees (nested levels with halving radii, down to single
classes). A node pair too far apart is dropped, one surely close is linked as a whole, and
single classes, or the few rows of two small nodes, are compared in double precision.

The centres of a cell come from a hash sample of it; they steer only the work, every class is
compared. Cells that ``ROUNDS`` splits leave large are cut by a hash; their parts share centre
and radius. Links leave a task as counts and as a spanning forest, not as pairs.

With vectors spread evenly in many dimensions no bound prunes, and the work is all pairs of a label.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and
vectors without a label, link with nothing; vectors of different lengths do not link; a null
vec_id links like any other and is never a component's smallest; repeated rows count each;
an empty table gives no rows. Labels may be of any type that can be grouped. Only the named
columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.llm.common import connected_components, join_hot, row_key, stored
from stackloom.session import ship

COSINE, BLOCK, CENTRES, ROUNDS, SLACK = 0.98, 8192, 64, 12, 1e-7
#: Rows compared at once, and most tasks that pairs of cells are dealt to.
STRIP, TASKS = 256, 4000
#: Row pairs of two nodes from which their children are visited instead of comparing the rows.
DIRECT = 1024


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ y.T)))


class Node:
    """A cover: ``rows`` lie within ``radius`` of row ``centre``; ``children`` cover them at half the level's radius."""

    __slots__ = ("rows", "centre", "radius", "children", "centres", "radii", "closed", "sizes")

    def __init__(self, x: np.ndarray, rows: np.ndarray, level: float = 2.0):
        self.rows, self.centre, self.children, self.radius = rows, int(rows[0]), [], 0.0
        if len(rows) > 1:
            d = x[rows] - x[self.centre]
            self.radius = float(np.sqrt(np.einsum("ij,ij->i", d, d).max()))
        if self.radius <= 10 * SLACK:  # as small as the error of distances
            self.centres, self.radii, self.closed = rows[:1], np.array([self.radius]), np.ones(1, bool)
            self.sizes = np.array([len(rows)])
            return
        while level / 2 >= self.radius:
            level /= 2
        half, left = level / 2, rows
        near_from = 1 - half * half / 2  # the cosine of that distance
        while len(left):
            some, open_ = left[:STRIP], np.ones(len(left), bool)
            near = x[some] @ x[left].T >= near_from
            for i in range(len(some)):
                if open_[i]:
                    near[i, i] = True
                    mine = np.flatnonzero(near[i] & open_)
                    open_[mine] = False
                    self.children.append(Node(x, left[mine], half))
            left = left[open_]
        self.centres = np.array([c.centre for c in self.children])
        self.radii = np.array([c.radius for c in self.children])
        self.closed = np.array([not c.children for c in self.children])
        self.sizes = np.array([len(c.rows) for c in self.children])

    def parts(self) -> list[Node]:
        return self.children or [self]

    def depth(self) -> int:
        return 1 + max((c.depth() for c in self.children), default=0)


class Forest:
    """Union-find over rows."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def linked(x: np.ndarray, copies: np.ndarray, side: np.ndarray, cosine: float) -> tuple[np.ndarray, Forest]:
    """(copies linked to each row, forest of links) between the rows of side 0 and of side 1, or within side 0 if there is no other."""
    links, forest, limit = np.zeros(len(x), dtype=np.int64), Forest(len(x)), float(np.sqrt(2 - 2 * cosine))
    trees = [Node(x, np.flatnonzero(side == s)) for s in (0, 1) if (side == s).any()]
    todo = [(trees[0], trees[-1])]

    def one_ball(a: Node, b: Node) -> None:
        links[a.rows] += copies[b.rows].sum() - (copies[a.rows] if a is b else 0)
        if a is not b:
            links[b.rows] += copies[a.rows].sum()
        for i in (*a.rows.tolist(), *b.rows.tolist()):
            forest.join(a.centre, i)

    def compared(of_a: np.ndarray, of_b: np.ndarray) -> None:
        """Rows against other rows, or against themselves."""
        i, j = np.nonzero(x[of_a] @ x[of_b].T >= cosine)
        i, j = of_a[i], of_b[j]
        if of_a is of_b:
            i, j = i[i != j], j[i != j]
        np.add.at(links, i, copies[j])
        if of_a is not of_b:
            np.add.at(links, j, copies[i])
        for p, q in zip(i.tolist(), j.tolist()):
            forest.join(p, q)

    def visit(a: Node, of_a: np.ndarray, b: Node, of_b: np.ndarray, same: bool) -> None:
        """Pairs of parts of two nodes; of the same parts each pair once."""
        if not len(of_a) or not len(of_b):
            return
        left, right = a.parts(), b.parts()
        widest = float(a.radii[of_a].max() + b.radii[of_b].max()) + limit + SLACK
        least = -2.0 if widest >= 2 else 1 - widest * widest / 2  # no pair under this cosine is near enough
        for s in range(0, len(of_a), STRIP):
            skip = s if same else 0
            dots = x[a.centres[of_a[s : s + STRIP]]] @ x[b.centres[of_b[skip:]]].T
            i, j = np.nonzero(dots >= least)
            gap = np.sqrt(np.maximum(0.0, 2 - 2 * dots[i, j]))
            first = i + s < j + skip
            i, j = of_a[i + s], of_b[j + skip]
            reach = a.radii[i] + b.radii[j]
            near = gap - reach <= limit + SLACK
            if same:
                near &= first
            whole = gap + reach < limit - SLACK
            small = a.closed[i] & b.closed[j] | (a.sizes[i] * b.sizes[j] <= DIRECT)
            for k in np.flatnonzero(near & (whole | ~small)).tolist():
                p, q = left[i[k]], right[j[k]]
                if whole[k]:
                    one_ball(p, q)
                else:
                    todo.append((p, q))
            rest = np.flatnonzero(near & ~whole & small)  # in order of i
            i, j = i[rest], j[rest].tolist()
            cuts = [0, *(np.flatnonzero(i[1:] != i[:-1]) + 1).tolist(), len(i)] if len(i) else [0]
            for u, v in zip(cuts, cuts[1:]):
                compared(left[i[u]].rows, np.concatenate([right[k].rows for k in j[u:v]]))

    while todo:
        a, b = todo.pop()
        if a is b:
            if 2 * a.radius < limit - SLACK:
                one_ball(a, a)
                continue
            if not a.children or len(a.rows) ** 2 <= DIRECT:
                compared(a.rows, a.rows)
                continue
            todo += [(c, c) for c in a.children if len(c.rows) > 1]
        # Single classes and wider balls apart, so that the widest of a group tells how near its pairs must be.
        groups = [(np.flatnonzero(n.closed), np.flatnonzero(~n.closed)) for n in (a, b)]
        for own, other in ((0, 0), (0, 1), (1, 1)) if a is b else ((0, 0), (0, 1), (1, 0), (1, 1)):
            visit(a, groups[0][own], b, groups[1][other], a is b and own == other)
    return links, forest


def unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sound(embedding: str = "embedding") -> Column:
    """Whether a vector can link at all."""
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(embedding) > 0) & ~bad & ~F.forall(embedding, lambda v: v == 0), F.lit(False))


def cells(classes: DataFrame, block: int = BLOCK, centres: int = CENTRES, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(``classes`` plus the leaf ``cell`` of each, ``cell, parent, centre, radius`` of the tree) for ``classes(class, label, embedding)``.

    A root cell holds the vectors of one label and length; its radius is 2, which bounds all.
    """
    roots = classes.groupBy("label", F.size("embedding").alias("size")).agg(F.min("class").alias("cell"), F.min_by("embedding", "class").alias("centre"), F.count("*").alias("n"))
    roots = stored(roots, "embedding-roots")
    placed = join_hot(classes.withColumn("size", F.size("embedding")), roots.drop("centre"), ["label", "size"], "n", classes.count())
    placed = stored(placed.select(*classes.columns, "cell"), "embedding-placed")
    first = roots.select("cell", "centre")
    tree = stored(first.select("cell", F.lit(None).cast("long").alias("parent"), F.transform("centre", lambda v: v.cast("double")).alias("centre"), F.lit(2.0).alias("radius")), "embedding-tree")
    own_columns = classes.columns
    names, done, kinds = [*own_columns, "parent", "cell"], [], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema)
    for depth in range(rounds):
        sizes = stored(placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > block).withColumn("parts", F.ceil(F.col("n") / block)), "embedding-sizes")
        total = placed.count()
        if sizes.isEmpty():
            break
        done.append(placed.join(sizes, "cell", "left_anti"))
        big = join_hot(placed, sizes.withColumn("rows", F.col("n")), ["cell"], "rows", total).withColumn("part", F.pmod(F.xxhash64(F.lit(1), "class"), F.col("parts")))
        big = stored(big, "embedding-big")
        chosen = big.where(F.pmod(F.xxhash64(F.lit(depth), "class"), F.ceil(F.col("n") / F.least(F.lit(centres), 2 * F.col("parts")))) == 0)
        chosen = chosen.select("cell", "class", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        chosen = stored(chosen, "embedding-centres")  # Spark prunes a generator's input below a cogroup too far

        def nearest(rows: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return pd.DataFrame(columns=[*names, "far"])
            own = rows.iloc[:1] if around.empty else around.sort_values("class")
            d = apart(unit(rows["embedding"]), unit(own["embedding"]))
            return rows[own_columns].assign(parent=rows["cell"], cell=own["class"].to_numpy()[d.argmin(1)], far=d.min(1) + SLACK)[[*names, "far"]]

        split = big.groupBy("cell", "part").cogroup(chosen.groupBy("cell", "part")).applyInPandas(nearest, f"{kinds}, parent long, cell long, far double")
        # A cell is named by its parent and its centre's class.
        split = stored(split.withColumn("centre", F.col("cell")).withColumn("cell", F.xxhash64(F.lit(depth), "parent", "cell")), "embedding-split")
        grown = split.groupBy("cell", "parent").agg(F.max_by("embedding", F.col("class") == F.col("centre")).alias("centre"), F.max("far").alias("radius"))
        tree = stored(tree.union(grown.select("cell", "parent", F.transform("centre", lambda v: v.cast("double")).alias("centre"), "radius")), "embedding-tree")
        placed = stored(split.select(*classes.columns, "cell"), "embedding-placed")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
    parts = sizes.where(F.col("n") > block).select("cell", F.ceil(F.col("n") / block).alias("parts"), "n")
    cut = join_hot(placed, parts, ["cell"], "n", placed.count())
    cut = cut.select(*classes.columns, F.col("cell").alias("parent"), F.xxhash64(F.lit(-1), "cell", F.pmod(F.xxhash64(F.lit(2), "class"), F.col("parts"))).alias("cell"))
    leaves = placed.join(parts, "cell", "left_anti").unionByName(cut.drop("parent"))
    for d in done:
        leaves = leaves.unionByName(d)
    pieces = cut.select("cell", "parent").distinct().join(tree.select(F.col("cell").alias("parent"), "centre", "radius"), "parent").select("cell", "parent", "centre", "radius")
    return stored(leaves, "embedding-leaves"), stored(tree.union(pieces), "embedding-tree")


def distance(a: str, b: str) -> Column:
    """Between two vectors scaled to length 1, in double precision."""

    def norm(v: str) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))

    dots = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dots / (norm(a) * norm(b))))


def close_cells(tree: DataFrame, cosine: float) -> DataFrame:
    """Pairs ``(a, b)`` of leaf cells, each once, that may hold a link: the roots with themselves, then their children, down the tree."""
    limit = float(np.sqrt(2 - 2 * cosine)) + 4 * SLACK
    inner = tree.where("parent is not null").select(F.col("parent").alias("cell")).distinct()
    leaf = tree.join(inner, "cell", "left_anti").select(F.col("cell").alias("parent"), "cell", "centre", "radius")
    below = stored(tree.where("parent is not null").select("parent", "cell", "centre", "radius").union(leaf), "embedding-below")
    left, right = (below.select(F.col("parent").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("cell", "centre", "radius")]) for s in "ab")
    pairs, before = stored(tree.where("parent is null").select(F.col("cell").alias("a"), F.col("cell").alias("b")), "embedding-cell-pairs"), None
    while True:
        found = pairs.join(left, "a").join(right, "b").where("a <> b or cell_a <= cell_b")
        near = (F.col("cell_a") == F.col("cell_b")) | (distance("centre_a", "centre_b") - F.col("radius_a") - F.col("radius_b") <= limit)
        pairs = stored(found.where(near).select(F.col("cell_a").alias("a"), F.col("cell_b").alias("b")), "embedding-cell-pairs")
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return pairs
        before = state


def near_links(classes: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """Rows ``class, links, root``: per class and pair of cells how many vectors link to it, and a class it is connected to.

    ``classes(class, label, embedding, copies)``.
    """
    placed, tree = cells(classes, block)
    pairs = close_cells(tree, cosine)
    sides = stored(pairs.select(F.col("a").alias("cell"), "a", "b", F.lit(0).alias("side")).union(pairs.where("a <> b").select("b", "a", "b", F.lit(1))), "embedding-sides")
    tasks = max(1, min(TASKS, -(-pairs.count() // 2)))
    dealt = placed.join(sides, "cell").select("a", "b", "side", "class", "copies", "embedding").repartition(tasks, "a", "b")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        links, forest = linked(unit(rows["embedding"]), rows["copies"].to_numpy(), rows["side"].to_numpy(), cosine)
        some = np.flatnonzero(links)
        ids = rows["class"].to_numpy()
        return pd.DataFrame({"class": ids[some], "links": links[some], "root": ids[[forest.root(i) for i in some.tolist()]] if len(some) else ids[:0]})

    return dealt.groupBy("a", "b").applyInPandas(run, "class long, links long, root long")


def embedding_components(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Rows ``vec_id, n_links, component_id, kept`` for every row of ``embeddings(vec_id, embedding, label)``."""
    ship(embeddings.sparkSession)
    every = embeddings.select("vec_id", "label", "embedding")
    links_at_all = F.col("label").isNotNull() & sound()
    k1, k2 = row_key("label", "embedding")
    rows = every.where(links_at_all).select("vec_id", "label", "embedding", k1.alias("k1"), k2.alias("k2"))
    grouped = rows.groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = stored(grouped.withColumn("class", F.monotonically_increasing_id()), "embedding-classes")
    found = stored(near_links(classes.select("class", "label", "embedding", "copies"), cosine), "embedding-links")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("class").alias("a"), F.col("root").alias("b")), "embedding-components")
    marked = classes.select("k1", "k2", "class", "copies", "least").join(links, "class", "left").join(components, F.col("class") == F.col("node"), "left")
    marked = stored(marked.select("k1", "k2", "copies", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("root")), "embedding-marked")
    best = marked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    marked = stored(join_hot(marked, best, ["root"], "n", marked.count()).select("k1", "k2", "copies", "n_links", "component_id"), "embedding-marked")
    total = marked.agg(F.sum("copies")).first()[0] or 0
    out = join_hot(rows.select("vec_id", "k1", "k2"), marked, ["k1", "k2"], "copies", total).select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    rest = every.where(~links_at_all).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
