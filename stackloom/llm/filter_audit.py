"""Audit of how quality filters interact, over every order in which they can be applied.

Each document fails some set of filters, so a corpus is a count per set. The states of a
filter chain are the sets of filters applied so far: a lattice of subsets, with one edge for
each filter that is applied next. A document leaves on the edge of the first filter it fails.
Path counting forward (orders that reach a state) and backward (orders that lead on from it)
gives how many of all orders use an edge; an edge's removals times that number, summed over a
filter's edges, is the filter's Shapley value times the number of orders. What one order does
at one step is read from the same edges.

Documents are judged where they are read, and equal rows are counted. Copies are found by a digest of the text with the
smallest id per digest, summed on the map side; only digests and ids are shuffled, hot ones
are dealt out by ``join_hot``. From there on everything has one row per part and set of
failures.

Defined cases: a null text is empty; a null source is the part ``''``, as is an empty one; a
document with a null id has no label, fails no copy test and makes no other fail it; rows of
one id and text are no copies of each other; a document is good (toxic) if any label row of
its id says so; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.llm.common import WORD, join_hot, stored

#: Filters by letter; the last one is the test for copies.
LETTERS, COPY = "ABCDE", "E"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 50, 65, 5, r"[#$%&*|]"


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text fails each of the filters that look at one text alone."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text),
        "D": text.rlike(MARKS),
    }


def failure_set(failures: dict[str, Column], letters: str = LETTERS) -> Column:
    """The failed filters as bits, by place in ``letters``."""
    return sum((F.when(c, 1 << letters.index(f)).otherwise(0) for f, c in failures.items()), F.lit(0)).cast("int")


def failure_counts(docs: DataFrame, labels: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Rows ``part, failed, docs, good, toxic``: documents of each part and set of failures, and how many of them are labelled so."""
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    judged = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), failure_set(text_failures(F.col("text")), letters).alias("failed"), digest.alias("digest"))
    judged = stored(judged.groupBy(*judged.columns).agg(F.count("*").alias("rows")), "audit-judged")
    total = judged.count()
    copied = judged.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("most > least").drop("most")
    repeats = judged.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1")
    marked = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    marked = marked.where("good = 1 or toxic = 1").na.fill(0, ["good", "toxic"]).join(repeats, "doc_id", "left").na.fill(1, ["times"])
    copied, marked = stored(copied, "audit-copied"), stored(marked, "audit-marked")

    def copies(rows: DataFrame) -> DataFrame:
        return join_hot(rows, copied, ["digest"], "n", total).where("doc_id > least")

    def moved(rows: DataFrame, **sums: Column) -> DataFrame:
        """Counts of ``rows`` by their failures and, for those that are copies, from there to the set with the copy test."""
        bit, by = 1 << letters.index(COPY), ["part", "failed"]
        plain = rows.groupBy(*by).agg(*[c.alias(n) for n, c in sums.items()])
        again = copies(rows).groupBy(*by).agg(*[c.alias(n) for n, c in sums.items()])
        less = again.select(*by, *[(-F.col(n)).alias(n) for n in sums])
        more = again.select("part", F.col("failed").bitwiseOR(bit).alias("failed"), *sums)
        return plain.union(less).union(more)

    zero = F.lit(0).cast("long")
    labelled = stored(join_hot(judged, marked, ["doc_id"], "times", total), "audit-labelled")
    everything = moved(judged, docs=F.sum("rows")).select("part", "failed", "docs", zero.alias("good"), zero.alias("toxic"))
    some = moved(labelled, good=F.sum(F.col("good") * F.col("rows")), toxic=F.sum(F.col("toxic") * F.col("rows"))).select("part", "failed", zero.alias("docs"), "good", "toxic")
    return everything.union(some).groupBy("part", "failed").agg(*[F.sum(c).alias(c) for c in ("docs", "good", "toxic")])


def lattice(letters: str = LETTERS) -> list[tuple[int, int, int]]:
    """Edges ``(state, filter, orders)``: the filters applied so far, the one that is next, and how many orders of all filters do that."""
    full = (1 << len(letters)) - 1
    reaching, leaving = [0] * (full + 1), [0] * (full + 1)
    reaching[0] = leaving[full] = 1
    edges = [(s, f) for s in range(full + 1) for f in range(len(letters)) if not s >> f & 1]
    for s, f in edges:  # ascending states: every way into a state comes before its ways on
        reaching[s | 1 << f] += reaching[s]
    for s, f in reversed(edges):
        leaving[s] += leaving[s | 1 << f]
    return [(s, f, reaching[s] * leaving[s | 1 << f]) for s, f in edges]


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Rows ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` for ``counts`` as in :func:`failure_counts`.

    The edges and orders depend on the number of filters alone, so they are part of the plan.
    """
    def listed(rows: list[tuple], names: tuple[str, ...]) -> Column:
        return F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]))

    bit, failed = F.col("e.bit"), F.col("failed")
    here = failed.bitwiseAND(F.col("e.state"))
    leaves = (here == 0) & (failed.bitwiseAND(bit) != 0)
    stays = failed.bitwiseAND(F.col("e.state").bitwiseOR(bit)) == 0
    at = counts.select("*", listed([(s, f, 1 << f, n) for s, f, n in lattice(letters)], ("state", "filter", "bit", "orders")).alias("e"))

    def total(condition: Column, column: str = "docs") -> Column:
        return F.sum(F.when(condition, F.col(column)).otherwise(0)).cast("long")

    edges = at.groupBy("part", "e.state", "e.filter", "e.orders").agg(
        total(stays).alias("kept"),
        total(leaves).alias("removed"),
        total((here != 0) & (failed.bitwiseAND(bit) != 0)).alias("redundant"),
        total(failed == bit).alias("unique_fails"),
        total(leaves, "good").alias("good_lost"),
        total(leaves, "toxic").alias("toxic_lost"),
    )
    # All edges of one part: as many rows as the lattice has edges.
    edges = edges.groupBy("part").agg(F.collect_list(F.struct(*[c for c in edges.columns if c != "part"])).alias("edges"))
    orders = [("".join(p), k + 1, sum(1 << letters.index(x) for x in p[:k]), letters.index(p[k])) for p in permutations(letters) for k in range(len(letters))]
    spark = counts.sparkSession
    steps = spark.createDataFrame(orders, "filter_order string, step int, state int, filter int")
    flat = edges.select("part", F.explode("edges").alias("e"), F.aggregate(F.col("edges"), F.array_repeat(F.lit(0).cast("long"), len(letters)), lambda sums, x: F.transform(sums, lambda v, i: v + F.when(i == x["filter"], x["removed"] * x["orders"]).otherwise(0))).alias("values"))
    flat = flat.select("part", "e.*", F.get("values", F.col("e.filter")).alias("shapley"))
    return flat.join(F.broadcast(steps), ["state", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of ``docs(doc_id, source, text)`` with ``labels(doc_id, quality, toxic)``, per source."""
    return audit(stored(failure_counts(docs, labels), "audit-counts"))
