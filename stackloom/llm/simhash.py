"""SimHash near-duplicates: 64-bit fingerprints linked at a few differing bits, by pigeonring filtering.

A fingerprint is cut into a ring of ``bits + 1`` segments. If two fingerprints differ in at
most ``bits`` bits there is a segment from which every chain of consecutive segments stays
within its proportional budget: a chain of ``l`` segments differs in at most
``floor(l * bits / (bits + 1)) = l - 1`` bits. So the first segment is equal, and of the
second, which may differ in one bit, one half is equal. Both make the join key; the longer
chains prune, and the full Hamming distance decides.

Copies share a fingerprint and are one class, so the join is between distinct fingerprints.

Defined cases: a null or blank text has fingerprint 0 and links like any other; a null
doc_id counts as larger than every other one; repeated rows get equal results; an empty
table gives no rows. Only the named columns are read; where all of ``docs`` is returned, the
columns used meanwhile get names that it does not have.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from stackloom.llm.common import connected_components, join_hot, row_key, stored, unused
from stackloom.session import ship

SHINGLE_WORDS, BITS, SEED = 4, 4, 42
#: Values on one join key from which they are linked through hubs first.
DENSE = 64
#: Most choices of equal parts that a scheme has per start.
MOST_CHOICES = 32
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
#: Columns of a key, and rows of one key whose comparison with all its rows is one task's.
KEY, PART_ROWS = ["ring", "a", "b"], 2000


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if set in over half the XXH64 values of the text's shingles, repeats included."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    line, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    ends = ends[min(words, len(found)) - 1 :]
    hashes = np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends.tolist())), dtype="<u8", count=n)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, BLOCK):
        counts += np.unpackbits(hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def segments(bits: int) -> list[tuple[int, int]]:
    """(offset, length) of the ring's segments of a 64-bit value."""
    n = bits + 1
    return [(64 * i // n, 64 * (i + 1) // n - 64 * i // n) for i in range(n)]


def cut(value: Column, offset: int, length: int) -> Column:
    return F.shiftrightunsigned(value, offset).bitwiseAND(F.lit((1 << length) - 1))


#: Per scheme: how many segments after the first, into how many parts they are cut, how many parts are equal.
SCHEMES = ((1, 2, 1), (2, 4, 2), (3, 6, 3))


def scheme_for(n: int, bits: int) -> tuple[int, int, int]:
    """The scheme whose keys are long enough that ``n`` spread fingerprints meet few others by chance.

    From the ring's start ``k`` further segments differ in at most ``k`` bits, so of ``2 k`` parts
    of them ``k`` are equal. All schemes find the same links.
    """
    for scheme in SCHEMES:
        further, cut_in, equal = scheme
        if further <= bits and n <= 1 << (int(64 / (bits + 1) * (1 + further * equal / cut_in)) + 1):
            return scheme
    return SCHEMES[min(bits, len(SCHEMES)) - 1] if bits else (0, 1, 0)


def ring_keys(fp: Column, bits: int, scheme: tuple[int, int, int]) -> Column:
    """Array of ``struct(ring, a, b)``: per start the whole first segment ``a`` and, for each choice of equal parts of the next ones, their values ``b``."""
    parts, (further, cut_in, equal), keys = segments(bits), scheme, []
    for i, (offset, length) in enumerate(parts):
        pieces: list[tuple[int, int]] = []
        for k in range(1, further + 1):
            o, n = parts[(i + k) % len(parts)]
            each = cut_in // further
            pieces += [(o + n * j // each, n * (j + 1) // each - n * j // each) for j in range(each)]
        for j, chosen in enumerate(combinations(pieces, equal)):
            value = F.lit(0).cast("long")
            for o, n in chosen:
                value = F.shiftleft(value, n).bitwiseOR(cut(fp, o, n))
            keys.append(F.struct(F.lit(i * MOST_CHOICES + j).alias("ring"), cut(fp, offset, length).alias("a"), value.alias("b")))
    return F.array(*keys)


def chains_fit(ring: Column, difference: Column, bits: int) -> Column:
    """Whether from the ring's start every chain of ``l`` segments has at most ``l - 1`` differing bits."""
    parts, fits = segments(bits), F.lit(False)
    for i in range(len(parts)):
        ok, total = F.lit(True), F.lit(0)
        for step in range(len(parts)):
            total = total + F.bit_count(cut(difference, *parts[(i + step) % len(parts)]))
            ok = ok & (total <= (step + 1) * bits // len(parts))
        fits = F.when(F.floor(ring / MOST_CHOICES) == i, ok).otherwise(fits)
    return fits


def keyed_prints(prints: DataFrame, bits: int, scheme: tuple[int, int, int]) -> DataFrame:
    return prints.select("fp", F.explode(ring_keys(F.col("fp"), bits, scheme)).alias("k")).select("fp", "k.*")


def chosen_pairs(left: DataFrame, right: DataFrame, bits: int, scheme: tuple[int, int, int], more: Column, keys: list[str] = KEY) -> DataFrame:
    """Pairs of ``left(ring, a, b, x)`` and ``right(ring, a, b, y)`` that pass the chains and the full distance."""
    difference = F.col("x").bitwiseXOR(F.col("y"))
    found = left.join(right, keys).where(more & chains_fit(F.col("ring"), difference, bits) & (F.bit_count(difference) <= bits))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_pairs(prints: DataFrame, bits: int = BITS, scheme: tuple[int, int, int] | None = None) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of the distinct values in ``prints(fp)`` that differ in at most ``bits`` bits."""
    scheme = scheme or scheme_for(prints.count(), bits)
    keyed = keyed_prints(prints, bits, scheme)
    return chosen_pairs(keyed.withColumnRenamed("fp", "x"), keyed.withColumnRenamed("fp", "y"), bits, scheme, F.col("x") < F.col("y"))


def hub_links(prints: DataFrame) -> DataFrame:
    """Edges that connect all of ``prints(fp)`` within two bits of each other, at most 65 per value.

    Two values are within two bits if and only if some third one is within one bit of both;
    at most 65 values share such a hub, and each is linked to the least of them.
    """
    near = F.transform(F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), b) for b in range(64)]), lambda m: F.col("fp").bitwiseXOR(m))
    hubs = prints.select("fp", F.explode(near).alias("hub"))
    return hubs.withColumn("least", F.min("fp").over(Window.partitionBy("hub"))).where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def near_links(prints: DataFrame, bits: int = BITS, dense: int = DENSE) -> DataFrame:
    """Edges ``(a, b)`` between values of ``prints(fp)`` within ``bits`` bits that connect all such pairs.

    Where more than ``dense`` values meet on one key, as near copies of one text do, comparing
    all pairs would grow with the square of the group. Such values are first linked through
    hubs. On their keys only pairs of different groups are then compared, and only those
    outside the key's largest group with all others.
    """
    key, scheme = KEY, scheme_for(prints.count(), bits)
    keyed = stored(keyed_prints(prints, bits, scheme), "simhash-keys")
    crowded = stored(keyed.groupBy(*key).count().where(F.col("count") > dense), "simhash-crowded-keys")
    if bits < 2 or crowded.isEmpty():
        return chosen_pairs(keyed.withColumnRenamed("fp", "x"), keyed.withColumnRenamed("fp", "y"), bits, scheme, F.col("x") < F.col("y"))
    total = keyed.count()
    rows = stored(join_hot(keyed, crowded, key, "count", total, "left_semi"), "simhash-crowded")
    total, rare = rows.count(), keyed.join(crowded, key, "left_anti")
    pairs = chosen_pairs(rare.withColumnRenamed("fp", "x"), rare.withColumnRenamed("fp", "y"), bits, scheme, F.col("x") < F.col("y"))
    hubs = stored(hub_links(rows.select("fp").distinct()), "simhash-hubs")
    groups = connected_components(hubs, "simhash-groups")
    grouped = stored(rows.join(groups, rows.fp == groups.node, "left").select(*key, "fp", F.coalesce("component", "fp").alias("group")), "simhash-grouped")
    counts = grouped.groupBy(*key, "group").count().groupBy(*key).agg(F.max_by("group", F.struct("count", "group")).alias("largest"), F.sum("count").alias("count"), F.count("*").alias("groups"))
    parts = F.ceil(F.col("count") / PART_ROWS).cast("long")
    several = stored(counts.where("groups > 1").select(*key, "largest", "count", parts.alias("parts")), "simhash-largest")  # keys of one group need no comparison
    marked = stored(join_hot(grouped, several, key, "count", total), "simhash-marked")
    # The left rows of a large key are dealt to parts, and its right rows go to each, so no task compares a whole key.
    left = marked.select(*key, F.col("fp").alias("x"), F.col("group").alias("gx"), "largest", F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part")).where("gx <> largest").drop("largest")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    right = marked.select(*key, F.col("fp").alias("y"), F.col("group").alias("gy"), (F.col("group") == F.col("largest")).alias("main"), every)
    others = chosen_pairs(left, right, bits, scheme, (F.col("gx") != F.col("gy")) & (F.col("main") | (F.col("x") < F.col("y"))), [*key, "part"])
    return pairs.union(hubs).union(others).distinct()


def simhash_components(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows ``doc_id, key, other, fp, root, component_id`` for every row of ``docs(doc_id, text)``; ``key`` and ``other`` are its ``row_key``.

    ``root`` is the smallest fingerprint reachable over links and names the group; component_id
    is the group's smallest doc_id, which other groups may share, as all whose ids are null do.
    """
    ship(docs.sparkSession)
    key, other = row_key("doc_id", "text")
    light = stored(docs.select("doc_id", key.alias("key"), other.alias("other"), fingerprints("text").alias("fp")), "simhash-prints")
    classes = stored(light.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "simhash-classes")
    components = connected_components(near_links(classes.select("fp"), bits), "simhash-components")
    # A component's smallest doc_id, then per fingerprint.
    merged = stored(classes.join(components, classes.fp == components.node, "left").select("fp", F.coalesce("component", "fp").alias("root"), "least", "rows"), "simhash-roots")
    best = merged.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    merged = stored(join_hot(merged, best, ["root"], "n", merged.count()).select("fp", "root", "rows", "component_id"), "simhash-merged")
    return join_hot(light, merged, ["fp"], "rows", light.count(), stored_left=True).select("doc_id", "key", "other", "fp", "root", "component_id")


def one_of_each_group(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row of ``docs`` from each group, one whose doc_id is the group's smallest; of repeated rows one."""
    marked = stored(simhash_components(docs, bits), "simhash-marked")
    chosen = marked.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("key", "other")).alias("one"))
    a, b = unused(docs, "key"), unused(docs, "other")
    chosen = stored(chosen.select(F.col("one.key").alias(a), F.col("one.other").alias(b)).distinct(), "simhash-kept")
    keys = row_key("doc_id", "text")
    kept = docs.withColumns({a: keys[0], b: keys[1]}).join(chosen, [a, b], "left_semi")
    twice = marked.groupBy("key", "other").count().where("count > 1").select(F.col("key").alias(a), F.col("other").alias(b))
    # Rows that are there once need no sorting; of the others one is as good as another.
    once = kept.join(twice, [a, b], "left_anti")
    several = kept.join(twice, [a, b], "left_semi").dropDuplicates([a, b])
    return once.union(several).drop(a, b)
