"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources get shares of the mix by weight. The mix is counted in blocks of equal tokens; each
source gets a whole number of blocks by the highest quotients ``weight / (2k - 1)``, and a
source's blocks are divided among its shards the same way. Within a shard the documents lie
on one line in a seeded order; its blocks are cut from that line and the quota takes them
from the line's start, around again for repeats. A seeded order makes any run of blocks a
seeded random selection.

A shard is a hash bucket of one source. Shards are many enough that each holds at most about
``SHARD_ROWS`` documents, so no task orders a whole source. Equal rows are counted first and
their number is divided over the shards, where they stand together as one entry. Quotas are
found near the standard divisor, so blocks are never listed.

Defined cases: null text has size 0; a null source is a source of its own, last in order;
repeated rows count each for itself; sources of size 0 get target 0; quotients that tie go
by source, then shard; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.llm.common import WORD, row_key, stored, unused

#: Weights of the sources in code point order, repeating; share of all sizes that the mix has; most times that a source is taken.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2
#: Documents in a shard, on average, and the least and most tokens of a block.
SHARD_ROWS, LARGEST_BLOCK, BLOCKS_OF_SMALLEST = 10_000, 1024, 1000
SEED = 17
#: Equal rows that one window numbers.
SAME_ROWS = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sources(source, source_size, ..)`` plus ``target``: shares by weight, capped at ``most`` times the size, the excess reshared by weight.

    The final level ``t`` satisfies ``sum(min(most * size, weight * t)) = total``. With sources
    ordered by ``most * size / weight`` the capped ones are a prefix, so one running sum finds ``t``.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("weight", w).withColumn("cap", (most * F.col("source_size")).cast("double")).withColumn("breakpoint", F.col("cap") / F.col("weight"))
    run = Window.orderBy("breakpoint", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = share * F.sum("source_size").over(every)
    ranked = ranked.withColumn("capped_before", F.coalesce(F.sum("cap").over(run), F.lit(0.0))).withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(run), F.lit(0.0))).withColumn("total", total.cast("double"))
    level = (F.col("total") - F.col("capped_before")) / F.col("weight_left")
    found = ranked.withColumn("level", F.min_by(level, F.when(level <= F.col("breakpoint"), F.col("capped_before"))).over(every))
    return found.select(*sources.columns, "weight", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), F.col("cap")).alias("target"))


def sainte_lague(cells: DataFrame, group: list[str], order: list[Column], weight: str, seats: str) -> DataFrame:
    """``cells`` plus ``quota``: ``seats`` (one number per group) given to the group's cells by the highest quotients ``weight / (2k - 1)``.

    Rounding at the standard divisor is off by at most half a seat per cell. Seats whose quotient
    lies within a factor of the divisor that must hold them are listed and ranked exactly.
    """
    whole, w = Window.partitionBy(*group), F.col(weight).cast("double")
    n = F.count("*").over(whole)
    base = cells.withColumn("_w", F.sum(w).over(whole)).withColumn("_n", n.cast("double"))
    base = base.withColumn("_share", F.when(F.col("_w") > 0, w * F.col(seats) / F.col("_w")).otherwise(0.0))
    base = base.withColumn("_base", F.floor(F.col("_share") + 0.5)).withColumn("_off", F.col(seats) - F.sum("_base").over(whole))
    # Seats k (1, 2, ..) have quotients share / (k - 0.5), against 1 at the standard divisor.
    slack = F.when(F.col(seats) > 0, F.least(F.lit(0.9), 4 * F.col("_n") / F.col(seats))).otherwise(0.0)
    low = F.floor(F.col("_share") * (1 - slack) + 0.5)
    high = F.floor(F.col("_share") / (1 - slack) + 0.5) + 1
    base = base.withColumn("_lo", F.when(F.col("_off") < 0, F.greatest(F.lit(0), low - 1) + 1).otherwise(F.col("_base") + 1)).withColumn("_hi", F.when(F.col("_off") > 0, high).otherwise(F.col("_base")))
    listed = base.where("_off <> 0 and _share > 0 and _hi >= _lo").withColumn("_k", F.explode(F.sequence("_lo", "_hi"))).withColumn("_q", F.col("_share") / (F.col("_k") - 0.5))
    place = Window.partitionBy(*group).orderBy(F.when(F.col("_off") > 0, -F.col("_q")).otherwise(F.col("_q")), *order, "_k")
    ids = list(dict.fromkeys([*group, *[c for c in cells.columns if c not in (weight, seats)]]))
    moved = listed.withColumn("_place", F.row_number().over(place)).where("_place <= abs(_off)").groupBy(*ids).agg(F.sum(F.signum("_off")).cast("long").alias("_change"))
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ids]
    joined = base.alias("b").join(moved.alias("m"), same, "left")
    return joined.select(*[F.col(f"b.{c}").alias(c) for c in cells.columns], (F.col("b._base") + F.coalesce(F.col("m._change"), F.lit(0))).cast("long").alias("quota"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Rows ``doc_id, key, source, size, source_size, target, taken`` for every row of ``docs(doc_id, source, text)``.

    ``taken`` is how many words the mix takes of the document, repeats counted; ``key`` hashes doc_id, source and text.
    """
    sized = docs.select("doc_id", "source", row_key("doc_id", "source", "text")[0].alias("key"), word_count(F.col("text")).alias("size"))
    sized = stored(sized.groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("rows")), "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("rows"))
    targets = stored(capped_targets(sources, weights, share, most).withColumn("shards", F.ceil(F.col("rows") / SHARD_ROWS)), "mix-targets")
    whole = targets.agg(F.sum("target").alias("target"), F.min(F.when(F.col("target") > 0, F.col("target"))).alias("least")).first()
    block = max(1, min(LARGEST_BLOCK, int((whole.least or 0) // BLOCKS_OF_SMALLEST)))
    blocks = round((whole.target or 0) / block)

    by_source = sainte_lague(targets.select("source", "target", F.lit(0).alias("all"), F.lit(blocks).cast("long").alias("seats")), ["all"], [F.col("source").isNull(), F.col("source")], "target", "seats")
    laid = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "t.source_size", "t.target", "t.shards")
    # Equal rows are divided over as many shards as they can fill, from the one that their hash names.
    parts = F.least("rows", "shards")
    laid = laid.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).withColumn("copies", F.floor(F.col("rows") / parts) + (F.col("part") < F.col("rows") % parts).cast("long"))
    laid = laid.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "key") % F.col("shards") + F.col("part"), F.col("shards")))
    cells = laid.groupBy("source", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("line"))
    cells = cells.alias("c").join(by_source.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("c.source", "c.shard", "c.line", F.col("s.quota").alias("seats"))
    cells = sainte_lague(cells, ["source"], [F.col("shard")], "line", "seats").select("source", "shard", "line", "quota")

    line = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "key"), "key", "doc_id", "size")
    whole = F.col("size") * F.col("copies")
    laid = laid.withColumn("start", F.sum(whole).over(line.rowsBetween(Window.unboundedPreceding, 0)) - whole)
    joined = laid.alias("d").join(cells.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.shard") == F.col("c.shard")))
    words = F.least(F.col("quota") * block, most * F.col("line"))
    rounds = F.when(F.col("line") > 0, F.floor(words / F.col("line"))).otherwise(0)
    rest = words - rounds * F.col("line")
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    taken = F.col("size") * rounds + F.greatest(F.lit(0), F.least("size", rest - F.col("start") - F.col("copy") * F.col("size")))
    return joined.select("d.doc_id", "d.key", "d.source", "d.size", "d.source_size", "d.target", taken.cast("long").alias("taken"))


def numbered_within(rows: DataFrame, keys: list[str], nth: str) -> DataFrame:
    """``rows`` plus their number, from 1, among those of the same ``keys``, of which few may have very many rows.

    Rows are stored and counted per part of that table; a window orders one key's rows of one
    part, another one the parts of a key.
    """
    at, part, before = unused(rows, "at"), unused(rows, "part"), unused(rows, "before")
    held = stored(rows.withColumn(at, F.monotonically_increasing_id()), "mix-hot").withColumn(part, F.shiftright(at, 33))
    sizes = held.groupBy(*keys, part).agg(F.count("*").alias(before))
    ends = F.sum(before).over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*keys, part, F.coalesce(ends, F.lit(0)).alias(before))
    own = held.withColumn(nth, F.row_number().over(Window.partitionBy(*keys, part).orderBy(at)))
    same = [F.col(f"h.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, part]]
    joined = own.alias("h").join(offsets.alias("o"), same)
    return joined.select(*[F.col(f"h.`{c}`") for c in rows.columns], (F.col(f"h.{nth}") + F.col(f"o.{before}")).cast("int").alias(nth))


def numbered_rows(rows: DataFrame, keys: list[str], nth: str, hot: DataFrame | None, order: Column) -> DataFrame:
    """``rows`` plus their number among those of the same ``keys``; ``hot(keys..)`` names the few with very many rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    if hot is None:
        return rows.withColumn(nth, F.row_number().over(w))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    few = rows.alias("l").join(F.broadcast(hot.alias("r")), same, "left_anti").withColumn(nth, F.row_number().over(w))
    many = rows.alias("l").join(F.broadcast(hot.alias("r")), same, "left_semi")
    return few.unionByName(numbered_within(many, keys, nth))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix has it: one row for each full pass over a document and one for a cut pass, which keeps its first words joined by one space. Columns as in ``docs``; ``n_chars``, if there, is renewed for cut rows.

    Equal rows get their amounts one by one, numbered on both sides. Those with more than
    ``SAME_ROWS`` equals, or a thousandth of all rows if that is more, are at most 1,000 kinds.
    """
    id_, key, size, words, nth, turn = names = [unused(docs, n) for n in ("id", "key", "size", "taken", "nth", "pass")]
    taken = stored(mix(docs, **options).select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "key", "size", "taken"), names)]), "mix-taken")
    most = max(SAME_ROWS, taken.count() // 1000)
    hot = stored(taken.groupBy(key, id_).count().where(F.col("count") > most).select(key, id_), "mix-same")
    hot = None if hot.isEmpty() else hot
    taken = numbered_rows(taken, [key, id_], nth, hot, F.col(words))
    rows = docs.withColumns({key: row_key("doc_id", "source", "text")[0], id_: F.col("doc_id")})
    rows = numbered_rows(rows, [key, id_], nth, hot, F.lit(0))
    both = rows.alias("r").join(taken.alias("t"), F.col(f"r.{key}").eqNullSafe(F.col(f"t.{key}")) & F.col(f"r.{id_}").eqNullSafe(F.col(f"t.{id_}")) & (F.col(f"r.{nth}") == F.col(f"t.{nth}")))
    both = both.select("r.*", f"t.{size}", f"t.{words}")
    passes = F.when(F.col(size) == 0, F.lit(1)).otherwise(F.ceil(F.col(words) / F.col(size)))
    both = both.where(passes > 0).withColumn(turn, F.explode(F.sequence(F.lit(1), passes.cast("int"))))
    left = F.col(words) - (F.col(turn) - 1) * F.col(size)
    cut = (F.col(size) > 0) & (left < F.col(size))
    text = F.when(cut, F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.greatest(left, F.lit(1)).cast("int")), " ")).otherwise(F.col("text"))
    out = [text.alias("text") if c == "text" else F.when(cut, F.length(text)).otherwise(F.col("n_chars")).cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return both.select(*out)
