"""URL filters: allow and block rules on hosts and path prefixes, by hashed expressions.

A rule ``(host, path, action)`` fits a url whose host is the rule's host or a subdomain of
it and whose path starts with the rule's path. Each distinct (host, path) is expanded into
host-suffix + path-prefix expressions. These meet the rules on a short hash prefix; the
full digests then confirm the match and the longest rule wins.

Defined cases: a null url, or one without ``://``, has an empty host and path and gets the
default action; rules of one length: the longer host wins (two of one length and host are the
same rule); the same rule with both actions blocks; repeated urls are judged once and joined back; no rows give
no rows. Columns of ``pages`` beyond the named ones are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm.common import join_hot, stored

#: The rules of the standard query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest that the join uses.
PREFIX_DIGITS = 8
#: Rules whose rows, of ``ROW_BYTES`` and up to four bytes a character, stay below this go to all executors.
SENT_BYTES, ROW_BYTES = 64 << 20, 300


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for h, p, a in rules]
    return spark.range(1).select(F.inline(F.array(*rows))) if rows else spark.range(0).select(*[F.lit("").alias(c) for c in ("host", "path", "action")])


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/``, ``?``, ``#``; path then up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def host_suffixes(host: Column, most: int) -> Column:
    """``host`` and its parent domains of at most ``most`` labels (the most that any rule has)."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.least(n, F.lit(most))), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))


def path_prefixes(path: Column, longest: int, odd: list[int]) -> Column:
    """Prefixes that end with ``/``, the empty one, and those of the lengths ``odd`` of rules that do not end with ``/``; none longer than the ``longest`` rule path."""
    head = F.substring(path, 1, longest)
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(head))), lambda i: F.substring(head, i, F.lit(1)) == "/")
    lengths = F.array_distinct(F.concat(F.array(F.lit(0)), ends, F.filter(F.array(*map(F.lit, odd)) if odd else F.array().cast("array<int>"), lambda n: n <= F.length(path))))
    return F.transform(lengths, lambda n: F.substring(path, F.lit(1), n))


def fitting(expressions: DataFrame, keyed: DataFrame, sent: bool) -> DataFrame:
    """``host, path, ranked`` of every rule that one of the place's ``expressions(host, path, digest, short)`` names.

    Rules that are not ``sent`` meet each distinct expression once. Those that name a rule then
    go to their places by :func:`join_hot`, as a top-level domain stands in a large share of them.
    """
    if sent:
        return expressions.join(F.broadcast(keyed), "short").where("digest = rule_digest").select("host", "path", "ranked")
    counted = stored(expressions.groupBy("digest", "short").agg(F.count("*").alias("places")), "url-expressions")
    named = counted.join(keyed, "short").where("digest = rule_digest").select("digest", "ranked", "places")
    total = counted.agg(F.sum("places")).first()[0] or 0
    return join_hot(expressions.select("host", "path", "digest"), stored(named, "url-named"), ["digest"], "places", total).select("host", "path", "ranked")


def url_filter(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``pages`` columns ``page_id, url`` plus ``host, path, rule, verdict`` (rule: the winning rule's text, else null)."""
    bounds = rules.agg(
        F.coalesce(F.sum(F.lit(ROW_BYTES) + 4 * F.length(F.concat("host", "path"))), F.lit(0)).alias("bytes"),
        F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0)).alias("labels"),
        F.coalesce(F.max(F.length("path")), F.lit(0)).alias("longest"),
        F.sort_array(F.collect_set(F.when(~F.col("path").endswith("/") & (F.col("path") != ""), F.length("path")))).alias("odd"),
    ).first()
    host, path = url_parts(F.col(url))
    judged = pages.select("page_id", F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    if not bounds.labels:
        return judged.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    # Urls without a host meet no rule; of the others each (host, path) is judged once.
    places = stored(judged.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("urls")), "url-places")
    expressions = places.select(
        "host", "path", F.explode(host_suffixes(F.col("host"), bounds.labels)).alias("h"), path_prefixes(F.col("path"), bounds.longest, bounds.odd).alias("ps")
    )
    expressions = expressions.select("host", "path", F.explode(F.transform("ps", lambda p: F.concat("h", F.lit("\t"), p))).alias("expression"))
    digest = F.sha2("expression", 256)
    expressions = expressions.select("host", "path", digest.alias("digest")).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    keyed = rules.withColumn("expression", F.concat("host", F.lit("\t"), "path")).select(
        digest.alias("rule_digest"),
        F.substring(digest, 1, PREFIX_DIGITS).alias("short"),
        F.struct(F.length(F.concat("host", "path")).alias("length"), F.length("host").alias("host_length"), (F.col("action") == "block").alias("block"), F.concat("host", "path").alias("rule"), F.col("action")).alias("ranked"),
    )
    keyed = keyed.groupBy("short", "rule_digest").agg(F.max("ranked").alias("ranked"))  # a rule may be listed many times
    best = fitting(expressions, keyed, bounds.bytes <= sent_bytes).groupBy("host", "path").agg(F.max("ranked").alias("best"))
    ruled = stored(places.join(best, ["host", "path"], "left"), "url-ruled")
    named = join_hot(judged.where("host <> ''"), ruled, ["host", "path"], "urls", ruled.agg(F.sum("urls")).first()[0] or 0)
    named = named.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
    return named.unionByName(judged.where("host = ''").select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))
