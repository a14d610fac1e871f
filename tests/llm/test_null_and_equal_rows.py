"""Rows that differ only in which value is null, and large numbers of equal rows."""

from collections import Counter

from pyspark.sql import functions as F

from stackloom.llm import filter_audit, license_scan, mixing, simhash, substring_dedup
from stackloom.llm.common import join_hot, row_key, stored

SCHEMA = "doc_id string, text string, source string"


def test_row_keys_tell_nulls_apart(spark):
    rows = [(None, "x", "s"), ("x", None, "s"), (None, None, "s"), ("x", "x", "s"), ("", None, "s"), (None, "", "s")]
    keys = spark.createDataFrame(rows, SCHEMA).select(*row_key("doc_id", "text")).collect()
    assert len(set(keys)) == len(rows)


def test_swapped_nulls_lose_nothing(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(None, "x", "s"), ("x", None, "s"), (None, long, "a"), (long, None, "b"), ("1", long + " end", "a"), ("2", "other words", None), ("other words", "2", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.one_of_each_group(docs).collect()
    assert len(kept) == len({r.root for r in simhash.simhash_components(docs).collect()})
    cut = substring_dedup.remove_repeats(docs).collect()
    assert Counter(r.doc_id for r in cut) == Counter(d for d, *_ in rows)
    assert {r.doc_id: r.n_removed for r in cut if r.doc_id in ("x", "1", "2")} == {"x": 0, "1": 80, "2": 0}
    assert len(mixing.mix(docs).collect()) == len(rows)
    swapped = spark.createDataFrame([("d", "b", "a"), ("d", "a", "b"), ("d", None, "a"), ("d", "a", None)], SCHEMA)
    assert len({r.key for r in mixing.mix(swapped).collect()}) == 4


def test_equal_rows_are_divided(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 500)
    rows = [("same", "one two three", "a")] * 20_000 + [(str(i), "word " * (i % 7), "a") for i in range(2000)] + [("z", "b " * 50, "b")] * 3
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(docs)
    got = out.collect()
    assert len(got) == len(rows) and sorted(got) == sorted(mixing.mix(docs.repartition(7)).collect())
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    for s in ("a", "b"):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) < 0.01 * own[0].target + 2
    sizes = Counter(r.taken for r in got if r.doc_id == "same")
    assert len(sizes) > 1  # some copies are taken more often than others, none is lost
    def mixed(limit):
        monkeypatch.setattr(mixing, "SAME_ROWS", limit)
        frame = docs.withColumn("n", F.monotonically_increasing_id() % 5).withColumn("at", F.lit(1))
        out = mixing.mixed_documents(frame.repartition(6))
        assert out.columns == frame.columns
        return Counter((r.doc_id, r.text, r.source) for r in out.collect())

    whole, parts = mixed(10**6), mixed(100)  # in one window, and over parts
    assert whole == parts
    assert sum(n * len((t or "").split()) for (_, t, _), n in parts.items()) == sum(r.taken for r in got)
    counts = filter_audit.failure_counts(docs, spark.createDataFrame([("same", 0, 1)], "doc_id string, quality int, toxic int")).collect()
    assert sum(r.docs for r in counts) == len(rows) and sum(r.toxic for r in counts) == 20_000


def test_hot_key_of_equal_rows_is_cut(spark):
    left = stored(spark.createDataFrame([(1, "x")] * 30_000 + [(k, "y") for k in range(2, 500)], "k long, v string").repartition(4), "left")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    joined = join_hot(left, right, ["k"], "n", left.count(), stored_left=True)
    assert joined.count() == left.count()
    parts = joined.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 0.6 * left.count()


def test_bands_are_not_capped(monkeypatch):
    import pytest

    monkeypatch.setattr(license_scan, "CONTAINED", 0.05)
    text = " ".join(f"w{i}" for i in range(200))
    with pytest.raises(ValueError):
        license_scan.Notices({"n": text}, 5, 256)
