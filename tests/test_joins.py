"""Joins by address and time against plain Python, with blocks so small that values are carried over many of them."""

import random

import pytest
from pyspark.sql import functions as F

from stackloom.operators import symbols as sym
from stackloom.sources import text


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(sym, "TOP_BITS", 2)
    monkeypatch.setattr(sym, "TIME_BITS", 4)


def floor(rows, at):
    below = [r for r in rows if r[0] <= at]
    return max(below)[1] if below else None


def test_floor_join_carries_over_blocks(spark, small_blocks):
    rng = random.Random(1)
    table = {(k, a): f"{k}-{a}" for k in ("x", "y") for a in rng.sample(range(5000), 12)}
    points = {(k, rng.randrange(5000)) for k in ("x", "y", "z") for _ in range(300)}
    found = sym.floor_join(spark.createDataFrame(sorted(points), "k string, p long"), spark.createDataFrame([(k, a, n) for (k, a), n in table.items()], "k string, a long, name string"), "p", "a", ["k"], block=8)
    got = {(r.k, r.p): r.name for r in found.collect()}
    assert got == {(k, p): floor([(a, n) for (j, a), n in table.items() if j == k], p) for k, p in points}


def test_kernel_addresses_are_unsigned(spark):
    high = 18446744071562067968
    symbols = spark.createDataFrame([("h", str(high + 16 * i), f"s{i}", i) for i in range(5)] + [("h", "64", "low", 9), ("h", str(high), "again", 7), ("g", "1", "other", 0)], "host string, addr string, sym string, line_no int").withColumn("addr", F.col("addr").cast(text.ADDRESS))
    ips = spark.createDataFrame([("h", str(high + 5)), ("h", "65"), ("h", "3"), ("g", str(high))], "host string, ip string").withColumn("ip", F.col("ip").cast(text.ADDRESS))
    got = {(r.host, int(r.ip)): r.symbol for r in sym.resolve(ips, symbols, ["host"]).collect()}
    assert got == {("h", high + 5): "again_[k]+5", ("h", 65): "low_[k]+1", ("h", 3): "0x3_[k]", ("g", high): f"other_[k]+{high - 1}"}


def test_resolve_at(spark, small_blocks):
    rng = random.Random(2)
    tables = {(h, t): {a * 10: f"{h}{t // 2 if h == 'b' else t}-{a}" for a in range(t % 3, 8)} for h in "ab" for t in (20, 21, 60, 200)}
    tables["b", 21] = tables["b", 20]
    rows = [(h, t, a, n) for (h, t), own in tables.items() for a, n in own.items()]
    points = {(rng.choice("abc"), rng.randrange(0, 300), rng.randrange(0, 100)) for _ in range(400)}
    got = {(r.host, r.at, r.ip): (r.valid_from, r.symbol) for r in sym.resolve_at(spark.createDataFrame(sorted(points), "host string, at long, ip long"), spark.createDataFrame(rows, "host string, taken long, addr long, sym string")).collect()}
    assert set(got) == points
    for h, t, ip in points:
        taken = [s for g, s in tables if g == h and s <= t]
        own = tables[h, max(taken)] if taken else {}
        below = [a for a in own if a <= ip]
        want = f"{own[max(below)]}_[k]+{ip - max(below)}" if below else f"0x{ip:x}_[k]"
        first = None if not taken else 20 if h == "b" and max(taken) == 21 else max(taken)
        assert got[h, t, ip] == (first, want)


def test_names_and_generations_of_a_busy_process(spark, small_blocks):
    rng = random.Random(3)
    at = F.timestamp_micros("us").alias("ts")
    samples = [(i, "h", rng.choice([1, 1, 1, 2]), rng.randrange(4000)) for i in range(600)]
    ends = [("h", 1, rng.randrange(4000)) for _ in range(40)] + [("h", 2, 100), ("g", 1, 5)]
    frame = spark.createDataFrame(samples, "sample_id long, host string, pid long, us long")
    got = {r.sample_id: r.generation for r in sym.generations(frame.withColumn("ts", at), spark.createDataFrame(ends, "host string, pid long, us long").withColumn("exit_ts", at)).collect()}
    assert got == {i: sum(e[:2] == (h, p) and e[2] < t for e in ends) for i, h, p, t in samples}
    names = {(h, p, t): None if t % 5 == 0 else f"n{t}" for h, p, t in ends}
    found = {(r.pid, r.at): r.comm for r in sym.process_names(frame.withColumn("at", F.col("us")), spark.createDataFrame([(*k, n) for k, n in names.items()], "host string, pid long, valid_from long, comm string")).collect()}
    for _, h, p, t in samples:
        before = [k for k in names if k[:2] == (h, p) and k[2] <= t]
        assert found[p, t] == ("<exit task>" if not before else names[max(before)] or "<err read comm>")


def test_off_cpu_of_a_busy_thread(spark, small_blocks):
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 1, 1, 2]), rng.randrange(3000), rng.choice(["in", "out"])) for i in range(500)]
    got = sorted(tuple(r) for r in sym.off_cpu(spark.createDataFrame(rows, "event_id long, tid long, us long, kind string").withColumn("ts", F.timestamp_micros("us"))).collect())
    want = []
    for tid in (1, 2):
        own = sorted((t, i, k) for i, x, t, k in rows if x == tid)
        want += [(i, tid, t - s) for (s, _, before), (t, i, k) in zip(own, own[1:]) if k == "in" and before == "out" and t > s]
    assert got == sorted(want)


def test_kallsyms_lines_have_numbers(spark, tmp_path):
    (tmp_path / "h1").mkdir()
    (tmp_path / "h1" / "kallsyms").write_text("10 T first\nnot a line\n10 t last\n20 T end\t[mod]\n")
    rows = text.read_kallsyms(spark, str(tmp_path))
    assert sorted((r.host, r.line_no, int(r.addr), r.sym) for r in rows.collect()) == [("h1", 0, 16, "first"), ("h1", 2, 16, "last"), ("h1", 3, 32, "end")]
    assert {int(r.addr): r.sym for r in sym.last_of_address(rows, ["host"]).collect()} == {16: "last", 32: "end"}


def test_few_length_classes_hold_all_lengths(spark):
    lengths = [*range(50), *[2**i - 1 for i in range(64)], *[2**i for i in range(63)]]
    rows = spark.createDataFrame([(0, n) for n in lengths], "first long, last long")
    found = {r["last"]: r.c for r in rows.select("last", sym.length_class(F.col("first"), F.col("last")).alias("c")).collect()}
    assert len({found[n] for n in range(50)}) == 2 and len(set(found.values())) <= 21
    assert all(n < 2**c <= 16 * max(n, 1) for n, c in found.items())
    random.seed(5)
    intervals = [(a := random.randrange(2000), a + random.choice([0, 3, 40, 700, 5000]), i) for i in range(200)]
    points = range(0, 8000, 7)
    got = sym.closed_interval_join(spark.createDataFrame([(p,) for p in points], "p long"), spark.createDataFrame(intervals, "first long, last long, map_id long"), "p")
    want = {p: min((b - a, a, i) for a, b, i in intervals if a <= p <= b) for p in points if any(a <= p <= b for a, b, _ in intervals)}
    assert {r.p: (r["last"] - r["first"], r["first"], r.map_id) for r in got.collect()} == want
