"""Golden values of functions, windows and the bucket wheel."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stackloom.functions import cpuset, frames, itanium, metadata, timefmt
from stackloom.operators import dictionary, filters, history, timeline


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


#: Symbols and their names without function parameters, as a public demangler shows them (checked values).
NAMES = {
    "_ZZN3fooEvENKUlvE_clEv": "foo()::{lambda()#1}::operator()",
    "_ZN1AcviEv": "A::operator int",
    "_ZTV3foo": "vtable for foo",
    "_ZThn8_N3fooD1Ev": "non-virtual thunk to foo::~foo()",
    "_ZN3foo3barEi.isra.0": "foo::bar",
    "_Z1fIiEvT_": "f<int>",
    "_ZStlsISt11char_traitsIcEERSt13basic_ostreamIcT_ES5_PKc": "std::operator<< <std::char_traits<char> >",
    "_Z1fDTplfp_fp_E": "f",
    "_ZN1AcvT_IiEEv": "A::operator int<int>",
    "_ZGVZ4mainE1x": "guard variable for main::x",
    "_ZNKSt6vectorIiSaIiEE4sizeEv": "std::vector<int, std::allocator<int> >::size",
    "_ZN3fooIXadL_Z3barvEEE3bazEv": "foo<&(bar())>::baz",
    "_ZN12_GLOBAL__N_13fooEv": "(anonymous namespace)::foo",
    "_ZZN3fooEiENUt_C1Ev": "foo(int)::{unnamed type#1}::foo",
    "_ZZN1A1fEiENKUlT_E_clIiEEDaS1_": "A::f(int)::{lambda(auto:1)#1}::operator()<int>",
    "_ZGTtNSt11logic_errorC1EPKc": "transaction clone for std::logic_error::logic_error(char const*)",
    "_ZTSFN1AEPS_RKS_E": "typeinfo name for A (A*, A const&)",
    "_ZTIPFvRA3_iE": "typeinfo for void (*)(int (&) [3])",
    "_ZTIM1AKFivE": "typeinfo for int (A::*)() const",
    "_ZNSsC1Ev": "std::basic_string<char, std::char_traits<char>, std::allocator<char> >::basic_string",
    "_ZNSs4findEc": "std::string::find",
}


def test_names_of_the_abi():
    for symbol, name in NAMES.items():
        assert itanium.name_of(symbol) == name, symbol
    for odd in ("", "_Z", "_ZXX", "plain", "_ZN", "_ZNE", "_Z99x", "_ZS5_", "_ZN1AIE", "_ZT"):
        assert itanium.name_of(odd) is None, odd


@pytest.mark.parametrize("deep", ["_Z1fI" + "A_" * 10_000 + "iEvv", "_Z1fI" + "Dp" * 10_000 + "iEvv", "_Z1f" + "I" * 10_000, "_ZN" + "1aI" * 10_000 + "E", "_Z1fIX" + "nt" * 10_000 + "Lb1EEEvv", "_Z" + "Z1fv" * 10_000, "_ZTI" + "P" * 10_000 + "i", "_Z1fI" + "F" * 10_000 + "vE" * 10_000])
def test_deep_names_stay(deep):
    assert frames.demangle_name(deep) == deep


def test_deep_pointers_are_not_walked(monkeypatch):
    asked, plain = [], itanium.Reader.type
    monkeypatch.setattr(itanium.Reader, "type", lambda self: asked.append(1) or plain(self))
    assert frames.demangle_name(deep := "_Z1fI" + "PRO" * 1000 + "iEvv") == deep and len(asked) < 10
    assert frames.demangle_name("_ZTI" + "P" * 1900 + "i") == "typeinfo for int" + "*" * 1900


def test_names_are_made_by_many_tasks(spark):
    symbols = spark.createDataFrame([(i, f"_ZN2ns3f{i:02}Ev") for i in range(40)] + [(40, None)], "id int, symbol string").coalesce(1)
    found = dictionary.demangled(symbols, "symbol", "name")
    assert found.columns == ["id", "name"] and found.rdd.getNumPartitions() >= 4
    assert {r.id: r.name for r in found.collect()} == {i: f"ns::f{i:02}" for i in range(40)} | {40: None}


def test_names_of_a_library():
    """Every symbol of the C++ library against the system's demangler, where both are there."""
    import glob
    import shutil
    import subprocess

    found = glob.glob("/usr/lib/*/libstdc++.so.6")
    if not found or not shutil.which("c++filt") or not shutil.which("nm"):
        pytest.skip("no library or no demangler")
    lines = subprocess.run(["nm", "-D", found[0]], capture_output=True, text=True).stdout.splitlines()
    symbols = sorted({line.split()[-1].split("@")[0] for line in lines if "_Z" in line})
    shown = subprocess.run(["c++filt", "-p", "-i"], input="\n".join(symbols) + "\n", capture_output=True, text=True).stdout.split("\n")
    wrong = [s for s, name in zip(symbols, shown) if (itanium.name_of(s) or s) != name]
    assert len(symbols) > 1000 and not wrong, wrong[:5]


def test_cpu_set(spark):
    assert cpuset.parse_cpu_set("0-2, 7,9-8") == {0, 1, 2, 7, 8, 9}
    assert cpuset.parse_cpu_set("9-8,x", swap=False) == set() and cpuset.parse_cpu_set("all") is None
    assert one(spark, cpuset.cpu_set(F.lit("0-2, 7,9-8"))) == [0, 1, 2, 7, 8, 9]


def test_times(spark):
    assert [timefmt.parse_time_ms(t) for t in ("00:00:01", "1:02:03.4", "02:03")] == [1000, 3723400, 123000]
    assert timefmt.parse_range("00:00:01..00:00:02") == timefmt.parse_range("00:00:02 00:00:01") == (1000, 2000)
    for bad in ("bad-format", ""):
        with pytest.raises(ValueError):
            timefmt.parse_time_ms(bad)
    with pytest.raises(ValueError, match="invalid time"):
        timefmt.parse_time_ms("02:03", strict=True)
    assert one(spark, timefmt.time_ms(F.lit("1:02:03.45678"))) == 3723456
    assert one(spark, timefmt.format_ms(F.lit(86403000))) == "24:00:03.000"
    assert one(spark, timefmt.format_unit(F.lit(1536), timefmt.BYTE_UNITS, 1024)) == "1.50KB"


def test_templates_and_names(spark):
    cases = {"foo<int>(double)": "foo(double)", "std::vector<int, std::allocator<int> >": "std::vector", "operator<<": "operator<<", "operator>": "operator>"}
    cases |= {"a<" * 30 + ">" * 30 + "b": "ab", "a<" * 30 + ">" * 29: "a<" * 30 + ">" * 29, "f<a>(b<c>>": "f<a>(b<c>>"}
    for raw, want in cases.items():
        assert one(spark, frames.strip_templates(F.lit(raw))) == want
    assert frames.strip_plain("a<b>c>d") == "ac>d"
    assert frames.demangle_name("_ZN3foo3barEi+12") == "foo::bar+12"
    assert frames.demangle_name("_ZNSt3mapIiN2ns3fooESt4lessIiEEixERS1_") == "std::map::operator[]"
    assert frames.demangle_name("plain") == "plain" and frames.demangle_name("_ZXX") == "_ZXX"


def test_frames(spark):
    assert one(spark, frames.collapse_hex(F.lit("0x56d20 [libc.so.6]"))) == "<...> [libc.so.6]"
    assert one(spark, frames.collapse_irqoff(F.lit("<# IRQOFF SAMPLE ON CPU 47 #>"))) == "<# IRQOFF SAMPLE ON CPU <...> #>"
    assert one(spark, frames.hex_to_binary(F.lit("0g"))) is None


def test_metadata(spark):
    raw = f"{'abc':<15}{'xyz':<15}-1-2-3|pod-A|b"
    m = one(spark, metadata.parse_metadata(F.lit(raw)))
    assert (m.comm, m.group_comm, int(m.cgroup_id), m.cpu, m.pid, m.env) == ("abc", "xyz", 1, 2, 3, "pod-A|b")
    assert not one(spark, metadata.parse_metadata(F.lit("short")))["ok"]
    assert one(spark, metadata.select_env(F.lit("A=1"), [])) == "SYSTEM"


def test_filter_commands():
    f = filters.ViewerFilter().set("pid 4").set("cpuv 0-1")
    assert [k for k, _ in f.tests] == ["pid", "cpuv"] and f.unset("pid").tests == [("cpuv", [0, 1])]
    for bad in ("pid", "nope 3", ""):
        with pytest.raises(ValueError):
            f.set(bad)


def test_windows():
    assert timeline.shift_window(10, 20, 0, 25, True) == (15, 25)
    assert timeline.shift_window(10, 20, 0, 25, False) == (0, 10)
    assert timeline.chart_bounds(900, 0, 1000, 600) == (400, 1000)
    assert timeline.chart_bounds(0, 0, 100, 600) == (0, 100)


WHEEL = "host string, record_ms long, stack string, cnt long"


def emitted_in_turns(spark, turns):
    from stackloom.plans.stream import in_turns

    return in_turns(spark, [spark.createDataFrame([("h", *r) for r in rows], WHEEL) for rows in turns])


def test_wheel(spark):
    """Late samples go to the oldest open second; clock rows flush, a control row flushes all."""
    turns = [[(1000, "1", 3), (2000, "2", 4), (11_000, None, None)], [(12_000, None, None)], [(1500, "1", 5), (2500, "2", 7)], [(13_000, None, None)], [(4000, "1", 9)], [(None, None, None)]]
    rows = emitted_in_turns(spark, turns)
    found = {}
    for r in rows.where("stack is not null").collect():
        found.setdefault((r.batch, r.start_ms, r.end_ms), {})[r.stack] = r["count"]
    assert found == {(2, 1000, 2000): {"1": 3}, (4, 2000, 3000): {"1": 5, "2": 11}, (6, 4000, 5000): {"1": 9}}
    from stackloom.streaming.buckets import wheel_statistics

    last = wheel_statistics(rows).first()
    assert (last.clamped, last.flushed, last.pending, last.pending_weight) == (5, 3, 0, 0)


def test_closed_seconds_do_not_meet_the_state(monkeypatch):
    """Many unordered rows of a host in parts against a plain loop: only what stays open is put, and sums cross blocks."""
    import pandas as pd

    from stackloom.streaming import buckets

    class Held:
        def __init__(self):
            self.own, self.touched = {}, 0

        def iterator(self):
            return iter([(k, v) for k, v in self.own.items()])

        def containsKey(self, k):
            self.touched += 1
            return k in self.own

        def getValue(self, k):
            self.touched += 1
            return self.own[k]

        def updateValue(self, k, v):
            self.touched += 1
            self.own[k] = v

        def removeKey(self, k):
            self.touched += 1
            del self.own[k]

    class Marks:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, v):
            self.held = v

    monkeypatch.setattr(buckets, "SUM_ROWS", 300, raising=False)
    monkeypatch.setattr(buckets, "BLOCK_BITS", 5, raising=False)
    rng, processor = random.Random(11), buckets.ClampingProcessor()
    processor.counts, processor.marks = Held(), Marks()
    open_, oldest, top, clamped, flushed = {}, 0, 0, 0, 0
    for turn in range(3):
        rows = [(rng.randrange(turn * 900_000, 1_000_000 + turn * 1_000_000), rng.choice("abc"), rng.randint(1, 3)) for _ in range(4000)]
        parts = [pd.DataFrame({"host": "h", "record_ms": [r[0] for r in p], "stack": [r[1] for r in p], "cnt": [r[2] for r in p]}) for p in (rows[i : i + 170] for i in range(0, len(rows), 170))]
        before, processor.counts.touched = len(open_), 0
        out = pd.concat(list(processor.handleInputRows(("h",), iter(parts), None)))
        for ms, stack, n in rows:
            top, clamped = max(top, ms), clamped + (n if ms // 1000 < oldest else 0)
            at = (max(ms // 1000, oldest), stack)
            open_[at] = open_.get(at, 0) + n
        limit = top // 1000 - 10
        closed = {at: n for at, n in open_.items() if at[0] < limit}
        open_, oldest, flushed = {at: n for at, n in open_.items() if at[0] >= limit}, max(oldest, limit), flushed + len({at[0] for at in closed})
        found = out[out["stack"].notna()]
        assert {(int(s) // 1000, x): int(n) for s, x, n in zip(found["start_ms"], found["stack"], found["count"])} == closed and len(found) == len(closed)
        last = out[out["stack"].isna()].iloc[0]
        assert (last.clamped, last.flushed, last.pending, last.pending_weight, last.batch) == (clamped, flushed, len({at[0] for at in open_}), sum(open_.values()), turn + 1)
        assert {at: v[0] for at, v in processor.counts.own.items()} == open_
        assert processor.counts.touched <= before + len(open_) < len(closed) / 10


def test_idle_host_is_flushed(spark, tmp_path):
    """With no more input, the wall clock goes on: it stands at six seconds when the samples come."""
    import time

    from stackloom.streaming import buckets

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", buckets.ROCKSDB)
    spark.createDataFrame([("h", 5000, "a", 2), ("h", 6000, "b", 1)], WHEEL).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = buckets.clamped_counts(spark.readStream.schema(WHEEL).parquet(str(tmp_path / "in")), tick_ms=500, hold_s=1, clock_offset_ms=int(time.time() * 1000) - 6000)
    running = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            if running.exception():
                raise running.exception()
            done = running.lastProgress and spark.read.schema(buckets.OUT_SCHEMA).parquet(str(tmp_path / "out")).where("stack = 'b'").count()
            if done:
                break
    finally:
        running.stop()
    rows = spark.read.schema(buckets.OUT_SCHEMA).parquet(str(tmp_path / "out")).where("stack is not null").collect()
    assert {(r.start_ms, r.stack, r["count"]) for r in rows} == {(5000, "a", 2), (6000, "b", 1)}


def test_observed_metrics_are_the_states_rows(spark):
    from stackloom.plans.stream import in_turns
    from stackloom.streaming import buckets

    rng = random.Random(5)
    parts = [spark.createDataFrame([(rng.choice("ab"), rng.randrange(t * 9000, t * 9000 + 12000), rng.choice("xy"), rng.randint(1, 4)) for _ in range(80)], WHEEL).coalesce(1) for t in range(3)]
    listener = buckets.MetricsListener()
    spark.streams.addListener(listener)
    rows = in_turns(spark, parts, listener).collect()
    spark.streams.removeListener(listener)
    held = [r for r in listener.stored(spark).orderBy("batch").collect() if r.batches]
    assert len(held) == 3
    for r, batch in zip(held, (1, 2, 3)):
        own = [x for x in rows if x.batch == batch]
        closed, state = [x for x in own if x.stack is not None], [x for x in own if x.stack is None]
        assert (r.buckets, r.weight, r.batches) == (len(closed), sum(x["count"] for x in closed), len(state))
        assert (r.pending, r.pending_weight) == (sum(x.pending for x in state), sum(x.pending_weight for x in state))


def test_pairs_of_a_busy_key_in_chunks(monkeypatch):
    """Rows of one key in unordered parts against a plain loop, with the state carried over batches."""
    from stackloom.streaming import pairing

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, v):
            self.held = v

        def clear(self):
            self.held = None

    monkeypatch.setattr(pairing, "CHUNK_ROWS", 7)
    rng = random.Random(6)
    ticks = [(i, t, rng.random() < 0.2) for i, t in enumerate(sorted(rng.sample(range(10_000), 90)))]
    gaps, off = pairing.GapProcessor(40), pairing.OffCpuProcessor()
    gaps.last, off.out = Value(), Value()
    found, blocked = [], []
    for begin in (0, 31, 60):
        own = rng.sample(ticks[begin : begin + (31, 29, 30)[(0, 31, 60).index(begin)]], k=(31, 29, 30)[(0, 31, 60).index(begin)])
        frames = [pd.DataFrame(own[i : i + 11], columns=["tick_id", "ts_us", "throttled"]) for i in range(0, len(own), 11)]
        for part in gaps.handleInputRows(("h", 0), iter(frames), None):
            found += part.itertuples(index=False, name=None)
        for part in off.handleInputRows(("h", 5), iter([f.rename(columns={"tick_id": "event_id", "throttled": "is_out"}) for f in frames]), None):
            blocked += part.itertuples(index=False, name=None)
    last, want, began, pairs = None, [], None, []
    for i, t, flag in ticks:
        if flag:
            last, began = None, t
            continue
        if last is not None and (t - last) * 10 > 11 * 40:
            want.append((i, "h", 0, t - last - 40))
        last = t
        if began is not None and t > began:
            pairs.append((i, 5, t - began))
        began = None
    assert found == want and blocked == pairs


def test_history(spark):
    days = spark.createDataFrame([(f"cpa_2512{d}",) for d in range(16, 25)], "name string").withColumn("day", F.to_date(history.store_time(F.col("name"))))
    plan = history.retention_plan(days, "day", F.to_date(F.lit("2025-12-24")), 7)
    assert [r.name for r in plan.where("expired").collect()] == ["cpa_251216"]
    at = F.to_timestamp(F.lit("2025-12-16 12:34:56"))
    assert one(spark, history.store_name(at, at, F.lit(True))) == "cpa_251216_start_123456"
    assert one(spark, history.store_name(at, at, F.lit(False))) == "cpa_251216"
    assert history.new_store_quota(500, 700, 7) == 100
