"""Stores on file systems that only Spark opens, cut files, ranges by an index, followed folders, and tables that take each interval once."""

import random
import threading
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from stackloom.sources import frames, store, tables

KEYS = ["host", "store_id"]


def records_of(seed=1, n=400):
    rng = random.Random(seed)
    return [(i * 1000, i * 1000 + 1000, sorted((k, rng.randint(1, 9)) for k in rng.sample(range(1, 500), rng.randint(0, 40)))) for i in range(n)]


def put(folder, records, packed, strings=((1, "frame one"), (2, "b")), per_frame=7, tail=b""):
    folder.mkdir(parents=True, exist_ok=True)
    z = zstandard.ZstdCompressor()
    raw = [store.record_bytes(*r) for r in records]
    joined = [b"".join(raw[i : i + per_frame]) for i in range(0, len(raw), per_frame)]
    (folder / "stack.bin").write_bytes(b"".join(z.compress(x) if packed else x for x in joined) + tail)
    (folder / "conf").write_text("cpu_num: 4\n")
    for name, lines in (("strmap", [f"{s} {k}\n" for k, s in strings]), ("idsmap", ["1;2; 10\n", "2; 11\n"])):
        (folder / name).write_bytes(b"".join(z.compress(x.encode()) if packed else x.encode() for x in lines))


def entries(records):
    return sorted((i, a, b, k, n) for i, (a, b, own) in enumerate(records) for k, n in own)


def loaded(spark, path):
    records, counts = store.read_stack_bin(spark, path)
    both = counts.join(records, [*KEYS, "record_idx"])
    return sorted((r.record_idx, r.start_ms, r.end_ms, r.ids_id, r["count"]) for r in both.collect()), records.count()


@pytest.fixture()
def small_splits(spark, monkeypatch):
    monkeypatch.setattr(store, "SPLIT_BYTES", 64)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("packed", [False, True])
def test_large_files_are_cut(spark, tmp_path, small_splits, packed):
    records = records_of()
    strings = [(k, f"name {k}") for k in range(1, 900)] + [(5, "later")]
    put(tmp_path / "h" / "cpa_251216", records, packed, strings)
    rows, odd = store._pieced(spark, [f"file:{tmp_path}/h/cpa_251216/stack.bin"], packed)
    assert not odd and rows.rdd.getNumPartitions() > 1
    assert loaded(spark, str(tmp_path)) == (entries(records), len(records))
    names = {r.sid: r.str for r in store.read_strmap(spark, str(tmp_path)).collect()}
    assert names == dict(strings)
    assert {(r.ids_id, tuple(r.sids)) for r in store.read_idsmap(spark, str(tmp_path)).collect()} == {(10, (1, 2)), (11, (2,))}


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("case", ["cut", "mark inside", "bad head", "straddling", "empty"])
def test_odd_files_are_read_as_a_whole(spark, tmp_path, small_splits, packed, case):
    records = records_of(2, 60)
    mark = int.from_bytes(store.FOOT + store.HEAD, "little")
    want, tail = records, b""
    if case == "cut":
        tail = store.record_bytes(1, 2, [(3, 4)] * 9)[:50]
        tail = zstandard.ZstdCompressor().compress(tail) if packed else tail
    if case == "mark inside":
        records[30] = (records[30][0], records[30][1], [(7, mark), (8, int.from_bytes(store.ZSTD, "little"))])
    if case == "bad head":
        tail = b"zz" * 30 + store.record_bytes(1, 2, [])
        tail = zstandard.ZstdCompressor().compress(tail) if packed else tail
    if case == "empty":
        want = records = []
        tail = b"no record here" * 9
    put(tmp_path / "h" / "cpa_251216", records, packed, tail=tail)
    if case == "straddling":
        raw = b"".join(store.record_bytes(*r) for r in records)
        z = zstandard.ZstdCompressor()
        (tmp_path / "h" / "cpa_251216" / "stack.bin").write_bytes(b"".join(z.compress(raw[i : i + 333]) if packed else raw[i : i + 333] for i in range(0, len(raw), 333)))
    rows, n = loaded(spark, str(tmp_path))
    assert (rows, n) == (entries(want), len(want))


@pytest.mark.parametrize("packed", [False, True])
def test_hosts_of_any_name(spark, tmp_path, small_splits, packed):
    names = ["h 1=x+y", "h%41", "h[2]", "h{3}", "é"]
    records = records_of(9, 30)
    mark = int.from_bytes(store.FOOT + store.HEAD, "little")
    for i, name in enumerate(names):  # every second file cannot be cut
        own = [*records, (40_000, 41_000, [(1, mark), (2, int.from_bytes(store.ZSTD, "little"))])] if i % 2 else records
        put(tmp_path / "s" / name / "cpa_251216", own, packed)
    whole = store.load_stores(spark, f"{tmp_path}/s")
    assert sorted(r.host for r in whole.conf.collect()) == sorted(names)
    for df in (whole.strmap, whole.idsmap, whole.records):
        assert sorted(r.host for r in df.select("host").distinct().collect()) == sorted(names)
    assert {r.host: r["count"] for r in whole.records.groupBy("host").count().collect()} == {n: 30 + i % 2 for i, n in enumerate(names)}


def made(spark, records, hosts=("h1", "h 2=x")):
    keys = [(h, s) for h in hosts for s in ("cpa_251216", "cpa_251217")]
    conf = spark.createDataFrame([(*k, {"cpu_num": "8", "freq": "49"}) for k in keys], "host string, store_id string, raw map<string,string>")
    strmap = spark.createDataFrame([(*k, i, f"str{i};\t{k[1]} é") for k in keys for i in range(1, 2500)], "host string, store_id string, sid int, str string")
    idsmap = spark.createDataFrame([(*k, i, [i, i + 1, 1]) for k in keys for i in range(1, 300)], "host string, store_id string, ids_id int, sids array<int>")
    rows = spark.createDataFrame([(*k, i, a, b, len(e)) for k in keys for i, (a, b, e) in enumerate(records)], "host string, store_id string, record_idx int, start_ms long, end_ms long, entry_len long")
    counts = spark.createDataFrame([(*k, i, x, n) for k in keys for i, (_, _, e) in enumerate(records) for x, n in e], "host string, store_id string, record_idx int, ids_id int, count long")
    return store.Stores(conf, strmap, idsmap, rows, counts)


def tables_of(stores):
    return [sorted(map(str, df.select(*sorted(df.columns)).collect())) for df in (stores.strmap, stores.idsmap, stores.records, stores.counts)]


@pytest.mark.parametrize("packed", [False, True])
def test_round_trip_where_only_spark_can_open(spark, tmp_path, packed):
    conf = spark._jsc.hadoopConfiguration()
    name = f"store{packed}".lower()
    conf.set(f"fs.viewfs.mounttable.{name}.link./data", f"file://{tmp_path}")
    whole = made(spark, records_of(3, 150))
    for _ in range(2):  # written again, files are replaced
        store.write_stores(whole, f"viewfs://{name}/data/stores", packed)
    assert sorted(p.name for p in (tmp_path / "stores").iterdir()) == ["h 2=x", "h1"]
    back = store.load_stores(spark, f"viewfs://{name}/data/stores")
    assert tables_of(back) == tables_of(whole)
    assert {(r.cpu_num, r.freq) for r in back.conf.collect()} == {(8, 49)}
    raw = (tmp_path / "stores" / "h1" / "cpa_251216" / "stack.bin").read_bytes()
    assert (raw[:4] == store.ZSTD) == packed
    data = store.plain(open(tmp_path / "stores" / "h1" / "cpa_251216" / "stack.bin", "rb")).read()
    assert data == b"".join(store.record_bytes(*r) for r in records_of(3, 150))
    with pytest.raises(Exception, match="cannot open"):
        frames.read_stores(spark, f"viewfs://{name}/data/stores").count()


def test_packed_and_plain_hosts_are_written_at_once(spark, tmp_path):
    whole = made(spark, records_of(3, 20))
    keys = whole.conf.select("host", "store_id").distinct().collect()
    first = (F.col("host") == keys[0].host) & (F.col("store_id") == keys[0].store_id)
    store.write_stores(whole, f"{tmp_path}/both", first)
    for chosen, zstd in ((first, True), (~first, False)):
        part = store.Stores(*[df.where(chosen) for df in (whole.conf, whole.strmap, whole.idsmap, whole.records, whole.counts)])
        store.write_stores(part, f"{tmp_path}/one", zstd)
    found = {p.relative_to(tmp_path / "both"): p.read_bytes() for p in (tmp_path / "both").rglob("*") if p.name in store.FILES}
    assert len(found) == 4 * len(keys) > 4 and found == {p.relative_to(tmp_path / "one"): p.read_bytes() for p in (tmp_path / "one").rglob("*") if p.name in store.FILES}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    whole = made(spark, records_of(3, 20))
    broken = whole.counts.withColumn("count", F.when(F.col("record_idx") < 15, F.col("count")).otherwise(F.raise_error("lost").cast("long")))
    with pytest.raises(Exception, match="lost"):
        store.write_stores(store.Stores(whole.conf, whole.strmap, whole.idsmap, whole.records, broken), f"{tmp_path}/out")
    assert [p for p in (tmp_path / "out").rglob("*") if p.is_file()] == []


def test_index_prunes_and_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(frames, "TASK_BYTES", 3000)
    monkeypatch.setattr(frames, "CHUNK_BYTES", 2000)
    records = records_of(4)
    for host, packed in (("a", True), ("b", False)):
        put(tmp_path / "s" / host / "cpa_251216", records, packed)
    frames.write_index(spark, f"{tmp_path}/s", f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index").collect()
    assert Counter(r.host for r in index for _ in range(r.records)) == {"a": 400, "b": 400}
    for path in (None, f"{tmp_path}/index"):
        rows = frames.read_stores(spark, f"{tmp_path}/s", path)
        got = sorted((r.host, r.record_idx, r.start_ms, r.end_ms, r.ids_id, r["count"]) for r in rows.collect())
        assert got == sorted((h, *e) for h in "ab" for e in entries(records))
        part = rows.where("host = 'a' and start_ms >= 100000 and end_ms <= 120000")
        assert sorted((r.record_idx, r.ids_id) for r in part.collect()) == [(e[0], e[3]) for e in entries(records) if 100 <= e[0] < 120]
    assert len(frames.StoreReader(f"{tmp_path}/s", f"{tmp_path}/index").partitions()) > 10
    # What a filter leaves to read.
    reader = frames.StoreReader(f"{tmp_path}/s", f"{tmp_path}/index")
    list(reader.pushFilters([frames.EqualTo(("host",), "a"), frames.GreaterThanOrEqual(("start_ms",), 100_000), frames.LessThanOrEqual(("end_ms",), 120_000)]))
    chunks = [c for p in reader.partitions() for c in p.value[1]]
    assert 3 <= len(chunks) <= 5 < len(index) / 10


def test_small_files_share_tasks(spark, tmp_path):
    records = records_of(4, 6)
    for i in range(60):
        put(tmp_path / "s" / f"h{i % 3}" / f"cpa_2512{i // 3 + 1:02}", records, i % 2 == 0)
    assert spark.dataSource.register(frames.FrameIndex) is None
    index = spark.read.format("profile_frames").option("tasks", 7).load(f"{tmp_path}/s")
    assert index.rdd.getNumPartitions() <= 8 and index.select("path").distinct().count() == 60
    frames.write_index(spark, f"{tmp_path}/s", f"{tmp_path}/index")
    for at in (None, f"{tmp_path}/index"):
        rows = frames.read_stores(spark, f"{tmp_path}/s", at)
        assert rows.rdd.getNumPartitions() <= 5
        assert sorted((r.record_idx, r.start_ms, r.end_ms, r.ids_id, r["count"]) for r in rows.collect()) == sorted(e for e in entries(records) for _ in range(60))
    big = frames.grouped([("a", 10), ("b", frames.TASK_BYTES), ("c", frames.TASK_BYTES), ("d", 10), ("e", 10)], 1)
    assert big == [["a"], ["b"], ["c"], ["d", "e"]] and frames.grouped([], 4) == [[]]


@pytest.mark.parametrize("packed", [False, True])
def test_stream_follows_growing_stores(spark, tmp_path, packed):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    records = records_of(5, 120)
    folder, late = tmp_path / "s" / "h" / "cpa_251216", tmp_path / "s" / "h" / "cpa_251217"
    put(folder, [], packed)
    z = zstandard.ZstdCompressor()
    raw = b"".join((z.compress if packed else bytes)(b"".join(store.record_bytes(*r) for r in records[i : i + 10])) for i in range(0, 120, 10))

    def run():
        stream = frames.tail_stores(spark, f"{tmp_path}/s")
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
        query.processAllAvailable()
        query.stop()

    for share in (0.3, 0.31, 0.8, 1.0):  # cut in the middle of frames and records
        (folder / "stack.bin").write_bytes(raw[: int(len(raw) * share)])
        run()
    put(late, records[:20], packed)
    run()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.record_idx, r.start_ms, r.end_ms, r.ids_id, r["count"]) for r in got if r.store_id == "cpa_251216") == entries(records)
    assert sorted((r.record_idx, r.ids_id) for r in got if r.store_id == "cpa_251217") == [(e[0], e[3]) for e in entries(records[:20])]


def test_guarded_stream_waits(tmp_path):
    records = records_of(6, 20)
    done = [*records[:10], (10_000, 10_000, []), *records[10:]]
    put(tmp_path / "s" / "h" / "cpa_251216", done, False, per_frame=1)
    open_, guarded = frames.StoreTail(f"{tmp_path}/s").latestOffset(), frames.StoreTail(f"{tmp_path}/s", True)
    assert [v.split()[1] for v in open_["stores"].values()] == ["21"]
    assert [v.split()[1] for v in guarded.latestOffset()["stores"].values()] == ["11"]
    put(tmp_path / "p" / "h" / "cpa_251216", done, True, per_frame=11)
    assert [v.split()[1] for v in frames.StoreTail(f"{tmp_path}/p", True).latestOffset()["stores"].values()] == ["11"]


def buckets(spark, rows):
    return spark.createDataFrame(rows, "host string, store_id string, start_ms long, end_ms long, meta string, frames array<string>, count long")


def decoded(spark, path):
    whole = tables.read_tables(spark, path)
    strings = {(r.host, r.store_id, r.sid): r.str for r in whole.strmap.collect()}
    stacks = {(r.host, r.store_id, r.ids_id): tuple(strings[r.host, r.store_id, k] for k in r.sids) for r in whole.idsmap.collect()}
    spans = {(r.host, r.store_id, r.record_idx): (r.start_ms, r.end_ms) for r in whole.records.collect()}
    assert len(spans) == whole.records.count() and len(strings) == whole.strmap.count() and len(stacks) == whole.idsmap.count()
    return Counter((r.host, r.store_id, *spans[r.host, r.store_id, r.record_idx], stacks[r.host, r.store_id, r.ids_id], r["count"]) for r in whole.counts.collect())


def test_intervals_are_stored_once(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    rows = [(h, f"cpa_2512{d}", t * 1000, t * 1000 + 1000, f"m{rng.randint(1, 3)}", ["main", f"f{rng.randint(1, 6)}"][: rng.randint(0, 2)], 1) for h in ("a", "b") for d in (16, 17) for t in range(6) for _ in range(5)]
    feed, out = f"{tmp_path}/feed", f"{tmp_path}/tables"
    move, moved = tables.move, []

    def failing(ledger, at, target):
        moved.append(target)
        if len(moved) in (7, 30):
            raise OSError("killed")
        move(ledger, at, target)

    monkeypatch.setattr(tables, "move", failing)
    failures = 0
    for i in range(3):
        buckets(spark, [r for r in rows if r[2] // 2000 == i]).coalesce(1).write.mode("append").parquet(feed)
        while True:
            stream = spark.readStream.schema(buckets(spark, []).schema).parquet(feed)
            query = stream.writeStream.foreachBatch(tables.interval_sink(out)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
            try:
                query.awaitTermination()
                break
            except Exception as e:
                assert "killed" in str(e)
                failures += 1
                seen = decoded(spark, out) if i else None  # what is half there is not seen
                assert seen is None or {r[2] // 2000 for r in seen} == set(range(i))
    assert failures == 2
    sums = Counter()
    for h, s, a, b, m, f, n in rows:
        sums[h, s, a, b, (m, *f)] += n
    assert decoded(spark, out) == Counter((*k, n) for k, n in sums.items())
    assert not tables.commit(spark, out, "stream_0", {})
    # Only the partitions of the batch's own day are compared.
    plan = tables.stored_rows(spark, out, "strmap", ["2025-12-16"], spark.createDataFrame([("a",)], "host string"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in text and "2025-12-16" in text
    assert {r.store_id for r in plan.collect()} == {"cpa_251216"}


def test_shared_frames_are_looked_up_once(spark, tmp_path, monkeypatch):
    written, keep = {}, tables.stored

    def watched(df, name):
        held = written[name] = keep(df, name)
        return held

    monkeypatch.setattr(tables, "stored", watched)
    rows = [("a", "cpa_251216", t * 1000, t * 1000 + 1000, f"m{m}", f, m + 1) for t in range(2) for m in range(50) for f in ([], ["main"], ["main", "f", "main"])]
    for i in range(2):
        tables.interval_sink(f"{tmp_path}/t")(buckets(spark, [r for r in rows if r[2] == i * 1000]), i)
        assert written["interval-lists"].count() == 3  # of 150 stacks
    assert decoded(spark, f"{tmp_path}/t") == Counter((h, s, a, b, (m, *f), n) for h, s, a, b, m, f, n in rows)
    whole = tables.read_tables(spark, f"{tmp_path}/t")
    assert whole.idsmap.count() == 150 and whole.strmap.count() == 52  # the second interval brings nothing new


def test_stored_rows_are_not_dealt_by_host(spark, tmp_path, monkeypatch):
    keep, plans = tables.stored_rows, []

    def watched(*args):
        rows = keep(*args)
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows

    monkeypatch.setattr(tables, "stored_rows", watched)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "4000")  # between the size of the batch and that of its hosts
    try:
        for i in range(2):
            tables.interval_sink(f"{tmp_path}/t")(buckets(spark, [(f"h{m % 2}", "cpa_251216", i * 1000, i * 1000 + 1000, f"meta {m * 7919}", ["main"], 1) for m in range(3000)]), i)
    finally:
        spark.conf.set(key, before)
    assert len(plans) == 6 and all("BroadcastHashJoin" in p for p in plans[3:])
    assert sum(decoded(spark, f"{tmp_path}/t").values()) == 6000


def test_files_are_renamed_several_at_a_time(spark, tmp_path, monkeypatch):
    move, both = tables.move, threading.Barrier(2)

    def waiting(ledger, at, target):
        both.wait(20)  # fails unless two are under way
        move(ledger, at, target)

    monkeypatch.setattr(tables, "move", waiting)
    rows = [("a", f"cpa_2512{d}", 0, 1000, "m", ["main"], 1) for d in (16, 17)]
    tables.interval_sink(f"{tmp_path}/t")(buckets(spark, rows).coalesce(1), 0)
    assert sum(decoded(spark, f"{tmp_path}/t").values()) == 2


def test_many_days_are_listed_by_few_tasks(spark, tmp_path):
    days = 40  # more than a driver lists by itself
    tables.interval_sink(f"{tmp_path}/t")(buckets(spark, [("a", f"cpa_25{1 + d // 28:02}{1 + d % 28:02}", 0, 1000, "m", ["main"], 1) for d in range(days)]), 0)
    key, group = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "listing-of-days"
    before, status = spark.conf.get(key), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group, group)
    try:
        rows = tables.read_table(spark, f"{tmp_path}/t", "records")
        stages = [status.getStageInfo(i) for j in status.getJobIdsForGroup(group) for i in status.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [s.numTasks for s in stages] == [4 * spark.sparkContext.defaultParallelism]
    assert spark.conf.get(key) == before and rows.count() == days


def test_shared_lists_decode_alike(spark):
    from stackloom.operators import dictionary

    rng = random.Random(9)
    stacks = [("a", s, i, [rng.randint(1, 9) for _ in range(rng.randint(1, 4))]) for s in "xy" for i in range(60)]
    encoded = spark.createDataFrame(stacks, "host string, store_id string, ids_id int, sids array<int>")
    strings = spark.createDataFrame([("a", s, i, f"{s}{i}") for s in "xy" for i in range(1, 8)], "host string, store_id string, sid int, str string")  # 8 and 9 are lost
    plain = {(r.store_id, r.ids_id): r.parts for r in dictionary.decode_stacks(encoded, strings).collect()}
    shared = dictionary.decode_shared(encoded, strings).collect()
    assert len(shared) == 120 and {(r.store_id, r.ids_id): r.parts for r in shared} == plain


def test_ids_do_not_change(spark):
    from stackloom.operators.dictionary import merge_ids

    rng = random.Random(8)
    held = spark.createDataFrame([], "host string, str string, sid int")
    seen: dict = {}
    for _ in range(3):
        new = [(h, f"s{rng.randint(1, 30)}") for h in "ab" for _ in range(12)]
        merged = merge_ids(spark.createDataFrame(new, "host string, str string"), held, "str", "sid", ["host"]).collect()
        assert {(r.host, r.str) for r in merged} == set(new) and all(r.is_new == ((r.host, r.str) not in seen) for r in merged)
        assert all(seen.get((r.host, r.str), r.sid) == r.sid for r in merged)
        seen |= {(r.host, r.str): r.sid for r in merged}
        held = spark.createDataFrame([(*k, v) for k, v in seen.items()], "host string, str string, sid int")
        for h in "ab":
            assert sorted(v for k, v in seen.items() if k[0] == h) == list(range(1, 1 + sum(k[0] == h for k in seen)))


def test_frame_ends_are_those_of_the_library():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    parts = [zstandard.ZstdCompressor(level=1, write_checksum=c, write_content_size=s).compress(rng.integers(0, 4, n, np.uint8).tobytes()) for c in (0, 1) for s in (0, 1) for n in (0, 1, 300, 70_000, 400_000)]
    stream = zstandard.ZstdCompressor().compressobj()
    parts.append(stream.compress(b"ab" * 200_000) + stream.flush())
    parts.insert(3, store.SKIPPED + b"\n")
    data = b"".join(parts)
    assert list(frames.frame_ends(pa.BufferReader(data), 0, len(data))) == np.cumsum(list(map(len, parts))).tolist()
    assert list(frames.frame_ends(pa.BufferReader(data[:-5]), 0, len(data) - 5)) == np.cumsum(list(map(len, parts)))[:-1].tolist()
