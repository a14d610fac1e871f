"""Stores on disk: golden cases of the four files, both readers' views, and split."""

import pytest
import zstandard
from pyspark.sql import functions as F

from stackloom.functions.metadata import parse_metadata
from stackloom.operators import timeline
from stackloom.operators.dictionary import decode_stacks
from stackloom.sources import frames, store, text

META = f"{'comm':<15}{'group':<15}-0-0-42|pod-x"


def make(folder, records, strmap, idsmap, conf="cpu_num: 4\nfreq: 100\nrecord_interval: 1\n", frames=1):
    folder.mkdir(parents=True)
    (folder / "conf").write_text(conf)
    z = zstandard.ZstdCompressor()
    for name, lines in (("strmap", strmap), ("idsmap", idsmap)):
        (folder / name).write_bytes(b"".join(z.compress((l + "\n").encode()) for l in lines))
    raw = [store.record_bytes(*r) for r in records]
    (folder / "stack.bin").write_bytes(b"".join(z.compress(r) for r in raw) if frames else b"".join(raw))
    return str(folder)


@pytest.fixture(scope="module")
def minimal(tmp_path_factory):
    root = tmp_path_factory.mktemp("stores")
    make(root / "hosta" / "cpa_251216", [(1, 2, [(10, 100)]), (3, 4, [])], [f"{META} 1", "foo_[k] 2", "bar 3", "broken x"], ["1;2;3 10", "; 11", "1;2; 12"])
    make(root / "hosta" / "cpa_251216_start_123456", [(1, 2, [(10, 1)]), (3, 4, [])], [f"{META} 1"], ["1; 10"], frames=0)
    (root / "hosta" / "cpa_251217").mkdir()
    return str(root)


def test_discover(spark, minimal):
    rows = {r.store_id: str(r.created) for r in store.discover_stores(spark, minimal).collect()}
    assert rows == {"cpa_251216": "2025-12-16 00:00:00", "cpa_251216_start_123456": "2025-12-16 12:34:56"}


def test_conf(spark, tmp_path):
    path = make(tmp_path / "h" / "cpa_251216", [], [], [], conf="cpu_num: 8\nfreq: 99\nrecord_interval: 5\nfoo: bar: baz\nno colon\nfreq: x\nfreq: 98\n: empty\n")
    row = store.read_conf(spark, f"{path}/conf").first()
    assert (row.cpu_num, row.freq, row.record_interval, row.raw["foo"]) == (8, 98, 5, "bar: baz")
    assert [r.value for r in store.conf_lines(store.read_conf(spark, f"{path}/conf")).collect()] == ["cpu_num: 8", "freq: 98", "record_interval: 5"]


def test_dictionaries_and_records(spark, minimal):
    path = f"{minimal}/hosta/cpa_251216"
    strings, ids = store.read_strmap(spark, path), store.read_idsmap(spark, path)
    assert {(r.sid, r.str) for r in strings.collect()} == {(1, META), (2, "foo_[k]"), (3, "bar")}
    assert {(r.ids_id, tuple(r.sids)) for r in ids.collect()} == {(10, (1, 2, 3)), (12, (1, 2))}
    records, counts = store.read_stack_bin(spark, path)
    assert {(r.record_idx, r.start_ms, r.end_ms, r.entry_len) for r in records.collect()} == {(0, 1, 2, 1), (1, 3, 4, 0)}
    assert [(r.record_idx, r.ids_id, r["count"]) for r in counts.collect()] == [(0, 10, 100)]
    assert timeline.clean_records(records).count() == 1
    m = strings.where("sid = 1").select(parse_metadata(F.col("str")).alias("m")).first().m
    assert (m.pid, int(m.cgroup_id), m.env, m.comm, m.group_comm) == (42, 0, "pod-x", "comm", "group")
    decoded = decode_stacks(ids, strings.where("sid <> 3")).where("ids_id = 10").first()
    assert decoded.parts == [META, "foo_[k]", "<# STRMAP LOST ID #>"]


def test_data_source(spark, minimal):
    rows = frames.read_stores(spark, f"{minimal}/hosta/*").collect()
    assert {r.host for r in rows} == {"hosta"}
    assert {(r.store_id, r.ids_id, r["count"]) for r in rows} == {("cpa_251216", 10, 100), ("cpa_251216_start_123456", 10, 1)}


def test_cut_frame_and_bad_marks(spark, tmp_path):
    path = make(tmp_path / "h" / "cpa_251216", [(1, 2, [(10, 100)]), (2, 3, [(11, 5)])], ["a 1"], ["1; 10"])
    raw = (tmp_path / "h" / "cpa_251216" / "stack.bin").read_bytes()
    (tmp_path / "h" / "cpa_251216" / "stack.bin").write_bytes(raw[:-3])
    assert store.read_stack_bin(spark, path)[0].count() == 1
    (tmp_path / "h" / "cpa_251216" / "stack.bin").write_bytes(store.record_bytes(1, 2, [])[:-2] + b"xx")
    with pytest.raises(Exception, match="bad end mark"):
        store.read_stack_bin(spark, path)[0].count()
    (tmp_path / "h" / "cpa_251216" / "stack.bin").write_bytes(b"zz" * 20)
    assert store.read_stack_bin(spark, path)[0].count() == 0


def test_guards(spark):
    rows = [("s", 0, 1000, 2000, 1), ("s", 1, 2000, 2000, 0), ("s", 2, 2000, 3000, 1), ("s", 3, 3000, 4000, 0)]
    r = spark.createDataFrame(rows, "store_id string, record_idx int, start_ms long, end_ms long, entry_len long")
    assert {(x.start_ms, x.end_ms) for x in timeline.clean_records(r).collect()} == {(1000, 2000), (2000, 3000)}
    assert timeline.clean_records(r, "export").count() == 4


def test_empty_record_bytes():
    raw = store.record_bytes(5, 5, [])
    assert len(raw) == 28 and raw[-2:] == b"\xfc\xfd" and raw[18:26] == b"\0" * 8


def test_export_range_errors(spark):
    r = spark.createDataFrame([(0, 0, 10)], "record_idx int, start_ms long, end_ms long")
    for kwargs, says in ((dict(output_num=0), "output_num"), (dict(output_num=2), "not found enough records")):
        with pytest.raises(ValueError, match=says):
            timeline.select_export_range(r, None, None, **kwargs)
    with pytest.raises(ValueError, match="reversed"):
        timeline.select_export_range(r, 10_000, 5_000)
    with pytest.raises(ValueError, match="no valid records"):
        timeline.select_export_range(r.limit(0), None, None)
    across = spark.createDataFrame([(0, 86398000, 86399000), (1, 86400000, 86403000)], "record_idx int, start_ms long, end_ms long")
    assert timeline.select_export_range(across, None, None).count() == 2


def test_split(spark, tmp_path):
    path = make(tmp_path / "h" / "cpa_251216", [(0, 10, [(2, 3), (9, 1)])], ["known 1"], ["99;2; 2", "1; 3"])
    records, counts = store.read_stack_bin(spark, path)
    strings, ids, kept = store.split_store(records, counts, store.read_idsmap(spark, path), store.read_strmap(spark, path))
    assert [(r.sid, r.str) for r in strings.collect()] == [(1, "<# STRMAP LOST ID #>")]
    assert [(r.ids_id, r.sids) for r in ids.collect()] == [(1, [1, 1])]
    assert [(r.ids_id, r["count"]) for r in kept.collect()] == [(1, 3)]


def test_tables_round_trip(spark, minimal, tmp_path):
    records, counts = store.read_stack_bin(spark, f"{minimal}/hosta/cpa_251216")
    store.write_tables(store.read_strmap(spark, f"{minimal}/hosta/cpa_251216"), store.read_idsmap(spark, f"{minimal}/hosta/cpa_251216"), records, counts, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "stack_counts")).where("host = 'hosta'").count() == 1


def test_folded(spark, tmp_path):
    head = f"{'thread':<15}{'proc':<15}-1-2-3|ENV"
    lines = [f"{head};bad".encode() + b"\xa0symbol; 1", f"{head};<# IRQOFF SAMPLE ON CPU 2 #>;main;leaf; 1".encode(), f"{head};main;<# IRQOFF SAMPLE ON CPU 2 #>;leaf; 1".encode(), b"no count", f"{'<err read comm>'}{'':<15}-0-36--1|SYSTEM;frame_[k] 1".encode()]
    (tmp_path / "f").write_bytes(b"\n".join(lines) + b"\n")
    rows = text.read_folded(spark, str(tmp_path / "f")).collect()
    good = [r for r in rows if r._corrupt is None]
    assert len(good) == 3 and good[0].stack == ["bad�symbol"] and good[1].stack[0].startswith("<#")
    assert (good[2].meta.pid, good[2].meta.cpu, good[2].meta.group_comm) == (-1, 36, "")


def test_kallsyms_maps_callchain(spark):
    lines = spark.createDataFrame([("ffffffff81000000 T _stext",), ("bad",)], "value string")
    assert [(int(r.addr), r.sym) for r in text.parse_kallsyms(lines).collect()] == [(0xFFFFFFFF81000000, "_stext")]
    maps = spark.createDataFrame([(1, "00400000-00452000 r-xp 00000000 08:02 1 /bin/a"), (2, "00452000-00453000 rw-p 0 0 0")], "line_no int, value string")
    assert [(int(r.start), int(r.stop), r.path) for r in text.parse_proc_maps(maps).collect()] == [(0x400000, 0x452000, "/bin/a")]
    ips = spark.createDataFrame([([str(x) for x in (text.KERNEL_CONTEXT, 2**64 - 5, text.USER_CONTEXT, 7, 8)],)], "ips array<string>").select(F.col("ips").cast("array<decimal(20,0)>").alias("ips"))
    row = ips.select(text.split_callchain(F.col("ips"), 1).alias("c")).first().c
    assert [int(x) for x in row.kernel] == [2**64 - 5] and [int(x) for x in row.user] == [7]


def test_addresses_above_64_bits(spark):
    lines = spark.createDataFrame([("10000000000001000 T over",), ("0000000000000000ffffffff81000000 t zeros",), ("0 T zero",), ("ffffffffffffffff T top",), ("f" * 40 + " T huge",)], "value string")
    assert {r.sym: int(r.addr) for r in text.parse_kallsyms(lines).collect()} == {"over": 2**64 + 0x1000, "zeros": 0xFFFFFFFF81000000, "zero": 0, "top": 2**64 - 1}


def test_listing_goes_past_64_bits(spark, tmp_path):
    """Keys as large tables have them: the twin's numbers go on above 2^64."""
    import duckdb

    from stackloom.plans import catalog

    spark.range(3).selectExpr("524286 + id as p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    got = catalog.QUERIES["s14_read_kallsyms"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(con.execute(catalog.ORACLES["s14_read_kallsyms"]).fetchall())


def test_files_are_read_once_and_in_parts(spark, tmp_path):
    """Lines go on over the parts a file is read in; the tables stay when the files have gone."""
    import shutil

    from stackloom.sources import store

    folder = tmp_path / "h" / "cpa_240101"
    folder.mkdir(parents=True)
    names = [f"näme_{i}_{'x' * (i % 60)}" for i in range(40_000)]
    (folder / "conf").write_text("freq: 49\n")
    (folder / "strmap").write_bytes("".join(f"{n} {i}{'\r' if i % 3 == 0 else ''}\n" for i, n in enumerate(names)).encode().removesuffix(b"\n"))
    (folder / "idsmap").write_text("1;2; 1\n3; 2")
    (folder / "stack.bin").write_bytes(store.record_bytes(0, 5, [(1, 7)]))
    s = store.load_stores(spark, str(tmp_path))
    shutil.rmtree(tmp_path / "h")
    assert {r.sid: r.str for r in s.strmap.collect()} == dict(enumerate(names))
    assert {r.ids_id: list(r.sids) for r in s.idsmap.collect()} == {1: [1, 2], 2: [3]}


def test_each_store_has_a_task_to_write(spark, tmp_path):
    """Few bytes in many stores: the smallest file is not written by one task for all."""
    from stackloom.sources import store

    keys = "host string, store_id string, "
    ids = [("h", f"cpa_2401{i:02d}") for i in range(1, 25)]
    conf = spark.createDataFrame([(*k, "49") for k in ids], keys + "f string").groupBy("host", "store_id").agg(F.max("f").alias("f")).select("host", "store_id", F.create_map(F.lit("freq"), "f").alias("raw"))
    tables = [spark.createDataFrame([(*k, *row) for k in ids], keys + kinds) for row, kinds in (((1, "a"), "sid int, str string"), ((1, [1]), "ids_id int, sids array<int>"), ((0, 0, 5, 1), "record_idx int, start_ms long, end_ms long, entry_len long"), ((0, 1, 7), "record_idx int, ids_id int, count long"))]
    spark.sparkContext.setJobGroup("writing", "stores")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        store.write_stores(store.Stores(conf, *tables), str(tmp_path / "out"), zstd=False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    tracker, stages = spark.sparkContext.statusTracker(), []
    for job in tracker.getJobIdsForGroup("writing"):
        stages += [tracker.getStageInfo(i) for i in tracker.getJobInfo(job).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sum(1 for x in stages if x and x.numTasks == 7) >= 4  # all four kinds of files
    assert len(list((tmp_path / "out").glob("h/*/[!.]*"))) == 4 * len(ids)
