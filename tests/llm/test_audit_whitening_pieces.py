"""Filter audit, whitening and SentencePiece against brute force on small tables with nulls, odd values, ties and repeated rows."""

import hashlib
import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece

from stackloom.llm import filter_audit, pieces, queries, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = "part failed digest least n docs good toxic times state filter ids decoded whitened deviation".split()
DOCS = "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in CLASHES)


def audit_rows():
    rng = random.Random(3)
    texts = ["", None, "word " * 60, " ".join(f"w{i}" for i in range(70)), "UPPER " * 55, " ".join(f"W{i}" for i in range(60)), "a#b " + " ".join(f"x{i}" for i in range(50)), "# short", "\t\n", "é" * 30]
    rows = [(rng.choice([*range(60), None]), rng.choice(texts), rng.choice(["a", "b", "", None, "part"])) for _ in range(200)]
    rows += [(7, "word " * 60, "a")] * 3 + [(100 + i, "hot text", "b") for i in range(150)] + [(5000, "long " * 20000, "c")]
    return [r + tuple(range(len(CLASHES))) for r in rows]


def brute_audit(rows, labels):
    smallest = {}
    for d, t, *_ in rows:
        if d is not None:
            smallest[t or ""] = min(smallest.get(t or "", d), d)
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, x in labels if x == 1}
    judged = []
    for d, t, s, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > smallest[t]}
        judged.append((s or "", {f for f in fails if fails[f]}, d in good, d in toxic))
    out = {}
    for part in {p for p, *_ in judged}:
        own = [x for x in judged if x[0] == part]
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for key, row in out.items():
            if key[0] == part:
                row.append(total[key[1][key[2] - 1]])
    return out


@pytest.mark.parametrize("none_of", ["", "docs", "labels"])
def test_filter_audit(spark, none_of):
    rows = [] if none_of == "docs" else audit_rows()
    rng = random.Random(4)
    labels = [] if none_of == "labels" else [(rng.choice([*range(70), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    got = filter_audit.filter_audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    names = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in got} == brute_audit(rows, labels)
    assert len(got) == len({r.part for r in got}) * 600


def test_paths_are_counted():
    edges = filter_audit.lattice("ABCD")
    used = Counter((sum(1 << x for x in p[:k]), p[k]) for p in itertools.permutations(range(4)) for k in range(4))
    assert {(s, f): n for s, f, n in edges} == used


def test_filter_audit_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL["op11_filter_audit"])
    names = [x[0] for x in want.description]
    got = [tuple(r[n] for n in names) for r in queries.op11_filter_audit(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want.fetchall())


def vector_rows(kind="float"):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    rows = [(i, v) for i, v in enumerate(base.astype(np.float32 if kind == "float" else float).tolist())]
    rows += [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 5), (1003, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, [0.25] * 5), (1004, [1.0, 2.0]), (1005, []), (1006, [-0.0] * 5)]
    return rows + [rows[7]] * 40


def brute_whitening(rows, d):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v)]
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in kept]
    n, s = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[float(n * a - t) / n for a, t in zip(v, s)] for v in x])
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return [i for i, _ in kept], n, [sum((n * a - t) ** 2 for a, t in zip(v, s)) for v in x], centred @ columns[:, order] / np.sqrt(values[order]), values[order] / values.sum()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_whitening(spark, kind, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 128)
    rows = vector_rows(kind)
    frame = spark.createDataFrame([(*r, 1, 1) for r in rows], f"vec_id long, embedding array<{kind}>, whitened int, label int").repartition(3)
    result, fit = whitening.whiten(frame)
    got = sorted(result.collect(), key=lambda r: (r.vec_id is None, r.vec_id, r.deviation))
    ids, n, away, z, share = brute_whitening(rows, 5)
    order = sorted(range(n), key=lambda k: (ids[k] is None, ids[k], away[k]))
    assert [r.vec_id for r in got] == [ids[k] for k in order] and fit.n == n
    assert [int(r.deviation) for r in got] == [away[k] for k in order]
    ours, want = np.array([r.whitened for r in got]), z[order]
    assert np.allclose(ours, want * np.sign((ours * want).sum(axis=0)), atol=1e-8)
    assert np.allclose(fit.explained, share, rtol=1e-9)
    assert whitening.identity_error(result) < 1e-9
    few, _ = whitening.whiten(frame, components=2)
    assert {len(r.whitened) for r in few.collect()} == {2}


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, []), (2, [])]):
        result, fit = whitening.whiten(spark.createDataFrame(rows, schema))
        assert result.count() == 0 and fit.n == 0 and whitening.identity_error(result) == 0
    result, fit = whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0])] * 3, schema))
    assert [list(r.whitened) for r in result.collect()] == [[]] * 3 and whitening.identity_error(result) == 0
    flat, fit = whitening.whiten(spark.createDataFrame([(i, [i / 3, 2.0 * (i // 2), 7.0]) for i in range(50)], schema))
    assert {len(r.whitened) for r in flat.collect()} == {2} and whitening.identity_error(flat) < 1e-9


def test_scatter_is_exact():
    rng = random.Random(1)
    for size, n in ((40, 100), (1 << 20, 65), (1 << 52, 64)):
        rows = np.array([[rng.randint(-size, size) for _ in range(4)] + [3] for _ in range(n)])
        product, sums = whitening.cross_products(rows)
        exact = rows.astype(object)
        assert (product == exact.T @ exact).all() and (sums == exact.sum(axis=0)).all()
        s = exact.sum(axis=0)
        assert [int(v) for v in whitening.deviations(rows, n, s).to_pylist()] == ((n * exact - s) ** 2).sum(axis=1).tolist() if size < 1 << 40 else True


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary_path())


def odd_texts(library):
    rng = random.Random(5)
    vocabulary = [library.id_to_piece(i) for i in range(259, library.get_piece_size())]
    texts = [None, "", " ", "a" * 3000, " " * 5000 + "x", "�", "<s></s><unk> <0x41>", "▁" * 20, "word " * 20000, "x\0y", "ab" * 2000]
    for _ in range(3000):
        k = rng.choice([0, 1, 2, 5, 20, 80])
        texts.append(
            rng.choice(
                [
                    lambda: "".join(rng.choice("ab ") for _ in range(k)),
                    lambda: "".join(rng.choice(vocabulary) for _ in range(k)),
                    lambda: "".join(rng.choice("  \n\t▁aé漢😀\0<0x41>") for _ in range(k)),
                    lambda: "".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x370, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(k)),
                    lambda: "".join(rng.choice("aeiounrst") for _ in range(3 * k)),
                    lambda: " " * rng.randint(0, 70) + rng.choice(vocabulary) + " " * rng.randint(0, 40),
                ]
            )()
        )
    return texts


def test_pieces_are_the_librarys(spark, library):
    texts = odd_texts(library)
    rows = [(i, t, None) + tuple(range(len(CLASHES))) for i, t in enumerate(texts)] + [(None, "no id", None) + (0,) * len(CLASHES)] * 2
    both = pieces.decode(pieces.encode(spark.createDataFrame(rows, DOCS).repartition(3))).collect()
    assert len(both) == len(rows)
    assert [r.decoded for r in both if r.doc_id is None] == ["no id"] * 2
    for r in both:
        if r.doc_id is not None:
            want = library.encode(texts[r.doc_id] or "")
            assert r.ids == want and r.decoded == library.decode(want), repr(texts[r.doc_id])
    none = spark.createDataFrame([], DOCS)
    assert pieces.decode(pieces.encode(none)).count() == 0


def test_decode_of_any_ids(spark, library):
    rng = random.Random(6)
    lists = [[rng.choice([1, 2, 3 + 0xE2, 3 + 0x80, 3 + 0x41, 3 + 0xF0, 259, 260, rng.randrange(259, 32000)]) for _ in range(rng.randint(0, 12))] for _ in range(500)]
    got = pieces.decode(spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>")).collect()
    assert {r.doc_id: r.decoded for r in got} == {i: library.decode(x) for i, x in enumerate(lists)}


@pytest.mark.parametrize("seed", range(4))
def test_merges_follow_the_queue(seed, tmp_path):
    """Small vocabularies whose pieces score in any order, so that merges make better pairs, against the library."""
    from sentencepiece import sentencepiece_model_pb2

    rng = random.Random(seed)
    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces.vocabulary_path(), "rb") as f:
        model.ParseFromString(f.read())
    plain = {"".join(rng.choices("ab▁", k=rng.randint(2, 6))) for _ in range(25)} | {"a", "b", "▁", "ab", "▁▁"}
    del model.pieces[259:]
    for p in sorted(plain):
        model.pieces.add(piece=p, score=-rng.randint(1, 12), type=1)
    model.trainer_spec.vocab_size = len(model.pieces)
    path = str(tmp_path / "small.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Vocabulary(path)
    for _ in range(400):
        text = "".join(rng.choices("aab c", k=rng.randint(1, 40)))
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, first = own.encode(raw, np.array([0, len(raw)]))
        assert ids.tolist() == library.encode(text), text


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces.vocabulary_path(), "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    path = str(tmp_path / "other.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Vocabulary(path)


def test_queries(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op13_sentencepiece(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    rows = queries.op12_embedding_whitening(spark, sf_dir).collect()
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    ids, n, away, z, share = brute_whitening(vectors, 64)
    assert len(rows) == 32 * n and {r.n for r in rows} == {n}
    at = {i: k for k, i in enumerate(ids)}
    signs = np.sign([sum(r.whitened * z[at[r.vec_id], c] for r in rows if r.component == c + 1) for c in range(32)])
    for r in rows:
        assert r.deviation == away[at[r.vec_id]] and r.identity_error < 1e-4
        assert r.whitened == pytest.approx(z[at[r.vec_id], r.component - 1] * signs[r.component - 1], abs=1e-7) and r.explained == pytest.approx(share[r.component - 1], rel=1e-6)
