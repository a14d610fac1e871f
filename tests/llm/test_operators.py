"""The ten operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stackloom.llm import embedding_dedup, html_extract, license_scan, mixing, packing, quality, queries, simhash, substring_dedup, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that operators use themselves under these names.
CLASHES = "score key n_words fp taken other k1 k2 first n id nth pass size toxicity words removed root group _group component_id".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHES)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [rng.choice("abcdefghij") * rng.randint(1, 3) + str(rng.randint(0, 300)) for _ in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=70))
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 40, 200, 900])))
        if i % 7 == 0:
            text += "\n" + passage[: rng.randint(150, len(passage))] + "\t" + text[:40]
        if i % 11 == 0 and rows:
            text = rows[i // 2][1]
        rows.append((i, text, "en", rng.choice(["b", "a", None, "Z"]), len(text or "")))
    rows += [(1000, None, None, None, None), (1001, "", "en", "a", 0), (1002, " \n\t ", "en", "a", 4), (None, passage, "en", "a", 1)]
    rows += [(1003, "word " * 5000, "en", "b", 25000), rows[8], rows[8]]
    return [r + tuple(range(len(CLASHES))) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORD.findall(text or "")


def key(row):
    return tuple((x is None, 0 if x is None else x) for x in row)


def test_url_filter(spark):
    urls = ["http://WWW.Example.COM/en/x?y", "https://example.com/en/", "http://notexample.com/en/", "x://a.net/es/q#z", "x://net/fr/", "x://net/fr", "no scheme", None, "http://a.com", "http://com/", "http://b.example.com/en", "://", "http://a.b.www.example.com/en/p/q/r?en/"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls + urls)], "page_id long, url string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, url_filter.rules_table(spark)).collect()}
    for i, u in enumerate(urls + urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(h + p), h + p, a) for h, p, a in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else (0, None, "allow")
        assert got[i] == (host, path, best[1], best[2]), u
    odd = url_filter.rules_table(spark, [("a.net", "/e", "block"), ("net", "", "block"), ("net", "", "allow")])
    assert [r.rule for r in url_filter.url_filter(pages.where("page_id in (3, 4)"), odd).orderBy("page_id").collect()] == ["a.net/e", "net"]
    assert url_filter.url_filter(pages.limit(0), odd).count() == 0
    assert {r.verdict for r in url_filter.url_filter(pages, url_filter.rules_table(spark, [])).collect()} == {"allow"}


def test_url_filter_with_many_rules(spark, sf_dir):
    """Rules that are too large to be sent are joined by distinct expression, with a domain that most places share and rules listed twice."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages = pages.unionByName(spark.range(5000).select(F.col("id").alias("page_id"), F.format_string("http://h%d.com/en/%d/x", F.col("id") % 50, F.col("id")).alias("url")), allowMissingColumns=True)
    listed = url_filter.RULES + [("com", "/", "allow"), ("com", "/", "block")] + [(f"h{i}.com", f"/en/{i + 50 * k}/", "allow") for i in range(50) for k in range(20)]
    rules = spark.createDataFrame(listed, "host string, path string, action string")
    sent, joined = [sorted(url_filter.url_filter(pages, rules, sent_bytes=n).collect(), key=str) for n in (1 << 30, -1)]
    assert joined == sent and len(joined) == pages.count()
    assert {r.rule for r in joined} >= {"com/", "h3.com/en/53/"}
    assert {r.verdict for r in joined if r.rule == "com/"} == {"block"}


def brute_license(text, notices):
    """Places of notices from every window, without MinHash."""
    w = [x for x in re.split("[\\x00-/:-@\\[-`{-\\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    out = []
    for name, notice in notices.items():
        t = [x for x in re.split("[\\x00-/:-@\\[-`{-\\x7f]+", notice.lower()) if x]
        width = min(5, len(t))
        template = {tuple(t[i : i + width]) for i in range(len(t) - width + 1)}
        size = 1
        while size < len(t) - width + 1:
            size *= 2
        block, blocks = (1, size) if size <= 2 else (size // 2, 3)
        shingles = [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]
        spans = []
        for a in range(0, len(shingles), block):
            inside = [i for i in range(a, min(a + block * blocks, len(shingles))) if shingles[i] in template]
            share = len({shingles[i] for i in inside}) / len(template)
            if share >= 0.8:
                spans.append((inside[0], inside[-1] + width, share))
        out += [(name, *p) for p in license_scan.joined(spans)]
    return sorted(out)


def test_license_scan(docs, none):
    from stackloom.llm.notices import NOTICES

    rng = random.Random(12)
    filler = [rng.choice("abcdefghij") * 3 + str(rng.randint(0, 50)) for _ in range(300)]

    def edited(name, share):
        return " ".join(x if rng.random() > share else rng.choice(filler) for x in NOTICES[name].split())

    texts = ["x y " * 30 + "Released under  the MIT\nLicense! " + "z " * 40 + NOTICES["gpl-notice"].upper() + " All rights reserved", "Released under the BSD License.", "All Rights, reserved.", None, ""]
    texts += ["a " * 9 + NOTICES["mit-permission"].replace("free of charge, ", "")]
    texts += [" ".join(rng.choices(filler, k=rng.randint(0, 700))) + " " + edited(name, share) + " " + " ".join(rng.choices(filler, k=rng.randint(0, 300))) for name in NOTICES for share in (0, 0.01, 0.03, 0.2)]
    texts += [(NOTICES["mit"] + "\n") * 40, "word " * 30_000 + NOTICES["bsd-3-clause"]]
    rows = [(i if i % 9 else None, t, "clash") for i, t in enumerate(texts)] + [(1, texts[0], "clash")]
    got = license_scan.license_scan(docs.sparkSession.createDataFrame(rows, "doc_id long, text string, notice string")).collect()
    want = [(i, *p) for i, t, _ in rows for p in brute_license(t, NOTICES)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert len(want) > 80 and {"mit", "bsd-3-clause", "gpl-3.0-line"} <= {w[1] for w in want}
    place = [r for r in got if r.notice == "mit-line"][0]
    assert (place.start_word, place.end_word, place.containment) == (60, 65, 1.0)
    assert ("mit-permission", 9) not in {(r.notice, r.start_word) for r in got if r.doc_id == 5}  # 4 of 25 shingles lost in the middle and at its cut
    whole = license_scan.license_scan(docs).collect()
    assert sorted(map(tuple, whole), key=key) == sorted([(r.doc_id, *p) for r in docs.collect() for p in brute_license(r.text, NOTICES)], key=key)
    assert license_scan.license_scan(none).count() == 0
    assert license_scan.license_scan(docs, {}).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    odd = docs.sparkSession.createDataFrame([(7, "It's the café, <|endoftext|>no! ﬁne ÀÉ 12a\u00a0b x\u0308y 漢字 don't--stop"), (8, None), (8, "é" * 300)], "doc_id long, text string")
    some = docs.select("doc_id", "text").union(odd)
    got = queries.digested(packing.token_pieces(some))
    rows = packing.pack(got).collect()
    want = []
    for r in some.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want.append((r.doc_id, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted([tuple(r)[:5] for r in rows], key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:i]) for i, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= 2048
    assert len(by) <= sum(r.length for r in rows) / 2048 * 1.1 + 1
    assert packing.pack(queries.digested(packing.token_pieces(none))).count() == 0


def test_sequences(docs):
    packed = packing.pack(packing.token_pieces(docs.where("doc_id < 20").select("doc_id", "text")))
    for r in packing.sequences(packed).collect():
        assert len(r.ids) == 4 * r.length


def targets(rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and left * weight[s] / w > 2 * sizes[s]}
        if not over:
            return sizes, {s: 2.0 * sizes[s] if s in capped else left * weight[s] / w for s in order}
        capped |= over


def test_mixing(docs, none):
    sizes, want = targets(corpus())
    rows = mixing.mix(docs).collect()
    assert sorted((tuple(r) for r in rows), key=key) == sorted((tuple(r) for r in mixing.mix(docs.repartition(3)).collect()), key=key)
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(rows) == docs.count()
    for s in want:
        assert taken[s] == pytest.approx(want[s], rel=0.01, abs=2)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_sainte_lague(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.choice([0.0, rng.random(), rng.random() * 50]), 40 + g) for g in range(3) for i in range(12)]
    got = mixing.sainte_lague(spark.createDataFrame(rows, "g int, i int, w double, seats long"), ["g"], [F.col("i")], "w", "seats").collect()
    for g in range(3):
        w = {i: x for a, i, x, _ in rows if a == g}
        quota = Counter()
        for _ in range(40 + g):
            quota[max(w, key=lambda i: (w[i] / (2 * quota[i] + 1), -i))] += 1
        assert {r.i: r.quota for r in got if r.g == g} == {i: quota[i] for i in w}


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><nav><ul><li>menu</ul></nav>
<div class="cookie-notice">cookies</div><article><h1>Head &amp; line</h1><p><b>One<br>two <p>three&nbsp; <i>four</i></b> &copy;</p><ul><li>a<li>b</ul><div class="share">tweet</div><form>x</form>
<section id="comments"><p>first!</p></section></article><aside>side</aside><footer>foot</footer></body></html>"""


def test_html(spark):
    rows = [(1, "http://a.com/x", PAGE), (2, None, None), (3, "http://a.com/y", ""), (4, "http://a.com/z", "plain & text"), (5, "http://a.com/z", "<p>cut <b>off &am"), (1, "http://a.com/x", PAGE)]
    rows += [(10 + i, "http://b.org/", f"<html><body><div class='top'>Same everywhere</div><div class='story'><p>Own text {i}</p></div></body></html>") for i in range(12)]
    got = {r.page_id: r.text for r in html_extract.html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Head & line\n\nOne two\n\nthree four ©\n\na\n\nb"
    assert got[2] == got[3] == "" and got[4] == "plain & text" and got[5] == "cut off &am"
    assert all(got[10 + i] == f"Own text {i}" for i in range(12))
    assert html_extract.html_extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_tree_decides(spark):
    """Repeated plain text in an article goes, own blocks outside one stay, copies of a page are no repetition."""
    page = "<body><div class=lead>{0}</div><div class=top>Every page</div><article><h1>Title {1}</h1><p>Own {1}</p><ul><li>Item {1}</li><li>Read more</li></ul><p>Follow us</p></article></body>"
    rows = [(i, "http://a.org/", page.format(f"Lead {i}", i)) for i in range(12)]
    rows += [(100 + i, "http://b.org/", page.format("Lead", 0)) for i in range(12)]
    rows += [(200 + i, "http://c.org/", page.format(f"Lead {i}", i)) for i in range(3)]
    got = {r.page_id: r.text for r in html_extract.html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Lead {i}\n\nTitle {i}\n\nOwn {i}\n\nItem {i}" for i in range(12))
    assert all(got[100 + i] == "Title 0\n\nOwn 0\n\nItem 0\n\nRead more\n\nFollow us" for i in range(12))
    assert all(got[200 + i] == f"Title {i}\n\nOwn {i}\n\nItem {i}\n\nRead more\n\nFollow us" for i in range(3))


def brute_importance(pages, declared=html_extract.DECLARED):
    """Importance of each style and repeated content node of (host, html) pages, in plain Python."""
    shown, texts, facts = defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set)), {}
    groups = defaultdict(dict)  # of each heading the main content nodes of its different pages
    for host, page in pages:
        found, styles, heading, own = html_extract.read_page(page or "", host)
        groups[heading][own] = {t[2] for t in found if not styles.get(t[1], (0, True, True))[1] and not styles.get(t[1], (0, True, True))[2]}
    near = {}
    for heading, own in groups.items():
        k = Counter(c for main in own.values() for c in main)
        near[heading] = len(own) < 2 or not k or sum(n for n in k.values() if 2 * n > len(own)) / sum(k.values()) >= 0.5
    for host, page in pages:
        found, styles, heading, own = html_extract.read_page(page or "", host)
        which = heading if heading is not None and near[heading] else own
        for style, (children, noise, outside) in styles.items():
            shown[style][children].add(which)
            facts[style] = noise, outside
        for _, style, content, _ in found:
            texts[style][content].add(which)
    out = {}
    for style, (noise, outside) in facts.items():
        m = len(set().union(*shown[style].values()))
        factor, expected = declared if noise else 1.0, 0.0 if outside else 1.0

        def judged(measured):
            return factor * (html_extract.EXPECTED * expected + m * measured) / (html_extract.EXPECTED + m)

        share = lambda k: 1 - math.log(k) / math.log(m) if m > 1 else 1.0
        every = [share(len(p)) for p in texts[style].values() for _ in p]
        content = sum(every) / len(every)
        sizes = [len(p) for p in shown[style].values()]
        entropy = -sum(k / sum(sizes) * math.log(k / sum(sizes), m) for k in sizes) if m > 1 else 1.0
        weight = html_extract.G ** len(sizes)
        out[style] = judged((1 - weight) * entropy + weight * content)
        out |= {c: judged(share(len(p))) for c, p in texts[style].items() if len(p) > 1}
    return out


def test_html_importance_is_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    odd = spark.createDataFrame([(-1 - i, f"http://a.org/{i}", f"<div class=top>Every page</div><div class=x><p>a{i % 4}<p>b{i}</div><footer>foot {i}</footer>" * (i % 3)) for i in range(20)] + [(-50, None, "<p>x"), (-51, "http://a.org", None)], "page_id long, url string, html string")
    both = pages.unionByName(odd)
    hosted = [(r.host, r.html) for r in both.select(url_filter.url_parts(F.col("url"))[0].alias("host"), "html").collect()]
    want = brute_importance(hosted)
    got = {r.node: r.importance for r in html_extract.importances(html_extract.read_pages(both)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    low = {k for k, v in want.items() if v < html_extract.LEAST}
    rows = {(r.page_id, r.text) for r in html_extract.html_extract(both).collect()}
    brute = {(r.page_id, html_extract.joined_texts([dict(zip(("block", "style", "content", "text"), t)) for t in html_extract.read_page(r.html or "", h)[0]], low)) for r, (h, _) in zip(both.collect(), hosted)}
    assert rows == brute
    assert {(r.page_id, r.text) for r in html_extract.html_extract(both, sent=0).collect()} == brute  # nodes joined to pages, not sent
    # Without the tree's decisions every page keeps more, and the given pages have their article alone.
    everything = {(r.page_id, html_extract.joined_texts([dict(zip(("block", "style", "content", "text"), t)) for t in html_extract.read_page(r.html or "", None)[0]], set())) for r in both.collect()}
    assert all(t not in everything for t in brute if t[0] >= 0)
    article = {r.page_id: re.search("<article>(.*?)</article>", r.html, re.S)[1] for r in pages.collect()}
    for i, text in rows:
        if i in article:
            assert "".join(text.split()) == "".join(html.unescape(re.sub("<[^>]*>", "", article[i])).split())


def test_html_pages_of_one_heading(spark):
    """Articles under a common title are different pages; near copies of one article are one."""
    page = "<body><main><h1>Daily news</h1><p>Own {0}</p><p>More of {0}</p><p>And {0}</p><p>Subscribe today</p></main></body>"
    rows = [(i, "http://a.org/", page.format(i)) for i in range(60)] + [(60 + i, "http://a.org/", page.format(0)) for i in range(40)]
    near = "<body><main><h1>One story</h1>{}</main></body>"
    lines = [f"<p>Line {k} of the story</p>" for k in range(12)]
    rows += [(100 + i, "http://b.org/", near.format("".join(f"<p>Changed {i}</p>" if k == i % 12 else x for k, x in enumerate(lines)))) for i in range(60)]
    got = {r.page_id: r.text for r in html_extract.html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Own {i}\n\nMore of {i}\n\nAnd {i}" or got[i] == f"Daily news\n\nOwn {i}\n\nMore of {i}\n\nAnd {i}" for i in range(60))
    assert {got[60 + i] for i in range(40)} == {got[0]}
    for i in range(60):
        assert got[100 + i].split("\n\n") == ["One story", *(f"Changed {i}" if k == i % 12 else f"Line {k} of the story" for k in range(12))]


def test_html_long_and_clashing(spark):
    page = "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>x&amp" + "<b>y</b>" * 50_000 + "&am<i>p;</i></article>"
    table = spark.createDataFrame([(1, "http://a.org/", page, "t", 1, 2)], "page_id long, url string, html string, text string, low int, page int")
    text = html_extract.html_extract(table).first().text
    assert text == "deep\n\nx&" + "y" * 50_000 + "&amp;"


def test_html_noise_inside_blocks(spark):
    """Text is booked with the element it stands in, and names of real parts of an article are no noise."""

    def read(page):
        return html_extract.html_extract(spark.createDataFrame([(1, "http://a.org/", page)], "page_id long, url string, html string")).first().text.split("\n\n")

    assert read("<article><div>Real text <span class=share><div>x</div></span></div></article>") == ["Real text"]
    assert read("<article><p>Real text <span class=share><div>x</div></span></p></article>") == ["Real text", "x"]  # the div ends the paragraph and its span
    assert read("<article><p>One <button>Copy</button><span class='ad'>buy</span><i hidden>no</i><b aria-hidden=true>no</b>two &amp; <i>three</i></p></article>") == ["One two & three"]
    assert read("<article><h2 id=search-history>Search history</h2><section id=related-work><p>Related work</p></section></article>") == ["Search history", "Related work"]
    assert read("<article class='content has-sidebar'><div class='with-comments'><p>All</p></div></article>") == ["All"]
    assert read("<article><p>All</p><div class='share-buttons'>a</div><div id='related-posts'>b</div><section id=comments>c</section><p class='ad'>d</p></article>") == ["All"]


@pytest.mark.parametrize("window", [35, 8])
def test_substring(docs, none, window):
    rows = [(r.doc_id, words(r.text)) for r in docs.select("doc_id", "text").collect()]
    count = Counter(tuple(w[i : i + window]) for _, w in rows for i in range(len(w) - window + 1))
    want = []
    for d, w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        want.append((d, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    got = substring_dedup.remove_repeats(docs.select("doc_id", "text"), window, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(w[2] for w in want) > 0
    if window == 35:
        cut = substring_dedup.remove_repeats(docs)
        assert set(docs.columns) <= set(cut.columns) and cut.count() == len(rows)
        assert substring_dedup.remove_repeats(docs, counts=("a", "b")).select("n_words").distinct().collect() == [(CLASHES.index("n_words"),)]
        assert substring_dedup.remove_repeats(none).count() == 0


def brute_links(rows, cosine=0.98):
    """(links, component) by vec_id for rows (vec_id, embedding, label) that can link."""
    x = np.array([r[1] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([str(r[2]) for r in rows])
    near = (x @ x.T >= cosine) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    ids = np.array([r[0] for r in rows])
    component, before = ids.copy(), None
    while before is None or (component != before).any():
        before = component
        component = np.array([min([component[i], *component[near[i]]]) for i in range(len(ids))])
    return {int(i): (int(near[k].sum()), int(component[k]), bool(component[k] == i)) for k, i in enumerate(ids)}


@pytest.mark.parametrize("block,kind", [(4096, "int"), (48, "string"), (16, "long")])
def test_embeddings(spark, block, kind, monkeypatch):
    rng = np.random.default_rng(0)
    base, rows = rng.normal(size=(60, 16)), []
    label = (lambda i: f"l{i % 3}") if kind == "string" else (lambda i: i % 3)
    for i in range(240):
        v = base[i % 60] + rng.normal(size=16) * 0.06 * (i // 60)
        rows.append((i, [float(np.float32(x)) for x in v], label(i)))
    rows += [(300 + i, rows[5][1], rows[5][2]) for i in range(5)] + [(400, [2 * x for x in rows[7][1]], rows[7][2])]
    good, one = list(rows), label(1)
    rows += [(900, None, one), (901, [0.0] * 16, one), (902, [float("nan")] * 16, one), (903, rows[3][1], None), (904, [], one), (905, [None] + [1.0] * 15, one), (906, rows[4][1][:8], rows[4][2])]
    old = embedding_dedup.near_links
    monkeypatch.setattr(embedding_dedup, "near_links", lambda c, cosine: old(c, cosine, block))
    table = spark.createDataFrame([(*r, r[2], 1.0, 2) for r in rows], f"vec_id long, embedding array<float>, label {kind}, cell {kind}, radius double, class int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_components(table).collect()}
    want = brute_links(good) | {i: (0, i, True) for i in range(900, 907)}
    assert got == want and sum(n for n, _, _ in want.values()) > 50
    assert embedding_dedup.embedding_components(table.limit(0)).count() == 0


def test_cover_trees_have_levels():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 16))
    x = np.concatenate([base[rng.integers(0, 12, 300)] + rng.normal(size=(300, 16)) * s for s in (0.3, 0.02, 1e-9)])
    x = np.concatenate([x, x[:5], 3 * x[5:9]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = embedding_dedup.Node(x, np.arange(len(x)))
    assert tree.depth() >= 4

    def check(node, level):
        far = np.linalg.norm(x[node.rows] - x[node.centre], axis=1)
        assert far.max() <= node.radius + 1e-12 and node.radius <= level + 1e-6
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children]).tolist()) == sorted(node.rows.tolist())
            assert node.children[0].centre == node.centre  # nested
        for c in node.children:
            check(c, level / 2)

    check(tree, 2.0)
    for side in (np.zeros(len(x), int), rng.integers(0, 2, len(x))):
        links, forest = embedding_dedup.linked(x, np.ones(len(x), np.int64), side, 0.98)
        near = x @ x.T >= 0.98
        np.fill_diagonal(near, False)
        near &= (side[:, None] != side[None]) | (side.max() == 0)
        assert (links == near.sum(1)).all() and near.sum() > 1000
        for i in range(len(x)):
            assert {forest.root(int(j)) for j in np.flatnonzero(near[i])} <= {forest.root(i)}


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    rows = quality.quality(docs, quality.train(docs, labels, 20)).collect()
    by = sorted((r.doc_id is None, r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    want = []
    for r in docs.select("doc_id", "text").collect():
        w, text = words(r.text), r.text or ""
        count = Counter(zip(w, w[1:], w[2:]))
        hit = {i + k for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        dup = len(lines) - len(set(lines))
        want.append((r.doc_id is None, r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    assert by == sorted(want)
    assert not any(r.kept and r.base_failed for r in rows)
    assert quality.quality(none, quality.train(none, labels)).count() == 0


def test_marginals_are_exact(monkeypatch):
    """Forward and backward sums in blocks equal sums over all labellings; no chain is cut."""
    import itertools

    rng = np.random.default_rng(2)
    lens, stay = [1, 8, 3, 7], rng.normal(size=2)
    e = [rng.normal(size=n) for n in lens]
    parts = [(i, s, min(s + 3, n)) for i, n in enumerate(lens) for s in range(0, n, 3)]
    scores = np.zeros((len(parts), 3))
    for k, (i, a, b) in enumerate(parts):
        scores[k, : b - a] = e[i][a:b]
    p, both = quality.marginals(scores, stay, np.array([b - a for _, a, b in parts]), np.array([i for i, _, _ in parts]))
    for k, (i, a, b) in enumerate(parts):
        every = list(itertools.product((0, 1), repeat=lens[i]))
        weight = np.exp([sum(x * y for x, y in zip(e[i], ys)) + sum(stay[u] for u, v in zip(ys, ys[1:]) if u == v) for ys in every])
        weight /= weight.sum()
        for t in range(a, b):
            assert p[k, t - a] == pytest.approx(sum(w for w, ys in zip(weight, every) if ys[t]))
            for s in (0, 1):
                assert both[k, t - a, s] == pytest.approx(sum(w for w, ys in zip(weight, every) if t and ys[t] == ys[t - 1] == s))


def test_quality_on_unseen_texts(spark):
    """Trained without the held-out fold, the verdict holds on it."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.fold(F.col("doc_id")) == toxicity.HELD_OUT
    field = quality.train(docs, labels.where(~held))
    rows = quality.quality(docs.join(labels.where(held).select("doc_id"), "doc_id"), field).join(labels, "doc_id").collect()
    bad, good = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1 and not r.base_failed]
    assert len(bad) > 10 and sum(not r.kept for r in bad) >= 0.9 * len(bad) and sum(r.kept for r in good) >= 0.95 * len(good)


def test_toxicity_on_unseen_texts(spark):
    """Of the held-out toxic texts about one in twelve holds no term of the others."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.fold(F.col("doc_id")) == toxicity.HELD_OUT
    rows = toxicity.score(docs, toxicity.train(docs, labels)).join(labels.where(held), "doc_id").collect()
    toxic, clean = [r.score >= 0.7 for r in rows if r.toxic == 1], [r.score >= 0.7 for r in rows if r.toxic == 0]
    assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def brute_lines(text):
    """Features, words and repeats of each line with a word, line by line."""
    out, seen = [], set()
    for line in (text or "").encode().split(b"\n"):
        w = line.split()
        if not w:
            continue
        n, size = len(w), len(line)
        values = (
            n, sum(b in quality.SYMBOLS for b in line) / size, line.count(b"|"), sum(48 <= b <= 57 for b in line) / size, sum(x == y for x, y in zip(w, w[1:])) / n, len(set(w)) / n,
            sum(map(len, w)) / n, int(line in seen), int(line.rstrip()[-1:] in b".!?"), sum(x[-1] in quality.SYMBOLS for x in w) / n,
        )
        buckets = [int(o) + sum(v > e for e in edges) for o, edges, v in zip(quality.OFFSETS, quality.EDGES.values(), values)]
        out.append((buckets, n, line in seen))
        seen.add(line)
    return out


def test_lines_are_brute_force(docs):
    from stackloom.llm.wordhash import buffers, split
    import pyarrow as pa

    texts = [r.text for r in docs.select("text").collect()] + ["a | b 12\n\na | b 12\n x. \r\nx#\ty!\n\n", "\n\n", "last line no break", "é ñ\u00a0b 7", "\n"] + ["tail\n", "tail\n tail"]
    texts += [r.text for r in docs.sparkSession.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    data, offsets = buffers(pa.array(texts, pa.string()))
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    words = split(data, offsets)
    found = quality.lines_of(data, offsets, words, words.hashes())
    for i, t in enumerate(texts):
        a, b = found.first[i : i + 2]
        assert [(f.tolist(), n, r) for f, n, r in zip(found.features[a:b], found.words[a:b].tolist(), found.repeats[a:b].tolist())] == brute_lines(t)


def test_viterbi_is_best():
    rng = np.random.default_rng(1)
    field = quality.Field(rng.normal(size=quality.OFFSETS[-1]), rng.normal(size=2))
    chains = [np.array([[int(o + rng.integers(0, len(e) + 1)) for o, e in zip(quality.OFFSETS, quality.EDGES.values())] for _ in range(n)], dtype=int).reshape(n, len(quality.EDGES)) for n in (3, 0, 7, 1, 5, 7, 2)]
    first = np.cumsum([0, *map(len, chains)])
    labels = field.content(np.concatenate(chains), first)
    for k, chain in enumerate(chains):
        n = len(chain)

        def total(own):
            return sum(field.weights[f].sum() for f, l in zip(chain, own) if l) + sum(field.stay[int(a)] for a, b in zip(own, own[1:]) if a == b)

        every = [tuple(bool(m >> i & 1) for i in range(n)) for m in range(1 << n)]
        assert total(labels[first[k] : first[k + 1]].tolist()) == pytest.approx(max(map(total, every)))
    assert len(field.content(chains[0][:0], np.zeros(1, int))) == 0


def test_toxicity(spark, none):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        text = rng.choices(vocabulary, k=60) + (["grubby", "folk"] if toxic else rng.choice([["grubby"], ["folk"], []]))
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows + [(7000, None), (7001, ""), (None, "grubby folk")], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.train(docs, known)
    got = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    held = [(got[i], t) for i, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((s >= 0.7) == bool(t) for s, t in held) / len(held) > 0.97
    assert got[7000] == got[7001] < 0.7 and all(0 <= s <= 1 for s in got.values())
    assert toxicity.score(none, toxicity.train(none, known)).count() == 0
    assert all(r.score > 0.999 for r in toxicity.score(docs, toxicity.train(docs, known.where("toxic = 1"))).collect())


def brute_fingerprint(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(w)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_machine_is_brute_force(docs):
    """Scores from the sum over all pairs of a text's known terms, one by one."""
    def hashed(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        return toxicity.terms(raw, np.array([0, len(raw)]))[1].tolist()

    rng = np.random.default_rng(4)
    texts = ["", "idiot", "Such an IDIOT, you idiots!", "the weather is fine", "fine idiots are idiotic " * 300, "x\ty\nz"]
    known = sorted({h for w in ("idiot", "idiots", "idiotic", "fine", "you", "weather", "x") for h in hashed(w)})
    machine = toxicity.Machine(np.array(known, np.uint64), -0.3, rng.normal(size=len(known)), rng.normal(size=(len(known), 3)))
    raw = [t.encode() for t in texts]
    got = machine.score(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for text, score in zip(texts, got):
        words_ = re.findall("[a-z0-9]+", text.lower())
        at = sorted({known.index(h) for w in words_ for h in hashed(w) if h in known})
        z = machine.bias + sum(machine.w[i] for i in at) + sum(float(machine.v[i] @ machine.v[j]) for k, i in enumerate(at) for j in at[k + 1 :])
        assert score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)


def test_fit_follows_the_gradient():
    """One step of training moves every parameter against the numeric gradient of the weighted log loss."""
    hashes = np.arange(1, 5, dtype=np.uint64)
    rows, labels = [np.array([0, 1]), np.array([1, 2]), np.array([0, 3]), np.array([2, 3, 1])], np.array([1, 0, 1, 0])
    start, one = (toxicity.fit(hashes, rows, labels, factors=2, rounds=n, decay=(0.0, 0.0)) for n in (0, 1))

    def loss(bias, w, v):
        total = 0.0
        for r, y in zip(rows, labels):
            z = bias + w[r].sum() + sum(v[i] @ v[j] for k, i in enumerate(r) for j in r[k + 1 :])
            total += 0.25 * (math.log1p(math.exp(-z)) if y else math.log1p(math.exp(z)))
        return total

    def slope(change):
        return (loss(*change(1e-5)) - loss(*change(-1e-5))) / 2e-5

    for i in range(4):
        g = slope(lambda e: (start.bias, start.w + e * (np.arange(4) == i), start.v))
        assert abs(g) < 1e-9 or (one.w[i] - start.w[i]) * g < 0
        for f in range(2):
            step = np.zeros((4, 2))
            step[i, f] = 1
            g = slope(lambda e: (start.bias, start.w, start.v + e * step))
            assert abs(g) < 1e-7 or (one.v[i, f] - start.v[i, f]) * g < 0


def test_simhash(spark, docs, none):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    long = next(t for _, t in rows if t and len(t) > 3000)
    rows += [(2000 + i, long.replace(" ", f" E{i} ", i)) for i in range(6)]
    small = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            root[i] = min(root[j] for j in range(len(rows)) if bin(prints[i] ^ prints[j]).count("1") <= 4)
    least = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    want = sorted(((d, format(p, "016x"), least.get(r)) for (d, _), p, r in zip(rows, prints, root)), key=key)
    found = simhash.simhash_components(small).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    assert sorted(map(tuple, found), key=key) == want
    kept = simhash.one_of_each_group(small)
    assert kept.count() == len(set(root))
    assert simhash.one_of_each_group(docs).columns == docs.columns
    assert simhash.simhash_components(none).count() == 0


def test_simhash_groups_of_one_id(spark):
    """Groups that share their smallest doc_id, null ones and equal ones, each keep a row."""
    rng = random.Random(6)
    texts = [" ".join(rng.choices("abcdefghij", k=3)) + " " + " ".join(str(rng.random()) for _ in range(60)) for _ in range(24)]
    rows = [(None, t) for t in texts[:12]] + [(7, t) for t in texts[12:20]] + [(8 + i, t) for i, t in enumerate(texts[20:])]
    rows += [(None, texts[0]), (None, texts[20]), (30, texts[1]), (7, texts[12])]
    kept = simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(30 if t == texts[1] else d, t) for d, t in rows[:24]]
    assert sorted(map(tuple, kept.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("scheme", simhash.SCHEMES)
def test_near_pairs_are_all(spark, scheme):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for p in list(prints):
        for k in range(1, 7):
            prints.append(p ^ sum(1 << b for b in rng.sample(range(64), k)))
    signed = sorted({p - 2**64 if p >> 63 else p for p in prints})
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 4}
    got = {(r.a, r.b) for r in simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long"), scheme=scheme).collect()}
    assert got == want and len(want) > 100


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART_ROWS", 10)
    rng = random.Random(6)
    centre, prints = rng.getrandbits(64), set()
    for _ in range(300):
        prints.add(centre ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 4))))
    for _ in range(60):
        p = rng.getrandbits(44) << 20 | centre & 0xFFFFF
        prints |= {p, p ^ sum(1 << b for b in rng.sample(range(64), 3))}
    signed = sorted(p - 2**64 if p >> 63 else p for p in prints)
    up = {p: p for p in signed}

    def root(p):
        while up[p] != p:
            p = up[p]
        return p

    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 4:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = {(r.a, r.b) for r in simhash.near_links(frame, dense=8).collect()}
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 4 for a, b in links)
    got = {p: p for p in signed}

    def find(p):
        while got[p] != p:
            p = got[p]
        return p

    for a, b in links:
        x, y = find(a), find(b)
        got[max(x, y)] = min(x, y)
    assert {p: find(p) for p in signed} == {p: root(p) for p in signed}


def test_components(spark):
    from stackloom.llm.common import connected_components

    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(200, 201 + i) for i in range(30)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {n: n for e in edges for n in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {n: r for n, r in up.items() if n in got} and all(up[n] == n for n in set(up) - set(got))


def test_pipeline_is_brute_force(spark, docs, none, sf_dir):
    """Each stage's result against plain Python over what the stage before kept; the last one against the tokenizer."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    stage = dict(corpus_pipeline.STAGES)
    extra = spark.createDataFrame([(None, f"{i} unlike text of no id " + " ".join(str(i * k) for k in range(60)), "en", "a", 7, *range(len(CLASHES))) for i in range(5)], DOCS)
    first = docs.unionByName(extra)
    clean = stage["toxicity"](spark, first, sf_dir).cache()
    scored = toxicity.score(first.select("doc_id", "text"), toxicity.train(first, spark.read.parquet(f"{sf_dir}/labels.parquet"))).collect()
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=key) == sorted(((r.doc_id, r.text) for r in scored if r.score < 0.7), key=key)

    rows = [(r.doc_id, r.text) for r in clean.collect()]
    prints = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min(root[j] for j in range(len(rows)) if bin(prints[i] ^ prints[j]).count("1") <= 4) for i in range(len(rows))]
    once = stage["simhash_near_dedup"](spark, clean, sf_dir).cache()
    assert once.columns == docs.columns
    groups = defaultdict(list)
    for row, r in zip(rows, root):
        groups[r].append(row)
    kept = [(r.doc_id, r.text) for r in once.collect()]
    assert len(kept) == len(groups)
    for members in groups.values():
        best = [k for k in kept if k in members]
        ids = [d for d, _ in members if d is not None]
        assert len(best) == 1 and best[0][0] == (min(ids) if ids else None)
    assert sum(d is None for d, _ in kept) >= 5

    count = Counter(tuple(words(t)[i : i + 35]) for _, t in kept for i in range(len(words(t)) - 34))
    want = []
    for d, t in kept:
        w = words(t)
        gone = {k for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        want.append((d, " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t))
    cut = stage["substring_dedup"](spark, once, sf_dir).cache()
    assert cut.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in cut.collect()), key=key) == sorted(want, key=key)
    assert all(r.n_chars == len(r.text) for r in cut.collect() if r.text and (r.doc_id, r.text) not in kept)

    mixed = stage["source_mixing"](spark, cut, sf_dir).cache()
    assert mixed.columns == docs.columns
    sizes, wanted = targets([(r.doc_id, r.text, None, r.source) for r in cut.collect()])
    taken = Counter()
    for r in mixed.collect():
        taken[r.source] += len(words(r.text))
        assert any(r.text == c.text or " ".join(words(c.text)).startswith(r.text) for c in cut.collect() if c.doc_id == r.doc_id)
    assert all(taken[s] == pytest.approx(wanted[s], rel=0.02, abs=2) for s in wanted)

    packed = stage["best_fit_packing"](spark, mixed, sf_dir).collect()
    t = Tokenizer.from_file(packing.vocabulary_path())
    ids = Counter((r.doc_id, *np.frombuffer(r.ids, "<u4").tolist()) for r in packed)
    assert ids == Counter((r.doc_id, *(whole[s : s + 2048])) for r in mixed.collect() for whole in [t.encode(r.text or "", add_special_tokens=False).ids + [0]] for s in range(0, len(whole), 2048))
    by = defaultdict(list)
    for r in packed:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        ends = 0
        for o, n in sorted(parts):
            assert o == ends
            ends += n
        assert ends <= 2048

    frame = none
    for name, f in corpus_pipeline.STAGES:
        frame = f(spark, frame, sf_dir)
        assert frame.count() == 0
