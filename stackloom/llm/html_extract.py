"""HTML extraction: the main text of a page, by a style tree merged from all pages of its host.

A page is read into blocks of text. Each text stands in an element whose *style* is the path of
tags, class, id and role words above it. The pages of a host form one tree of styles, in which
a node's importance decides: texts under nodes of less than ``LEAST`` go.

What is measured of a style that ``m`` different pages show: its content importance, the mean
of ``1 - log k / log m`` over its texts (content nodes) that ``k`` pages show; and from the ``l``
child sequences it shows ``(1 - G**l) * entropy + G**l * content importance`` (base ``m``
entropy). The importance weighs that with what is expected of a style of which no page tells
anything, as if ``EXPECTED`` pages had told it: 1 in what a page declares as its main element
or in a page that declares none, 0 outside. Names that declare an element a menu, form,
notice, advert, comment and the like (tag, or class, id or role words) are a feature of the
style that multiplies its importance by ``DECLARED``. A content node is judged the same way by
its own ``1 - log k / log m``, so a text that many pages repeat goes where others of its style stay.

Copies and near copies of an article are one page and repeat nothing. Pages with one first
heading in the main element are near copies if at least ``ALIKE`` of what they show there stands
on most of them; where pages with one heading share less, as articles under a common title do,
each is a page of its own. Equal pages are one, and pages without a heading differ by their texts.

Node ids are 64-bit hashes that include the host. Scripts, styles and other elements without
rendered text are never read.

Defined cases: null html is empty text; unclosed, crossed or cut tags end as a browser would
end them; a null url is a host like any other; every page gets a row; an empty table gives no
rows. Only the named columns are read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.llm.common import join_hot, row_key, stored
from stackloom.llm.url_filter import url_parts
from stackloom.session import ship

#: Weight of child styles, least importance, pages that the expectation stands for, and the factor of declared noise.
G, LEAST, EXPECTED, DECLARED = 0.9, 0.35, 6, 0.2
#: Share of their main content nodes that stands on most pages of one heading if these are near copies.
ALIKE = 0.5
#: Nodes of low importance up to this number go to the executors; more are joined to the pages.
SENT_NODES = 1_000_000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z:-]+)")
#: Element lists and words (fixed values).
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
NEVER = {"head", "nav", "aside", "footer", "form", "button", "menu", "dialog", "fieldset"} | RAW
MAIN = {"article", "main"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = {"ul", "ol", "dl", "table", "menu"}
NOISE = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "gdpr", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
OUTSIDE_NOISE = NOISE | {"footer", "header", "masthead", "contentinfo", "complementary"}
#: Words that beside one of those above still leave the whole name a name of noise.
FURNITURE = {"area", "bar", "block", "box", "button", "buttons", "container", "icons", "left", "links", "list", "main", "page", "posts", "right", "section", "site", "slot", "stories", "top", "unit", "wrap", "wrapper"}
#: First words of names that tell what an element has or lacks, not what it is.
MODIFIERS = {"has", "is", "no", "not", "with", "without"}
#: Ids of whole sections that hold what readers wrote.
REPLIES = {"comments", "disqus", "replies"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
WORDS = re.compile(r"[a-z]+")


def named_noise(tag: str, names: list[tuple[str, str]], inside: bool) -> bool:
    """Whether names (attribute, name) of an element say that it is noise.

    Outside a main element one word does. Inside, the whole name must: ids of headings and
    sections are often made from their titles, and of those only ``REPLIES`` count.
    """
    for attribute, name in names:
        words = WORDS.findall(name)
        if not words or words[0] in MODIFIERS:
            continue
        if not inside:
            if not OUTSIDE_NOISE.isdisjoint(words):
                return True
        elif attribute == "id" and (tag in HEADINGS or tag == "section"):
            if tag == "section" and name in REPLIES:
                return True
        elif not NOISE.isdisjoint(words) and all(w in NOISE or w in FURNITURE for w in words):
            return True
    return False


class Element:
    __slots__ = ("tag", "words", "parent", "noise", "main", "children", "path")

    def __init__(self, tag: str, parent: Element | None, names: list[tuple[str, str]], hidden: bool):
        self.tag, self.parent, self.children, self.path = tag, parent, [], 0
        self.words = " ".join(sorted({w for _, name in names for w in WORDS.findall(name)})) if names else ""
        inside = parent is not None and parent.main
        self.main = inside or tag in MAIN or tag != "body" and "main" in self.words.split()
        noise = tag in NEVER or hidden or bool(names) and named_noise(tag, names, inside or tag in MAIN) or tag == "header" and not inside
        self.noise = parent is not None and parent.noise or noise and tag not in ("html", "body")


def attributes(raw: str) -> tuple[list[tuple[str, str]], bool]:
    """(class, id and role names with their attribute, whether the element is hidden)."""
    names, hidden = [], False
    for name, a, b, c, alone in ATTRIBUTE.findall(raw):
        name, value = (name or alone).lower(), (a or b or c).lower()
        if name in ("class", "id", "role"):
            names += [(name, v) for v in value.split()]
        hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "")
    return names, hidden


def read_blocks(page: str) -> tuple[list[list[tuple[Element | None, str]]], list[Element]]:
    """(blocks in page order, each a list of texts with the element they stand in; all elements).

    A text stands in the innermost block element, or in an inline element that is declared noise.
    """
    blocks: list[list[tuple[Element | None, str]]] = []
    every: list[Element] = []
    stack: list[Element] = []
    # Of each open element the one that its texts stand in.
    holders: list[Element | None] = [None]
    text: list[tuple[Element | None, str]] = []

    def book(run: str) -> None:
        if run:
            text.append((holders[-1], html.unescape(run) if "&" in run else run))

    def flush() -> None:
        if any(not run.isspace() for _, run in text):
            blocks.append(text.copy())
        text.clear()

    def close(at: int) -> None:
        if any(e.tag in BLOCKS for e in stack[at:]):
            flush()
        del stack[at:]
        del holders[at + 1 :]

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            book(page[at:])
            break
        book(page[at : m.start()])
        at = m.end()
        closing, tag = m[1] or m[4], (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if closing:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag), None)
            if k is not None:
                close(k)
            elif tag in BLOCKS:
                flush()
            continue
        if tag == "br" or tag == "wbr":
            book(" " if tag == "br" else "")
            continue
        if tag in BLOCKS:
            flush()
            if tag in SIBLINGS or tag in ("p",):
                ends = SIBLINGS.get(tag, {"p"})
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag in ends:
                        close(k)
                        break
                    if stack[k].tag in HOLDERS or stack[k].tag in BLOCKS and tag == "p":
                        break
            elif tag not in ("html", "head", "body"):
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag in BLOCKS), None)
                if k is not None and stack[k].tag == "p":
                    close(k)
        if tag in ("html", "head", "body") and any(e.tag == tag for e in stack):
            continue
        raw = m[3] or m[6] or ""
        element = Element(tag, stack[-1] if stack else None, *(attributes(raw) if raw else ([], False)))
        if stack and tag in BLOCKS:
            stack[-1].children.append(tag)
        if tag in VOID:
            if tag in BLOCKS:
                flush()
            continue
        every.append(element)
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if not raw.rstrip().endswith("/"):
            stack.append(element)
            holders.append(element if tag in BLOCKS or element.noise and not (holders[-1] and holders[-1].noise) else holders[-1])
    flush()
    return blocks, every


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def read_page(page: str, host: str | None) -> tuple[list[tuple[int, int, int, str]], dict[int, tuple[int, bool, bool]], int | None, int]:
    """A page as (texts ``block, style, content, text``; the styles that hold texts: ``children, noise, outside``; its first main heading; all its texts)."""
    blocks, every = read_blocks(page)
    declared = any(e is not None and e.main and not e.noise for block in blocks for e, _ in block)
    root = digest(f"{host}/{declared}")
    for e in every:
        e.path = digest(f"{e.parent.path if e.parent else root}/{e.tag}.{e.words}")
    texts, styles, heading = [], {}, None
    for number, block in enumerate(blocks):
        own: dict[Element | None, str] = {}
        for e, run in block:
            own[e] = own[e] + run if e in own else run
        contents = {}
        for e, run in own.items():
            style, line = e.path if e else root, " ".join(run.split())
            contents[e] = style, digest(f"{style}/{line}")
            if line:
                outside = declared and not (e and e.main)
                styles[style] = digest(" ".join(e.children)) if e else 0, bool(e and e.noise), outside
                if heading is None and e and e.tag in HEADINGS and not outside and not e.noise:
                    heading = digest(f"{host}/{line}")
        if len(own) == 1:
            texts.append((number, *contents[e], line))
        else:
            texts += [(number, *contents[e], run) for e, run in block]
    return texts, styles, heading, digest(" ".join(str(t[2]) for t in texts))


def read_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, key, other, heading, own, styles, texts`` for ``pages(page_id, url, html)``: everything that later steps need of the pages."""
    key, other = row_key("page_id", "url", "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    style = pa.struct([("style", pa.int64()), ("children", pa.int64()), ("noise", pa.bool_()), ("outside", pa.bool_())])
    text = pa.struct([("block", pa.int32()), ("style", pa.int64()), ("content", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heading, own, styles, texts = [], [], [], []
            for host, source in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                found, shown, title, whole = read_page(source or "", host)
                heading.append(title)
                own.append(whole)
                styles.append([dict(zip(("style", "children", "noise", "outside"), (k, *v))) for k, v in shown.items()])
                texts.append([dict(zip(("block", "style", "content", "text"), t)) for t in found])
            arrays = [pa.array(heading, pa.int64()), pa.array(own, pa.int64()), pa.array(styles, pa.list_(style)), pa.array(texts, pa.list_(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *arrays], names=["page_id", "url", "key", "other", "heading", "own", "styles", "texts"])

    rows = pages.select("page_id", "url", key.alias("key"), other.alias("other"), url_parts(F.col("url"))[0].alias("host"), "html")
    return rows.mapInArrow(run, f"page_id {kind}, url string, key long, other long, heading long, own long, styles array<struct<style: long, children: long, noise: boolean, outside: boolean>>, texts array<struct<block: int, style: long, content: long, text: string>>")


def told_apart(read: DataFrame) -> DataFrame:
    """``heading`` of the headings whose pages are no near copies of each other.

    Of the main content nodes that different pages of a heading show, counted once per page,
    less than ``ALIKE`` stand on more than half of these pages.
    """
    plain = F.transform(F.filter("styles", lambda s: ~s["noise"] & ~s["outside"]), lambda s: s["style"])
    main = F.array_distinct(F.transform(F.filter("texts", lambda t: F.array_contains(F.col("plain"), t["style"])), lambda t: t["content"]))
    pages = read.where("heading is not null").withColumn("plain", plain).select("heading", "own", main.alias("main"))
    shown = pages.select("heading", "own", F.explode("main").alias("content")).distinct().groupBy("heading", "content").agg(F.count("*").alias("k"))
    sizes = pages.select("heading", "own").distinct().groupBy("heading").agg(F.count("*").alias("g")).where("g > 1")
    shares = shown.groupBy("heading", "k").agg((F.count("*") * F.col("k")).alias("n")).join(sizes, "heading")
    return shares.groupBy("heading").agg((F.sum(F.when(2 * F.col("k") > F.col("g"), F.col("n")).otherwise(0)) / F.sum("n")).alias("alike")).where(F.col("alike") < ALIKE).select("heading")


def with_page(read: DataFrame, sent: int = SENT_NODES) -> DataFrame:
    """``read`` plus ``page``, which near copies share."""
    apart = stored(told_apart(read).withColumn("apart", F.lit(True)), "style-apart")
    few = apart.count() <= sent
    joined = read.join(F.broadcast(apart) if few else apart, "heading", "left")
    return joined.withColumn("page", F.when(F.col("heading").isNull() | F.col("apart"), F.col("own")).otherwise(F.col("heading"))).drop("apart")


def importances(read: DataFrame, declared: float = DECLARED, sent: int = SENT_NODES) -> DataFrame:
    """``node, importance`` of every style and of every content node that more than one page shows."""
    read = with_page(read, sent)
    styles = read.select("page", F.explode("styles").alias("s")).select("page", "s.*")
    shown = styles.groupBy("page", "style", "children").agg(F.max("noise").alias("noise"), F.max("outside").alias("outside"))
    shown = shown.groupBy("style", "children").agg(F.count("*").alias("k"), F.max("noise").alias("noise"), F.max("outside").alias("outside"))
    pages = styles.select("page", "style").distinct().groupBy("style").agg(F.count("*").alias("m"))
    k = F.col("k")
    shown = shown.groupBy("style").agg(F.count("*").alias("l"), F.sum("k").alias("sequences"), F.sum(k * F.log(k)).alias("sequence_logs"), F.max("noise").alias("noise"), F.max("outside").alias("outside"))
    texts = read.select("page", F.explode(F.transform("texts", lambda t: F.struct(t["style"].alias("style"), t["content"].alias("content")))).alias("t")).select("page", "t.*").distinct()
    contents = stored(texts.groupBy("style", "content").agg(F.count("*").alias("k")), "style-contents")
    sums = contents.groupBy("style").agg(F.sum("k").alias("texts"), F.sum(k * F.log(k)).alias("text_logs"))
    # One row per style; a site has as many as its templates have elements.
    tree = stored(pages.join(shown, "style").join(sums, "style"), "style-tree")
    m, base = F.col("m"), F.when(F.col("m") > 1, F.log("m"))
    content = F.coalesce(1 - F.col("text_logs") / F.col("texts") / base, F.lit(1.0))
    entropy = F.coalesce((F.log("sequences") - F.col("sequence_logs") / F.col("sequences")) / base, F.lit(1.0))
    weight = F.pow(F.lit(G), F.col("l"))
    expected, factor = F.when(F.col("outside"), 0.0).otherwise(1.0), F.when(F.col("noise"), declared).otherwise(1.0)

    def judged(measured: Column) -> Column:
        return factor * (EXPECTED * expected + m * measured) / (EXPECTED + m)

    of_styles = tree.select(F.col("style").alias("node"), judged((1 - weight) * entropy + weight * content).alias("importance"))
    several = contents.where("k > 1")
    told = several.groupBy("style").agg(F.count("*").alias("rows")).join(tree.select("style", "m", "noise", "outside"), "style")
    repeated = join_hot(several, stored(told, "style-told"), ["style"], "rows", several.count())
    return of_styles.union(repeated.select(F.col("content").alias("node"), judged(F.coalesce(1 - F.log("k") / base, F.lit(1.0))).alias("importance")))


def joined_texts(texts: list[dict], low: set[int]) -> str:
    """The texts of no low node: those of one block follow each other, blocks are joined by an empty line."""
    blocks: dict[int, str] = {}
    for t in texts:
        if t["style"] not in low and t["content"] not in low:
            blocks[t["block"]] = blocks.get(t["block"], "") + t["text"]
    lines = (" ".join(b.split()) for b in blocks.values())
    return "\n\n".join(line for line in lines if line)


def html_extract(pages: DataFrame, declared: float = DECLARED, sent: int = SENT_NODES) -> DataFrame:
    """Rows ``page_id, url, text`` for ``pages(page_id, url, html)``; blocks are joined by an empty line."""
    ship(pages.sparkSession)
    read = stored(read_pages(pages), "style-pages", "zstd")
    low = stored(importances(read, declared, sent).where(F.col("importance") < LEAST).select("node"), "style-low")
    kind = pages.schema["page_id"].dataType.simpleString()
    if low.count() <= sent:
        everywhere, own = frozenset(low.toArrow().column("node").to_pylist()), F.array().cast("array<bigint>")
        rows = read.select("page_id", "url", "texts", own.alias("low"))
    else:
        # Of each page the low ones among its own nodes.
        everywhere, nodes = frozenset(), read.select("key", "other", F.explode(F.array_distinct(F.concat("texts.style", "texts.content"))).alias("node")).distinct()
        mine = nodes.join(low, "node", "left_semi").groupBy("key", "other").agg(F.collect_set("node").alias("low"))
        rows = read.join(mine, ["key", "other"], "left").select("page_id", "url", "texts", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [joined_texts(t, everywhere if not own else set(own)) for t, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string")
