"""Main text of web pages by a site style tree: what the pages of one host share is furniture.

A page is cut into elements with a path each: tags, classes and ids from the root. Pages of a host are merged by path.
A path's importance comes from entropies over the pages that show it, with logarithms to the base of their number:

- presentation: the entropy of the sequences of children that they have there. One sequence everywhere has none.
- content: 1 less the mean entropy of the texts that stand there. A text on all pages has entropy 1, on one page 0.

A base is at least FEWEST, so a few like pages prove little; what only one distinct page shows has importance 1. In each
page, a node's composite importance mixes its own presentation with the mean of its children and its text, as in

    (1 - GAMMA ** l) * presentation + GAMMA ** l * mean, l the number of sequences known there,

and branches under LEAST go. What a page says itself bounds this: elements stated as furniture by tag, role, class or id
have no importance, nor has what is outside of the article (or else the main part) if the page marks one; of a header
inside of it, headings count. If the branches under LEAST hold more than half of the text that is left, they are the
text, and stay: near copies of one page on a host are no furniture.

Only hashes and counts leave the pages: one row for each path, sequence and text of a task, summed over tasks, so a host
with a third of all pages is spread. Pages stay where they are read. What is known of a host is joined to its pages,
broadcast up to SENT rows (counted first), else shuffled, with skewed hosts split by Spark.

Defined results: null and empty pages, and pages without text, have the empty text. Null or hostless urls are pages of
their own, with importance 1 everywhere. Repeated rows give repeated results. Extra columns are dropped. Empty tables
give no rows. Pages of any length are read whole; markup that doesn't close is closed as browsers do; references are
decoded once; a table row is one block, its cells are parted by a space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, quoted, stage, text_slices

GAMMA, LEAST, FEWEST = 0.9, 0.3, 8
SENT = 200_000
#: Rows of counts that a task holds before it passes them on; hosts whose nodes a task keeps.
HELD, HOSTS = 200_000, 500

BLOCKS = frozenset([
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: Elements that start inside of a paragraph without ending it.
IN_P = frozenset(["option", "optgroup", "select", "legend", "caption", "tbody", "thead", "tfoot", "tr", "body", "html", "head"])
#: A start tag ends an open element of these, up to the nearest of the others.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "option": (("option",), ("select",)),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)), "body": (("head",), ("html",)),
}
VOID = frozenset(["hr"])
RAW = frozenset(["script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"])
FURNITURE = frozenset(["nav", "footer", "aside", "form", "noscript", "template", "svg", "canvas", "object", "button", "select", "dialog", "menu", "head", "audio", "video", "datalist", "search", "map"])
ROLES = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "status"])
#: Words of a class or id that state furniture.
STATED = frozenset([
    "ad", "ads", "adsense", "advert", "advertisement", "advertisements", "advertising", "adverts", "aside", "banner", "breadcrumb", "breadcrumbs", "comment", "commentlist", "comments", "consent", "cookie", "cookies", "copyright",
    "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "related", "replies", "respond", "share", "sharing",
    "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
])
#: Words of a class or id that tell other articles than the page's own.
OTHER_ARTICLES = frozenset(["comment", "comments", "related", "sponsored", "promo", "recommended", "reply"])
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: Tags that matter without attributes; others do if they have one of these.
SPACES = frozenset(["br", "td", "th"])
KNOWN = BLOCKS | FURNITURE | RAW
STATES = re.compile("class|id|role", re.I)
P_ENDS_AT = ("button", "td", "th", "table", "div", "li", "article", "section", "main", "blockquote", "body")
HOST = re.compile(r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
_END = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in RAW}
_TEXT, _CHILDREN, _SHOWN = 1, 0, 2


def host_of(url: str | None) -> int | None:
    found = HOST.match(url or "")
    return _signed(xxhash.xxh3_64_intdigest(found[1].lower())) if found else None


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@lru_cache(20_000)
def _stated(tag: str, rest: str) -> tuple[str, bool, bool, int]:
    """Of a start tag: its part of a path, whether it states furniture, whether a header, and 2 for an article, 1 for a main part."""
    names, role = [], ""
    for name, value in ATTRIBUTE.findall(rest):
        value = value.strip("\"'").lower()
        if name.lower() == "role":
            role = value
        else:
            names += value.split()
    words = {w for name in names for w in re.split("[^a-z0-9]+", name)}
    kind = tag + "".join(f".{n}" for n in sorted(names))
    if tag in ("html", "body", "main"):
        return kind, False, False, int(tag == "main")
    if tag == "article":
        return kind, bool(words & OTHER_ARTICLES), False, 2
    return kind, tag in FURNITURE or role in ROLES or bool(words & STATED), tag == "header" or "header" in words, int(role == "main" or "articlebody" in names)


class Page:
    """A page's elements and texts. Lists run by element, in order of their start; element 0 is the page."""

    def __init__(self, html: str):
        self.parent, self.path, self.out, self.place, self.tag = [-1], [0], [False], [0], [""]
        self.children: list[list[str]] = [[]]
        self.blocks: list[tuple[int, str]] = []  # element and text
        self._read(html)
        best = max((self.place[e] for e, _ in self.blocks), default=0)
        self.blocks = [b for b in self.blocks if self.place[b[0]] >= best]
        self.within = [not o and p >= best for o, p in zip(self.out, self.place, strict=True)]

    def _read(self, html: str) -> None:
        stack, names, pieces = [0], [""], []
        at, owner = 0, 0
        out_of, search = self.out, TOKEN.search
        opened: dict[str, int] = {}  # so that no tag is looked for among thousands where none is open

        def flush() -> None:
            if text := " ".join("".join(pieces).split()):
                self.blocks.append((owner, text))
            pieces.clear()

        def cut(k: int) -> None:
            for name in names[k:]:
                opened[name] -= 1
            del names[k:], stack[k:]

        def close(tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
            if any(opened.get(t) for t in tags):
                for k in range(len(names) - 1, 0, -1):
                    if names[k] in tags:
                        return cut(k)
                    if names[k] in stop:
                        return

        while m := search(html, at):
            if m.start() > at and not out_of[stack[-1]]:
                raw = html[at : m.start()]
                if not pieces:
                    owner = stack[-1]
                pieces.append(unescape(raw) if "&" in raw else raw)
            at = m.end()
            end, tag, rest = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
            if not tag:
                continue
            tag = tag.lower()
            if end:
                if pieces and tag in BLOCKS:
                    flush()
                if opened.get(tag):
                    k = len(names) - 1
                    while names[k] != tag:
                        k -= 1
                    cut(k)
                continue
            if tag in SPACES:
                if pieces:
                    pieces.append(" ")
            elif tag not in KNOWN and not STATES.search(rest):
                continue
            if tag in RAW:
                found = _END[tag].search(html, at)
                at = found.start() if found else len(html)
                continue
            kind, stated, header, placed = _stated(tag, rest)
            block = tag in BLOCKS
            if not block and not stated:
                continue
            if block:
                if pieces:
                    flush()
                if tag not in IN_P:
                    if names[-1] == "p":
                        cut(len(names) - 1)
                    else:
                        close(("p",), P_ENDS_AT)
                if tag in ENDS:
                    close(*ENDS[tag])
            up = stack[-1]
            place, heading = self.place[up], tag in HEADINGS
            if placed > place and not out_of[up]:
                place = placed
            self.children[up].append(kind)
            self.parent.append(up)
            self.path.append(xxhash.xxh3_64_intdigest(kind, self.path[up]))
            self.place.append(place)
            # a header is furniture, but for headings in one that belongs to the article or main part
            out_of.append(out_of[up] or stated or not heading and (header and not place or self.tag[up] == "header"))
            self.tag.append("header" if header and not heading else tag)
            self.children.append([])
            if tag not in VOID and not rest.endswith("/"):
                stack.append(len(self.parent) - 1)
                names.append(tag)
                opened[tag] = opened.get(tag, 0) + 1
        if at < len(html) and not out_of[stack[-1]]:
            if not pieces:
                owner = stack[-1]
            pieces.append(unescape(html[at:]))
        flush()
        self.blocks = [(e, t) for e, t in self.blocks if self.tag[e] != "header"]

    def features(self) -> set[tuple[int, int, int]]:
        """(path, kind, hash) of what the page shows at each path."""
        out = set()
        for e, inside in enumerate(self.within):
            if inside:
                out.add((self.path[e], _SHOWN, 0))
                if self.children[e]:
                    out.add((self.path[e], _CHILDREN, xxhash.xxh3_64_intdigest("\n".join(self.children[e]))))
        for e, text in self.blocks:
            out.add((self.path[e], _TEXT, xxhash.xxh3_64_intdigest(text)))
        return out

    def text(self, known: dict[int, tuple[float, float, int]]) -> str:
        """The texts whose branches are important; known: (content, presentation, sequences) of a path, all else is 1, 1, 1."""
        if known:
            n = len(self.parent)
            total, parts, own = [0.0] * n, [0] * n, [False] * n
            for e, _ in self.blocks:
                own[e] = True
            low = [False] * n
            for e in range(n - 1, -1, -1):  # children start after their parents
                content, presentation, sequences = known.get(_signed(self.path[e]), (1.0, 1.0, 1))
                if own[e]:
                    total[e] += content
                    parts[e] += 1
                if parts[e]:
                    mean = total[e] / parts[e]
                    weight = GAMMA**sequences
                    value = (1 - weight) * presentation + weight * mean if parts[e] > own[e] else mean
                    low[e] = value < LEAST
                    if e:
                        total[self.parent[e]] += value
                        parts[self.parent[e]] += 1
            for e in range(1, n):
                low[e] = low[e] or low[self.parent[e]]
            kept = [t for e, t in self.blocks if not low[e]]
            if 2 * sum(map(len, kept)) >= sum(len(t) for _, t in self.blocks):
                return "\n".join(kept)
        return "\n".join(t for _, t in self.blocks)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (url, html) to (host, path, kind, feature, n, lo, hi): pages that show a feature, and the range of their texts' hashes."""
    held: dict[tuple[int, int, int, int], list[int]] = {}

    def rows() -> pa.RecordBatch:
        columns = [*zip(*held, strict=True), *zip(*held.values(), strict=True)]
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["host", "path", "kind", "feature", "n", "lo", "hi"])
        held.clear()
        return out

    for part, pages in text_slices(batches, 1):
        for url, html in zip(part.column(0).to_pylist(), pages, strict=True):
            host = host_of(url)
            if host is None or not html:
                continue
            page = Page(html.decode())
            text = _signed(xxhash.xxh3_64_intdigest("\n".join(t for _, t in page.blocks)))
            for path, kind, feature in page.features():
                key = host, _signed(path), kind, _signed(feature)
                was = held.get(key)
                if was is None:
                    held[key] = [1, text, text]
                else:
                    was[0] += 1
                    was[1], was[2] = min(was[1], text), max(was[2], text)
            if len(held) > HELD:
                yield rows()
    if held:
        yield rows()


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, content, presentation, sequences) of the paths that several distinct pages of a host show, from (url, html) rows."""
    rows = pages.mapInArrow(_features, "host long, path long, kind long, feature long, n long, lo long, hi long")
    one = rows.groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    k = F.when(F.col("lo") == F.col("hi"), 1).otherwise(F.col("n"))
    kind = lambda which, value: F.when(F.col("kind") == which, value)
    node = one.withColumn("k", k).groupBy("host", "path").agg(
        F.max(kind(_SHOWN, F.col("k"))).alias("m"), F.sum(kind(_CHILDREN, F.col("k"))).alias("all"), F.sum(kind(_CHILDREN, F.col("k") * F.log("k"))).alias("klogk"),
        F.count(kind(_CHILDREN, F.lit(1))).alias("sequences"), F.avg(kind(_TEXT, F.log("k"))).alias("texts")).where("m > 1")
    base = F.log(F.greatest("m", F.lit(FEWEST)))
    entropy = (F.log("all") - F.col("klogk") / F.col("all")) / base
    bounded = lambda x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 6)
    return node.select("host", "path", F.coalesce(bounded(1 - F.col("texts") / base), F.lit(1.0)).alias("content"), F.coalesce(bounded(entropy), F.lit(1.0)).alias("presentation"), F.greatest("sequences", F.lit(1)).cast("int").alias("sequences"))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (row, html, host, nodes) to (row, text)."""
    hosts: dict[int, dict[int, tuple[float, float, int]]] = {}
    for part, pages in text_slices(batches, 1):
        nodes, texts = part.column(3), []
        for i, (host, html) in enumerate(zip(part.column(2).to_pylist(), pages, strict=True)):
            known: dict = {}
            if host is not None and nodes[i].is_valid:
                if host not in hosts:
                    if len(hosts) >= HOSTS:
                        hosts.clear()
                    own = nodes[i].values
                    hosts[host] = dict(zip(own.field(0).to_pylist(), zip(*(own.field(c).to_pylist() for c in (1, 2, 3)), strict=True), strict=True))
                known = hosts[host]
            texts.append(Page(html.decode()).text(known) if html else "")
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["row", "text"])


def _hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts = [host_of(u) for u in batch.column(0).field(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hosts, pa.int64())], names=["row", "html", "host"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.select(quoted(page_id).alias("page_id"), quoted(url).cast("string").alias("url"), quoted(html).cast("string").cast("binary").alias("html"))
    tree = stage(style_tree(rows.select("url", "html")), "style-tree")
    sent = F.broadcast if tree.count() <= SENT else lambda d: d
    by_host = tree.groupBy(F.col("host").alias("_h")).agg(F.collect_list(F.struct("path", "content", "presentation", "sequences")).alias("nodes"))
    one = rows.select(F.struct("page_id", "url").alias("row"), "html")
    row_type = one.schema["row"].dataType.simpleString()
    with_host = one.mapInArrow(_hosts, f"row {row_type}, html binary, host long")
    met = with_host.join(sent(by_host), F.col("host") == F.col("_h"), "left").select("row", "html", "host", "nodes")
    out = met.mapInArrow(_extracted, f"row {row_type}, text string")
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
