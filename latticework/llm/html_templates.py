"""Operator 10, HTML extraction with site template removal.

Every page is parsed into elements. The hash of an element covers its tag, its
attributes and all that is below it. Spark counts, per host, on how many
different pages each hash occurs; elements whose hash occurs on at least
`min_pages` pages and on `min_share` of the host's pages are templates, and are
deleted with all below them. The visible text of the rest is returned, block
elements on lines of their own.

Defined results: null or empty HTML gives an empty text and takes no part in
the counts. A null or odd URL has host "". Pages are told apart by their
content, so repeated rows and copies of a page count once; each row gets its own
result. Pages of any length are parsed whole. An element that reaches both bounds
exactly is a template. Unclosed and badly nested tags are mended: an end tag closes all that
was opened since, and is ignored if nothing matches it. Text of script, style,
noscript, template, head (but not title) is not visible. Columns other than
page_id, url and html are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm._arrow import slices
from latticework.session import ship, stash

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template"))
_HIDDEN = frozenset(("script", "style", "noscript", "template", "head"))
_BLOCK = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split()
)
#: An opening tag ends these elements, if they are the innermost.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {
    x: {"p"} for x in "div ul ol table section article h1 h2 h3 h4 h5 h6 nav footer header blockquote pre form".split()
}


class Node:
    __slots__ = ("children", "hash", "key", "tag")

    def __init__(self, tag: str, key: str) -> None:
        self.tag, self.key, self.children, self.hash = tag, key, [], 0


def parse(page: str) -> Node:
    """The tree of a page; leaves are strings. Every element has its hash."""
    root = Node("", "")
    stack, at = [root], 0

    def close() -> None:
        node = stack.pop()
        parts = xxhash.xxh64(node.key.encode("utf-8", "replace"))
        for x in node.children:
            parts.update(b"\x01" + x.hash.to_bytes(8, "little") if type(x) is Node else b"\x02" + " ".join(x.split()).encode("utf-8", "replace"))
        node.hash = parts.intdigest()

    for m in _TOKEN.finditer(page):
        if m.start() < at:  # inside of a raw element
            continue
        if m.start() > at and (text := page[at : m.start()]).strip():
            stack[-1].children.append(text)
        elif m.start() > at:
            stack[-1].children.append(" ")
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if any(x.tag == tag for x in stack):
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        ends = _ENDS.get(tag)
        while ends and stack[-1].tag in ends:
            close()
        node = Node(tag, f"{tag} {' '.join(m[3].rstrip('/').split())}")
        stack[-1].children.append(node)
        stack.append(node)
        if tag in _VOID or m[3].endswith("/"):
            close()
        elif tag in _RAW:
            end = re.compile(rf"</{tag}\s*>|\Z", re.I).search(page, at)
            if end.start() > at:
                node.children.append(page[at : end.start()])
            at = end.end()
            close()
    if at < len(page) and page[at:].strip():
        stack[-1].children.append(page[at:])
    while stack:
        close()
    return root


def subtree_hashes(root: Node) -> set[int]:
    """Hashes of the elements that hold something; as signed 64-bit numbers."""
    found, todo = set(), list(root.children)
    while todo:
        x = todo.pop()
        if type(x) is Node:
            if x.children:
                found.add(x.hash - (1 << 64) if x.hash >> 63 else x.hash)
                todo.extend(x.children)
    return found


def visible_text(root: Node, templates: frozenset[int]) -> tuple[str, int]:
    """Text without the templates, and how many elements were deleted (those below them not counted)."""
    out: list[str] = []
    removed, todo = 0, [root]
    while todo:
        x = todo.pop()
        if type(x) is not Node:
            out.append(x)
            continue
        if x.children and (x.hash - (1 << 64) if x.hash >> 63 else x.hash) in templates and x.tag:
            removed += 1
            continue
        if x.tag in _HIDDEN:
            todo.extend(c for c in x.children if type(c) is Node and c.tag == "title")
            continue
        if x.tag in _BLOCK:
            out.append("\0")
            todo.append("\0")
        todo.extend(reversed(x.children))
    lines = (" ".join(entities.unescape(x).split()) for x in "".join(out).split("\0"))
    return "\n".join(x for x in lines if x), removed


def _host() -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "html"):
        host, hash_, page = [], [], []
        for h, x in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
            root = parse(x)
            found = subtree_hashes(root)
            whole = root.hash - (1 << 64) if root.hash >> 63 else root.hash
            host += [h] * (len(found) + 1)
            hash_ += [None, *found]
            page += [whole] * (len(found) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(hash_, pa.int64()), pa.array(page, pa.int64())], ["host", "subtree", "page"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple = (None, frozenset())
    for b in slices(batches, "html"):
        text, removed = [], []
        for x, t in zip(b.column("html").to_pylist(), b.column("templates").to_pylist()):
            if t != last[0]:
                last = (t, frozenset(t or ()))
            one = visible_text(parse(x or ""), last[1])
            text.append(one[0])
            removed.append(one[1])
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), pa.array(text, pa.string()), pa.array(removed, pa.int64())], ["page_id", "host", "text", "removed"])


def extract(pages: DataFrame, min_pages: int = 3, min_share: float = 0.05, broadcast_limit: int = 1_000_000, salts: int = 64) -> DataFrame:
    """(page_id, host, text, removed) for every page.

    Every page is parsed twice, as its tree is larger than its HTML. Up to broadcast_limit hosts and template hashes (8 MB) the templates are
    sent to the pages; beyond, both are shuffled by host and salt.
    """
    ship(pages.sparkSession)
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), _host().alias("host"), "html")
    seen = p.filter("length(html) > 0").select("host", "html").mapInArrow(_count, "host string, subtree long, page long")
    # counted in two steps, of which the first spreads the pages of one element over all tasks
    counts = stash(seen.groupBy("host", "subtree").agg(F.countDistinct("page").alias("pages")).filter((F.col("pages") >= min_pages) | F.col("subtree").isNull()), "html-counts")
    # the row whose subtree is null holds the host's number of pages
    hosts = counts.filter("subtree is null").select("host", F.col("pages").alias("all"))
    many = counts.filter("subtree is not null").join(hosts, "host").filter(F.col("pages") >= F.col("all") * min_share)
    # a host has few templates: a page has 1 / min_share times fewer elements than its host has templates
    site = stash(many.groupBy("host").agg(F.collect_list("subtree").alias("templates")), "html-templates")
    size = site.agg(F.count("*"), F.coalesce(F.sum(F.size("templates")), F.lit(0))).first()
    if sum(size) <= broadcast_limit:
        joined = p.join(F.broadcast(site), "host", "left")
    else:  # pages of one host are spread over `salts` tasks
        salt = F.pmod(F.xxhash64("page_id", "html"), F.lit(salts)).cast("int")
        many = site.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = p.withColumn("salt", salt).join(many.hint("shuffle_hash"), ["host", "salt"], "left")
    return joined.select("page_id", "host", "html", "templates").mapInArrow(_extract, "page_id long, host string, text string, removed long")
