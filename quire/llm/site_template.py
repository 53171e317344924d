"""HTML extraction by removing site templates: element subtrees that recur across many pages of a host.

1. Each page is parsed into a tree (unclosed paragraphs, list items and cells end where the next begins, an open head at
   what can't stand in it; comments,
   declarations, scripts, styles and the head but for its title are left out), and every element's subtree gets a
   64-bit hash of its tag, attributes, white-space-normalised text and children.
2. Spark counts, for each host and hash, the pages that have it, over all pages; rows of one host with the same html are one page.
3. Block-level subtrees with text, cells apart, on at least ``min_pages`` pages and at least ``min_share`` of the host's pages are its template: they are
   deleted from each page, and what text is left is the page's, one line a block element. Inline elements and cells
   (a word in bold, a link, a number in a table) recur within running content, and go only with a block around them. Void elements that recur are counted as removed too, but keep their line break.

A page is parsed once: what it parses to is stored (text, and where its elements begin and end in it), counted and cut.
The templates of all hosts are broadcast if they are at most ``BROADCAST_ROWS`` rows, else joined to the pages by host.

Defined results: a null or empty html gives a null text and 0 removed; a url without a host (or a null one) belongs to no
site, and nothing is removed from its pages; each row has a result, repeated ones too, but counts once, so copies of a page don't make it a template; malformed
markup never fails; a page that is all template has an empty text; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_PAGES = 5
MIN_SHARE = 0.02
BROADCAST_ROWS = 500_000
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+|[^>]*+)>",
    re.S | re.I,
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th title tr ul".split())
#: Which open elements a start tag ends, and at which it stops looking.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_P = (frozenset(["p"]), frozenset("div article section main aside header footer nav td th li body blockquote".split()))
ENDS |= {t: _P for t in BLOCK - set(ENDS) - {"br", "html", "body", "title"}}
#: Elements that can be a template by themselves.
WHOLE = BLOCK - frozenset("br hr td th title".split())
HEAD = frozenset("title meta link base basefont bgsound script style noscript noframes template".split())
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attributes", "parts", "hash", "solid")

    def __init__(self, tag: str, attributes: str) -> None:
        self.tag, self.attributes, self.parts, self.hash, self.solid = tag, attributes, [], 0, False


def _blank(text: str) -> bool:
    return text.isspace() or "&" in text and not entities.unescape(text).strip()


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root, and all elements under it, children before their parents, with hashes; linear in the page's length."""
    root = Node("", "")
    stack, done, at, in_head = [root], [], 0, False
    places: dict[str, list[int]] = {}  # of each tag's open elements in the stack

    def close(k: int) -> None:
        """Close the open elements from the k-th on."""
        while len(stack) > k:
            node = stack.pop()
            places[node.tag].pop()
            key = [node.tag, _SPACE.sub(" ", node.attributes).strip()]
            for x in node.parts:
                if isinstance(x, str):
                    key.append(_SPACE.sub(" ", x).strip())
                    node.solid = node.solid or bool(x) and not _blank(x)
                else:
                    key.append(f"\x01{x.hash:x}")
                    node.solid = node.solid or x.solid
            node.hash = xxhash.xxh3_64_intdigest("\x00".join(key).encode("utf-8", "replace"))
            done.append(node)

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def add(text: str) -> None:
        if text:
            if stack[-1].tag == "head" and not text.isspace():
                leave_head()
            stack[-1].parts.append(text)

    def leave_head() -> None:
        while places.get("head"):
            close(places["head"][-1])

    end = page.rfind(">") + 1  # nothing behind it is a tag, so no tag is looked for to the end again and again
    for m in TOKEN.finditer(page, 0, end):
        add(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            if at == end and (m[0].startswith("<!--") and not m[0].endswith("-->") or m[1] and not re.search(rf"</{m[1]}\s*>\Z", m[0], re.I)):
                at = len(page)  # never closed
            continue
        tag = tag.lower()
        if m[2]:
            if k := last((tag,)):
                close(k)
            continue
        if tag not in HEAD and in_head:
            leave_head()
            in_head = False
        in_head |= tag == "head"
        if tag in ENDS:
            ended, stop = ENDS[tag]
            k = last(ended)
            if k > last(stop):
                close(k)
        node = Node(tag, m[4] or "")
        stack[-1].parts.append(node)
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)
        if tag in VOID or node.attributes.endswith("/"):
            close(len(stack) - 1)
    tail = page[at:]
    add(tail[: m.start()] if (m := re.search("<[!?]", tail)) else tail)
    close(1)
    return root, done


def flat(root: Node) -> tuple[str, list[tuple[int, int, int]]]:
    """The text, with ``\\x00`` for line breaks, and (hash, start, end) of what can be removed in it, outer elements first; void elements have no length."""
    out: list[str] = []
    found: list[list[int]] = []
    size = 0
    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, int):
            found[x][2] = size
            continue
        if isinstance(x, str):
            out.append(x)
            size += len(x)
            continue
        if x.tag in VOID:
            found.append([x.hash, size, size])
        elif x.tag in WHOLE and x.solid:
            todo.append(len(found))
            found.append([x.hash, size, size])
        if x.tag in BLOCK:
            out.append("\x00")
            size += 1
            todo.append("\x00")
        parts = [p for p in x.parts if not isinstance(p, str) and p.tag in ("title",)] if x.tag == "head" else x.parts
        todo += reversed(parts)
    return "".join(out), [tuple(x) for x in found]


def cut(text: str, elements: list[tuple[int, int, int]], removed: frozenset[int] | set[int]) -> tuple[str, int]:
    """Text without the removed elements, and how many were removed."""
    out, at, count = [], 0, 0
    for h, start, end in elements:
        if h in removed and start >= at:
            count += 1
            if end > start:
                out += [text[at:start], "\x00"]
                at = end
    out.append(text[at:])
    lines = (_SPACE.sub(" ", entities.unescape(x)).strip() for x in "".join(out).split("\x00"))
    return "\n".join(x for x in lines if x), count


def text_of(root: Node, removed: frozenset[int] | set[int]) -> tuple[str, int]:
    """Text without the removed subtrees, and how many were removed."""
    return cut(*flat(root), removed)


def host_of(url) -> F.Column:
    """Lower-case host of an absolute url without user and port, null if it has none."""
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1))
    return F.when(found != "", found)


PARSED = "text string, hashes array<long>, starts array<int>, ends array<int>"
RESULT = "text string, n_removed int"


def _parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in batches:
        texts, elements = [], []
        for page in pages.to_pylist():
            text, own = flat(parse(page)[0]) if page else (None, [])
            texts.append(text)
            elements.append(np.array(own, np.uint64).reshape(-1, 3))
        at = pa.array(np.cumsum([0, *map(len, elements)]), pa.int32())
        table = np.concatenate([*elements, np.zeros((0, 3), np.uint64)])
        made = [pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(table[:, k]).view(np.int64), kind)) for k, kind in ((0, pa.int64()),)]
        made += [pa.ListArray.from_arrays(at, pa.array(table[:, k].astype(np.int32))) for k in (1, 2)]
        yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), *made], ["text", "hashes", "starts", "ends"])


def templates(parsed: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """(site, hash) of every template subtree; ``parsed`` has (site, page, hashes)."""
    pages = parsed.filter("site IS NOT NULL AND page IS NOT NULL")
    same = pages.groupBy("site", "page").agg(F.count(F.lit(1)).alias("rows"))
    sizes = same.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    # few pages are stored more than once; each of their rows counts as its share of one
    copies = common.stored(same.filter("rows > 1"), "copies")
    side = copies if copies.count() > BROADCAST_ROWS else F.broadcast(copies)
    each = pages.join(side, ["site", "page"], "left").select("site", F.explode(F.array_distinct("hashes")).alias("hash"), F.coalesce(1 / F.col("rows"), F.lit(1.0)).alias("share"))
    counts = each.groupBy("site", "hash").agg(F.round(F.sum("share")).alias("n")).filter(F.col("n") >= min_pages)
    return counts.join(sizes, "site").filter(F.col("n") >= min_share * F.col("pages")).select("site", "hash")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(row, host, text, n_removed) of each page; ``row`` holds the caller's columns but html."""
    spark, host = pages.sparkSession, host_of(F.col("url"))
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in pages.columns if c.lower() != "html"]
    parse_pages = F.arrow_udf(_parsed, T.StructType.fromDDL(PARSED)).asNondeterministic()  # so that the planner calls it once
    rows = pages.select(F.struct(*kept).alias("row"), host.alias("host"), F.xxhash64("html").alias("page"), F.col("html").isNull().alias("none"), parse_pages("html").alias("found"))
    rows = rows.withColumns({"site": F.when(F.col("host").isNotNull(), F.xxhash64("host")), "page": F.when(~F.col("none"), F.col("page"))})
    rows = common.stored(rows.select("row", "host", "site", "page", "found.*"), "parsed")
    found = common.stored(templates(rows.select("site", "page", "hashes"), min_pages, min_share), "templates")
    by_site = found.groupBy("site").agg(F.collect_list("hash").alias("template"))
    shared = None
    if found.count() <= BROADCAST_ROWS:
        shared = spark.sparkContext.broadcast({r["site"]: frozenset(r["template"]) for r in by_site.collect()})
        rows = rows.withColumn("template", F.lit(None).cast("array<long>"))
    else:
        rows = rows.join(by_site, "site", "left")

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        of: dict[int, frozenset[int]] = {} if shared is None else shared.value
        for site, template, text, hashes, starts, ends in batches:
            texts, counts = [], []
            for k, (own, x) in enumerate(zip(site.to_pylist(), text.to_pylist())):
                removed = of.get(own, frozenset()) if template[k].as_py() is None else frozenset(template[k].as_py())
                x, n = cut(x, list(zip(hashes[k].as_py(), starts[k].as_py(), ends[k].as_py())), removed) if x is not None else (None, 0)
                texts.append(x)
                counts.append(n)
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["text", "n_removed"])

    cut_pages = F.arrow_udf(run, T.StructType.fromDDL(RESULT)).asNondeterministic()
    return rows.select("row", "host", cut_pages("site", "template", "text", "hashes", "starts", "ends").alias("cut")).select("row", "host", "cut.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages")).select(F.col("row.page_id").alias("page_id"), F.col("row.url").alias("url"), "host", "text", "n_removed")
