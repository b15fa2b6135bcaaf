"""Main-text extraction by minimum cut.

A page is cut into text blocks.  A linear classifier over a block's tag, length and links gives
it a bounded cost for either label, its capacities from source and to sink; elements that speak
for or against content (article, nav, class words) are nodes with capacities of their own, as
many times as they have blocks, so that only the average of their blocks can outweigh them.
Smoothness edges tie each block to the nearest such element, that element to the next one
around it, neighbouring blocks by their distance in the DOM, and blocks to the last one of
their kind in the same container.  The maximum flow's cut separates content from boilerplate:
a short paragraph is content in an article or between long ones, whatever its own sign.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolith.llm.common import map_arrow

MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>?""", re.S)
NAMED = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PARTS = re.compile(r"[^a-z]+")
# Elements by their part in a page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "object", "svg", "canvas", "select", "option", "button", "audio", "video", "datalist"}
#: Of these a missing end tag hides the rest of the page; the others then hide nothing.
OPAQUE = {"script", "style", "textarea", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Log odds of content that an element has for each of its blocks.  A class or id word counts if all of a name's parts do,
# neutral ones apart: "cookie-notice" and "site-footer" count, "no-sidebar" and "legal-analysis" do not.
ELEMENTS = {"article": 3.0, "main": 3.0, "nav": -3.0, "menu": -3.0, "footer": -3.0, "aside": -3.0, "dialog": -3.0, "form": -3.0, "head": -6.0}
ROLES = {"main": 3.0, "article": 3.0, "navigation": -3.0, "banner": -3.0, "contentinfo": -3.0, "complementary": -3.0, "search": -3.0, "dialog": -3.0, "alertdialog": -3.0, "menu": -3.0, "menubar": -3.0}
#: A form right under the body often holds the whole page.
WHOLE_FORM, HEADER, HIDDEN, CLEAR, VAGUE, GOOD = -0.5, -3.0, -6.0, -3.0, -1.0, 2.0
CLEAR_WORDS = set("ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr popup newsletter subscribe signup signin login sidebar nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments reply replies disqus pager pagination".split())
VAGUE_WORDS = set("promo promotion banner notice notices alert alerts modal overlay subscription side menu header topbar share sharing social related recommended recommendations respond discussion widget toolbar copyright legal disclaimer search tags".split())
GOOD_WORDS = set("article content entry main post story".split())
NEUTRAL = GOOD_WORDS | set("area bar block body bottom box buttons container form global group holder inner items js left links list page panel posts primary right row secondary section site slot small text top unit widgets wrap wrapper".split())
# A block's own log odds: base, paragraphs and headings, length from short to long (at FULL characters), all text linked.
BASE, PARAGRAPH, HEADING, SHORT, LONG, FULL, STEP, LINKS = -0.3, 0.5, 0.6, -1.2, 1.5, 240, 24, -1.0
# Edges: block to its element, element to the next around it, neighbours of one kind and of two, the last of a kind in a container.
HOLD, UP, TIE, UNLIKE, SAME = 2.6, 1.5, 1.2, 0.4, 0.6


@dataclass(slots=True)
class Block:
    """Neighbouring texts that nothing tells apart: one node of the graph."""

    texts: list[str]
    weight: float
    element: int  # the nearest element that has evidence, or -1
    container: int
    tag: str
    depth: int
    low: int  # the lowest depth since the block before


def _named(value: str) -> float:
    """Evidence of one class or id name."""
    parts = [x for x in PARTS.split(value) if x]
    core = [x for x in parts if x not in NEUTRAL]
    if not core:
        return GOOD if any(x in GOOD_WORDS for x in parts) and not {"list", "links", "items", "posts"} & set(parts) else 0.0
    if all(x in CLEAR_WORDS or x in VAGUE_WORDS for x in core):
        return CLEAR if any(x in CLEAR_WORDS for x in core) else VAGUE
    return 0.0


def evidence(tag: str, attributes: str, inside: bool, under: str) -> float:
    """Log odds of content of an element itself; the most telling of tag, role, class and id counts, boilerplate before content."""
    found = [WHOLE_FORM if tag == "form" and under in ("", "body", "html") else ELEMENTS.get(tag, 0.0)]
    if tag == "header" and not inside:
        found.append(HEADER)
    for m in NAMED.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role":
            found.append(ROLES.get(value.strip(), 0.0))
        elif name in ("class", "id"):
            # Classes of the whole page say how it looks, not what is in it; ids in an article are anchors, named by its topics.
            if tag not in ("body", "html"):
                found += (0.0 if name == "id" and inside and x == VAGUE else x for x in map(_named, value.split()))
        elif name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            found.append(HIDDEN)
    return min(found) if min(found) < 0 else max(found)


def own_weight(tag: str, chars: int, linked: int) -> float:
    """A block's own log odds of content, in steps of its length and of its share of linked text."""
    weight = BASE + LINKS * round(10 * linked / max(chars, 1)) / 10
    if tag in HEADINGS:
        return weight + HEADING
    return weight + (PARAGRAPH if tag in ("p", "blockquote", "pre") else 0.0) + SHORT + (LONG - SHORT) * (min(chars, FULL) // STEP) / (FULL // STEP)


def parse(html: str) -> tuple[list[Block], list[tuple[float, int]]]:
    """Blocks in page order, and the elements with evidence: log odds, and the next such element around it or -1."""
    blocks: list[Block] = []
    elements: list[tuple[float, int]] = []
    # An open element: tag, nearest element with evidence, index of the nearest block element, inside an article, its number.
    stack: list[tuple[str, int, int, bool, int]] = [("", -1, 0, False, 0)]
    opened: dict[str, int] = {}
    endless: set[str] = set()
    texts: list[str] = []
    linked = number = low = at = 0
    place: tuple[int, str, int, int] = (-1, "", 0, 0)

    def flush() -> None:
        nonlocal linked, low
        if texts:
            text = " ".join("".join(texts).split())
            texts.clear()
            if text:
                element, tag, container, depth = place
                weight = own_weight(tag, len(text), min(linked, len(text)))
                last = blocks[-1] if blocks else None
                if last and (last.element, last.container, last.tag, last.weight, last.depth) == (element, container, tag, weight, depth) and low >= depth - 1:
                    last.texts.append(text)
                else:
                    blocks.append(Block([text], weight, element, container, tag, depth, min(low, depth)))
                low = depth
        linked = 0

    def leave(k: int) -> None:
        nonlocal low
        while len(stack) > k:
            opened[stack.pop()[0]] -= 1
        low = min(low, len(stack) - 1)

    while at < len(html):
        m = MARK.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            if not texts:
                top = stack[-1]
                near = stack[top[2]]
                place = (top[1], near[0], stack[top[2] - 1][4] if top[2] else 0, top[2])
            if "&" in text:
                text = unescape(text)
            texts.append(text)
            if opened.get("a"):
                linked += len(text)
        if not m:
            break
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        if closing:
            if opened.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                leave(k)
            continue
        if tag in RAW:
            if tag not in OPAQUE and (attributes.endswith("/") or tag in endless):
                continue
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            if end or tag in OPAQUE:
                at = end.end() if end else len(html)
            else:
                endless.add(tag)
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:
            closed = CLOSES.get(tag, ())
            while stack[stack[-1][2]][0] == "p" or stack[stack[-1][2]][0] in closed:
                leave(stack[-1][2])
        _, element, near, inside, _ = stack[-1]
        if tag in BLOCK or attributes:
            odds = evidence(tag, attributes, inside, stack[-1][0])
            if odds:
                elements.append((odds, element))
                element = len(elements) - 1
        number += 1
        stack.append((tag, element, len(stack) if tag in BLOCK else near, inside or tag in ("article", "main"), number))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return blocks, elements


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes on the source's side of a minimum cut (those that the residual graph reaches), by Dinic's algorithm.

    source, sink: capacities from and to the terminals by node; edges: symmetric capacities between nodes.
    """
    n = len(source)
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]
    s, t, tiny = n, n + 1, 1e-9

    def edge(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for k in range(n):
        straight = min(source[k], sink[k])  # flows through the node alone
        if source[k] > straight:
            edge(s, k, source[k] - straight, 0.0)
        if sink[k] > straight:
            edge(k, t, sink[k] - straight, 0.0)
    for a, b, c in edges:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(room[e] for e in path)
                first = 0
                for k, e in reversed(list(enumerate(path))):
                    room[e] -= flow
                    room[e ^ 1] += flow
                    if room[e] <= tiny:
                        first = k
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(out[a]):
                path.append(out[a][turn[a]])
                a = to[path[-1]]
            elif path:
                level[a] = -2
                a = to[path.pop() ^ 1]
            else:
                break


def graph(blocks: list[Block], elements: list[tuple[float, int]]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Log odds by node (blocks, then elements) and the smoothness edges."""
    n = len(blocks)
    size = [0] * len(elements)
    edges: list[tuple[int, int, float]] = []
    last: dict[tuple[int, str], tuple[int, int]] = {}  # node and number of the last text of a kind
    place = 0
    for k, block in enumerate(blocks):
        if block.element >= 0:
            size[block.element] += len(block.texts)
            edges.append((k, n + block.element, HOLD * len(block.texts)))
        kind = (block.container, block.tag)
        if k:
            other = blocks[k - 1]
            away = block.depth + other.depth - 2 * min(block.low, block.depth, other.depth)
            alike = 1.0 if kind == (other.container, other.tag) else UNLIKE
            edges.append((k - 1, k, TIE * alike / (1 + max(away - 2, 0) / 2)))
        if kind in last and last[kind][0] < k - 1:
            edges.append((last[kind][0], k, SAME / (place - last[kind][1])))
        place += len(block.texts)
        last[kind] = (k, place - 1)
    # Elements come after those around them: inner ones pass on that they hold blocks at all.
    holds = [x > 0 for x in size]
    for k in range(len(elements) - 1, -1, -1):
        outer = elements[k][1]
        if holds[k] and outer >= 0:
            holds[outer] = True
            edges.append((n + k, n + outer, UP))
    return [b.weight * len(b.texts) for b in blocks] + [odds * max(m, 1) for (odds, _), m in zip(elements, size, strict=True)], edges


def main_text(html: str | None) -> str:
    """The content blocks of a page, one a line; empty if there are none."""
    blocks, elements = parse(html or "")
    if not blocks:
        return ""
    odds, edges = graph(blocks, elements)
    content = min_cut([max(x, 0.0) for x in odds], [max(-x, 0.0) for x in odds], edges)
    return "\n".join(text for block, kept in zip(blocks, content, strict=False) if kept for text in block.texts)


#: Paragraphs whose length may be measured by the page's own.
PLAIN = ("p", "blockquote", "pre")


def page_text(html: str | None) -> str:
    """main_text, or for a page that it leaves empty the cut with paragraphs measured by the page's own median instead of FULL.

    Short paragraphs are boilerplate beside long ones; where a page has no others they are what it says.  What elements and links
    tell stays as it is, so that menus, footers and forms stay out.
    """
    text = main_text(html)
    if text or not html:
        return text
    blocks, elements = parse(html)
    own_measure = [b.tag in PLAIN and (b.element < 0 or elements[b.element][0] > 0) for b in blocks]
    lengths = sorted(len(t) for b, x in zip(blocks, own_measure, strict=True) if x for t in b.texts)
    if not lengths:
        return ""
    middle = max(lengths[len(lengths) // 2], 1)
    for b, measured in zip(blocks, own_measure, strict=True):
        if measured and middle < FULL:
            own = sum(map(len, b.texts)) / len(b.texts)
            b.weight += (LONG - SHORT) * (min(own, middle) / middle - (min(int(own), FULL) // STEP) / (FULL // STEP))
    odds, edges = graph(blocks, elements)
    content = min_cut([max(x, 0.0) for x in odds], [max(-x, 0.0) for x in odds], edges)
    return "\n".join(text for block, kept in zip(blocks, content, strict=False) if kept for text in block.texts)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [page_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of each row; null and empty html give an empty text.

    Very long pages take time and memory in proportion to their length.
    Rows are handled one by one: repeated rows and null ids or urls pass through.  Character references are
    decoded, white space inside a block is one space, blocks are joined by one newline in page order.  Extra
    columns are ignored; an empty table gives no rows.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(own, _texts, "page_id long, url string, text string")
