"""Main-text extraction: labels against an independent labelling by enumeration, whole-page cases, hostile pages."""

import itertools
import random
import time
from html.parser import HTMLParser

import pytest

from annolith.llm import htmlextract as H
from annolith.llm.htmlextract import graph, main_text, min_cut, parse

LONG = "word " * 60


class Plain(HTMLParser):
    """Blocks (text, tag, own element, container, path) of well-formed pages of div, article, nav, section, ul, li, p, h2 and a."""

    def __init__(self):
        super().__init__()
        self.path, self.blocks, self.number, self.odds, self.linked = [], [], 0, {}, 0
        self.open = None

    def handle_starttag(self, tag, attributes):
        self.number += 1
        odds = {"article": 3.0, "nav": -3.0, "aside": -3.0, "form": -1.5}.get(tag, 0.0)
        names = {"ad": -3.0, "share": -1.0, "content": 2.0, "no-sidebar": 0.0}
        odds = odds or names[dict(attributes).get("class", "no-sidebar")]
        if tag != "a":
            self.open = None
        self.path.append((tag, self.number))
        if odds:
            self.odds[self.number] = odds

    def handle_endtag(self, tag):
        if tag != "a":
            self.open = None
        self.path.pop()

    def handle_data(self, data):
        if not data.strip():
            return
        path = [x for x in self.path if x[0] != "a"]
        if self.open is None:
            self.open = {"text": "", "path": path, "linked": 0}
            self.blocks.append(self.open)
        self.open["text"] += data
        self.open["linked"] += len(data) if len(path) < len(self.path) else 0


def brute_text(html):
    """The cheapest labelling of all, by enumeration; ties go to boilerplate."""
    page = Plain()
    page.feed(html)
    holders = sorted({n for b in page.blocks for _, n in b["path"] if n in page.odds})
    names = [*range(len(page.blocks)), *(f"e{n}" for n in holders)]
    cost, edges, size = {}, [], {n: 0 for n in holders}
    last = {}
    for k, b in enumerate(page.blocks):
        tag, n = b["path"][-1][0], len(b["text"])
        odds = -0.3 - round(10 * b["linked"] / n) / 10 + (0.6 if tag == "h2" else (0.5 if tag == "p" else 0) - 1.2 + 2.7 * (min(n, 240) // 24) / 10)
        cost[k] = odds
        near = [n for _, n in b["path"] if n in page.odds]
        if near:
            size[near[-1]] += 1
            edges.append((k, f"e{near[-1]}", 2.6))
        edges += [(f"e{a}", f"e{c}", 1.5) for a, c in itertools.pairwise(near)]
        kind = (b["path"][-2][1] if len(b["path"]) > 1 else 0, tag)
        if k:
            other = page.blocks[k - 1]
            same = len([1 for x, y in zip(b["path"], other["path"], strict=False) if x == y])
            away = len(b["path"]) + len(other["path"]) - 2 * same
            edges.append((k - 1, k, 1.2 * (1.0 if kind == page.blocks[k - 1]["kind"] else 0.4) / (1 + max(away - 2, 0) / 2)))
        b["kind"] = kind
        if kind in last and last[kind] < k - 1:
            edges.append((last[kind], k, 0.6 / (k - last[kind])))
        last[kind] = k
    for n in holders:
        cost[f"e{n}"] = page.odds[n] * max(size[n], 1)
    edges = list({(a, b): (a, b, c) for a, b, c in edges if isinstance(a, str)}.values()) + [e for e in edges if not isinstance(e[0], str)]

    def total(side):
        return sum(max(-cost[x], 0) if side[x] else max(cost[x], 0) for x in names) + sum(c for a, b, c in edges if side[a] != side[b])

    sides = [dict(zip(names, x, strict=True)) for x in itertools.product([False, True], repeat=len(names))]
    best = min(total(s) for s in sides)
    side = min((s for s in sides if total(s) < best + 1e-9), key=lambda s: sum(s.values()))
    return "\n".join(" ".join(b["text"].split()) for k, b in enumerate(page.blocks) if side[k])


def random_page(rng):
    """Up to seven blocks in nested elements, no two neighbours alike in all that the classifier sees."""

    def text():
        return "x" * rng.choice([3, 30, 75, 130, 200, 300]) + str(rng.randint(0, 99))

    def inner(depth):
        out = []
        for _ in range(rng.randint(1, 2)):
            tag = rng.choice(["p", "p", "h2", "div", "section", "article", "nav"] if depth < 3 else ["p", "h2"])
            if tag in ("p", "h2"):
                link = rng.random() < 0.3
                out.append(f"<{tag}>{'<a>' if link else ''}{text()}{'</a>' if link else ''}</{tag}>")
            else:
                name = rng.choice(["ad", "share", "content", "no-sidebar"]) if tag in ("div", "section") else "no-sidebar"
                out.append(f'<{tag} class="{name}">{inner(depth + 1)}</{tag}>')
        return "".join(out)

    return f"<div>{inner(0)}{inner(0)}</div>"


def test_labels_against_enumeration():
    rng = random.Random(3)
    tried = moved = 0
    while tried < 60:
        page = random_page(rng)
        blocks, elements = parse(page)
        if len(blocks) + len(elements) > 10 or any(len(b.texts) > 1 for b in blocks):
            continue
        tried += 1
        assert main_text(page) == brute_text(page), page
        odds, _ = graph(blocks, elements)
        moved += any((x > 0) != (t in main_text(page).split("\n")) for x, b in zip(odds, blocks, strict=False) for t in b.texts)
    assert moved > 10


def test_joined_blocks_change_nothing():
    """Neighbours that nothing tells apart are one node: the labels are those of single nodes."""
    rng = random.Random(4)
    for _ in range(200):
        page = "<div>" + "".join(f"<p>{'x' * rng.choice([5, 5, 5, 90, 90, 300])}</p>" if rng.random() < 0.8 else "<h2>xx</h2>" for _ in range(9)) + "</div>"
        blocks, elements = parse(page)
        single = [H.Block([t], b.weight, b.element, b.container, b.tag, b.depth, b.low if k == 0 else b.depth - 1) for b in blocks for k, t in enumerate(b.texts)]
        odds, edges = graph(single, elements)
        kept = min_cut([max(x, 0.0) for x in odds], [max(-x, 0.0) for x in odds], edges)
        assert main_text(page) == "\n".join(b.texts[0] for b, y in zip(single, kept, strict=True) if y)


def test_cut_decides_labels(spark):
    """On whole pages many blocks have another label than their own sign, and none of the article is lost."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    moved = 0
    for page in pages:
        blocks, elements = parse(page.html)
        odds, _ = graph(blocks, elements)
        kept = set(main_text(page.html).split("\n"))
        moved += sum((x > 0) != (t in kept) for x, b in zip(odds, blocks, strict=False) for t in b.texts)
        article = page.html.partition("<article>")[2].partition("</article>")[0]
        outside = page.html.replace(article, "")
        assert set(main_text(article and f"<article>{article}</article>").split("\n")) == kept
        assert main_text(outside) == ""
    assert moved > len(pages)


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<body class="no-sidebar single-post"><p>First para.</p><p>{LONG}</p></body>', f"First para.\n{LONG.strip()}"),
        (f'<body class="page search-enabled"><p>{LONG}</p></body>', LONG.strip()),
        ('<article class="post has-comments"><p>Short.</p></article>', "Short."),
        ('<article id="legal-analysis"><p>Short.</p></article>', "Short."),
        (f'<article><p>{LONG}</p><section id="social"><h2>Social</h2><p>Of it.</p></section></article>', f"{LONG.strip()}\nSocial\nOf it."),
        ("<article><p>1</p><svg/><p>2</p><iframe src='x'/><p>3</p></article>", "1\n2\n3"),
        ("<article><p>1 <math><mi>x</mi><mo>=</mo></math> 2</p></article>", "1 x= 2"),
        (f"<article><p>{LONG}</p><ul><li><a href=x>Source one</a></li><li><a href=y>Two</a></li></ul></article>", f"{LONG.strip()}\nSource one\nTwo"),
        (f'<article><p>{LONG}</p><div class="share-buttons"><a href=x>Tell friends</a></div><p>End.</p></article>', f"{LONG.strip()}\nEnd."),
        (f'<main><p>{LONG}</p></main><div id="comments" class="post-comments"><p>{LONG}</p><p>{LONG}</p></div>', LONG.strip()),
        (f'<div class="cookie-notice">{LONG}</div><div class="entry-content"><p>Of it.</p></div><div class="site-footer">{LONG}</div>', "Of it."),
        (f"<body><form id=aspnet><div><p>{LONG}</p><p>Of it.</p><p>{LONG}</p></div></form></body>", f"{LONG.strip()}\nOf it.\n{LONG.strip()}"),
        (f"<article><p>{LONG}</p><form><p>Your mail address for our letter of the week: <input></p></form></article>", LONG.strip()),
        ("<form><p>Name <input> <select><option>a</option></select></p></form>", ""),
        (f"<article><button>Open<p>{LONG}</p></article>", f"Open\n{LONG.strip()}"),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<body>" + "<p>word word</p>" * 300 + "</body>", "\n".join(["word word"] * 300)),
        ("<nav><a href=x>Home</a></nav><p>One line.</p><p>Two lines.</p><footer>me</footer>", "One line.\nTwo lines."),
        ('<div class="cookie-notice"><p>We bake.</p></div><p>So short.</p>', "So short."),
        ("<form><p>Name <input></p></form>", ""),
        ("<ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul>", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_pages_of_short_paragraphs(page, want):
    """A page without long paragraphs is measured by its own."""
    assert H.page_text(page) == want


@pytest.mark.parametrize(
    "page, cut, rule",
    [
        # A vague name on long paragraphs: they outvote it together; one alone with short ones does not.
        (f'<div class="notice"><p>{LONG}</p><p>{LONG}</p></div>', f"{LONG.strip()}\n{LONG.strip()}", ""),
        (f'<div class="notice"><p>{LONG}</p><p>a</p><p>b</p><p>c</p></div>', "", ""),
        # Short paragraphs between long ones, without any telling element.
        (f"<p>{LONG}</p><p>A short one.</p><p>{LONG}</p>", f"{LONG.strip()}\nA short one.\n{LONG.strip()}", f"{LONG.strip()}\n{LONG.strip()}"),
        # A vague part inside an article that holds the article's own kind of text.
        (f'<article><p>{LONG}</p><div class="related"><p>{LONG}</p></div><p>{LONG}</p></article>', "\n".join([LONG.strip()] * 3), "\n".join([LONG.strip()] * 2)),
    ],
)
def test_the_cut_against_the_nearest_element(page, cut, rule):
    """Pages on which the cut and the rule `a block takes its nearest telling element's label, else its own sign` differ, or agree."""
    blocks, elements = parse(page)
    nearest = [(elements[b.element][0] if b.element >= 0 else b.weight) > 0 for b in blocks]
    assert main_text(page) == cut
    assert "\n".join(t for b, kept in zip(blocks, nearest, strict=True) if kept for t in b.texts) == rule


HOSTILE = {
    "inline": "<b>" * 300_000 + "<br>x" * 200_000,
    "items": "<b>" * 300_000 + "<li>x" * 150_000,
    "deep": "<div>" * 300_000 + "x",
    "buttons": "<button>" * 250_000,
    "quotes": '<a href="' * 200_000,
    "mixed": "<div>x</div><p>xyz y</p>" * 80_000,
    "paragraphs": "<p>word word</p>" * 60_000,
    "classes": '<div class="ad">x</div><div class="content">y</div>' * 40_000,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_pages(name):
    began = time.perf_counter()
    H.page_text(HOSTILE[name])
    assert time.perf_counter() - began < 15
