"""Line dedup against an independent version: own pieces, own pairs, own patience diff."""

import random
import re
import time
from functools import cache

import pytest

from annolith.llm import linededup
from annolith.llm.linededup import dedup_lines, passages
from conftest_prose import prose

SPACE = " \t\n\v\f\r"


def split(text):
    """(piece, words, line) in order, and for each the text up to the next piece in its line."""
    out = []
    for n, line in enumerate(text.split("\n")):
        words = list(re.finditer(r"[^\x20\x09-\x0D]+", line))
        begin = 0
        for k, m in enumerate(words):
            nxt = words[k + 1] if k + 1 < len(words) else None
            if nxt is None or re.match(r"[A-ZÀ-ÖØ-Þ]", nxt[0]) or m[0][-1] in ".!?":
                own = words[begin : k + 1]
                until = nxt.start() if nxt else m.end()
                out.append((line[own[0].start() : m.end()], sum(-(-len(w[0].encode()) // 24) for w in own), n, line[own[0].start() : until]))
                begin = k + 1
    return out


def shortest(own, least):
    """(first, end) of the shortest run of `least` words from each piece on."""
    for k in range(len(own)):
        total = 0
        for end in range(k, len(own)):
            total += own[end][1]
            if total >= least:
                yield k, end + 1
                break


def longest_common(a, b):
    """A longest rising subsequence by dynamic programming over pairs that stand once; the one patience sorting finds."""
    once = [(k, b.index(x)) for k, x in enumerate(a) if x is not None and a.count(x) == 1 and b.count(x) == 1]

    @cache
    def best(k):
        return 1 + max((best(j) for j in range(k) if once[j][1] < once[k][1]), default=0)

    out, need = [], max((best(k) for k in range(len(once))), default=0)
    top = None
    for n in range(need, 0, -1):
        # Patience sorting ends each pile at its lowest card dealt before the next one.
        k = min((k for k in range(len(once)) if best(k) == n and (top is None or k < top and once[k][1] < once[top][1])), key=lambda k: once[k][1])
        out.append(once[k])
        top = k
    return dict(out[::-1])


def brute_align(a, b):
    found = longest_common(tuple(a), tuple(b))
    for (k, low), (end, high) in list(zip([(-1, -1), *found.items()], [*found.items(), (len(a), len(b))], strict=True)):
        if k >= 0:
            while k + 1 < end and low + 1 < high and a[k + 1] == b[low + 1]:
                k, low = k + 1, low + 1
                found[k] = low
        if end < len(a):
            while end - 1 > k and high - 1 > low and a[end - 1] == b[high - 1]:
                end, high = end - 1, high - 1
                found[end] = high
        for x in range(k + 1, end):
            spots = [y for y in range(low + 1, high) if b[y] == a[x] and a[x] is not None]
            if spots:
                found[x] = low = spots[0]
    return found


def brute_cut(a, b, least):
    """Positions of the later text's pieces (a) that go."""
    left, gone = [x[0] for x in a], set()
    for _ in range(linededup.PASSES):
        found, cut = brute_align(left, [x[0] for x in b]), set()
        group = []
        for k in [*sorted(found), len(a) + 99]:
            if group and (k - group[-1] > 3 or found[k] - k != found[group[-1]] - group[-1]):
                if sum(a[x][1] for x in group) >= least:
                    cut |= set(group)
                group = []
            group.append(k)
        if not cut:
            break
        gone |= cut
        left = [None if k in cut else x for k, x in enumerate(left)]
    # Whatever is left of any stretch of `least` words in a row that both hold.
    for i in range(len(a)):
        for j in range(len(b)):
            k = total = 0
            while i + k < len(a) and j + k < len(b) and a[i + k][0] == b[j + k][0]:
                total += a[i + k][1]
                k += 1
            if total >= least:
                gone |= set(range(i, i + k))
    return gone


def brute_line_dedup(texts, least=20):
    """id -> (text, words cut)."""
    own = {i: split(t or "") for i, t in texts.items()}
    first = {}
    for i in sorted(own):
        for a, b in shortest(own[i], least):
            first.setdefault(tuple(x[0] for x in own[i][a:b]), i)
    out = {}
    for i, text in texts.items():
        spans = {}
        for a, b in shortest(own[i], least):
            owner = first[tuple(x[0] for x in own[i][a:b])]
            if owner != i:
                spans.setdefault(owner, []).append((a, b, tuple(x[0] for x in own[i][a:b])))
        gone = set()
        for owner, found in spans.items():
            runs = {r for _, _, r in found}
            there = [(a, b) for a, b in shortest(own[owner], least) if tuple(x[0] for x in own[owner][a:b]) in runs]
            low, high = min(a for a, _, _ in found), max(b for _, b, _ in found)
            low, high = max(0, low - least), high + least
            gone |= {low + k for k in brute_cut(own[i][low:high], own[owner][max(0, min(a for a, _ in there) - least) : max(b for _, b in there) + least], least)}
        lines = []
        for n, line in enumerate((text or "").split("\n")):
            here = [k for k, x in enumerate(own[i]) if x[2] == n]
            if not here or not gone & set(here):
                lines.append(line)
            elif set(here) - gone:
                lead = line[: len(line) - len(line.lstrip(SPACE))]
                tail = line[len(line.rstrip(SPACE)) :]
                kept = "".join(own[i][k][3] for k in here if k not in gone)
                lines.append(lead + (kept.rstrip(SPACE) if here[-1] in gone else kept) + tail)
        out[i] = (text if not gone else "\n".join(lines), sum(own[i][k][1] for k in gone))
    return out


def check(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.text, r.words_cut) for r in dedup_lines(docs).collect()}
    want = brute_line_dedup(texts)
    assert got == want
    return {i: x[0] for i, x in got.items()}


def test_against_brute_force(spark):
    rng = random.Random(7)
    pool = [prose(200 + k, rng.choice([2, 6, 9, 15, 21, 30])).capitalize() + rng.choice([".", "", "!"]) for k in range(40)]
    texts = {}
    for i in range(120):
        parts = []
        while len(parts) < rng.randint(1, 14):
            at, n = rng.randrange(len(pool)), rng.choice([1, 1, 2, 4])
            parts += pool[at : at + n] if rng.random() < 0.6 else [prose(1000 + 50 * i + len(parts), rng.randint(1, 25))]
        texts[i] = "".join(x + rng.choice(["\n", " ", " ", "\n\n", "  "]) for x in parts)
    check(spark, texts)
    assert any(x[1] for x in brute_line_dedup(texts).values())


def test_long_owners_are_met_in_stretches(spark, monkeypatch):
    """A long first document with a licence at both ends, a passage across the border of two stretches, and copies of single runs."""
    monkeypatch.setattr(linededup, "STRETCH", 256)
    licence = "This licence is printed here. " + prose(900, 24).capitalize() + ". It ends so."
    body = [prose(2000 + k, 7).capitalize() + "." for k in range(700)]
    across = body[linededup.STRETCH - 4 : linededup.STRETCH + 4]
    texts = {1: "\n".join([licence, *body, licence])}
    texts |= {k: "\n".join([licence, *(prose(5000 + 40 * k + j, 9).capitalize() + "." for j in range(30)), *(across if k % 2 else []), licence]) for k in range(2, 12)}
    check(spark, texts)
    monkeypatch.setattr(linededup, "STRETCH", 2)
    check(spark, texts)


def test_driver_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check(spark, {r.doc_id: r.text for r in rows if r.text is not None})


def test_align_is_ordered():
    places = {7: [3], 8: [1], 9: [2], 6: [5]}
    assert linededup.align([7, 8, 9, 6], places, [0, 8, 9, 7, 0, 6]) == {1: 1, 2: 2, 3: 5}
    assert linededup.align([4, 8, 4], {4: [0, 4], 8: [1]}, [4, 8, 0, 0, 4]) == {0: 0, 1: 1, 2: 4}


def test_line_dedup(small):
    out = dedup_lines(small)
    assert out.columns == [*small.columns, "n_lines", "n_cut", "words_cut"]
    got = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    passage = prose(3, 40)
    assert passage in got[10].text and passage not in got[11].text
    assert got[11].text == prose(5, 9) + "\nother tail" and (got[11].n_cut, got[11].words_cut) == (1, 40)
    assert got[0].text == prose(1, 60) and got[1].text == "" and got[1].n_cut == 1
    for k in (2, 3, 4, 5, 6, 7, 8, 9, 12, 13):
        assert got[k].text == {r.doc_id: r.text for r in small.collect()}[k]
    assert [r.text for r in out.filter("doc_id is null").collect()] == [prose(1, 60)]
    assert out.count() == small.count()


def test_short_lines_repeated_often(spark):
    base = "\n".join(["Of it."] * 30 + [prose(3, 25)] + ["Of it."] * 30)
    texts = {1: base, 2: base, 3: "\n".join(["Of it."] * 40), 4: prose(3, 25) + "\nOf it.", 5: "Of it.\nOf it.\n" + prose(9, 12)}
    # Document 3 shares 30 lines in a row, over and over, with document 1.
    assert check(spark, texts) == {1: base, 2: "", 3: "", 4: "", 5: texts[5]}


def test_stanza_repeated_often(spark):
    stanza = "\n".join(prose(100 + k, 15) for k in range(4))
    owner = "\n".join([stanza] * 17)
    texts = {1: owner, 2: prose(8, 12) + "\n" + stanza, 3: "Of it.\n" + prose(9, 12)}
    assert check(spark, texts) == {1: owner, 2: prose(8, 12), 3: "Of it.\n" + prose(9, 12)}


def test_passages_in_other_order_and_repeated(spark):
    one, two = ("\n".join(prose(k, 15) for k in range(a, a + 4)) for a in (110, 120))
    texts = {0: two + "\n" + one, 1: one + "\n" + two, 2: f"Here.\n{one}\nThere.\n{one}"}
    assert check(spark, texts) == {0: texts[0], 1: "", 2: "Here.\nThere."}


@pytest.mark.parametrize("n", [12, 15])
def test_passage_with_several_owners(spark, n):
    """Lines that first appeared in other documents: the later of two documents that share them in a row loses them."""
    lines = [prose(k, n) for k in range(130, 133)]
    texts = {1: lines[0] + "\nElse.", 2: lines[1] + "\nMore.", 3: lines[2], 4: "\n".join(lines), 5: "\n".join(["Head.", *lines, "Tail."])}
    assert check(spark, texts) == texts | {5: "Head.\nTail."}


def test_passage_inside_longer_lines(spark):
    passage = ". ".join(prose(k, 14).capitalize() for k in range(150, 154)) + "."
    texts = {1: prose(160, 9) + " " + passage + "\nEnd.", 2: f"{prose(161, 7)} {passage} and then {prose(162, 5)}\n{passage}"}
    assert check(spark, texts) == {1: texts[1], 2: f"{prose(161, 7)} and then {prose(162, 5)}"}


def test_changed_piece_inside_a_block(spark):
    a = [prose(k, 9).capitalize() + "." for k in range(170, 178)]
    b = [*a[:3], "It is new.", *a[4:6], "So is this one.", a[7]]
    texts = {1: " ".join(a), 2: " ".join(b)}
    # The run of three pieces links the pair; the other two, over one changed piece, lie outside the stretch it spans.
    check(spark, texts)


def test_repeated_ids_and_rows(spark):
    one, two = prose(180, 30), prose(181, 30)
    rows = [(5, one), (5, two), (5, two), (9, two), (9, two), (7, one + "\n" + two), (None, one), (4, None)]
    got = [tuple(r) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text", "words_cut").collect()]
    want = [(5, one, 0), (5, two, 0), (5, two, 0), (9, "", 30), (9, "", 30), (7, "", 60), (None, one, 0), (4, None, 0)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_equal_lines_in_linear_time():
    own = [5] * 100_000
    began = time.perf_counter()
    assert len(passages(own, [3] * len(own), own, [3] * len(own), 20)) == len(own)
    back = list(range(20_000))
    assert len(passages(back[::-1], [25] * len(back), back, [25] * len(back), 20)) == len(back)
    assert time.perf_counter() - began < 20


def test_line_dedup_of_nothing(nothing):
    assert dedup_lines(nothing).count() == 0
