"""Personal data: validated base matches, and identifiers discovered by bootstrapped contextual extraction.

Base matches (e-mail, IP, card, phone) are seeds, and so are opaque tokens that a credential's
name is assigned (kind secret).  Every identifier-like token (one with a digit or an @) and
every spaced run of digit groups is an instance; the words around it are its patterns.  On the
graph of patterns and instances, confidence is passed in rounds: a pattern is as good as the
share of its instances that are known to be of a kind, an instance as good as the noisy-or of
its patterns.  Instances that good patterns surround are added, if their shape fits: that of
the base kinds is given, that of secrets is whatever enough seeds have in common.  A secret is
one wherever its value stands.

Only DataFrame functions are used.  The texts are read once; what is shuffled are tokens with
their contexts, and counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolith.llm.common import materialise

_ALNUM = "".join(chr(c) for c in range(128) if chr(c).isalnum())
_LOCAL, _HOST = rf"[{_ALNUM}._%+\-]", rf"[{_ALNUM}\-]"
#: Equal to the plain patterns from left to right, without backtracking: a match starts where its run starts, or where
#: the last one ended.  Characters are listed one by one, which the regex engine looks up faster than ranges.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_ID = rf"{_ALNUM}._%+/:#\-"
TOKEN = rf"(?<![{_ID}@])(?=[{_ID}&&[^0-9]]*+[0-9@])[{_ID}@]++"
#: Digit groups joined by single spaces, dots, dashes or parentheses, such as "(171) 555-2028"; groups that go on as words end it.
_GROUP = rf"[0-9]++(?![{_ALNUM}_@%/:#])"
RUN = rf"(?<![{_ALNUM}._%+@\-])(?<![0-9][/:#])\+?\(?{_GROUP}(?:(?:[.-]|\x20?[()]\x20?|\x20){_GROUP})*+"
#: Rounds; seeds that a pattern or a shape needs; score that adds an instance; characters that an instance needs; characters of context.
ROUNDS, SUPPORT, CERTAIN, LEAST, AROUND = 3, 3, 0.8, 6, 96
#: Seeds of secrets: what stands before them, and what they look like.  Lower case only; patterns know no case.
WORDS = ("token", "secret", "password", "passwd", "(?:api|access|private)[_-]?key")
OPAQUE = r"\A(?=(?:[^0-9]*+[0-9]){4})(?=(?:[^A-Za-z]*+[A-Za-z]){4})[A-Za-z0-9+/_=-]{20,}\z"
#: What a credential's name is assigned: an opaque token, or a shorter one of letters and digits, such as a password.
SEED = rf"{OPAQUE}|\A(?=[^0-9]*+[0-9])(?=[^A-Za-z]*+[A-Za-z])[A-Za-z0-9_%+#-]{{8,}}\.?\z"
KINDS = (*PATTERNS, "secret")


def assigned(words: tuple[str, ...] = WORDS) -> str:
    """What stands right before a seed: one of the words, perhaps as the last part of a name, and a sign of assignment."""
    return rf"(?:\A|[^\p{{L}}])(?:[a-z]+[_-])*(?:{'|'.join(words)})[\x22']?\x20*[:=]\x20*[\x22']?\z"


#: What a discovered token of each base kind must look like.
SHAPES = {"email": "@", "ip": r"[0-9][.:][0-9]+[.:][0-9]", "card": r"(?:[0-9][^0-9]?){12}", "phone": r"(?:[0-9][^0-9]?){7}"}


#: Matches of one block of the prefix sums that place them.
STRIDE = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of start, end (code points), value, left and right (up to AROUND characters around).

    Positions are sums of lengths, by blocks of STRIDE matches: a text of n matches takes n * STRIDE steps at most.
    """

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda acc, x: acc + x.gap + x.size)

    def placed(cells: Column) -> Column:
        def blocks(sums: Column) -> Column:
            def at(x: Column, i: Column) -> Column:
                block = F.floor(i / STRIDE).cast("int")
                begin = F.get(sums, block) + total(F.slice(cells, block * STRIDE + 1, i % STRIDE)) + x.gap
                return F.struct(begin.alias("start"), (begin + x.size).alias("end"), x.value.alias("value"), x.left.alias("left"), x.right.alias("right"))

            return F.transform(cells, at)

        last = F.floor((F.size(cells) - 1) / STRIDE).cast("int")
        own = F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(cells, b * STRIDE + 1, F.lit(STRIDE))))
        before = lambda sums: F.transform(sums, lambda _, b: F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0), lambda acc, x: acc + x))
        return let(let(own, before), blocks)

    def cells(both: Column) -> Column:
        n = F.size(both.found)
        lefts = F.zip_with(F.slice(both.pieces, F.lit(1), n), both.found, lambda p, f: F.struct(F.length(p).alias("gap"), F.length(f).alias("size"), f.alias("value"), F.right(p, F.lit(AROUND)).alias("left")))
        return F.zip_with(lefts, F.slice(both.pieces, F.lit(2), n), lambda x, p: F.struct(x.gap.alias("gap"), x.size.alias("size"), x.value.alias("value"), x.left.alias("left"), F.left(p, F.lit(AROUND)).alias("right")))

    none = F.array().cast("array<struct<start: int, end: int, value: string, left: string, right: string>>")
    found = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return let(found, lambda both: F.when(F.size(both.found) > 0, let(cells(both), placed)).otherwise(none))


def _luhn(digits: Column) -> Column:
    mirrored = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(mirrored, i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"\A{BYTE}(?:\.{BYTE}){{3}}\z")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)


def _test(kind: str) -> Callable[[Column], Column]:
    return lambda x: _valid(kind, x.value)


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda x: x.kind == kind


def base_spans(text: Column) -> dict[str, Column]:
    """By kind: array of start, end of the valid base matches of a text."""
    needs = {"email": text.contains("@"), "phone": text.contains("+")}
    out = {}
    for kind, pattern in PATTERNS.items():
        kept = F.filter(matches(text, pattern), _test(kind))
        spans = F.transform(kept, lambda x: F.struct(x.start.alias("start"), x.end.alias("end")))
        out[kind] = F.when(needs.get(kind, text.rlike("[0-9]")), spans).otherwise(F.array().cast("array<struct<start: int, end: int>>"))
    return out


def _joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x.start.alias("start"), x.end.alias("end")))


def _cells(text: Column, words_of_seeds: tuple[str, ...]) -> Column:
    """Tokens and spaced runs: array of start, end, value, the words before and the word after."""
    # Runs that are one token already are left out.
    spaced = F.filter(matches(text, RUN), lambda x: x.value.rlike(r"[0-9][\x20()]+[0-9]"))
    found = F.filter(F.concat(matches(text, TOKEN), spaced), lambda x: F.length(x.value) >= LEAST)
    words = lambda c: F.split(F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, "[0-9]+", "9")), r"\s+", " ")), " ")

    def cell(x: Column) -> Column:
        seed = x.left.rlike(assigned(words_of_seeds)) & x.value.rlike(SEED)
        return F.struct(x.start.alias("start"), x.end.alias("end"), x.value.alias("value"), F.slice(F.reverse(words(x.left)), 1, 3).alias("before"), words(x.right)[0].alias("after"), seed.alias("seed"))

    kind = "array<struct<start: int, end: int, value: string, before: array<string>, after: string, seed: boolean>>"
    return F.when(text.rlike("[0-9@]"), F.transform(found, cell)).otherwise(F.array().cast(kind))


def _instances(marks: DataFrame) -> DataFrame:
    """(key, start, end, value, kind or null, pattern) of marks (key, base, cells)."""
    own = marks.filter(F.size("cells") > 0).select("key", F.explode("cells").alias("x")).select("key", "x.*")
    last = lambda n: F.concat_ws(" ", F.reverse(F.slice("before", 1, n)))
    contexts = F.array(
        F.when(F.size("before") >= 2, F.concat(F.lit("2:"), last(2))),
        F.when(F.size("before") >= 3, F.concat(F.lit("3:"), last(3))),
        F.concat(F.lit("r:"), last(1), F.lit("|"), F.col("after")),
    )
    own = own.select("key", "start", "end", "value", "seed", F.filter(contexts, lambda c: c.rlike(r"\p{L}{3}")).alias("patterns"))
    # Which tokens touch a base span: both meet in the stretches of 64 characters that they cover.
    cover = lambda a, b: F.explode(F.sequence(F.floor(a / 64), F.floor((b - 1) / 64))).alias("stretch")
    spans = marks.filter(F.size("base") > 0).select("key", F.explode("base").alias("b")).select("key", "b.kind", F.col("b.start").alias("s"), F.col("b.end").alias("e")).distinct()
    spans = spans.select("*", cover(F.col("s"), F.col("e")))
    # Repeated rows meet once.
    places = own.select("key", "start", "end").distinct().select("*", cover(F.col("start"), F.col("end")))
    touched = places.join(spans.hint("merge"), ["key", "stretch"]).filter("s < end and e > start").groupBy("key", "start", "end").agg(F.min("kind").alias("kind"))
    kind = F.coalesce("kind", F.when(F.col("seed"), "secret"))
    return own.join(touched.hint("merge"), ["key", "start", "end"], "left").select("key", "start", "end", "value", kind.alias("kind"), F.explode_outer("patterns").alias("pattern"))


def _shape(value: Column) -> Column:
    """Alphabet and length of an opaque token."""
    return F.concat(F.when(value.rlike(r"\A(?:[0-9a-f]+|[0-9A-F]+)\z"), "hex").when(value.rlike(r"\A[0-9A-Za-z]+\z"), "letters").otherwise("marks"), F.length(value).cast("string"))


def discovered(marks: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(key, kind, start, end) of secrets and of what bootstrapping finds in marks (key, base, cells) beside the base spans."""
    seen = materialise(_instances(marks), "instances")
    edges = materialise(seen.filter("pattern is not null").groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "graph", few=True)
    known = materialise(seen.filter("kind is not null").groupBy("value").agg(F.max("kind").alias("kind")).withColumn("score", F.lit(1.0)), "known", few=True)
    totals = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    shapes = known.filter("kind = 'secret'").groupBy(_shape(F.col("value")).alias("shape")).agg(F.count("*").alias("n")).filter(F.col("n") >= SUPPORT).select("shape", F.lit(True).alias("common"))
    # What may still be found: instances without a kind, each with the kinds that its shape allows.
    looks = F.array(*(F.when(F.regexp_replace("value", r"[\x20()]+", " ").rlike(shape), kind) for kind, shape in SHAPES.items()), F.when(F.col("common") & F.col("value").rlike(OPAQUE), "secret"))
    fresh = edges.filter("kind is null").select("pattern", "value").join(known.select("value").hint("merge"), "value", "left_anti")
    fresh = fresh.withColumn("shape", _shape(F.col("value"))).join(shapes.hint("merge"), "shape", "left").select("pattern", "value", F.explode(F.array_compact(looks)).alias("kind"))
    fresh = materialise(fresh, "fresh", few=True)
    scores = known
    for _ in range(rounds):
        rated = edges.select("pattern", "value").join(scores.hint("merge"), "value").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count_if(F.col("score") > 0.5).alias("support"))
        good = rated.filter(F.col("support") >= SUPPORT).join(totals.hint("merge"), "pattern").select("pattern", "kind", (F.col("mass") / (F.col("n") + 1)).alias("trust"))
        heard = fresh.join(good.hint("merge"), ["pattern", "kind"]).groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("trust") * 0.999)))).alias("score"))
        scores = materialise(known.union(heard.select("value", "kind", "score")), "scores", few=True)
    # Values of the base kinds are judged by the base rules where they stand; a secret is one everywhere.
    best = scores.filter(F.col("score") >= CERTAIN).groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("found"))
    best = best.join(known.filter("kind <> 'secret'").select("value").hint("merge"), "value", "left_anti")
    found = seen.filter("kind is null or kind = 'secret'").select("key", "start", "end", "value").distinct().join(best.hint("merge"), "value")
    # A token inside a run, or a part that overlaps one, is not found twice.
    earlier = Window.partitionBy("key").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("until", F.max("end").over(earlier)).filter("until is null or start >= until")
    return found.select("key", F.col("found").alias("kind"), "start", "end")


def extract(docs: DataFrame, words: tuple[str, ...] = WORDS, rounds: int = ROUNDS) -> DataFrame:
    """Each row's doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (string), n_secret, n_spans and found (array of kind, start, end).

    The first four counts and base_sha256 are of base spans, spans and found are all spans by kind (secrets last)
    and start; n_secret counts secrets, n_spans all spans.  Null and empty texts have no spans.  Rows of equal
    doc_id and text (null ids too) get equal results; every row stays one row.  Positions are code points, ends
    exclusive.  words: what names a seed of kind secret; a seed has 8 characters at least, with a digit and a letter.  What is discovered
    beside them looks like a seed of 20 characters or more.  Discovered spans never touch base spans.  Instances have LEAST characters at least, and see
    AROUND characters on either side.  Extra columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("of")).alias("key"), text.alias("text"))
    rows = own.select("key", *(c.alias(k) for k, c in base_spans(F.col("text")).items()), _cells(F.col("text"), words).alias("cells"))
    # Written: the only pass over the texts.
    marks = materialise(rows, "marks")
    base = F.concat(*(_named(F.col(k), k) for k in PATTERNS))
    more = discovered(marks.select("key", base.alias("base"), "cells"), rounds)
    more = more.groupBy(F.col("key").alias("at")).agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("more"))
    out = marks.select("key", *PATTERNS, base.alias("base")).join(more.hint("merge"), F.col("key") == F.col("at"), "left")
    added = F.coalesce("more", F.array().cast("array<struct<kind: string, start: int, end: int>>"))
    every = F.concat(*(F.array_sort(F.concat(*([_named(F.col(k), k)] if k in PATTERNS else []), F.filter(added, _of_kind(k)))) for k in KINDS))
    return out.select(
        F.col("key.id").alias("doc_id"),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        F.size(F.filter(added, _of_kind("secret"))).cast("long").alias("n_secret"),
        F.size(every).cast("long").alias("n_spans"),
        every.alias("found"),
    )
