"""Benchmark decontamination as a prefix-filtered containment join.

A benchmark item's windows (ITEM_WORDS consecutive words, or the whole item if it is
shorter) are the sets to contain, their tokens the shingles of SHINGLE consecutive words.
Shingles are ordered by their frequency over all documents; a window can only be contained
where its rarest shingle stands, so that shingle is the whole prefix that must be joined
(containment 1: prefix length 1).  The shingle's place in the window fixes where the window
would start, the document's length bounds it, and the words standing there are compared one
by one.  Common words make few common shingles: windows of a dozen frequent words still have
prefixes of their own.

Only DataFrame functions are used.  The documents are scanned twice whatever the benchmark's
size, once to count shingles and once to mark where rarest shingles may stand.  Both scans know
the shingles by a bitmap of SLOTS bits alone, which is all that is broadcast; what passes it meets
the benchmark's shingles or windows in joins that shuffle.  Shingles travel as 64-bit hashes: two
that share one only add up their counts and candidates, which the comparison of words settles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolith.llm.common import lower_ascii, materialise

ITEM_WORDS, SHINGLE = 10, 3
#: Bits of the bitmap that stands for a set of shingles: at most SLOTS / 64 rows of it are broadcast (some 10 MB).
SLOTS = 1 << 24
#: ASCII letters and digits and all non-ASCII characters make words.  The others are listed one by one: the regex
#: engine looks those up in a table, ranges of a negated class cost twenty times as much.
WORD = f"[^{''.join(f'\\x{c:02X}' for c in range(128) if not chr(c).isalnum())}]+"


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, size: int = ITEM_WORDS) -> DataFrame:
    """(item_id, window): each item's distinct windows as arrays of lower-cased words; null and wordless items have none."""
    words = items.select("item_id", word_array(lower_ascii(F.col("text"))).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return words.select("item_id", "words", F.explode(starts).alias("at")).select("item_id", F.slice("words", F.col("at"), size).alias("window")).distinct()


def _slot(token: Column) -> Column:
    return token.bitwiseAND(F.lit(SLOTS - 1))


def _bitmap(tokens: DataFrame) -> DataFrame:
    """(cell, bits): the slots of tokens (token) by 64."""
    slots = tokens.select(_slot(F.col("token")).alias("slot")).select(F.shiftright("slot", 6).alias("cell"), F.col("slot").bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    return slots.groupBy("cell").agg(F.bit_or(bit).alias("bits"))


def _known(rows: DataFrame, bitmap: DataFrame) -> DataFrame:
    """rows (with token) and known: whether the bitmap has the token's slot (null and false: no)."""
    slot = _slot(F.col("token"))
    both = rows.withColumn("cell", F.shiftright(slot, 6)).join(F.broadcast(bitmap), "cell", "left")
    return both.withColumn("known", F.getbit("bits", slot.bitwiseAND(F.lit(63)).cast("int")) == 1).drop("cell", "bits")


def _token(words: str, pos: Column, length: int) -> Column:
    """Hash of the shingle of so many words from place pos on (null where the array ends before).

    Words are lower-cased in full, which A-Z lowering implies and which is cheaper by far; comparisons are exact.
    """
    own = [F.lower(F.get(words, pos + k)) for k in range(length)]
    return F.when(pos + length <= F.size(words), F.xxhash64(F.lit(length), *own))


def _spoken(docs: DataFrame) -> DataFrame:
    """(doc_id, words, pos): every word's place in every document; one row with nulls where there is none.

    Outer explodes: the others make the optimiser filter by the array's size, which runs the regex again.
    """
    words = docs.select("doc_id", word_array(F.col("text").cast("string")).alias("words"))
    return words.select("doc_id", "words", F.posexplode_outer("words").alias("pos", "spoken")).drop("spoken")


def _shingled(places: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, words, pos, heads, token): the shingle of each length at each place (null where it does not fit).

    heads: true in one row of each document.
    """
    tokens, first = [_token("words", F.col("pos"), n) for n in lengths], F.coalesce(F.col("pos") == 0, F.lit(True))
    if len(tokens) == 1:
        return places.select("doc_id", "words", "pos", first.alias("heads"), tokens[0].alias("token"))
    each = places.select("doc_id", "words", "pos", F.posexplode(F.array(*tokens)).alias("which", "token"))
    return each.select("doc_id", "words", "pos", (first & (F.col("which") == 0)).alias("heads"), "token")


def occurrences(docs: DataFrame, items: DataFrame, size: int = ITEM_WORDS, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Where windows occur: (doc_id, start, length, window_id); (window_id, item_id); and (doc_id, n_words) of every row of docs."""
    owned = materialise(item_windows(items, size).withColumn("window_id", F.sha2(F.array_join("window", " "), 256)), "windows")
    windows = owned.select("window_id", "window").distinct()
    # Windows shorter than a shingle are one themselves.
    lengths = sorted(r["n"] for r in windows.select(F.least(F.size("window"), F.lit(shingle)).alias("n")).distinct().collect()) or [shingle]  # `shingle` rows at most
    own = F.lit(None).cast("long")
    for n in lengths:
        own = F.when(F.least(F.size("window"), F.lit(shingle)) == n, _token("window", F.col("at"), n)).otherwise(own)
    ranked = windows.select("window_id", "window", F.posexplode("window").alias("at", "word")).withColumn("token", own).filter("token is not null").drop("word")
    vocabulary = materialise(ranked.select("token").distinct(), "vocabulary")
    # Counts of shingles whose slot the benchmark uses, over all documents; few reach the shuffle more than once a task.
    counted = _known(_shingled(_spoken(docs), lengths).select("token"), _bitmap(vocabulary)).filter("known").groupBy("token").agg(F.count("*").alias("n"))
    rarity = materialise(vocabulary.join(counted, "token"), "rarity")
    # The rarest shingle of each window with the words it must stand among; one that no document holds rules its windows out.
    prefix = ranked.join(rarity, "token", "left").groupBy("window_id", "window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "at")).alias("first"))
    prefix = materialise(prefix.filter("first.n > 0").select("window_id", "window", F.col("first.token").alias("token"), F.col("first.at").alias("at")), "prefixes")
    # One scan marks the places of prefix shingles, with the words around them, and each document's first word for its length.
    begin = F.greatest(F.col("pos") - (size - 1), F.lit(0))
    marked = _known(_shingled(_spoken(docs), lengths), _bitmap(prefix.select("token"))).filter("known or heads")
    known = F.coalesce("known", F.lit(False))
    around = F.when(known, F.slice("words", begin + 1, 2 * size - 1))
    marked = materialise(marked.select("doc_id", F.coalesce(F.size("words"), F.lit(0)).alias("n_words"), "pos", "heads", "token", known.alias("known"), begin.alias("begin"), around.alias("around")), "places")
    start, length = F.col("pos") - F.col("at"), F.size("window")
    met = marked.filter("known").join(prefix, "token").filter((start >= 0) & (start + length <= F.col("n_words")))
    same = lower_ascii(F.array_join(F.slice("around", start - F.col("begin") + 1, length), " ")) == F.array_join("window", " ")
    found = met.filter(same).select("doc_id", start.alias("start"), length.alias("length"), "window_id")
    every = marked.filter("heads").select("doc_id", F.greatest("n_words", F.lit(0)).cast("long").alias("n_words"))
    return found, owned.select("window_id", "item_id").distinct(), every


def _key(doc_id: Column, text: Column) -> Column:
    """Rows of equal id and text are one document."""
    return F.struct(doc_id.cast("long").alias("doc_id"), F.xxhash64(text.cast("string")).alias("of"))


def contamination(docs: DataFrame, items: DataFrame, size: int = ITEM_WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the item ids found.

    Text is lower-cased in A-Z only; null text has no words and no hits.  A null doc_id is judged with its
    own text like any other row of that id.  Rows that share doc_id and text share their hits (identical rows
    get identical results).  Null or wordless items match nothing; items with equal windows are all reported;
    the windows of an item with a null id hit words, but it has no id to be counted or listed by.
    Extra columns of either table are ignored.
    """
    return _judged(docs, items, size).drop("key")


def _judged(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """contamination with the key of the row it judges."""
    keyed = docs.select(_key(F.col("doc_id"), F.col("text")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, owners, every = occurrences(keyed, items.select(F.col("item_id"), F.col("text").cast("string").alias("text")), size)
    found = materialise(found.distinct(), "hits")
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(F.greatest(acc.end, x.end).alias("end"), (acc.n + F.greatest(F.lit(0), x.end - F.greatest(acc.end, x.start))).cast("long").alias("n")),
        lambda acc: acc.n,
    )
    hits = found.groupBy("doc_id").agg(spans.alias("spans")).select("doc_id", covered.alias("n_hit"))
    named = found.select("doc_id", "window_id").distinct().join(owners, "window_id").select("doc_id", F.col("item_id").cast("string").alias("item"), "item_id").distinct()
    named = named.groupBy("doc_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = hits.join(named, "doc_id", "left").withColumnRenamed("doc_id", "hit_key")
    out = every.join(both, every.doc_id.eqNullSafe(both.hit_key), "left")
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("doc_id.doc_id").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_found).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_found, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        items_found.alias("items"),
        every.doc_id.alias("key"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, size: int = ITEM_WORDS) -> DataFrame:
    """docs without the rows that hold any window of an item, each judged by its own text; all columns stay."""
    hit = _judged(docs, items, size).filter("contaminated").select(F.col("key").alias("hit_key")).distinct()
    return docs.join(hit, _key(docs.doc_id, docs.text).eqNullSafe(hit.hit_key), "left_anti")
