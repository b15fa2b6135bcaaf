"""URL filter: host and path rules, and a path-template tree for what the rules leave open.

Each host's paths form a tree of segments.  Segments that are variable by their form (numbers,
hashes, dates) become wildcards at once.  Level by level, a branch point with many distinct
segments that hardly repeat becomes one wildcard too; of the other branches, those whose
labelled urls (those that a rule decides) lean to the same side are merged if a two-proportion
test finds no difference between a branch and the others of its side.  Branches without labels
are merged with nothing.  Levels go on as long as any branch point has more than one path below.
A template is rejected if the smoothed share of blocked urls among its labelled ones is high.  One
without labels takes over the mean of that share among the branches of its nearest ancestor that has
labelled urls: many rejected branches speak against their neighbour, one among several does not.

Only DataFrame functions are used.  Pages are first counted by host and shaped path, so that a
host's share of all rows meets in counts and not in rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolith.llm.common import lower_ascii, materialise

#: Verdict and pattern; the longest that fits wins.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A branch point is a wildcard from so many distinct segments on, if they repeat less than this on average.
MANY, REPEATS = 16, 4.0
#: Standard errors within which label rates of branches count as similar.
SIMILAR = 2.0
#: Prior share of blocked urls and its weight in labelled urls, and the purity that rejects.
PRIOR, WEIGHT, PURE = 0.2, 4.0, 0.7
WILD = "*"
#: Names of merged branches.
MERGED = {"block": "{block}", "allow": "{allow}"}


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, r"\A[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, pattern in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones win
        name, _, rest = pattern.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, pattern).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def shaped(path: Column) -> Column:
    """All segments, those variable by form as wildcards (with a file's ending kept)."""

    def shape(x: Column) -> Column:
        number = F.regexp_replace(x, r"\A[0-9]+(?:[-_.:][0-9]+)*(?=\z|\.[A-Za-z]{1,5}\z)", WILD)
        return F.regexp_replace(number, r"\A(?=[0-9a-fA-F-]*[0-9])[0-9a-fA-F-]{8,}(?=\z|\.[A-Za-z]{1,5}\z)", WILD)

    return F.transform(F.filter(F.split(path, "/", -1), lambda x: x != ""), shape)


def _branches(children: DataFrame) -> DataFrame:
    """(host, template, segment, name): what each branch of a level is called after generalising and merging."""
    side = F.when(F.col("labelled") > 0, F.when(2 * F.col("blocked") >= F.col("labelled"), MERGED["block"]).otherwise(MERGED["allow"]))
    # Written, so that the joins with a branch point's sums can be split where it has very many branches.
    children = materialise(children.withColumn("side", side), "branches", few=True)
    points = children.groupBy("host", "template").agg(F.count("*").alias("distinct"), F.sum("n").alias("all"))
    wild = points.filter((F.col("distinct") >= MANY) & (F.col("all") < REPEATS * F.col("distinct"))).select("host", "template", F.lit(True).alias("wild"))
    sides = children.filter("side is not null").groupBy("host", "template", "side").agg(F.count("*").alias("peers"), F.sum("labelled").alias("s_labelled"), F.sum("blocked").alias("s_blocked"))
    sides = sides.filter("peers > 1").drop("peers")
    size = lambda c: F.nullif(c.cast("double"), F.lit(0.0))
    own, others, hit = size(F.col("labelled")), size(F.col("s_labelled") - F.col("labelled")), F.col("s_blocked") - F.col("blocked")
    share = F.col("s_blocked") / size(F.col("s_labelled"))
    error = F.sqrt(share * (1 - share) * (1 / own + 1 / others))
    similar = F.abs(F.col("blocked") / own - hit / others) <= SIMILAR * error
    both = children.join(wild, ["host", "template"], "left").join(sides, ["host", "template", "side"], "left")
    return both.select("host", "template", "segment", F.when(F.col("wild"), WILD).when(similar, F.col("side")).otherwise(F.col("segment")).alias("name"))


def templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, n, labelled, blocked, template) for counted shapes (host, shape, n, labelled, blocked)."""
    tree, done, level = materialise(shapes.withColumn("template", F.array().cast("array<string>")), "tree"), None, 0
    while True:
        # Below a node with one path nothing is generalised or merged: the rest of the path is taken as it is.
        rest = F.slice("shape", F.lit(level + 1), F.greatest(F.size("shape") - level, F.lit(0)))
        longer = F.size("shape") > level
        nodes = tree.filter(longer).groupBy("host", "template").agg(F.count("*").alias("paths")).filter("paths > 1").select("host", "template", F.lit(True).alias("open"))
        split = tree.join(nodes, ["host", "template"], "left").withColumn("open", F.coalesce(F.col("open") & longer, F.lit(False)))
        split = materialise(split, "tree", few=True)
        closed = split.filter("not open").withColumn("template", F.concat("template", rest)).drop("open")
        done = closed if done is None else done.unionByName(closed)
        here = split.filter("open").drop("open").withColumn("segment", F.get("shape", F.lit(level)))
        if not here.limit(1).count():
            return done
        children = here.groupBy("host", "template", "segment").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked")))
        grown = F.concat("template", F.array("name"))
        tree = here.join(_branches(children), ["host", "template", "segment"]).withColumn("template", grown).drop("name", "segment")
        level += 1


def _smoothed() -> Column:
    return (F.col("blocked") + WEIGHT * PRIOR) / (F.col("labelled") + WEIGHT)


def purity(tree: DataFrame) -> DataFrame:
    """(host, template, pure): the smoothed share of blocked urls among the labelled ones, or that of the nearest branch point above with
    labelled urls."""
    sums = [F.sum(c).cast("double").alias(c) for c in ("labelled", "blocked")]
    # Every node above a template by the digest of its path, and the branch that leads down from it: branches that were merged
    # speak one by one, those behind a wildcard together.
    prefix = F.transform(F.sequence(F.lit(0), F.size("template") - 1), lambda k: F.md5(F.array_join(F.slice("template", F.lit(1), k), "/")))
    above = tree.filter(F.size("template") > 0).select("host", "shape", "template", "labelled", "blocked", F.posexplode(prefix).alias("k", "point"))
    name = F.get("template", F.col("k"))
    branches = above.groupBy("host", "point", F.when(name == WILD, name).otherwise(F.get("shape", F.col("k"))).alias("branch")).agg(*sums)
    points = branches.groupBy("host", "point").agg(F.sum("labelled").alias("seen"), F.round(F.avg(_smoothed()), 9).alias("mean")).filter("seen > 0").drop("seen")
    points = materialise(points, "points", few=True)
    nodes = materialise(tree.groupBy("host", "template").agg(*sums), "nodes", few=True)
    free = nodes.filter((F.col("labelled") == 0) & (F.size("template") > 0)).select("host", "template", F.posexplode(prefix).alias("k", "point"))
    inherited = free.join(points, ["host", "point"]).groupBy("host", "template").agg(F.max_by("mean", "k").alias("mean"))
    own = nodes.join(inherited, ["host", "template"], "left")
    return own.select("host", "template", F.when(F.col("labelled") > 0, _smoothed()).otherwise(F.coalesce("mean", F.lit(PRIOR))).alias("pure"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Each row's page_id, host, path, rule, verdict, and template and purity (null where a rule decides).

    Null urls and those without :// have empty host and path; without a rule they stand under the empty
    template of the empty host.  Repeated rows are judged alike, and each counts; nulls in other columns and
    extra columns play no part.  An empty table gives no rows.
    """
    host, path = parts(F.col("url").cast("string"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = own.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), shaped(F.col("path")).alias("shape"))
    counts = [F.count("*").alias("n"), F.count("by_rule").alias("labelled"), F.count_if(F.col("by_rule") == "block").alias("blocked")]
    tree = materialise(templates(own.groupBy("host", "shape").agg(*counts)), "templates", few=True)
    rated = tree.select("host", "shape", "template").join(materialise(purity(tree), "purity", few=True), ["host", "template"])
    out = own.join(materialise(rated.select("host", "shape", "template", "pure"), "rated", few=True), ["host", "shape"], "left")
    chosen = F.when(F.col("by_rule").isNotNull(), F.col("by_rule")).when(F.col("pure") >= PURE, "block").otherwise("allow")
    free = F.col("by_rule").isNull()
    template = F.concat(F.lit("/"), F.array_join("template", "/"))
    return out.select("page_id", "host", "path", "rule", chosen.alias("verdict"), F.when(free, template).alias("template"), F.when(free, F.col("pure")).alias("pure"))
