"""The registered corpus queries: each applies its operator to a whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolith.llm import centroids, htmlextract, langid, merkle, neighbours, pii, quality, toxicity, urlfilter
from annolith.llm.common import crc_fold, table
from annolith.llm.decontam import contamination
from annolith.llm.linededup import dedup_lines
from annolith.llm.neardup import near_duplicates
from annolith.llm.packing import pack


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(table(spark, sf_dir, "documents")).drop("found")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "template")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_cut", "words_cut")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))
    return quality.judge(docs, model)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.fit(docs, crc_fold(F.col("doc_id"), 5) != 0)
    return langid.identify(docs, profiles).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlextract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(crc_fold(F.col("doc_id"), 3) != 1))
    scored = toxicity.score(docs, model)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"), F.size("sentences").cast("long").alias("n_sentences"))


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("scans")


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = neighbours.score(docs, neighbours.fit(docs, labels.filter(crc_fold(F.col("doc_id"), 5) != 0)))
    return scored.select("doc_id", neighbours.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= neighbours.THRESHOLD).cast("int").alias("predicted"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_packing": op2_packing,
    "op3_urlfilter": op3_urlfilter,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality": op5_quality,
    "op6_langid": op6_langid,
    "op7_decontamination": op7_decontamination,
    "op8_html": op8_html,
    "op9_toxicity": op9_toxicity,
    "op10_minhash_neardup": op10_minhash_neardup,
    "op11_centroids": op11_centroids,
    "op12_neighbours": op12_neighbours,
    "op13_merkle": op13_merkle,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_TOKENS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"



def _url_sql() -> str:
    """SQL of op3_urlfilter: the same tree, level by level (these tables have paths of fewer levels)."""
    u, depth = urlfilter, 6
    rules = sorted(u.RULES, key=lambda r: -len(r[1]))
    fits = {p: f"(host = '{p.partition('/')[0]}' OR ends_with(host, '.{p.partition('/')[0]}')) AND starts_with(path, '/{p.partition('/')[2]}')" for _, p in rules}
    case = lambda which: "CASE " + " ".join(f"WHEN {fits[r[1]]} THEN '{r[which]}'" for r in rules) + " END"
    number = "regexp_replace(x, '^[0-9]+(?:[-_.:][0-9]+)*($|\\.[A-Za-z]{1,5}$)', '*\\1')"
    shape = f"CASE WHEN regexp_matches({number}, '^[0-9a-fA-F-]{{8,}}(\\.[A-Za-z]{{1,5}})?$') AND regexp_matches({number}, '^[0-9a-fA-F-]*[0-9]') THEN regexp_replace({number}, '^[0-9a-fA-F-]{{8,}}', '*') ELSE {number} END"
    levels = ""
    smoothed = f"((blocked + {u.WEIGHT * u.PRIOR}) / (labelled + {u.WEIGHT}))"
    side = f"CASE WHEN labelled > 0 THEN CASE WHEN 2 * blocked >= labelled THEN '{u.MERGED['block']}' ELSE '{u.MERGED['allow']}' END END"
    share = "(s_blocked / s_labelled::DOUBLE)"
    similar = f"abs(blocked / labelled::DOUBLE - (s_blocked - blocked)::DOUBLE / (s_labelled - labelled)::DOUBLE) <= {u.SIMILAR} * sqrt({share} * (1 - {share}) * (1 / labelled::DOUBLE + 1 / (s_labelled - labelled)::DOUBLE))"
    for k in range(depth):
        levels += f""",
        p{k} AS (SELECT host, template, shape[{k + 1}] AS seg, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked FROM t{k} WHERE len(shape) > {k} GROUP BY 1, 2, 3),
        q{k} AS (SELECT *, {side} AS side, count(*) OVER point AS many, sum(n) OVER point AS whole FROM p{k} WINDOW point AS (PARTITION BY host, template)),
        s{k} AS (SELECT *, count(*) OVER own AS peers, sum(labelled) OVER own AS s_labelled, sum(blocked) OVER own AS s_blocked FROM q{k} WINDOW own AS (PARTITION BY host, template, side)),
        b{k} AS (SELECT host, template, seg, CASE WHEN many >= {u.MANY} AND whole < {u.REPEATS} * many THEN '*' WHEN side IS NOT NULL AND peers > 1 THEN CASE WHEN {similar} THEN side ELSE seg END ELSE seg END AS name FROM s{k}),
        t{k + 1} AS (SELECT t.host, shape, n, labelled, blocked, CASE WHEN b.host IS NOT NULL THEN list_append(t.template, name) ELSE t.template END AS template
               FROM t{k} t LEFT JOIN b{k} b ON t.host = b.host AND t.template = b.template AND t.shape[{k + 1}] = b.seg)"""
    return f"""WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, {_LOWER.replace("coalesce(text, '')", "regexp_extract(rest, '^[^/?#]*', 0)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
        r AS (SELECT *, {case(1)} AS rule, {case(0)} AS by_rule, list_filter(string_split(path, '/'), lambda x: x <> '') AS pieces FROM h),
        g AS (SELECT *, list_transform(pieces, lambda x: {shape}) AS shape FROM r),
        c AS (SELECT host, shape, count(*) AS n, count(by_rule) AS labelled, count(*) FILTER (WHERE by_rule = 'block') AS blocked FROM g GROUP BY 1, 2),
        t0 AS (SELECT *, CAST([] AS VARCHAR[]) AS template FROM c){levels},
        f AS (SELECT host, shape, labelled, blocked, list_concat(template, shape[{depth + 1}:]) AS template FROM t{depth}),
        nodes AS (SELECT host, template, sum(blocked)::DOUBLE AS blocked, sum(labelled)::DOUBLE AS labelled FROM f GROUP BY 1, 2),
        above AS (SELECT *, template[:k] AS point, CASE WHEN template[k + 1] = '*' THEN '*' ELSE shape[k + 1] END AS branch FROM (SELECT *, unnest(range(len(template))) AS k FROM f)),
        branches AS (SELECT host, point, branch, sum(labelled) AS labelled, sum(blocked) AS blocked FROM above GROUP BY 1, 2, 3),
        points AS (SELECT host, point, round(avg({smoothed}), 9) AS mean FROM branches GROUP BY 1, 2 HAVING sum(labelled) > 0),
        inherited AS (SELECT a.host, a.template, arg_max(mean, k) AS mean FROM above a JOIN points p ON a.host = p.host AND a.point = p.point GROUP BY 1, 2),
        v AS (SELECT n.host, n.template, CASE WHEN labelled > 0 THEN {smoothed} ELSE coalesce(mean, {u.PRIOR}) END AS pure FROM nodes n LEFT JOIN inherited i ON n.host = i.host AND n.template = i.template)
        SELECT page_id, g.host, path, rule, CASE WHEN by_rule IS NOT NULL THEN by_rule WHEN pure >= {u.PURE} THEN 'block' ELSE 'allow' END AS verdict,
               CASE WHEN by_rule IS NULL THEN '/' || array_to_string(f.template, '/') END AS template
        FROM g JOIN f ON g.host = f.host AND g.shape = f.shape JOIN v ON f.host = v.host AND f.template = v.template"""


def _centroid_sql() -> str:
    """SQL of op11_centroids: three rounds of full scans, in 64-bit integers."""
    c, width = centroids, range(1, centroids.WIDTH + 1)
    part = lambda s, n: f"(({s} - ((({s}) % {n}) + {n}) % {n}) // {n})"  # noqa: E731 - floor of the quotient
    sql = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({c.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE len(embedding) = {c.WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {c.WIDTH}),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS j, x AS c FROM v QUALIFY j < {c.CLUSTERS})"""
    for k in range(c.ROUNDS + 1):
        sql += f""",
        d{k} AS (SELECT r, vec_id, x, j, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{k}),
        a{k} AS MATERIALIZED (SELECT r, vec_id, x, j, CAST(d AS BIGINT) AS d FROM d{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, j) = 1)"""
        if k < c.ROUNDS:
            sums = ", ".join(f"CAST({part(f'sum(x[{i}])', 'count(*)')} AS BIGINT)" for i in width)
            sql += f""",
        m{k} AS (SELECT j, [{sums}] AS c FROM a{k} GROUP BY j), c{k + 1} AS MATERIALIZED (SELECT c{k}.j, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} ON c{k}.j = m{k}.j)"""
    return f"""{sql}
        SELECT vec_id, CAST(a.j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{c.ROUNDS} a JOIN c{c.ROUNDS} c ON a.j = c.j"""


def _merkle_sql() -> str:
    """SQL of op13_merkle: level by level, up to 16 ** 6 rows a source and 16 ** 3 sources."""
    n = merkle.FANOUT
    field = lambda x: f"coalesce(octet_length(encode({x})) || ':' || {x}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(x) for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # crc32 bit by bit: a byte comes in, then seven shifts more.
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: [CAST(ord(d) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(4294967295, list_reduce(list_concat([4294967295], {bits}), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))))"
    sql = f"""WITH f AS (SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {crc} % {merkle.TAMPERED} = 0 THEN {leaf(low)} ELSE {leaf("text")} END AS other FROM documents),
        l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM f), a0 AS (SELECT source AS g, i, leaf AS h FROM l)"""
    for tree, levels in (("a", 6), ("b", 3)):
        if tree == "b":
            sql += ", b0 AS (SELECT 0 AS g, source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, h FROM subroots)"
        for k in range(levels):
            own = f"(PARTITION BY g, i // {n} ORDER BY i ROWS BETWEEN"
            sql += f""",
        {tree}w{k} AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) = 1 AS single, coalesce(string_agg(h, '') OVER {own} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER {own} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {tree}{k}),
        {tree}{k + 1} AS (SELECT g, i // {n} AS i, CASE WHEN bool_or(single) THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {tree}w{k} GROUP BY 1, 2)"""
        sql += f", {'subroots AS (SELECT g AS source, h FROM a6)' if tree == 'a' else 'root AS (SELECT h AS root FROM b3)'}"
        joins = proof = ""
        for k in range(levels):
            joins += f" JOIN {tree}w{k} w{k} ON w{k}.g IS NOT DISTINCT FROM t.{'source' if tree == 'a' else 'g'} AND w{k}.i = t.i // {n**k}"
            proof += f" || CASE WHEN w{k}.single THEN '' ELSE w{k}.l || w{k}.r END"
        keep = "t.doc_id, t.source, t.leaf, t.other" if tree == "a" else "t.source, t.h AS subroot"
        lr = ", ".join(f"w{k}.single AS {tree}s{k}, w{k}.l AS {tree}l{k}, w{k}.r AS {tree}r{k}" for k in range(levels))
        sql += f", {tree}p AS (SELECT {keep}, '' {proof} AS {tree}proof, {lr} FROM {'l' if tree == 'a' else 'b0'} t{joins})"
    sql += ", x AS (SELECT ap.*, bp.* EXCLUDE (source), other AS n0 FROM ap JOIN bp ON ap.source IS NOT DISTINCT FROM bp.source)"
    at = 0
    for tree, levels in (("a", 6), ("b", 3)):
        for k in range(levels):
            before, at = ("x" if at == 0 else f"x{at}"), at + 1
            sql += f", x{at} AS (SELECT * EXCLUDE (n0), CASE WHEN {tree}s{k} THEN n0 ELSE sha256({tree}l{k} || n0 || {tree}r{k}) END AS n0 FROM {before})"
    return f"{sql} SELECT doc_id, leaf, subroot, root, sha256(aproof || bproof) AS proof_sha256, n0 AS folded_root, n0 = root AS verified FROM x{at}, root"


#: DuckDB SQL for the queries that SQL can express on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op11_centroids": _centroid_sql(),
    "op13_merkle": _merkle_sql(),
    "op3_urlfilter": _url_sql(),
    "op7_decontamination": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM win),
        pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
        hit AS (SELECT doc_id, i, pos.n, item_id FROM pos JOIN win ON pos.s = win.s AND pos.n = win.n),
        cov AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY 1),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN its ON d.doc_id = its.doc_id""",
    "op10_minhash_neardup": f"""WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
        sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0))),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
        both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, t.b FROM r JOIN both_ways t ON r.c = t.a)
        SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id, r.doc_id = min(c) AS kept FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id""",
}
