"""Registered queries: each operator family applied to whole driver tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annolith.functions import keywords, masks, parsing, prompts, taxonomy, text
from annolith.operators import inference, joins, kg, metrics, ranking
from annolith.sources.specs import PropertySpec, knowledge_frames, knowledge_priors, specs_frame

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ evaluation rows from lineitem

LABELS = ("a", "r", "z", "unknown")
SPECS = [PropertySpec("flag", "line", "flag", "categorical", LABELS, "flag")]
EV = """WITH ev AS (
  SELECT 'm' || CAST(l_suppkey % 3 AS VARCHAR) AS model, lower(l_linestatus) AS variant, l_orderkey * 10 + l_linenumber AS image_id,
         CASE WHEN l_returnflag = 'N' THEN 'unknown' ELSE lower(l_returnflag) END AS gt,
         CASE WHEN l_quantity < 20 THEN 'a' WHEN l_quantity < 40 THEN 'r' ELSE 'unknown' END AS pred,
         CASE WHEN l_discount < 0.05 THEN 'a' WHEN l_tax < 0.04 THEN 'r' ELSE 'unknown' END AS pred2
  FROM lineitem)"""


def _evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem")
    return rows.select(
        F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string")).alias("model"),
        F.lower("l_linestatus").alias("variant"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("image_id"),
        F.lit("flag").alias("property_key"),
        F.when(F.col("l_returnflag") == "N", "unknown").otherwise(F.lower("l_returnflag")).alias("gt"),
        F.when(F.col("l_quantity") < 20, "a").when(F.col("l_quantity") < 40, "r").otherwise("unknown").alias("pred"),
        F.when(F.col("l_discount") < 0.05, "a").when(F.col("l_tax") < 0.04, "r").otherwise("unknown").alias("pred2"),
    )


def _pct(part: str, whole: str) -> str:
    return f"round_even(100.0e0 * {part} / nullif({whole}, 0), 2)"


def _metrics_sql(keys: str) -> str:
    """SQL of property_metrics by keys (with a trailing comma, or empty)."""
    by = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    join = " AND ".join(f"c.{k.strip()} = f.{k.strip()}" for k in keys.split(",") if k.strip()) or "true"
    pick = "".join(f"c.{k.strip()}, " for k in keys.split(",") if k.strip())
    return f"""{EV}, labels AS (SELECT unnest(['a', 'r', 'z']) AS label),
    conf AS (SELECT {keys} label, count(*) FILTER (WHERE gt = label AND pred = label) AS tp, count(*) FILTER (WHERE gt <> label AND pred = label) AS fp,
                    count(*) FILTER (WHERE gt = label AND pred <> label) AS fn FROM ev, labels WHERE gt <> 'unknown' GROUP BY {keys} label),
    parts AS (SELECT {keys} label, coalesce(tp * 1.0e0 / nullif(tp + fp, 0), 0) AS p, coalesce(tp * 1.0e0 / nullif(tp + fn, 0), 0) AS r FROM conf),
    f AS (SELECT {keys} avg(coalesce(2 * p * r / nullif(p + r, 0), 0)) AS f1 FROM parts {by}),
    c AS (SELECT {keys} count(*) AS total, count(*) FILTER (WHERE pred <> 'unknown') AS yes, count(*) FILTER (WHERE gt <> 'unknown') AS known,
                 count(*) FILTER (WHERE gt <> 'unknown' AND pred = 'unknown') AS missed, count(*) FILTER (WHERE gt <> 'unknown' AND gt = pred) AS hit,
                 count(*) FILTER (WHERE gt <> 'unknown' AND pred <> 'unknown') AS covered FROM ev {by})
    SELECT {pick} 'flag' AS property, 'line' AS "group", 'categorical' AS value_type, CAST(yes AS BIGINT) AS pred_yes_count, CAST(total - yes AS BIGINT) AS pred_no_count,
           {_pct("yes", "total")} AS pred_yes_pct, {_pct("yes", "total")} AS coverage_pct, CAST(known AS BIGINT) AS gt_known_count,
           CAST(known - missed AS BIGINT) AS extracted_when_gt_known, CAST(missed AS BIGINT) AS missed_when_gt_known,
           {_pct("(known - missed)", "known")} AS coverage_on_gt_known_pct, {_pct("hit", "known")} AS accuracy_pct,
           CASE WHEN known > 0 THEN round_even(100.0e0 * f1, 2) END AS macro_f1_pct, {_pct("hit", "covered")} AS selective_accuracy_pct,
           {_pct("hit", "known")} AS exact_match_on_gt_known_pct
    FROM c LEFT JOIN f ON {join}"""


@query(_metrics_sql(""))
def property_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.property_metrics(_evaluation(spark, sf_dir), specs_frame(spark, SPECS))


@query(_metrics_sql("model, variant, "))
def model_variant_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.property_metrics(_evaluation(spark, sf_dir), specs_frame(spark, SPECS), ["model", "variant"])


def _observed_sql(pred: str, name: str) -> str:
    return f"""{name}_lab AS (SELECT DISTINCT model, variant, gt AS label FROM ev UNION SELECT DISTINCT model, variant, {pred} FROM ev WHERE {pred} <> 'unknown'),
    {name}_conf AS (SELECT l.model, l.variant, l.label, count(*) FILTER (WHERE gt = label AND {pred} = label) AS tp, count(*) FILTER (WHERE gt <> label AND {pred} = label) AS fp,
                    count(*) FILTER (WHERE gt = label AND {pred} <> label) AS fn FROM {name}_lab l JOIN ev e ON l.model = e.model AND l.variant = e.variant GROUP BY 1, 2, 3),
    {name}_parts AS (SELECT model, variant, coalesce(tp * 1.0e0 / nullif(tp + fp, 0), 0) AS p, coalesce(tp * 1.0e0 / nullif(tp + fn, 0), 0) AS r FROM {name}_conf),
    {name}_f AS (SELECT model, variant, avg(coalesce(2 * p * r / nullif(p + r, 0), 0)) AS f1 FROM {name}_parts GROUP BY 1, 2),
    {name} AS (SELECT e.model, e.variant, 'flag' AS property_key, CAST(count(*) AS BIGINT) AS n, {_pct(f"count(*) FILTER (WHERE gt = {pred})", "count(*)")} AS accuracy,
              round_even(100.0e0 * any_value(f.f1), 2) AS macro_f1,
              {_pct(f"count(*) FILTER (WHERE gt = {pred} AND {pred} <> 'unknown')", f"count(*) FILTER (WHERE {pred} <> 'unknown')")} AS selective_accuracy
              FROM ev e JOIN {name}_f f ON e.model = f.model AND e.variant = f.variant GROUP BY 1, 2)"""


@query(f"{EV}, {_observed_sql('pred', 'o')} SELECT * FROM o")
def macro_f1_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.observed_metrics(_evaluation(spark, sf_dir))


_DELTA = ", ".join(f"round_even(a.{m}, 2) AS {m}_raw, round_even(b.{m}, 2) AS {m}_kg, round_even(b.{m} - a.{m}, 2) AS {m}_delta" for m in ("accuracy", "macro_f1", "selective_accuracy"))


@query(f"{EV}, {_observed_sql('pred', 'a')}, {_observed_sql('pred2', 'b')} SELECT a.model, a.variant, a.property_key, a.n, {_DELTA} FROM a JOIN b ON a.model = b.model AND a.variant = b.variant AND a.n = b.n")
def metrics_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evaluation(spark, sf_dir)
    out = metrics.delta_table(metrics.observed_metrics(rows), metrics.observed_metrics(rows.drop("pred").withColumnRenamed("pred2", "pred")))
    return out.select("model", "variant", "property_key", "n", *(F.bround(c, 2).alias(c) for c in out.columns if c.endswith(("_raw", "_kg", "_delta"))))


@query(f"""{EV} SELECT 'flag' AS property, {_pct("count(*) FILTER (WHERE variant = 'f' AND pred <> 'unknown')", "count(*) FILTER (WHERE variant = 'f')")} AS f,
    {_pct("count(*) FILTER (WHERE variant = 'o' AND pred <> 'unknown')", "count(*) FILTER (WHERE variant = 'o')")} AS o,
    round_even({_pct("count(*) FILTER (WHERE variant = 'o' AND pred <> 'unknown')", "count(*) FILTER (WHERE variant = 'o')")} - {_pct("count(*) FILTER (WHERE variant = 'f' AND pred <> 'unknown')", "count(*) FILTER (WHERE variant = 'f')")}, 2) AS delta FROM ev""")
def raw_vs_masked_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.property_metrics(_evaluation(spark, sf_dir), specs_frame(spark, SPECS), ["variant"])
    return metrics.variant_pivot(rows, ("f", "o"))


_RUNS = """runs AS (SELECT model, variant, image_id, image_id % 7 <> 0 AS ok, image_id % 5 <> 0 AS match FROM ev)"""


@query(f"""{EV}, {_RUNS} SELECT model, variant, CAST(count(*) AS BIGINT) AS num_samples, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS valid_json_count, {_pct("count(*) FILTER (WHERE ok)", "count(*)")} AS valid_json_pct,
    CAST(count(*) FILTER (WHERE match) AS BIGINT) AS image_id_match_count, {_pct("count(*) FILTER (WHERE match)", "count(*)")} AS image_id_match_pct,
    {_pct("count(*) FILTER (WHERE ok)", "count(*)")} AS valid_json_per_response_pct FROM runs GROUP BY 1, 2""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evaluation(spark, sf_dir)
    flags = rows.withColumns({"has_valid_json": F.col("image_id") % 7 != 0, "image_id_matched": F.col("image_id") % 5 != 0})
    flags = flags.withColumns({"has_valid_json_all": F.col("has_valid_json"), "image_id_matched_all": F.col("image_id_matched"), "valid_json_count": F.col("has_valid_json").cast("int"), "expected_response_count": F.lit(1)})
    out = metrics.run_summary(flags, metrics.property_metrics(rows, specs_frame(spark, SPECS), ["model", "variant"]))
    return out.select("model", "variant", "num_samples", "valid_json_count", "valid_json_pct", "image_id_match_count", "image_id_match_pct", "valid_json_per_response_pct")


@query(f"""{EV} SELECT model, variant, image_id // 10 AS image_id, CAST(count(*) FILTER (WHERE pred <> 'unknown') AS BIGINT) AS valid_json_count, CAST(count(*) AS BIGINT) AS expected_response_count,
    round_even(count(*) FILTER (WHERE pred <> 'unknown') * 1.0e0 / count(*), 6) AS valid_json_ratio, bool_and(pred <> 'unknown') AS has_valid_json_all,
    first(pred ORDER BY image_id, pred) FILTER (WHERE pred <> 'unknown') AS primary_object_pred FROM ev GROUP BY 1, 2, 3""")
def response_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("pred") != "unknown", F.col("pred"))
    rows = _evaluation(spark, sf_dir).select("model", "variant", F.floor(F.col("image_id") / 10).cast("long").alias("image_id"), (2 * F.col("image_id") + (F.col("pred") == "r").cast("int")).alias("ord"), said.isNotNull().alias("valid"), F.lit(True).alias("id_matched"), said.alias("primary_object"), said.alias("notes"), F.lit(None).cast("string").alias("error"))
    return metrics.response_stats(rows).select("model", "variant", "image_id", "valid_json_count", "expected_response_count", "valid_json_ratio", "has_valid_json_all", "primary_object_pred")


# ------------------------------------------------------------------ normalisation and taxonomies


@query("""SELECT o_orderkey, replace(regexp_replace(lower(trim(o_orderpriority)), '\\s+', '_', 'g'), '-', '_') AS token,
    CASE WHEN replace(regexp_replace(lower(trim(o_orderpriority)), '\\s+', '_', 'g'), '-', '_') IN ('1_urgent', '2_high', '5_low') THEN replace(regexp_replace(lower(trim(o_orderpriority)), '\\s+', '_', 'g'), '-', '_') ELSE 'unknown' END AS categorical,
    CASE o_orderstatus WHEN 'F' THEN 'false' WHEN 'O' THEN 'unknown' ELSE 'unknown' END AS flag,
    replace(replace(replace(lower(trim(o_orderpriority)), '-', '_'), '/', '_'), ' ', '_') AS knowledge FROM orders""")
def normalize_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders")
    allowed = F.array(*map(F.lit, ("1_urgent", "2_high", "5_low", "unknown")))
    flag = text.normalize_boolean(F.replace(F.col("o_orderstatus"), F.lit("F"), F.lit("No")))
    return rows.select("o_orderkey", text.normalize_token(F.col("o_orderpriority")).alias("token"), text.normalize_categorical(F.col("o_orderpriority"), allowed).alias("categorical"), flag.alias("flag"), text.norm_knowledge(F.col("o_orderpriority")).alias("knowledge"))


@query("""SELECT p_partkey, array_to_string(list_filter(['red', 'blue', 'widget', 'gear'], lambda x: list_contains(string_split(lower(p_name), ' '), x)), ',') AS sorted_values,
    len(list_filter(['red', 'blue', 'widget', 'gear'], lambda x: list_contains(string_split(lower(p_name), ' '), x))) > 0 AS known,
    list_contains(string_split(lower(p_name), ' '), 'red') AND list_contains(string_split(lower(p_name), ' '), 'widget') AND NOT list_contains(string_split(lower(p_name), ' '), 'blue') AND NOT list_contains(string_split(lower(p_name), ' '), 'gear') AS equal FROM part""")
def multi_categorical_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part")
    allowed = F.array(*map(F.lit, ("red", "blue", "widget", "gear")))
    values = text.normalize_multi(text.split_list(F.replace(F.col("p_name"), F.lit(" "), F.lit(","))), allowed)
    shown = F.array_join(F.filter(allowed, lambda x: F.array_contains(F.col("values"), x)), ",")
    rows = rows.select("p_partkey", values.alias("values"))
    gt = F.array(F.lit("widget"), F.lit("red"))
    return rows.select("p_partkey", shown.alias("sorted_values"), text.is_known_list(F.col("values")).alias("known"), text.lists_equal(gt, F.col("values")).alias("equal"))


_MATERIALS = ["wood", "metal", "cardboard", "ceramic", "leather", "wax"]
_TOKEN = "(" + "['" + "','".join(_MATERIALS) + "'])[1 + CAST(p_partkey % 6 AS INT)]"
_ROUGH = "(['smooth','very_rough','medium'])[1 + CAST(p_size % 3 AS INT)]"


def _cases(column: str, table: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{default}' END"


@query(f"""WITH t AS (SELECT p_partkey, {_TOKEN} AS m, {_ROUGH} AS r, lower(p_type) AS k FROM part)
    SELECT p_partkey, {_cases("m", taxonomy.PDF_MATERIAL, "other")} AS pdf_material, {_cases("m", taxonomy.NATURAL_MATERIAL, "unknown")} AS natural_material,
    {_cases("r", taxonomy.ROUGHNESS, "unknown")} AS roughness, CASE k WHEN 'large' THEN 'heavy' WHEN 'small' THEN 'light' ELSE 'unknown' END AS weight,
    CASE {_cases("m", taxonomy.NATURAL_MATERIAL, "unknown")} WHEN 'fabric' THEN 'fuzzy' WHEN 'mixed' THEN 'mixed' ELSE {_cases("r", taxonomy.SURFACE_ROUGHNESS, "unknown")} END AS surface FROM t""")
def taxonomy_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part")
    material = F.array(*map(F.lit, _MATERIALS))[(F.col("p_partkey") % 6).cast("int")]
    rough = F.array(*map(F.lit, ("Smooth", "Very-Rough", " medium ")))[(F.col("p_size") % 3).cast("int")]
    weight = F.when(F.lower("p_type") == "large", "Heavy").when(F.lower("p_type") == "small", "very light").otherwise("medium")
    return rows.select("p_partkey", taxonomy.pdf_material(material).alias("pdf_material"), taxonomy.natural_material(material).alias("natural_material"), taxonomy.roughness(rough).alias("roughness"), taxonomy.weight_hint(weight).alias("weight"), taxonomy.natural_surface(material, rough).alias("surface"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN CASE WHEN l_quantity > 25 THEN 'fragile' ELSE 'not_fragile' END WHEN l_returnflag = 'A' THEN 'fragile' WHEN l_returnflag = 'R' THEN 'not_fragile' ELSE 'unknown' END AS pdf,
    CASE WHEN l_linenumber % 3 = 0 THEN CASE WHEN l_quantity > 25 THEN 'fragile' ELSE 'durable' END WHEN l_returnflag = 'A' THEN 'fragile' WHEN l_returnflag = 'R' THEN 'durable' ELSE 'unknown' END AS natural,
    CASE WHEN l_linenumber % 3 = 0 THEN CASE WHEN l_quantity > 25 THEN 'dirty' ELSE 'clean' END ELSE 'unknown' END AS state FROM lineitem""")
def fragility_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_quantity") > 25)
    raw = F.when(F.col("l_returnflag") == "A", "Slightly Brittle").when(F.col("l_returnflag") == "R", "non-brittle")
    return rows.select("l_orderkey", "l_linenumber", taxonomy.pdf_fragility(flag, raw).alias("pdf"), taxonomy.natural_fragility(flag, raw).alias("natural"), taxonomy.dirt_state(flag).alias("state"))


def _word(m: str) -> str:
    usable = [s for s in keywords.MATERIALS[m] if len(s) > 2 and s.isascii()]
    words, rest = [s for s in usable if s.strip().isalnum()], [s for s in usable if not s.strip().isalnum()]
    return "|".join([f"\\b(?:{'|'.join(words)})\\b", *rest])


_HITS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(' ' || txt || ' ', '{_word(m)}') THEN '{m}' END" for m in keywords.MATERIALS) + "], lambda x: x IS NOT NULL)"
_PART_TEXT = "lower(p_name || ' ' || (['steel','oak wood','cotton mesh','glass','pu foam','plain'])[1 + CAST(p_partkey % 6 AS INT)])"


def _part_text() -> Column:
    extra = F.array(*map(F.lit, ("Steel", "oak  WOOD", "cotton mesh", "glass", "pu foam", "plain")))[(F.col("p_partkey") % 6).cast("int")]
    return F.concat("p_name", F.lit(" "), extra)


@query(f"""WITH t AS (SELECT p_partkey, {_PART_TEXT} AS txt FROM part), h AS (SELECT *, {_HITS} AS hits FROM t)
    SELECT p_partkey, array_to_string(hits, ',') AS hits, CASE WHEN len(hits) = 1 THEN hits[1] WHEN len(hits) > 1 THEN 'mixed' ELSE 'unknown' END AS material,
    CASE WHEN len(hits) = 1 THEN 'metadata_text' WHEN len(hits) > 1 THEN 'metadata_text_multi' ELSE 'none' END AS source, regexp_matches(txt, '{"|".join(keywords.POROUS)}') AS porous FROM h""")
def keyword_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part").select("p_partkey", _part_text().alias("txt"))
    none = F.lit(None).cast("string")
    value, source = keywords.infer_material(none, none, none, F.col("txt"), none)
    return rows.select("p_partkey", F.array_join(keywords.detect_materials(F.col("txt")), ",").alias("hits"), value.alias("material"), source.alias("source"), keywords.has_any(text.space_lower(F.col("txt")), keywords.POROUS).alias("porous"))


def _any(column: str, hints: list[str]) -> str:
    return f"regexp_matches({column}, '{'|'.join(hints)}')"


@query(f"""WITH t AS (SELECT p_partkey, {_PART_TEXT} || ' | ' || lower(p_type) AS txt, (['glass','plastic','fabric','mixed','paper'])[1 + CAST(p_size % 5 AS INT)] AS m FROM part)
    SELECT p_partkey, CASE WHEN m = 'plastic' THEN CASE WHEN {_any("txt", keywords.SOFT)} THEN 'flexible' ELSE 'rigid' END ELSE {_cases("m", keywords.RIGIDITY_OF, "unknown")} END AS rigidity,
    CASE WHEN {_any("txt", keywords.TRANSLUCENT)} THEN 'translucent' WHEN {_any("txt", keywords.TRANSPARENT)} THEN 'transparent' WHEN {_any("txt", keywords.OPAQUE)} THEN 'opaque' ELSE {_cases("m", keywords.TRANSPARENCY_OF, "unknown")} END AS transparency,
    CASE WHEN {_any("txt", keywords.FUZZY)} THEN 'fuzzy' WHEN {_any("txt", keywords.POROUS)} THEN 'porous' WHEN {_any("txt", keywords.ROUGH)} THEN 'rough' WHEN {_any("txt", keywords.SMOOTH)} THEN 'smooth' ELSE {_cases("m", keywords.SURFACE_OF, "unknown")} END AS surface,
    CASE WHEN {_any("txt", keywords.FRAGILE)} THEN 'fragile' WHEN {_any("txt", keywords.DURABLE)} THEN 'durable' ELSE {_cases("m", keywords.FRAGILITY_OF, "unknown")} END AS fragility FROM t""")
def keyword_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    material = F.array(*map(F.lit, ("glass", "plastic", "fabric", "mixed", "paper")))[(F.col("p_size") % 5).cast("int")]
    rows = _read(spark, sf_dir, "part").select("p_partkey", text.space_lower(F.concat(_part_text(), F.lit(" | "), F.col("p_type"))).alias("txt"), material.alias("m"), F.lit("").alias("kind"))
    m, txt = F.col("m"), F.col("txt")
    return rows.select("p_partkey", keywords.infer_rigidity(m, txt).alias("rigidity"), keywords.infer_transparency(m, txt).alias("transparency"), keywords.infer_surface(m, txt, F.col("kind")).alias("surface"), keywords.infer_fragility(m, txt).alias("fragility"))


# ------------------------------------------------------------------ parsing, prompts, inference


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) < 50 THEN json_extract_string(props, '$.k') ELSE 'unknown' END AS low FROM events""")
def json_extract_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    allowed = [str(k) for k in range(50)]
    return rows.select("event_id", parsing.answer_value(F.col("v"), "k").alias("k"), parsing.prediction(F.col("v"), "k", "categorical", allowed).alias("low"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 2 THEN NULL ELSE json_extract_string(props, '$.k') END AS k,
    CASE WHEN event_id % 4 = 2 THEN 'json_not_found' END AS error FROM events""")
def tolerant_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 4
    raw = F.when(n == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(n == 1, F.concat(F.lit("So: "), F.replace(F.col("props"), F.lit('"'), F.lit("'")), F.lit(" done }"))).when(n == 2, F.lit("no answer")).otherwise(F.concat(F.lit("x "), F.col("props"), F.lit(" {")))
    rows = parsing.parsed(_read(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "raw")
    return rows.select("event_id", F.try_variant_get(F.try_parse_json("parsed"), "$.k", "string").alias("k"), F.col("parse_error").alias("error"))


_ANSWER = "'{\"image_id\": \"' || CAST(doc_id AS VARCHAR) || '\", \"primary_object\": \"object\", \"properties\": {\"toxic\": \"' || (CASE toxic WHEN 1 THEN 'true' ELSE 'false' END) || '\"}, \"notes\": \"reference example\"}'"


def _label_prompt(image: Column) -> Column:
    return prompts.property_prompt(image, F.lit("toxic"), F.lit("boolean"), F.array().cast("array<string>"), F.lit("Is the text rude?"))


_HEAD_SQL = "'" + prompts.HEAD.replace("'", "''") + "\nProperty description: Is the text rude?'"
_PROMPT_SQL = f"replace(replace(replace(replace({_HEAD_SQL}, '{{image}}', CAST(doc_id AS VARCHAR)), '{{key}}', 'toxic'), '{{hint}}', 'string'), '{{rule}}', '- \"toxic\" must be one of [true|false|unknown]')"


@query(f"SELECT doc_id, {_PROMPT_SQL} AS prompt, {_ANSWER} AS response FROM labels")
def sft_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "labels").select("doc_id", F.col("doc_id").cast("string").alias("image"), F.when(F.col("toxic") == 1, '"true"').otherwise('"false"').alias("value"))
    return rows.select("doc_id", _label_prompt(F.col("image")).alias("prompt"), prompts.demo_response(F.col("image"), F.lit("toxic"), F.col("value")).alias("response"))


@query("""SELECT conv_id, string_agg(upper(role) || ': ' || trim(text), chr(10) || chr(10) ORDER BY turn) AS chat FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def fallback_chat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").filter(text.strip(F.col("text")) != "")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return rows.groupBy("conv_id").agg(turns.alias("m")).select("conv_id", prompts.fallback_text(F.transform("m", lambda x: F.struct(x.role.alias("role"), x.content.alias("content")))).alias("chat"))


@query("""SELECT 'mock' AS model, 'raw' AS variant, CAST(doc_id AS VARCHAR) AS image_id, CAST(2 AS BIGINT) AS valid_json_count, CAST(2 AS BIGINT) AS image_id_match_count, true AS has_valid_json_all, 'object' AS primary_object_pred FROM (SELECT DISTINCT doc_id FROM labels)""")
def mock_backend_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [PropertySpec("toxic", "g", "toxic", "boolean", ("true", "false", "unknown")), PropertySpec("quality", "g", "quality", "boolean", ("true", "false", "unknown"))]
    rows = _read(spark, sf_dir, "labels").select("doc_id").distinct().crossJoin(F.broadcast(specs_frame(spark, specs).select("key", "ord")))
    image = F.col("doc_id").cast("string")
    asked = rows.select(F.lit("mock").alias("model"), F.lit("raw").alias("variant"), image.alias("image_id"), F.col("key").alias("property_key"), "ord", F.lit("true").alias("gt"), prompts.property_prompt(image, F.col("key"), F.lit("boolean"), F.array().cast("array<string>"), F.lit("")).alias("prompt"))
    _, runs = inference.evaluate(asked.withColumn("raw_output", inference.mock_from_prompt(F.col("prompt"))), specs)
    return runs.select("model", "variant", "image_id", "valid_json_count", "image_id_match_count", "has_valid_json_all", "primary_object_pred")


# ------------------------------------------------------------------ selection, joins, funnels


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a map of three properties."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id")
    flag = lambda c: F.when(F.col(c) == 1, "true").otherwise("unknown")
    gt = F.map_from_arrays(F.array(*map(F.lit, ("toxic", "quality", "lang"))), F.array(flag("toxic"), flag("quality"), F.coalesce("lang", F.lit("unknown"))))
    return rows.select(F.format_string("%012d", "doc_id").alias("image_id"), gt.alias("gt"))


_SAMPLES = "s AS (SELECT lpad(CAST(d.doc_id AS VARCHAR), 12, '0') AS image_id, toxic, quality, lang, (toxic = 1)::INT + (quality = 1)::INT + (lang IS NOT NULL)::INT AS known FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


@query(f"""WITH {_SAMPLES}, top AS (SELECT image_id AS demo, known FROM s WHERE known > 0 ORDER BY known DESC, image_id LIMIT 3),
    pairs AS (SELECT s.image_id, demo, row_number() OVER (PARTITION BY s.image_id ORDER BY top.known DESC, demo) AS n FROM s JOIN top ON demo <> s.image_id)
    SELECT s.image_id, coalesce(string_agg(demo, '|' ORDER BY n) FILTER (WHERE n <= 2), '') AS demos FROM s LEFT JOIN pairs p ON s.image_id = p.image_id GROUP BY 1""")
def few_shot_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.few_shot_fixed(_samples(spark, sf_dir), 2).select("image_id", F.array_join("demos", "|").alias("demos"))


@query(f"""WITH {_SAMPLES}, l AS (SELECT image_id, 'toxic' AS property_key, toxic = 1 AS ok FROM s UNION ALL SELECT image_id, 'quality', quality = 1 FROM s),
    top AS (SELECT * FROM (SELECT property_key, image_id AS demo, row_number() OVER (PARTITION BY property_key ORDER BY image_id) AS n FROM l WHERE ok) WHERE n <= 3),
    pairs AS (SELECT l.image_id, l.property_key, demo, row_number() OVER (PARTITION BY l.image_id, l.property_key ORDER BY demo) AS n FROM l JOIN top ON l.property_key = top.property_key AND demo <> l.image_id)
    SELECT l.image_id, l.property_key, coalesce(string_agg(demo, '|' ORDER BY n) FILTER (WHERE n <= 2), '') AS demos FROM l LEFT JOIN pairs p ON l.image_id = p.image_id AND l.property_key = p.property_key GROUP BY 1, 2""")
def few_shot_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir).select("image_id", F.explode("gt").alias("property_key", "gt")).filter(F.col("property_key") != "lang")
    return ranking.few_shot_dynamic(rows, 2).select("image_id", "property_key", F.array_join("demos", "|").alias("demos"))


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def allow_list_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.allow_list(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels").filter("quality = 1"), "doc_id").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def holdout_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.without(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT p_partkey, p_type FROM part WHERE p_type NOT IN ('LARGE', 'PROMO')")
def exclude_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.exclude_types(_read(spark, sf_dir, "part"), ["LARGE", "PROMO"], "p_type").select("p_partkey", "p_type")


@query("""WITH j AS (SELECT l.*, p_partkey, p_type, (l_quantity > 10)::INT + (l_discount > 0.03)::INT + (l_tax > 0.02)::INT AS known FROM lineitem l LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10)
    SELECT CAST(count(*) AS BIGINT) AS records_total, CAST(count(*) FILTER (WHERE p_partkey IS NOT NULL) AS BIGINT) AS with_image, CAST(count(*) FILTER (WHERE p_partkey IS NOT NULL AND known >= 2) AS BIGINT) AS with_min_known,
    CAST(count(*) FILTER (WHERE p_partkey IS NOT NULL AND known >= 2 AND p_type <> 'LARGE') AS BIGINT) AS candidates FROM j""")
def listing_join_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part").filter("p_size > 10").select("p_partkey", "p_type")
    rows = _read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    known = keywords.known_count([F.when(c, "yes").otherwise("unknown") for c in (F.col("l_quantity") > 10, F.col("l_discount") > 0.03, F.col("l_tax") > 0.02)])
    return metrics.funnel(rows, [("with_image", F.col("p_partkey").isNotNull()), ("with_min_known", known >= 2), ("candidates", F.col("p_type") != "LARGE")])


@query("SELECT p_brand, p_type, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_partkey) AS n FROM part) WHERE n = 1")
def dedup_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.dedup_best(_read(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_size", "p_partkey").select("p_brand", "p_type", "p_partkey", "p_size")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentation results from events: a user is an image, a type a method."""
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("image_name"), F.col("event_type").alias("method"), F.col("value").alias("iou"), (F.col("event_id") % 17).cast("double").alias("dice"), F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("double")).otherwise((F.col("event_id") % 5).cast("double")).alias("sam_score"), (F.col("event_id") % 7).cast("double").alias("dino_score"), "event_id")


_RESULTS = "r AS (SELECT user_id AS image_name, event_type AS method, value AS iou, CAST(event_id % 17 AS DOUBLE) AS dice, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 5 AS DOUBLE) END AS sam_score, CAST(event_id % 7 AS DOUBLE) AS dino_score, event_id FROM events)"
_BEST = "w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_name ORDER BY iou DESC, dice DESC, coalesce(sam_score, -1) DESC, dino_score DESC, method) AS n FROM r WHERE method IN ('click', 'signup', 'view')) WHERE n = 1)"
_METHODS = ["click", "signup", "view"]


@query(f"WITH {_RESULTS}, {_BEST} SELECT image_name, method, iou FROM w")
def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.prompt_winners(_results(spark, sf_dir), _METHODS).select("image_name", "method", "iou")


@query(f"WITH {_RESULTS}, {_BEST} SELECT method, CAST(count(*) AS BIGINT) AS win_count, round_even(count(*) * 1.0e0 / (SELECT count(*) FROM w), 6) AS win_ratio FROM w GROUP BY 1")
def prompt_win_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.win_counts(ranking.prompt_winners(_results(spark, sf_dir), _METHODS)).withColumn("win_ratio", F.bround("win_ratio", 6))


_MAIN = f"WITH {_RESULTS}, {_BEST}, c AS (SELECT r.image_name, r.event_id, r.iou AS main_object_iou, w.method AS best_class_method, w.iou AS best_class_iou, CASE WHEN r.iou > w.iou THEN 'main_object' WHEN w.iou > r.iou THEN 'best_class' ELSE 'tie' END AS winner FROM r JOIN w ON r.image_name = w.image_name WHERE r.method = 'purchase')"


@query(f"{_MAIN} SELECT image_name, main_object_iou, best_class_method, best_class_iou, winner FROM c")
def main_vs_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.main_vs_best(_results(spark, sf_dir), "purchase", _METHODS).select("image_name", "main_object_iou", "best_class_method", "best_class_iou", "winner")


@query(f"{_MAIN} SELECT CAST(count(*) FILTER (WHERE winner = 'main_object') AS BIGINT) AS main_object_win_count, CAST(count(*) FILTER (WHERE winner = 'best_class') AS BIGINT) AS best_class_win_count, CAST(count(*) FILTER (WHERE winner = 'tie') AS BIGINT) AS tie_count, round_even(avg(main_object_iou), 4) AS main_object_mean_iou, round_even(avg(best_class_iou), 4) AS best_class_mean_iou FROM c")
def main_vs_best_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.main_vs_best_summary(ranking.main_vs_best(_results(spark, sf_dir), "purchase", _METHODS))
    return out.select("main_object_win_count", "best_class_win_count", "tie_count", F.bround("main_object_mean_iou", 4).alias("main_object_mean_iou"), F.bround("best_class_mean_iou", 4).alias("best_class_mean_iou"))


@query(f"WITH {_RESULTS} SELECT method, CAST(count(*) AS BIGINT) AS num_rows, CAST(count(DISTINCT image_name) AS BIGINT) AS num_images, round_even(avg(iou), 4) AS iou_mean, round_even(stddev_samp(iou), 4) AS iou_std, round_even(median(iou), 4) AS iou_median, round_even(avg(sam_score), 4) AS sam_score_mean FROM r GROUP BY 1")
def summary_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.summary_by_method(_results(spark, sf_dir), ["iou", "sam_score"])
    return out.select("method", "num_rows", "num_images", *(F.bround(c, 4).alias(c) for c in ("iou_mean", "iou_std", "iou_median", "sam_score_mean")))


@query(f"""WITH {_RESULTS} SELECT image_name, method, event_id FROM (SELECT *, row_number() OVER (PARTITION BY image_name ORDER BY CASE WHEN dino_score = 0 THEN -1 ELSE dino_score END DESC, CASE WHEN coalesce(sam_score, 0) = 0 THEN -1 ELSE sam_score END DESC, iou DESC, list_position(['carpet', 'rug', 'area_rug'], m) ) AS n FROM (SELECT *, CASE method WHEN 'click' THEN 'carpet' WHEN 'view' THEN 'rug' WHEN 'signup' THEN 'area_rug' END AS m FROM r) WHERE m IS NOT NULL AND iou > 0) WHERE n = 1""")
def update_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("method") == "click", "carpet").when(F.col("method") == "view", "rug").when(F.col("method") == "signup", "area_rug")
    rows = _results(spark, sf_dir).withColumns({"kind": F.col("method"), "method": F.coalesce(named, F.lit("main")), "area_ratio": F.col("iou")})
    return ranking.select_update(rows, "best_class").select("image_name", F.col("kind").alias("method"), "event_id")


@query("SELECT 'p_brand' AS property, p_brand AS value, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'p_type', p_type, CAST(count(*) AS BIGINT) FROM part GROUP BY p_type")
def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.value_distribution(_read(spark, sf_dir, "part"), ["p_brand", "p_type"])


@query("SELECT p_name, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 20")
def top_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_values(_read(spark, sf_dir, "part"), "p_name", 20)


def _reviews(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.col("source").alias("mask_path"), F.col("lang").alias("mask_path_hint"), F.lit("src").alias("mask_source"), F.lit("").alias("seg_preview_path"))
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("image_id"), F.col("doc_id").alias("ord"), F.when(F.col("quality") == 1, "approved").otherwise("rejected").alias("decision"), F.when(F.col("toxic") == 1, "mask_path_hint").otherwise("mask_path").alias("selected_mask_field"))
    none = F.lit(None).cast("string")
    return docs, labels.withColumns({"selected_source_field": none, "selected_preview_field": none, "reviewed_at": F.lit("t0")})


@query("SELECT d.doc_id AS image_id, CASE WHEN toxic = 1 AND lang <> '' THEN lang ELSE source END AS mask_path, 'approved' AS review_decision FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1")
def review_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _reviews(spark, sf_dir)
    return joins.approved_rows(docs, labels).select("image_id", "mask_path", "review_decision")


@query("SELECT d.doc_id AS image_id, source AS mask_path, 'keep' AS final_review_decision, 't0' AS final_review_timestamp FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1")
def review_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _reviews(spark, sf_dir)
    kept = labels.withColumn("decision", F.when(F.col("decision") == "approved", "keep").otherwise("drop"))
    return joins.kept_rows(docs, kept).select("image_id", "mask_path", "final_review_decision", "final_review_timestamp")


@query("SELECT decision, CAST(count(*) AS BIGINT) AS n FROM (SELECT coalesce(CASE quality WHEN 1 THEN 'approved' WHEN 0 THEN 'rejected' END, 'undecided') AS decision FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY 1")
def review_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.review_progress(*_reviews(spark, sf_dir))


@query("SELECT p_partkey, coalesce(nullif(trim(regexp_replace(replace(replace(lower(CASE WHEN p_size % 2 = 0 THEN p_name END), '_', ' '), '-', ' '), '\\s+', ' ', 'g')), ''), lower(p_type)) AS prompt, lower(p_type) || '.' AS detector, 'grounded_sam:rug:' || p_brand AS source FROM part")
def hint_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), F.replace(F.col("p_name"), F.lit(" "), F.lit("_-"))))
    rows = _read(spark, sf_dir, "part")
    return rows.select("p_partkey", text.build_hint_prompt("primary_object", name, F.col("p_type"), F.lit(None).cast("string")).alias("prompt"), text.detector_prompt(F.col("p_type")).alias("detector"), text.provenance(F.lit("rug"), F.col("p_brand")).alias("source"))


@query("""WITH p AS (SELECT label, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b, vec_id FROM embeddings), q AS (SELECT vec_id, a, b FROM p WHERE b IS NOT NULL),
    e AS (SELECT vec_id, unnest(a) AS x, unnest(b) AS y FROM q)
    SELECT vec_id, CAST(count(*) FILTER (WHERE x > 0 AND y > 0) AS BIGINT) AS both, CAST(count(*) FILTER (WHERE x > 0 OR y > 0) AS BIGINT) AS either, CAST(count(*) FILTER (WHERE x > 0) AS BIGINT) AS area FROM e GROUP BY 1""")
def mask_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _read(spark, sf_dir, "embeddings").withColumn("next", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).filter("next is not null")
    flags = lambda c: F.transform(c, lambda x: x > 0)
    n = masks.array_counts(flags("embedding"), flags("next"))
    return rows.select("vec_id", n["both"].alias("both"), n["either"].alias("either"), n["a"].alias("area"))


_CONTEXT = ["background_dominant_bin_ratio", "background_color_entropy", "background_std", "background_saturation", "background_white_ratio", "background_dark_ratio", "border_dominant_bin_ratio"]
_CTX = "WITH c AS (SELECT l_orderkey, l_linenumber, l_discount AS d, l_tax AS t, l_quantity / 50.0 AS q FROM lineitem), s AS (SELECT *, least(greatest(0.25 * (1 - d) + 0.2 * t + 0.15 * q + 0.1 * d + 0.1 * (1 - t) + 0.1 * (1 - q) + 0.1 * (1 - d), 0.0), 1.0) AS score FROM c)"


@query(f"{_CTX} SELECT l_orderkey, l_linenumber, round_even(score, 6) AS score, score >= 0.55 AND d <= 0.08 AND (q < 0.3 OR t <= 0.05) AS kept FROM s")
def context_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t, q = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50.0
    named = dict(zip(_CONTEXT, (d, t, q, d, t, q, d), strict=True))
    rows = _read(spark, sf_dir, "lineitem").withColumn("score", masks.context_score(named))
    kept = masks.context_kept({"context_score": F.col("score"), "border_white_ratio": d, "border_dominant_bin_ratio": d, "background_area_ratio": q, "background_white_ratio": t}, 0.55, 0.08, 1.0, 0.05, 0.3)
    return rows.select("l_orderkey", "l_linenumber", F.bround("score", 6).alias("score"), kept.alias("kept"))


@query("""SELECT l_orderkey AS image_name, l_linenumber AS idx FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY 0.65 * l_discount + 0.3 * l_tax - 0.05 * abs(l_quantity / 50.0 - 0.5) DESC, l_linenumber) AS n FROM lineitem) WHERE n = 1""")
def sam_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_name"), F.col("l_linenumber").alias("idx"), F.col("l_discount").alias("overlap"), F.col("l_tax").alias("model_iou"), (F.col("l_quantity") / 50.0).alias("area"), F.lit(0.5).alias("seed_area"))
    return ranking.refined_choice(rows).select("image_name", "idx")


@query("""SELECT l_orderkey AS image_name, l_linenumber AS idx FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY 0.6 * l_discount + 0.3 * l_tax - 0.2 * (l_quantity / 50.0) + CASE WHEN l_linenumber % 2 = 0 THEN 0.05 * l_discount ELSE 0.0 END DESC, l_linenumber) AS n FROM lineitem) WHERE n = 1""")
def main_object_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_name"), F.col("l_linenumber").alias("idx"), F.col("l_discount").alias("area_ratio"), F.col("l_tax").alias("center_score"), (F.col("l_quantity") / 50.0).alias("border_ratio"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")).alias("predicted_iou"))
    return ranking.main_object_choice(rows).select("image_name", "idx")


_QUOTA = """pool AS (SELECT *, row_number() OVER (ORDER BY known_count DESC, md5(key || ':42'), key) AS pos FROM
      (SELECT p_partkey AS key, (['wood', 'metal', 'glass', 'unknown'])[1 + CAST(p_size % 4 AS INT)] AS material, p_type AS product_type, CAST(p_partkey % 5 AS INT) AS known_count FROM part)),
    ids AS (SELECT *, dense_rank() OVER (ORDER BY material) AS m, dense_rank() OVER (ORDER BY product_type) AS t, 60 // (SELECT greatest(1, count(DISTINCT material)) FROM pool WHERE material <> 'unknown') AS quota FROM pool),
    zero AS (SELECT list_transform(range(max(m)), lambda x: 0) AS ms, list_transform(range(max(t)), lambda x: 0) AS ts, CAST(max(pos) AS BIGINT) AS last FROM ids),
    walk(step, taken, total, ms, ts, done) AS (
      SELECT CAST(0 AS BIGINT), false, CAST(0 AS BIGINT), ms, ts, CAST([] AS BIGINT[]) FROM zero
      UNION ALL
      SELECT step + 1, ok, total + CAST(ok AS BIGINT), list_transform(w.ms, lambda x, i: CASE WHEN i = m AND ok THEN x + 1 ELSE x END), list_transform(w.ts, lambda x, i: CASE WHEN i = t AND ok THEN x + 1 ELSE x END), CASE WHEN ok THEN list_append(done, pos) ELSE done END
      FROM (SELECT w.*, i.pos, i.m, i.t, total < 60 AND w.ts[t] < 25 AND NOT list_contains(done, pos) AND (step >= last OR material <> 'unknown' AND w.ms[m] < greatest(1, quota)) AS ok FROM walk w, zero z, ids i WHERE i.pos = step % last + 1 AND step < 2 * last) w)"""


@query(f"WITH RECURSIVE {_QUOTA} SELECT key, material, product_type, known_count, CAST(total - 1 AS INT) AS ord FROM walk JOIN ids ON pos = done[total] WHERE taken")
def quota_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two greedy passes; the SQL walks row by row."""
    material = F.array(*map(F.lit, ("wood", "metal", "glass", "unknown")))[(F.col("p_size") % 4).cast("int")]
    pool = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), material.alias("material"), F.col("p_type").alias("product_type"), (F.col("p_partkey") % 5).cast("int").alias("known_count"))
    return ranking.quota_select(pool, 60, 25, shuffle=ranking.shuffled_md5)


PRIORS = knowledge_priors({
    "properties": ["intrinsic.main_material", "intrinsic.transparency_class"],
    "aliases": {"intrinsic.main_material": {"r": "glass"}},
    "material_priors": {"glass": {"intrinsic.transparency_class": {"clear": 2.5, "opaque": -1.5}}, "a": {"intrinsic.transparency_class": {"opaque": 0.6}}},
    "pairwise_rules": [{"left_property": "intrinsic.transparency_class", "right_property": "intrinsic.main_material", "weights": {"clear": {"glass": 1.0, "a": -2.0}, "opaque": {"a": 0.5}}}],
})


def _bundle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders")
    rows = rows.select(F.concat(F.lit("m"), (F.col("o_custkey") % 3).cast("string")).alias("model"), F.lower("o_orderstatus").alias("variant"), F.col("o_orderkey").alias("image_id"), F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("price"))
    material = F.when(F.col("p").startswith("1"), "a").when(F.col("p").startswith("5"), "R").otherwise("unknown")
    see = F.when(F.col("price") > 150000, "clear").otherwise("opaque")
    pairs = F.array(F.struct(F.lit("intrinsic.main_material").alias("property_key"), material.alias("pred_value")), F.struct(F.lit("intrinsic.transparency_class").alias("property_key"), see.alias("pred_value")))
    return rows.select("model", "variant", "image_id", F.explode(pairs).alias("x")).select("model", "variant", "image_id", "x.*")


_BUNDLE = "WITH b AS (SELECT 'm' || CAST(o_custkey % 3 AS VARCHAR) AS model, lower(o_orderstatus) AS variant, o_orderkey AS image_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'a' WHEN o_orderpriority LIKE '5%' THEN 'glass' ELSE 'unknown' END AS m, CASE WHEN o_totalprice > 150000 THEN 'clear' ELSE 'opaque' END AS t FROM orders)"


@query(f"""{_BUNDLE} SELECT model, variant, image_id, round_even(1.5e0 + CASE WHEN m = 'glass' THEN CASE t WHEN 'clear' THEN 2.5e0 ELSE -1.5e0 END WHEN m = 'a' AND t = 'opaque' THEN 0.6e0 ELSE 0.0e0 END
    + CASE WHEN t = 'clear' AND m = 'glass' THEN 1.0e0 WHEN t = 'clear' AND m = 'a' THEN -2.0e0 WHEN t = 'opaque' AND m = 'a' THEN 0.5e0 ELSE 0.0e0 END, 4) AS score FROM b""")
def kg_bundle_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases, materials, rules = knowledge_frames(spark, PRIORS)
    rows = kg.canonical(_bundle_rows(spark, sf_dir), aliases).select("model", "variant", "image_id", "property_key", F.col("pred_value").alias("value"), F.col("pred_value").alias("original"))
    return kg.bundle_scores(rows, materials, rules).withColumn("score", F.bround("score", 4))


@query("SELECT toxic, CAST(greatest(ceil(count(*) / 32.0), 1) AS BIGINT) AS steps_per_epoch, CAST(greatest(ceil(greatest(ceil(count(*) / 32.0), 1) * 2.5), 1) AS BIGINT) AS total_steps, CAST(3 AS BIGINT) AS estimated_epochs FROM labels GROUP BY 1")
def train_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _read(spark, sf_dir, "labels").groupBy("toxic").agg(F.count("*").alias("n"))
    return counts.select("toxic", *(c.alias(k) for k, c in prompts.training_schedule(F.col("n"), 8, 4, 2.5).items()))


@query("SELECT event_id, user_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 4 AS BIGINT) AS batch FROM events")
def property_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.batches(_read(spark, sf_dir, "events"), ["user_id"], "event_id", 6, 4).select("event_id", "user_id", "batch")
