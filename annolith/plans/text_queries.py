"""Registered queries of text rules, taxonomies, prompts and schemas, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from annolith.functions import keywords, prompts, taxonomy, text
from annolith.operators import joins, metrics
from annolith.plans import pipelines
from annolith.plans.queries import _HITS, _any, _cases, _read, query
from annolith.session import kept, scratch_path
from annolith.sources import specs
from annolith.sources.specs import PropertySpec, specs_frame


def _choice(column: str, values: list[str | None]) -> Column:
    """One of values by a number column."""
    return F.array(*(F.lit(v).cast("string") for v in values))[(F.col(column) % len(values)).cast("int")]


def _choice_sql(column: str, values: list[str | None]) -> str:
    listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"([{listed}])[1 + CAST({column} % {len(values)} AS INT)]"


_REST = {
    "reflectance": (taxonomy.reflectance, taxonomy.REFLECTANCE, ["matte", "very_glossy", "mirror_like", "dull", None]),
    "pdf_rigidity": (taxonomy.pdf_rigidity, taxonomy.PDF_RIGIDITY, ["rigid", "floppy", "flexible", "semi_rigid"]),
    "natural_rigidity": (taxonomy.natural_rigidity, taxonomy.NATURAL_RIGIDITY, ["rigid", "floppy", "flexible", "semi_rigid", "x"]),
    "temperature": (taxonomy.temperature_hint, taxonomy.TEMPERATURE, ["room", "warm", "chilled", "frozen", "mild"]),
    "phase": (taxonomy.phase, taxonomy.PHASE, ["solid", "liquid", "gas", "plasma"]),
    "filled": (taxonomy.filled_state, taxonomy.FILLED, ["empty", "half_full", "almost_full", "full", "some"]),
    "slipperiness": (taxonomy.slipperiness, taxonomy.SLIPPERINESS, ["slippery", "high", "normal", "low"]),
}


@query("SELECT p_partkey, " + ", ".join(f"{_cases(_choice_sql('p_partkey', raw), table, 'unknown')} AS {name}" for name, (_, table, raw) in _REST.items()) + " FROM part")
def taxonomy_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part")
    # Raw values come with blanks, capitals and hyphens.
    shown = lambda c: F.concat(F.lit(" "), F.initcap(F.replace(c, F.lit("_"), F.lit("-"))))
    return rows.select("p_partkey", *(rule(shown(_choice("p_partkey", raw))).alias(name) for name, (rule, _, raw) in _REST.items()))


#: Every token of the label tables and some that none has, in no order of theirs; the SQL below states the tables again, by hand.
_EVERY = """wood metal glass plastic fabric paper cardboard ceramic stone rubber leather composite wax matte glossy semi_glossy very_glossy mirror_like dull smooth very_smooth rough very_rough medium bumpy rigid flexible floppy
    semi_rigid stiff very_light light heavy very_heavy room room_temp warm hot cold chilled frozen mild solid liquid gas plasma empty almost_empty half_full almost_full full slippery high normal low unknown""".split()
_BY_HAND = {
    "pdf_material": "CASE WHEN t IN ('wood', 'metal', 'glass', 'plastic', 'fabric', 'rubber', 'leather', 'unknown') THEN t WHEN t IN ('paper', 'cardboard') THEN 'paper/cardboard' WHEN t IN ('ceramic', 'stone') THEN 'ceramic/stone' ELSE 'other' END",
    "natural_material": "CASE WHEN t IN ('wood', 'metal', 'glass', 'plastic', 'fabric', 'rubber', 'stone', 'paper') THEN t WHEN t = 'cardboard' THEN 'paper' WHEN t = 'ceramic' THEN 'stone' WHEN t IN ('leather', 'composite') THEN 'mixed' ELSE 'unknown' END",
    "reflectance": "CASE WHEN t = 'matte' THEN 'matte' WHEN t IN ('glossy', 'semi_glossy', 'very_glossy', 'mirror_like') THEN 'glossy' ELSE 'unknown' END",
    "roughness": "CASE WHEN t IN ('smooth', 'very_smooth') THEN 'smooth' WHEN t IN ('rough', 'very_rough') THEN 'rough' ELSE 'unknown' END",
    "pdf_rigidity": "CASE WHEN t = 'rigid' THEN 'rigid' WHEN t IN ('flexible', 'floppy') THEN 'deformable' ELSE 'unknown' END",
    "natural_rigidity": "CASE WHEN t = 'rigid' THEN 'rigid' WHEN t = 'floppy' THEN 'soft' WHEN t IN ('flexible', 'semi_rigid') THEN 'flexible' ELSE 'unknown' END",
    "weight": "CASE WHEN t IN ('very_light', 'light') THEN 'light' WHEN t IN ('heavy', 'very_heavy') THEN 'heavy' ELSE 'unknown' END",
    "temperature": "CASE WHEN t IN ('room', 'room_temp') THEN 'room' WHEN t IN ('warm', 'hot') THEN 'hot' WHEN t IN ('cold', 'chilled', 'frozen') THEN 'cold' ELSE 'unknown' END",
    "phase": "CASE WHEN t IN ('solid', 'liquid', 'gas') THEN t ELSE 'unknown' END",
    "filled": "CASE WHEN t = 'empty' THEN 'empty' WHEN t IN ('almost_empty', 'half_full', 'almost_full') THEN 'partially_filled' WHEN t = 'full' THEN 'filled' ELSE 'unknown' END",
    "slipperiness": "CASE WHEN t = 'slippery' THEN 'slippery' WHEN t IN ('high', 'normal') THEN 'not_slippery' ELSE 'unknown' END",
    "surface": "CASE WHEN t = 'fabric' THEN 'fuzzy' WHEN t IN ('leather', 'composite') THEN 'mixed' WHEN t IN ('smooth', 'very_smooth') THEN 'smooth' WHEN t IN ('rough', 'medium', 'very_rough') THEN 'rough' ELSE 'unknown' END",
    "pdf_fragility": "CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size > 25 THEN 'fragile' ELSE 'not_fragile' END WHEN b IN ('brittle', 'very_brittle', 'slightly_brittle') THEN 'fragile' WHEN b = 'non_brittle' THEN 'not_fragile' ELSE 'unknown' END",
    "natural_fragility": "CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size > 25 THEN 'fragile' ELSE 'durable' END WHEN b IN ('brittle', 'very_brittle', 'slightly_brittle') THEN 'fragile' WHEN b = 'non_brittle' THEN 'durable' ELSE 'unknown' END",
}
_BRITTLE = ["brittle", "very_brittle", "slightly_brittle", "non_brittle", "odd", None]


@query(f"SELECT p_partkey, {', '.join(f'{v} AS {k}' for k, v in _BY_HAND.items())} FROM (SELECT *, {_choice_sql('p_partkey', _EVERY)} AS t, {_choice_sql('p_partkey', _BRITTLE)} AS b FROM part)")
def taxonomy_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of the label tables, against SQL that states them by itself."""
    t = taxonomy
    raw, brittle = F.concat(F.lit(" "), F.initcap(F.replace(_choice("p_partkey", _EVERY), F.lit("_"), F.lit("-")))), _choice("p_partkey", _BRITTLE)
    flag = F.when(F.col("p_size") % 3 == 0, F.col("p_size") > 25)
    made = {
        "pdf_material": t.pdf_material(raw),
        "natural_material": t.natural_material(raw),
        "reflectance": t.reflectance(raw),
        "roughness": t.roughness(raw),
        "pdf_rigidity": t.pdf_rigidity(raw),
        "natural_rigidity": t.natural_rigidity(raw),
        "weight": t.weight_hint(raw),
        "temperature": t.temperature_hint(raw),
        "phase": t.phase(raw),
        "filled": t.filled_state(raw),
        "slipperiness": t.slipperiness(raw),
        "surface": t.natural_surface(raw, raw),
        "pdf_fragility": t.pdf_fragility(flag, brittle),
        "natural_fragility": t.natural_fragility(flag, brittle),
    }
    return _read(spark, sf_dir, "part").select("p_partkey", *(c.alias(name) for name, c in made.items()))


_GROUPS = {
    "main_material": ["wood", "cardboard", "ceramic", "wax", None],
    "transparency_class": ["Clear", "Semi-Opaque", None],
    "glossiness_class": ["matte", "glossy", "x"],
    "surface_roughness_class": ["smooth", "very_rough", "medium", None],
    "rigidity_class": ["rigid", "flexible", "semi_rigid", None],
    "brittleness_class": ["brittle", "non_brittle", "odd"],
    "mass_class": ["heavy", "very_light", "medium"],
    "state_of_matter": ["solid", "gas", None],
    "friction_class": ["slippery", "normal", None],
}
_P = {name: _choice_sql("p_partkey", values) for name, values in _GROUPS.items()}
_BREAK = "CASE WHEN p_partkey % 3 = 0 THEN p_size > 25 END"


def _class(table: dict[str, str], name: str, default: str = "unknown") -> str:
    return _cases(_P[name], table, default)


def _brittle(sound: str) -> str:
    return f"CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_size > 25 THEN 'fragile' ELSE '{sound}' END ELSE CASE {_P['brittleness_class']} WHEN 'brittle' THEN 'fragile' WHEN 'non_brittle' THEN '{sound}' ELSE 'unknown' END END"


@query(f"""SELECT p_partkey, {_P["main_material"]} AS raw_material, {_class(taxonomy.PDF_MATERIAL, "main_material", "other").replace("ELSE 'other'", f"WHEN NULL THEN 'unknown' ELSE CASE WHEN {_P['main_material']} IS NULL THEN 'unknown' ELSE 'other' END")} AS pdf_material,
    CASE {_P["transparency_class"]} WHEN 'Clear' THEN 'clear' WHEN 'Semi-Opaque' THEN 'semi_opaque' ELSE 'unknown' END AS pdf_transparency, {_class(taxonomy.REFLECTANCE, "glossiness_class")} AS pdf_reflectance,
    {_class(taxonomy.ROUGHNESS, "surface_roughness_class")} AS pdf_surface_roughness, {_class(taxonomy.PDF_RIGIDITY, "rigidity_class")} AS pdf_rigidity, {_brittle("not_fragile")} AS pdf_fragility, 'unknown' AS pdf_wetness,
    CASE WHEN p_size % 2 = 0 THEN 'dirty' ELSE 'clean' END AS pdf_state, {_class(taxonomy.WEIGHT, "mass_class")} AS pdf_weight_hint, 'hot' AS pdf_temperature_hint, {_class(taxonomy.PHASE, "state_of_matter")} AS pdf_phase, 'partially_filled' AS pdf_filled_state,
    {_class(taxonomy.SLIPPERINESS, "friction_class")} AS pdf_slipperiness_hint, {_class(taxonomy.NATURAL_MATERIAL, "main_material")} AS natural_material, {_class(taxonomy.NATURAL_RIGIDITY, "rigidity_class")} AS natural_rigidity,
    CASE {_class(taxonomy.NATURAL_MATERIAL, "main_material")} WHEN 'fabric' THEN 'fuzzy' WHEN 'mixed' THEN 'mixed' ELSE {_class(taxonomy.SURFACE_ROUGHNESS, "surface_roughness_class")} END AS natural_surface, {_brittle("durable")} AS natural_fragility FROM part""")
def protocol_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both protocols' columns and a raw value from nested records."""
    rows = _read(spark, sf_dir, "part")
    own = F.struct(*(_choice("p_partkey", values).alias(name) for name, values in _GROUPS.items()))
    flags = F.struct(F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") > 25).alias("breakable"))
    state = F.struct((F.col("p_size") % 2 == 0).alias("is_dirty"), F.lit("warm").alias("object_temperature_class"), F.lit("half_full").alias("fill_state_class"))
    record = F.parse_json(F.to_json(F.struct(F.struct(own.alias("intrinsic"), flags.alias("affordance"), state.alias("state")).alias("groups"))))
    rows = rows.select("p_partkey", record.alias("r"))
    pdf = {f"pdf_{k}": v for k, v in taxonomy.pdf_projection(F.col("r")).items()}
    natural = {f"natural_{k}": v for k, v in taxonomy.transfer_projection(F.col("r")).items() if k != "transparency"}
    return rows.select("p_partkey", taxonomy.ground_truth(F.col("r"), "intrinsic.main_material").alias("raw_material"), *(v.alias(k) for k, v in {**pdf, **natural}.items()))


@query("""SELECT p_partkey, '["' || array_to_string(string_split(p_name, ' '), '", "') || '"]' AS listed, CASE WHEN p_size % 2 = 0 THEN p_name || ' ' || p_brand END AS stripped, lower(p_name || ' ' || p_brand) AS lowered,
    replace(upper(p_name), ' ', '_') AS kind, CASE p_type WHEN 'SMALL' THEN 'rug' WHEN 'LARGE' THEN 'phone case' WHEN 'PROMO' THEN 'object' ELSE lower(p_type) END AS object,
    CASE p_partkey % 5 WHEN 4 THEN NULL ELSE p_name END AS picked, lower(replace(p_name, ' ', '/')) AS meta, lower(replace(p_name, ' ', '_')) AS slug FROM part""")
def text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists as text, stripped and picked values, product types, keys."""
    rows = _read(spark, sf_dir, "part")
    name, n = F.col("p_name"), F.col("p_partkey") % 5
    spaced = F.concat(F.lit("  "), F.replace(name, F.lit(" "), F.lit(" \t")), F.lit("\n"), F.col("p_brand"), F.lit(" "))
    kind = F.when(F.col("p_type") == "SMALL", "RUG").when(F.col("p_type") == "LARGE", "CELLULAR_PHONE_CASE").when(F.col("p_type") == "PROMO", "UNKNOWN").otherwise(F.col("p_type"))
    quoted = prompts.json_string(F.concat(F.lit("  "), name))
    shape = F.when(n == 0, quoted).when(n == 1, F.concat(F.lit('{"value": '), quoted, F.lit("}"))).when(n == 2, F.concat(F.lit('{"standardized_values": ['), quoted, F.lit(', "other"], "value": "not this"}')))
    shape = shape.when(n == 3, F.concat(F.lit('[{"value": " "}, {"value": '), quoted, F.lit("}]"))).otherwise("[]")
    rows = rows.withColumn("v", F.parse_json(shape))
    return rows.select(
        "p_partkey",
        text.serialize_list(F.split("p_name", " ")).alias("listed"),
        text.safe_strip(F.when(F.col("p_size") % 2 == 0, spaced).otherwise(" \t ")).alias("stripped"),
        text.space_lower(spaced).alias("lowered"),
        text.product_type(F.concat(F.lit(" "), F.replace(name, F.lit(" "), F.lit("  ")))).alias("kind"),
        text.primary_object(kind).alias("object"),
        text.pick_value(F.col("v")).alias("picked"),
        text.meta_key(F.concat(F.lit(" "), F.upper(F.replace(name, F.lit(" "), F.lit("\\"))))).alias("meta"),
        text.slugify(F.initcap(F.concat(name, F.lit(" ")))).alias("slug"),
    )


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN '/data/new/id' || c_custkey || '.png' ELSE '/data/new/' || c_name || '.jpg' END AS panel, CASE WHEN c_custkey % 2 = 0 THEN '/abs/' || c_name ELSE '/root/data/sub/' || c_name END AS relative,
    'a/b/' || c_name AS path, 'x/' || c_mktsegment AS mask_path, 'y\\' || c_mktsegment AS other, 'grounded_sam:rug:' || c_mktsegment AS source, c_mktsegment || '+sam_vit_b' AS model, replace(replace(c_name, '#', '_'), ' ', '_') AS metric FROM customer""")
def path_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel paths under a new root, dataset paths, slashes, provenance and names."""
    rows = _read(spark, sf_dir, "customer")
    name, key = F.col("c_name"), F.col("c_custkey")
    panel = F.when(key % 4 == 3, F.lit(" ")).when(key % 4 == 2, F.concat(F.lit("old\\deep\\"), name, F.lit(".jpg"))).otherwise(F.concat(F.lit("/old/"), name, F.lit(".jpg ")))
    path = F.when(key % 2 == 0, F.concat(F.lit("\\abs\\"), name)).otherwise(F.concat(F.lit("sub\\"), name))
    fixed = text.fix_path_columns(rows.select("c_custkey", F.concat(F.lit("a\\b\\"), name).alias("path"), F.concat(F.lit("x\\"), F.col("c_mktsegment")).alias("mask_path"), F.concat(F.lit("y\\"), F.col("c_mktsegment")).alias("other"), "c_name", "c_mktsegment", panel.alias("p"), path.alias("q")))
    return fixed.select(
        "c_custkey",
        text.panel_path("/data/new/", F.col("p"), F.concat(F.lit("id"), key.cast("string"))).alias("panel"),
        text.relative_path("/root/data/", F.col("q")).alias("relative"),
        "path",
        "mask_path",
        "other",
        text.provenance(F.lit("rug"), F.col("c_mktsegment")).alias("source"),
        text.model_name(F.concat(F.lit("org/"), F.col("c_mktsegment")), F.lit("vit_b")).alias("model"),
        text.metric_key(name).alias("metric"),
    )


@query("SELECT p_partkey, p_size, p_type FROM part WHERE p_size IN (3, 11, 28, 40) AND p_type NOT IN ('LARGE', 'PROMO')")
def parsed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and product types from command-line lists."""
    rows = _read(spark, sf_dir, "part").filter(F.col("p_size").isin(text.parse_int_list("3, 11,,28 ,40")))
    return joins.exclude_types(rows, sorted(text.parse_str_set("large, Promo ,")), "p_type").select("p_partkey", "p_size", "p_type")


# ------------------------------------------------------------------ metadata to properties, candidates

_LISTING = """listing AS (SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_partkey AS VARCHAR) END AS item_id, CASE WHEN p_partkey % 13 <> 0 THEN 'i' || (p_partkey % 700) END AS image,
    p_name || ' ' || {extra} AS title, {color} AS color, p_type AS kind FROM part)"""
_EXTRA = ["Steel", "oak WOOD durable", "cotton mesh plush", "clear glass", "rubber foam", "plain", "flexible plastic", "frosted acrylic"]
_COLORS = ["red", "solid color", "frosted", "clear"]
_PROPERTIES = f"""{_LISTING.format(extra=_choice_sql("p_partkey", _EXTRA), color=_choice_sql("p_size", _COLORS))},
    blobs AS (SELECT *, lower(' |  |  | ' || title || ' | ' || kind) AS txt, lower(title || ' |  |  | ' || color || ' | ' || kind) AS low FROM listing), hit AS (SELECT *, {_HITS} AS hits FROM blobs),
    mat AS (SELECT *, CASE WHEN len(hits) = 1 THEN hits[1] WHEN len(hits) > 1 THEN 'mixed' ELSE 'unknown' END AS material, CASE WHEN len(hits) = 1 THEN 'metadata_text' WHEN len(hits) > 1 THEN 'metadata_text_multi' ELSE 'none' END AS material_source FROM hit),
    props AS (SELECT *, CASE WHEN material = 'plastic' THEN CASE WHEN {_any("low", keywords.SOFT)} THEN 'flexible' ELSE 'rigid' END ELSE {_cases("material", keywords.RIGIDITY_OF, "unknown")} END AS rigidity,
    CASE WHEN {_any("low", keywords.TRANSLUCENT)} THEN 'translucent' WHEN {_any("low", keywords.TRANSPARENT)} THEN 'transparent' WHEN {_any("low", keywords.OPAQUE)} THEN 'opaque' ELSE {_cases("material", keywords.TRANSPARENCY_OF, "unknown")} END AS transparency,
    CASE WHEN {_any("low", keywords.FUZZY)} THEN 'fuzzy' WHEN {_any("low", keywords.POROUS)} THEN 'porous' WHEN {_any("low", keywords.ROUGH)} THEN 'rough' WHEN {_any("low", keywords.SMOOTH)} THEN 'smooth' ELSE {_cases("material", keywords.SURFACE_OF, "unknown")} END AS surface,
    CASE WHEN {_any("low", keywords.FRAGILE)} THEN 'fragile' WHEN {_any("low", keywords.DURABLE)} THEN 'durable' ELSE {_cases("material", keywords.FRAGILITY_OF, "unknown")} END AS fragility FROM mat)"""


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.concat(F.lit("i"), (F.col("p_partkey") % 700).cast("string"))
    rows = _read(spark, sf_dir, "part")
    return rows.select("p_partkey", F.when(F.col("p_partkey") % 11 != 0, F.col("p_partkey").cast("string")).alias("item_id"), F.when(F.col("p_partkey") % 13 != 0, image).alias("main_image_id"), F.concat("p_name", F.lit(" "), _choice("p_partkey", _EXTRA)).alias("title"), _choice("p_size", _COLORS).alias("color"), F.col("p_type").alias("kind"))


@query(f"WITH {_PROPERTIES} SELECT p_partkey, kind AS product_kind, material, material_source, rigidity, transparency, surface, fragility FROM props")
def inferred_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keywords.with_properties(_listings(spark, sf_dir), {"item_name": F.col("title"), "product_type": F.col("kind"), "color": F.col("color")})
    return rows.select("p_partkey", "product_kind", "material", "material_source", "rigidity", "transparency", "surface", "fragility")


_FOUND = f"""{_PROPERTIES}, files AS (SELECT 'i' || x AS image, 'a/' || x || '.jpg' AS image_rel, x % 5 <> 0 AS here FROM (SELECT DISTINCT p_partkey % 700 AS x FROM part WHERE p_partkey % 700 % 3 <> 0)),
    joined AS (SELECT p.*, f.image_rel, coalesce(f.here, false) AS here, (material <> 'unknown')::INT + (rigidity <> 'unknown')::INT + (transparency <> 'unknown')::INT + (surface <> 'unknown')::INT + (fragility <> 'unknown')::INT AS known FROM props p LEFT JOIN files f ON p.image = f.image)"""
_OK = "item_id IS NOT NULL AND image IS NOT NULL AND image_rel IS NOT NULL AND here AND known >= 3"


def _candidates(spark: SparkSession, sf_dir: str, observation: Observation | None = None) -> tuple[DataFrame, DataFrame | None]:
    number = _read(spark, sf_dir, "part").select((F.col("p_partkey") % 700).alias("x")).filter("x % 3 <> 0").distinct()
    path = F.concat(F.lit("a/"), F.col("x").cast("string"), F.lit(".jpg"))
    index = number.select(F.concat(F.lit("i"), F.col("x").cast("string")).alias("image_id"), path.alias("path"))
    local = number.filter("x % 5 <> 0").select(path.alias("path"))
    rows = _listings(spark, sf_dir)
    return joins.candidates(rows, index, {"item_name": F.col("title"), "product_type": F.col("kind"), "color": F.col("color")}, 3, ["LARGE"], local, observation)


@query(f"WITH {_FOUND} SELECT item_id, image AS main_image_id, image_rel, kind AS product_type, lower(kind) AS primary_object, material, rigidity, transparency, surface, fragility, CAST(known AS INT) AS known_count, title FROM joined WHERE {_OK} AND kind <> 'LARGE'")
def listing_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with ids, an image path, a local file and enough known properties."""
    found, _ = _candidates(spark, sf_dir)
    return found.withColumn("known_count", F.col("known_count").cast("int"))


@query(f"""WITH {_FOUND}, n AS (SELECT item_id IS NOT NULL AND image IS NOT NULL AS a, image_rel IS NOT NULL AS b, here AS c, known >= 3 AS d, kind <> 'LARGE' AS e FROM joined)
    SELECT CAST(count(*) AS BIGINT) AS records_total, CAST(count(*) FILTER (WHERE a) AS BIGINT) AS records_with_ids, CAST(count(*) FILTER (WHERE a AND b) AS BIGINT) AS records_with_image_rel, CAST(count(*) FILTER (WHERE a AND b AND c) AS BIGINT) AS records_with_local_image,
    CAST(count(*) FILTER (WHERE a AND b AND c AND d) AS BIGINT) AS records_with_min_known, CAST(count(*) FILTER (WHERE a AND b AND c AND d AND e) AS BIGINT) AS candidates, CAST(count(*) FILTER (WHERE a AND b AND c AND d AND NOT e) AS BIGINT) AS records_excluded_by_product_type FROM n""")
def candidate_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted on the pass that writes the candidates."""
    seen = Observation("funnel")
    kept(_candidates(spark, sf_dir, seen)[0], "candidates")
    return joins.with_excluded(metrics.observed(spark, seen, joins.FUNNEL))


# ------------------------------------------------------------------ schemas

_DIMS = ["key", "group", "name", "source_name", "value_type", "allowed", "description", "ord"]


def _document(df: DataFrame, name: str) -> str:
    """Writes the one text of a frame (value), a file in JSON, which is YAML too; its path.  A schema has some hundred values."""
    path = scratch_path(df.sparkSession, name)
    df.coalesce(1).write.text(path)
    return path


def _by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a type of part: grp, its brands, sizes and number of parts."""
    rows = _read(spark, sf_dir, "part").groupBy("p_type")
    return rows.agg(F.sort_array(F.collect_set("p_brand")).alias("brands"), F.sort_array(F.collect_set((F.col("p_size") % 7).cast("string"))).alias("sizes"), F.count("*").alias("n")).withColumn("grp", F.lower("p_type"))


def _listed(key: str, value: Column) -> Column:
    """A JSON object of all rows, by key."""
    by_key = lambda a, b: F.when(a.key < b.key, -1).when(a.key > b.key, 1).otherwise(0)
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), value.alias("value"))), by_key))


_TOKEN = "replace(regexp_replace(trim(lower({})), '\\s+', '_', 'g'), '-', '_')"
_TYPES = f"""g AS (SELECT lower(p_type) AS grp, any_value(p_type) AS raw, count(*) AS n, list_sort(list(DISTINCT {_TOKEN.format("p_brand")})) AS brands, list_sort(list(DISTINCT CAST(p_size % 7 AS VARCHAR))) AS sizes FROM part GROUP BY 1),
    o AS (SELECT *, row_number() OVER (ORDER BY grp) - 1 AS k FROM g), every AS (SELECT list_sort(list(DISTINCT {_TOKEN.format("p_brand")})) AS brands FROM part),
    s AS (SELECT grp || '.brand' AS "key", grp AS "group", 'brand' AS name, 'brand' AS source_name, 'categorical' AS value_type, array_to_string(brands, '|') || '|unknown' AS allowed, n || ' parts' AS description, 4 * k AS ord FROM o
      UNION ALL SELECT grp || '.maker', grp, 'maker', 'maker', 'categorical', array_to_string(every.brands, '|') || '|unknown', '', 4 * k + 1 FROM o, every
      UNION ALL SELECT grp || '.large', grp, 'large', 'large', 'boolean', 'true|false|unknown', '', 4 * k + 2 FROM o
      UNION ALL SELECT grp || '.sizes', grp, 'sizes', 'sizes', 'multi_categorical', array_to_string(sizes, '|'), '', 4 * k + 3 FROM o)"""


@query(f"""WITH {_TYPES}, compact AS (SELECT grp AS "key", 'pdf_compact' AS "group", grp AS name, raw AS source_name, 'categorical' AS value_type, array_to_string(brands, '|') || '|unknown' AS allowed, '' AS description, row_number() OVER (ORDER BY grp) - 1 AS ord FROM g),
    first AS (SELECT min(grp) AS grp FROM g), narrow AS (SELECT *, row_number() OVER (ORDER BY "key" DESC) - 1 AS place FROM s WHERE name IN ('large', 'sizes'))
    SELECT 'full' AS protocol, "key", "group", name, source_name, value_type, allowed, description, CAST(ord AS INT) AS ord FROM s UNION ALL SELECT 'one', "key", "group", name, source_name, value_type, allowed, description, CAST(ord AS INT) FROM s WHERE "group" = (SELECT grp FROM first)
    UNION ALL SELECT 'narrow', "key", "group", name, source_name, value_type, allowed, description, CAST(place AS INT) FROM narrow UNION ALL SELECT 'compact', "key", "group", name, source_name, value_type, allowed, description, CAST(ord AS INT) FROM compact""")
def schema_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema files made of the parts' types, brands and sizes, of each kind, to dimension rows: whole, one group, a subset in its
    own order, compact."""
    types = _by_type(spark, sf_dir)
    brands = _read(spark, sf_dir, "part").agg(F.sort_array(F.collect_set("p_brand")).alias("every"))
    text = lambda name: F.lit(name).alias("type")
    properties = F.struct(
        F.struct(text("categorical"), F.col("brands").alias("enum"), F.concat(F.col("n").cast("string"), F.lit(" parts")).alias("description")).alias("brand"),
        F.struct(text("categorical"), F.lit("brands").alias("enum_ref")).alias("maker"),
        F.struct(text("number")).alias("weight"),
        F.struct(text("boolean")).alias("large"),
        F.struct(text("list"), F.struct(text("categorical"), F.col("sizes").alias("enum")).alias("items")).alias("sizes"),
    )
    ontology = types.agg(_listed("grp", F.struct(properties.alias("properties"))).alias("groups")).crossJoin(brands)  # one row each
    full = _document(ontology.select(F.to_json(F.struct(F.struct(F.col("every").alias("brands")).alias("enums"), "groups")).alias("value")), "ontology")
    own = F.struct(text("categorical"), F.col("brands").alias("enum"), F.col("p_type").alias("source_name"))
    compact = _document(types.agg(F.to_json(F.struct(_listed("grp", own).alias("properties"))).alias("value")), "compact")
    keys = F.sort_array(F.flatten(F.collect_list(F.array(F.concat("grp", F.lit(".large")), F.concat("grp", F.lit(".sizes"))))), asc=False)
    subset = _document(types.agg(F.to_json(F.struct(keys.alias("property_keys"))).alias("value")), "subset")
    made = {
        "full": specs.protocol_specs(spark, "full_expanded", full),
        "one": specs.protocol_specs(spark, "expanded_ontology", full, groups=[types.agg(F.min("grp")).first()[0]]),
        "narrow": specs.protocol_specs(spark, "narrow_core", full, subset),
        "compact": specs.protocol_specs(spark, "pdf_protocol", compact),
    }
    out = None
    for name, found in made.items():
        part = specs_frame(spark, found).select(F.lit(name).alias("protocol"), *_DIMS).withColumn("allowed", F.array_join("allowed", "|"))
        out = part if out is None else out.union(part)
    return out


_NORM = "replace(replace(replace(trim(lower({})), '-', '_'), '/', '_'), ' ', '_')"


@query(f"""WITH p AS (SELECT p_brand AS brand, p_type AS kind, 'Size ' || p_size % 3 AS size, count(*) AS n FROM part GROUP BY 1, 2, 3)
    SELECT 'alias' AS kind, 'part.brand' AS property, {_NORM.format("brand")} AS one, {_NORM.format("min(kind)")} AS two, 0.0e0 AS w FROM p GROUP BY brand
    UNION ALL SELECT 'material', 'part.size', {_NORM.format("kind")}, {_NORM.format("size")}, CAST(sum(n) AS DOUBLE) FROM p GROUP BY kind, size
    UNION ALL SELECT 'rule', 'part.brand>part.size', {_NORM.format("brand")}, {_NORM.format("size")}, CAST(sum(n) AS DOUBLE) FROM p GROUP BY brand, size""")
def knowledge_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A priors file made of how often parts' brands, types and sizes meet, to its three tables, every key and value normalised."""
    rows = _read(spark, sf_dir, "part").select("p_brand", "p_type", F.concat(F.lit("Size "), (F.col("p_size") % 3).cast("string")).alias("size"))

    def nested(outer: str) -> DataFrame:
        """outer, weights: how often each size stands with it."""
        inner = rows.groupBy(outer, "size").agg(F.count("*").cast("double").alias("n"))
        return inner.groupBy(outer).agg(F.map_from_entries(F.collect_list(F.struct("size", "n"))).alias("weights"))

    alias = rows.groupBy("p_brand").agg(F.min("p_type").alias("to"))
    aliases = alias.agg(_listed("p_brand", F.col("to")).alias("aliases"))
    own = nested("p_type")
    materials = own.agg(_listed("p_type", F.map_from_arrays(F.array(F.lit("part.size")), F.array("weights"))).alias("materials"))
    pairs = nested("p_brand")
    rules = pairs.agg(_listed("p_brand", F.col("weights")).alias("rules"))
    # The rule comes in two halves, which add up.
    half = F.transform_values("rules", lambda _, row: F.transform_values(row, lambda _, n: n / 2))
    rule = F.struct(F.lit("part.brand").alias("left_property"), F.lit("part.size").alias("right_property"), half.alias("weights"))
    whole = aliases.crossJoin(materials).crossJoin(rules)  # one row each
    body = F.struct(F.array(F.lit("part.brand")).alias("properties"), F.map_from_arrays(F.array(F.lit("part.brand")), F.array("aliases")).alias("aliases"), F.col("materials").alias("material_priors"), F.array(rule, rule).alias("pairwise_rules"))
    path = _document(whole.select(F.to_json(body).alias("value")), "priors")
    found, priors, between = specs.knowledge_frames(spark, specs.knowledge_priors(specs.read_yaml(spark, path)))
    out = found.select(F.lit("alias").alias("kind"), "property", F.col("value").alias("one"), F.col("to").alias("two"), F.lit(0.0).alias("w"))
    out = out.union(priors.select(F.lit("material"), "property", "material", "value", "w"))
    return out.union(between.select(F.lit("rule"), F.concat("lp", F.lit(">"), "rp"), "lv", "rv", "w"))


# ------------------------------------------------------------------ prompts and training rows

_SPECS = [PropertySpec("toxic", "g", "toxic", "boolean", ("true", "false", "unknown"), description="Is it rude?"), PropertySpec("mood", "g", "mood", "categorical", ("calm", "loud", "unknown"))]
_TRAIN = "t AS (SELECT CAST(doc_id AS VARCHAR) AS image_id, 'p/' || doc_id AS path, CASE toxic WHEN 1 THEN 'true' ELSE 'unknown' END AS toxic, CASE quality WHEN 1 THEN 'calm' ELSE 'loud' END AS mood FROM labels)"


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = F.map_from_arrays(F.array(F.lit("toxic"), F.lit("mood")), F.array(F.when(F.col("toxic") == 1, "true").otherwise("unknown"), F.when(F.col("quality") == 1, "calm").otherwise("loud")))
    return _read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("image_id"), F.concat(F.lit("p/"), F.col("doc_id").cast("string")).alias("path"), gt.alias("gt"))


def _prompt_sql(key: str, rule: str, described: str) -> str:
    head = "'" + prompts.HEAD.replace("'", "''") + (f"\nProperty description: {described}" if described else "") + "'"
    return f"replace(replace(replace(replace({head}, '{{image}}', image_id), '{{key}}', '{key}'), '{{hint}}', 'string'), '{{rule}}', '- \"{key}\" must be one of [{rule}]')"


def _answer_sql(key: str) -> str:
    return f"""'{{"image_id": "' || image_id || '", "primary_object": "object", "properties": {{"{key}": "' || {key} || '"}}, "notes": "reference example"}}'"""


@query(f"""WITH {_TRAIN} SELECT image_id, path AS image_path, 'toxic' AS property_key, {_prompt_sql("toxic", "true|false|unknown", "Is it rude?")} AS prompt, {_answer_sql("toxic")} AS response, toxic AS gt_value FROM t WHERE toxic <> 'unknown'
    UNION ALL SELECT image_id, path, 'mood', {_prompt_sql("mood", "calm|loud|unknown", "")}, {_answer_sql("mood")}, mood FROM t""")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.training_examples(_train(spark, sf_dir), _SPECS)


@query(f"""WITH {_TRAIN} SELECT image_id, 'user=What is 1?;assistant=One of ' || mood || '.;user=What is ' || path || '?' AS chat, 'user=What is ' || path || '?' AS one FROM t""")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demos before the question, and the question alone."""
    rows = _train(spark, sf_dir)
    demos = F.array(F.struct(F.lit("What is 1?").alias("prompt"), F.concat(F.lit("One of "), F.col("gt")["mood"], F.lit(".")).alias("response")))
    shown = lambda m: F.array_join(F.transform(m, lambda x: F.concat(x.role, F.lit("="), x.content)), ";")
    question = F.concat(F.lit("What is "), F.col("path"), F.lit("?"))
    return rows.select("image_id", shown(prompts.few_shot_messages(demos, question)).alias("chat"), shown(prompts.user_message(question)).alias("one"))
