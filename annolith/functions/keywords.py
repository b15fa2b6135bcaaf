"""Pseudo-labels from product metadata by keywords, as Column expressions.

A material is found by whole words (alphanumeric synonyms) or by substring (others); hints are
plain substrings.  Synonyms of up to two characters never match.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolith.functions.text import UNKNOWN, once, product_type, space_lower

# Synonyms of each material, in order.
MATERIALS = {
    "glass": ["glass", "crystal", "стек", "glas", "verre", "vidrio"],
    "metal": ["metal", "steel", "iron", "aluminium", "aluminum", "alloy", "brass", "bronze", "chrome", "stainless", "металл"],
    "wood": ["wood", "wooden", "bamboo", "plywood", "timber", "madera", "holz", "legno", "木"],
    "plastic": ["plastic", "pvc", "acrylic", "polycarbonate", "polypropylene", "polyethylene", "polyurethane", "pu ", "abs", "пластик", "plast"],
    "rubber": ["rubber", "latex", "silicone", "silicon", "tpu", "silikon", "goma", "кауч"],
    "fabric": ["fabric", "textile", "cloth", "cotton", "polyester", "linen", "wool", "canvas", "nylon", "denim", "suede", "velvet", "mesh", "leather", "faux leather", "tela", "stoff", "algod", "baumwoll", "皮革", "涤纶"],
    "paper": ["paper", "cardboard", "karton", "papier", "papel", "бумаг"],
    "ceramic": ["ceramic", "porcelain", "earthenware", "clay", "keramik"],
    "stone": ["stone", "marble", "granite", "slate", "concrete", "cement", "камень", "piedra"],
}
# Hints.
SOFT = ["soft", "flex", "flexible", "elastic", "gel", "stretch"]
HARD = ["hard", "rigid", "solid", "stiff"]
TRANSPARENT = ["transparent", "clear", "see-through", "see through"]
TRANSLUCENT = ["translucent", "frosted", "semi-transparent", "semi transparent"]
OPAQUE = ["opaque", "solid color"]
FUZZY = ["fuzzy", "plush", "wool", "fleece", "fur", "velvet", "fluffy"]
ROUGH = ["rough", "textured", "grain", "grained", "ribbed", "embossed", "matte", "hammered"]
POROUS = ["porous", "sponge", "mesh", "foam"]
SMOOTH = ["smooth", "glossy", "polished", "sleek"]
FRAGILE = ["fragile", "breakable", "delicate", "brittle"]
DURABLE = ["durable", "unbreakable", "shatterproof", "heavy-duty", "heavy duty"]
# What a material implies where no hint decides.
RIGIDITY_OF = {"glass": "rigid", "metal": "rigid", "wood": "rigid", "ceramic": "rigid", "stone": "rigid", "fabric": "soft", "rubber": "flexible", "paper": "flexible", "mixed": "mixed"}
TRANSPARENCY_OF = {"glass": "transparent", "metal": "opaque", "wood": "opaque", "plastic": "opaque", "rubber": "opaque", "fabric": "opaque", "paper": "opaque", "ceramic": "opaque", "stone": "opaque"}
SURFACE_OF = {"glass": "smooth", "metal": "smooth", "plastic": "smooth", "ceramic": "smooth", "stone": "rough", "wood": "rough", "mixed": "mixed", "rubber": "smooth", "paper": "rough", "fabric": "mixed"}
FRAGILITY_OF = {"glass": "fragile", "ceramic": "fragile", "metal": "durable", "wood": "durable", "stone": "durable", "plastic": "durable", "rubber": "durable", "fabric": "durable", "paper": "fragile"}
FUZZY_TYPES = ["RUG", "BLANKET", "PILLOW", "SHEET"]


def material_pattern(synonyms: list[str]) -> str:
    """One alternation for a material."""
    usable = [s.lower() for s in synonyms if len(s) > 2]
    words = [re.escape(s.strip()) for s in usable if s.strip().isalnum()]
    others = [re.escape(s) for s in usable if not s.strip().isalnum()]
    return "(?U)" + "|".join([rf"\b(?:{'|'.join(words)})\b", *others])


def detect_materials(text: Column) -> Column:
    """Materials found, in the table's order."""
    padded = F.concat(F.lit(" "), space_lower(text), F.lit(" "))
    hits = lambda low: F.array_compact(F.array(*(F.when(low.rlike(material_pattern(s)), m) for m, s in MATERIALS.items())))
    return F.transform(F.array(padded), hits)[0]


def has_any(low: Column, hints: list[str]) -> Column:
    """low: a text normalised by space_lower, once for all rules."""
    return low.rlike("|".join(map(re.escape, hints)))


def _blob(*texts: Column) -> Column:
    return F.concat_ws(" | ", *(F.coalesce(t, F.lit("")) for t in texts))


def infer_material(material: Column, fabric: Column, finish: Column, title: Column, kind: Column) -> tuple[Column, Column]:
    """(value, source)."""
    direct, every = detect_materials(F.coalesce(material, F.lit(""))), detect_materials(_blob(material, fabric, finish, title, kind))
    value = F.when(F.size(direct) == 1, direct[0]).when(F.size(direct) > 1, "mixed").when(F.size(every) == 1, F.get(every, F.lit(0))).when(F.size(every) > 1, "mixed").otherwise(UNKNOWN)
    source = F.when(F.size(direct) == 1, "material_field").when(F.size(direct) > 1, "material_field_multi").when(F.size(every) == 1, "metadata_text").when(F.size(every) > 1, "metadata_text_multi").otherwise("none")
    return value, source


def _of(table: dict[str, str], material: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[material], F.lit(UNKNOWN))


def infer_rigidity(material: Column, low: Column) -> Column:
    return F.when(material == "plastic", F.when(has_any(low, SOFT), "flexible").otherwise("rigid")).otherwise(_of(RIGIDITY_OF, material))


def infer_transparency(material: Column, low: Column) -> Column:
    """low: the context and the colour."""
    return F.when(has_any(low, TRANSLUCENT), "translucent").when(has_any(low, TRANSPARENT), "transparent").when(has_any(low, OPAQUE), "opaque").otherwise(_of(TRANSPARENCY_OF, material))


def infer_surface(material: Column, low: Column, kind: Column) -> Column:
    """low: the context and the product type."""
    soft = (material == "fabric") & kind.rlike("|".join(FUZZY_TYPES))
    return F.when(has_any(low, FUZZY), "fuzzy").when(has_any(low, POROUS), "porous").when(has_any(low, ROUGH), "rough").when(has_any(low, SMOOTH), "smooth").when(soft, "fuzzy").otherwise(_of(SURFACE_OF, material))


def infer_fragility(material: Column, low: Column) -> Column:
    return F.when(has_any(low, FRAGILE), "fragile").when(has_any(low, DURABLE), "durable").otherwise(_of(FRAGILITY_OF, material))


TEXTS = ["product_type", "item_name", "bullet_point", "product_description", "color", "material", "fabric_type", "finish_type"]


def with_properties(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """df with product_kind, the five properties and material_source from text Columns by name (TEXTS; absent: NULL).

    One projection a step, so that each text is read and normalised once.
    """
    get = lambda name: fields.get(name, F.lit(None).cast("string"))
    out = df.withColumns({f"_{c}": once(get(c)) for c in TEXTS})
    out = out.withColumn("product_kind", once(product_type(F.col("_product_type"))))
    context = _blob(*(F.col(f"_{c}") for c in ("item_name", "bullet_point", "product_description", "color")), F.col("product_kind"))
    blob = _blob(*(F.col(f"_{c}") for c in ("material", "fabric_type", "finish_type", "item_name", "product_type")))
    out = out.withColumns({"_low": once(space_lower(context)), "_direct": once(detect_materials(F.coalesce("_material", F.lit("")))), "_every": once(detect_materials(blob))})
    one, many = lambda c: F.get(F.col(c), F.lit(0)), lambda c: F.size(c) > 1
    value = F.when(F.size("_direct") == 1, one("_direct")).when(many("_direct"), "mixed").when(F.size("_every") == 1, one("_every")).when(many("_every"), "mixed").otherwise(UNKNOWN)
    source = F.when(F.size("_direct") == 1, "material_field").when(many("_direct"), "material_field_multi").when(F.size("_every") == 1, "metadata_text").when(many("_every"), "metadata_text_multi").otherwise("none")
    out = out.withColumns({"material": once(value), "material_source": source})
    m, low = F.col("material"), F.col("_low")
    out = out.withColumns({"rigidity": once(infer_rigidity(m, low)), "transparency": once(infer_transparency(m, low)), "surface": once(infer_surface(m, low, F.col("product_kind"))), "fragility": once(infer_fragility(m, low))})
    return out.drop(*(f"_{c}" for c in TEXTS), "_low", "_direct", "_every")


def known_count(values: list[Column]) -> Column:
    """How many of the values are not unknown."""
    total = F.lit(0)
    for v in values:
        total = total + F.when(v != UNKNOWN, 1).otherwise(0)
    return total
