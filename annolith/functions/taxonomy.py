"""Projection of annotation values onto smaller label spaces, as Column expressions.

Arguments named raw are texts (NULL: absent); arguments named flag are booleans (NULL: absent
or no JSON boolean).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annolith.functions.text import UNKNOWN, lookup, normalize_token

# Label tables.
PDF_MATERIAL = {
    "wood": "wood",
    "metal": "metal",
    "glass": "glass",
    "plastic": "plastic",
    "fabric": "fabric",
    "paper": "paper/cardboard",
    "cardboard": "paper/cardboard",
    "ceramic": "ceramic/stone",
    "stone": "ceramic/stone",
    "rubber": "rubber",
    "leather": "leather",
    "unknown": "unknown",
}
NATURAL_MATERIAL = {
    "wood": "wood",
    "metal": "metal",
    "glass": "glass",
    "plastic": "plastic",
    "fabric": "fabric",
    "paper": "paper",
    "cardboard": "paper",
    "rubber": "rubber",
    "stone": "stone",
    "ceramic": "stone",
    "leather": "mixed",
    "composite": "mixed",
    "unknown": "unknown",
}
REFLECTANCE = {"matte": "matte", "glossy": "glossy", "semi_glossy": "glossy", "very_glossy": "glossy", "mirror_like": "glossy"}
ROUGHNESS = {"smooth": "smooth", "very_smooth": "smooth", "rough": "rough", "very_rough": "rough"}
PDF_RIGIDITY = {"rigid": "rigid", "flexible": "deformable", "floppy": "deformable"}
NATURAL_RIGIDITY = {"rigid": "rigid", "floppy": "soft", "flexible": "flexible", "semi_rigid": "flexible"}
BRITTLENESS = {"brittle": True, "very_brittle": True, "slightly_brittle": True, "non_brittle": False}
WEIGHT = {"very_light": "light", "light": "light", "heavy": "heavy", "very_heavy": "heavy"}
TEMPERATURE = {"room": "room", "room_temp": "room", "warm": "hot", "hot": "hot", "cold": "cold", "chilled": "cold", "frozen": "cold"}
PHASE = {"solid": "solid", "liquid": "liquid", "gas": "gas"}
FILLED = {"empty": "empty", "almost_empty": "partially_filled", "half_full": "partially_filled", "almost_full": "partially_filled", "full": "filled"}
SLIPPERINESS = {"slippery": "slippery", "high": "not_slippery", "normal": "not_slippery"}
SURFACE_ROUGHNESS = {"smooth": "smooth", "very_smooth": "smooth", "rough": "rough", "medium": "rough", "very_rough": "rough"}


def mapped(table: dict[str, str], raw: Column, default: str = UNKNOWN) -> Column:
    token = F.coalesce(normalize_token(raw), F.lit(UNKNOWN))
    return F.coalesce(lookup(table, token), F.lit(default))


def pdf_material(raw: Column) -> Column:
    return mapped(PDF_MATERIAL, raw, "other")


def natural_material(raw: Column) -> Column:
    return mapped(NATURAL_MATERIAL, raw)


def reflectance(raw: Column) -> Column:
    return mapped(REFLECTANCE, raw)


def roughness(raw: Column) -> Column:
    return mapped(ROUGHNESS, raw)


def pdf_rigidity(raw: Column) -> Column:
    return mapped(PDF_RIGIDITY, raw)


def natural_rigidity(raw: Column) -> Column:
    return mapped(NATURAL_RIGIDITY, raw)


def _fragility(flag: Column, raw: Column, sound: str) -> Column:
    """A real boolean decides; else the brittleness class."""
    by_class = {k: "fragile" if v else sound for k, v in BRITTLENESS.items()}
    return F.when(flag.isNotNull(), F.when(flag, "fragile").otherwise(sound)).otherwise(mapped(by_class, raw))


def pdf_fragility(flag: Column, raw: Column) -> Column:
    return _fragility(flag, raw, "not_fragile")


def natural_fragility(flag: Column, raw: Column) -> Column:
    return _fragility(flag, raw, "durable")


def natural_surface(material: Column, rough: Column) -> Column:
    """Mapped material fabric and mixed come before roughness."""
    kind = natural_material(material)
    return F.when(kind == "fabric", "fuzzy").when(kind == "mixed", "mixed").otherwise(mapped(SURFACE_ROUGHNESS, rough))


def dirt_state(flag: Column) -> Column:
    return F.when(flag, "dirty").when(~flag, "clean").otherwise(UNKNOWN)


def weight_hint(raw: Column) -> Column:
    return mapped(WEIGHT, raw)


def temperature_hint(raw: Column) -> Column:
    return mapped(TEMPERATURE, raw)


def phase(raw: Column) -> Column:
    return mapped(PHASE, raw)


def filled_state(raw: Column) -> Column:
    return mapped(FILLED, raw)


def slipperiness(raw: Column) -> Column:
    return mapped(SLIPPERINESS, raw)


def group_value(record: Column, group: str, name: str) -> Column:
    """groups.<group>.<name> of a record (variant) as text; NULL if absent."""
    return F.try_variant_get(record, f"$.groups.{group}.{name}", "string")


def group_flag(record: Column, group: str, name: str) -> Column:
    """A JSON boolean, or NULL."""
    value = F.try_variant_get(record, f"$.groups.{group}.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))


def ground_truth(record: Column, key: str, source_name: str | None = None) -> Column:
    """A property's raw text: dotted keys in their group, others at the top."""
    group, dot, name = key.partition(".")
    return group_value(record, group, source_name or name) if dot else F.try_variant_get(record, f"$['{source_name or key}']", "string")


def pdf_projection(record: Column) -> dict[str, Column]:
    """The 13 compact columns of the document protocol."""
    raw = lambda name: group_value(record, "intrinsic", name)
    state = lambda name: group_value(record, "state", name)
    return {
        "material": pdf_material(raw("main_material")),
        "transparency": F.coalesce(normalize_token(raw("transparency_class")), F.lit(UNKNOWN)),
        "reflectance": reflectance(raw("glossiness_class")),
        "surface_roughness": roughness(raw("surface_roughness_class")),
        "rigidity": pdf_rigidity(raw("rigidity_class")),
        "fragility": pdf_fragility(group_flag(record, "affordance", "breakable"), raw("brittleness_class")),
        "wetness": F.lit(UNKNOWN),
        "state": dirt_state(group_flag(record, "state", "is_dirty")),
        "weight_hint": weight_hint(raw("mass_class")),
        "temperature_hint": temperature_hint(state("object_temperature_class")),
        "phase": phase(raw("state_of_matter")),
        "filled_state": filled_state(state("fill_state_class")),
        "slipperiness_hint": slipperiness(raw("friction_class")),
    }


def transfer_projection(record: Column) -> dict[str, Column]:
    """The 5 columns of the natural-background transfer protocol."""
    raw = lambda name: group_value(record, "intrinsic", name)
    return {
        "material": natural_material(raw("main_material")),
        "rigidity": natural_rigidity(raw("rigidity_class")),
        "transparency": F.coalesce(normalize_token(raw("transparency_class")), F.lit(UNKNOWN)),
        "surface": natural_surface(raw("main_material"), raw("surface_roughness_class")),
        "fragility": natural_fragility(group_flag(record, "affordance", "breakable"), raw("brittleness_class")),
    }
