"""Normalisation of tokens, prompts, keys and paths, as Column expressions.

`unknown` is the value for what is missing; it is a string and not NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Tokens that mean nothing was given.
NULL_TOKENS = ["", "none", "null", "nan"]
TRUE_TOKENS, FALSE_TOKENS = ["true", "1", "yes", "y"], ["false", "0", "no", "n"]


def once(value: Column) -> Column:
    """The same value, nondeterministic to the optimiser: it is computed in its own projection and not copied into every
    filter and expression above, which for rules upon rules upon texts would grow beyond bounds."""
    return F.when(F.rand(0) >= 0.0, value)


def strip(value: Column) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def normalize_token(value: Column) -> Column:
    """Trimmed, lower case, white space runs and hyphens as underscores."""
    return F.translate(F.regexp_replace(F.lower(strip(value)), r"(?U)\s+", "_"), "-", "_")


def normalize_categorical(value: Column, allowed: Column) -> Column:
    """The token if it is allowed, else with / as _, else unknown."""
    token = normalize_token(value)
    swapped = F.replace(token, F.lit("/"), F.lit("_"))
    return F.when(token.isNull() | token.isin(NULL_TOKENS), UNKNOWN).when(F.array_contains(allowed, token), token).when(F.array_contains(allowed, swapped), swapped).otherwise(UNKNOWN)


def normalize_boolean(value: Column) -> Column:
    token = normalize_token(value)
    return F.when(token.isin(TRUE_TOKENS), "true").when(token.isin(FALSE_TOKENS), "false").otherwise(UNKNOWN)


def normalize_multi(values: Column, allowed: Column) -> Column:
    """Allowed tokens of an array of strings, first occurrences only; null gives an empty array."""
    tokens = F.transform(F.coalesce(values, F.array().cast("array<string>")), normalize_token)
    return F.array_distinct(F.filter(tokens, lambda x: F.array_contains(allowed, x) & (x != UNKNOWN)))


def split_list(value: Column) -> Column:
    return F.split(value, ",")


def normalize_value(value: Column, value_type: Column, allowed: Column) -> Column:
    """Scalar types by value_type; lists become their JSON text."""
    many = serialize_list(normalize_multi(split_list(value), allowed))
    return F.when(value_type == "multi_categorical", many).when(value_type == "boolean", normalize_boolean(value)).otherwise(normalize_categorical(value, allowed))


def is_known(value: Column) -> Column:
    """For scalars and for lists in their JSON text."""
    return ~F.coalesce(value, F.lit(UNKNOWN)).isin(UNKNOWN, "[]", "")


def is_known_list(values: Column) -> Column:
    return F.coalesce(F.size(values) > 0, F.lit(False))


def values_equal(gt: Column, pred: Column) -> Column:
    return is_known(gt) & F.coalesce(gt == pred, F.lit(False))


def lists_equal(gt: Column, pred: Column) -> Column:
    return is_known_list(gt) & F.coalesce(F.array_sort(gt) == F.array_sort(pred), F.lit(False))


def serialize_list(values: Column) -> Column:
    """JSON text with a space after each comma."""
    quoted = F.transform(values, lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def norm_knowledge(value: Column) -> Column:
    """Lower case; hyphen, slash and space each an underscore; white space is not collapsed."""
    token = F.translate(F.lower(strip(value)), "-/ ", "___")
    return F.when(token.isNull() | token.isin(NULL_TOKENS), UNKNOWN).otherwise(token)


def column_prefix(key: str) -> str:
    return key.replace(".", "__")


def safe_strip(value: Column) -> Column:
    """Trimmed with single spaces; empty becomes NULL."""
    return F.nullif(strip(F.regexp_replace(value, r"(?U)\s+", " ")), F.lit(""))


def space_lower(value: Column) -> Column:
    return F.lower(F.coalesce(safe_strip(value), F.lit("")))


def pick_value(value: Column) -> Column:
    """The first usable text of a variant: a string, {standardized_values, value}, or a list of those."""

    def of(path: str) -> Column:
        return safe_strip(F.try_variant_get(value, path, "string"))

    listed = F.coalesce(F.size(F.try_variant_get(value, "$.standardized_values", "array<variant>")) > 0, F.lit(False))
    one = F.when(listed, of("$.standardized_values[0]")).otherwise(of("$.value"))
    items = F.try_variant_get(value, "$", "array<variant>")
    std = F.filter(F.transform(items, lambda x: F.try_variant_get(x, "$.standardized_values[0]", "string")), lambda x: safe_strip(x).isNotNull())
    val = F.filter(F.transform(items, lambda x: F.coalesce(F.try_variant_get(x, "$.value", "string"), F.when(~F.schema_of_variant(x).startswith("OBJECT"), F.try_variant_get(x, "$", "string")))), lambda x: safe_strip(x).isNotNull())
    scalar = F.when(F.schema_of_variant(value) == "STRING", of("$"))
    return F.coalesce(scalar, one, safe_strip(F.get(std, F.lit(0))), safe_strip(F.get(val, F.lit(0))))


def product_type(value: Column) -> Column:
    """UPPER_SNAKE; empty is UNKNOWN."""
    return F.coalesce(F.regexp_replace(F.upper(safe_strip(value)), " ", "_"), F.lit("UNKNOWN"))


# Product types with a name of their own.
PRIMARY_OBJECTS = {
    "CELLULAR_PHONE_CASE": "phone case",
    "PORTABLE_ELECTRONIC_DEVICE_COVER": "device cover",
    "SHOES": "shoes",
    "SANDAL": "sandals",
    "BOOT": "boots",
    "CHAIR": "chair",
    "SOFA": "sofa",
    "TABLE": "table",
    "RUG": "rug",
    "LAMP": "lamp",
    "LIGHT_FIXTURE": "light fixture",
    "GLASSWARE": "glassware",
}


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of key in a small fixed table, or NULL."""
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def primary_object(kind: Column) -> Column:
    return F.coalesce(lookup(PRIMARY_OBJECTS, kind), F.when(kind == "UNKNOWN", "object"), F.lower(F.replace(kind, F.lit("_"), F.lit(" "))))


def hint_prompt(value: Column) -> Column:
    """Lower case, _ and - as spaces, single spaces; empty becomes NULL."""
    return safe_strip(F.translate(F.lower(value), "_-", "  "))


HINT_ORDER = {
    "primary_object": ["primary_object", "product_type", "title"],
    "product_type": ["product_type", "primary_object", "title"],
    "title": ["title", "primary_object", "product_type"],
}


def build_hint_prompt(field: str, primary: Column, kind: Column, title: Column) -> Column:
    if field not in HINT_ORDER:
        raise ValueError(f"unsupported hint field: {field}")
    given = {"primary_object": primary, "product_type": kind, "title": title}
    return F.coalesce(*(hint_prompt(given[name]) for name in HINT_ORDER[field]))


def meta_key(value: Column) -> Column:
    return F.lower(strip(F.translate(value, "\\", "/")))


def slugify(value: Column) -> Column:
    return F.replace(F.lower(strip(value)), F.lit(" "), F.lit("_"))


def model_name(detector: Column, kind: Column) -> Column:
    """The detector's last path part and the mask model's kind."""
    return F.concat(F.replace(F.element_at(F.split(detector, "/"), -1), F.lit(" "), F.lit("_")), F.lit("+sam_"), kind)


def metric_key(value: Column) -> Column:
    return F.regexp_replace(value, "[^a-zA-Z0-9_]+", "_")


def detector_prompt(value: Column) -> Column:
    """Trimmed, lower case, ending in a full stop."""
    text = F.lower(strip(value))
    return F.when(text.endswith("."), text).otherwise(F.concat(text, F.lit(".")))


def provenance(method: Column, model: Column) -> Column:
    return F.concat_ws(":", F.lit("grounded_sam"), method, model)


def relative_path(dataset_parent: str, path: Column) -> Column:
    """A dataset path on disk: backslashes as slashes, under the dataset's parent unless absolute."""
    fixed = F.translate(path, "\\", "/")
    return F.when(fixed.startswith("/"), fixed).otherwise(F.concat(F.lit(dataset_parent.rstrip("/") + "/"), fixed))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def panel_path(root: str, path: Column, image_id: Column) -> Column:
    """A panel's path under another root: by its file name, else by the id; NULL if there is neither."""
    name = F.coalesce(F.nullif(file_name(strip(path)), F.lit("")), F.concat(F.nullif(strip(image_id), F.lit("")), F.lit(".png")))
    return F.concat(F.lit(root.rstrip("/") + "/"), name)


def fix_path_columns(df):  # noqa: ANN001, ANN201
    """Slashes for backslashes in the columns named path or *_path."""
    names = [c for c in df.columns if c == "path" or c.endswith("_path")]
    return df.withColumns({c: F.translate(F.col(c), "\\", "/") for c in names}) if names else df


# Names by which mask and preview columns may be asked for.
MASK_FIELDS = {
    "mask_path": "mask_path",
    "masks": "mask_path",
    "masks_hint": "mask_path_hint",
    "mask_path_hint": "mask_path_hint",
    "masks_hint_title": "mask_path_hint_title",
    "mask_path_hint_title": "mask_path_hint_title",
}
PREVIEW_FIELDS = {
    "sam_preview_path": "sam_preview_path",
    "seg_preview_path": "seg_preview_path",
    "masks_preview": "seg_preview_path",
    "mask_preview_hint": "seg_preview_path_hint",
    "masks_preview_hint": "seg_preview_path_hint",
    "seg_preview_path_hint": "seg_preview_path_hint",
    "mask_preview_hint_title": "seg_preview_path_hint_title",
    "masks_preview_hint_title": "seg_preview_path_hint_title",
    "seg_preview_path_hint_title": "seg_preview_path_hint_title",
}


def field_choice(name: str | None, fields: dict[str, str]) -> str | None:
    """The column meant by a name; None for none."""
    asked = (name or "").strip()
    if asked and asked not in fields:
        raise ValueError(f"unknown field {name!r}; known: {sorted(fields)}")
    return fields[asked] if asked else None


def preview_field(mask_field: str) -> str | None:
    """The preview column that goes with a mask column."""
    return mask_field.replace("mask_path", "seg_preview_path") if mask_field in MASK_FIELDS.values() else None


def parse_int_list(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x.strip()]


def parse_str_set(text: str) -> set[str]:
    """Product types of a comma-separated list, as UPPER_SNAKE."""
    return {"_".join(x.upper().split()) for x in text.split(",") if x.strip()}


def field_suffix(name: str | None) -> str:
    """Suffix of result columns, with one underscore first; empty for none."""
    cleaned = (name or "").strip().replace("-", "_").replace(" ", "_")
    return cleaned if not cleaned or cleaned.startswith("_") else f"_{cleaned}"


def hint_suffix(hint_field: str, base: str = "_hint") -> str:
    return base if hint_field == "primary_object" else f"{base}_{hint_field}"


def folder_name(base: str, suffix: str | None) -> str:
    return base + field_suffix(suffix)
