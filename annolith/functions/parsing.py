"""Tolerant parsing of model answers.

Strict JSON is read by the engine; only what that can't read goes through Python, in Arrow
batches.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolith.functions.text import NULL_TOKENS, UNKNOWN, normalize_value, once, strip


def strip_code_fences(text: Column) -> Column:
    """Without a leading ``` or ```json and a trailing ```."""
    bare = strip(text)
    inner = F.regexp_replace(F.regexp_replace(bare, r"(?i)\A```(?:json)?\s*", ""), r"\s*```\z", "")
    return strip(F.when(bare.startswith("```"), inner).otherwise(bare))


def first_object(text: str) -> str | None:
    """From the first { to its matching }; braces inside double-quoted strings don't count."""
    begin = text.find("{")
    depth, quoted, at = 0, False, begin
    while 0 <= at < len(text):
        m = re.compile(r'[\\"]' if quoted else '["{}]').search(text, at)
        if not m:
            return None
        at = m.end()
        if quoted:
            if m[0] == "\\":
                at += 1
            else:
                quoted = False
        elif m[0] == '"':
            quoted = True
        else:
            depth += 1 if m[0] == "{" else -1
            if depth == 0:
                return text[begin:at]
    return None


def parse_object(blob: str) -> tuple[str | None, str | None]:
    """(JSON text, error) by JSON, then YAML, then a Python literal."""
    try:
        return json.dumps(json.loads(blob), ensure_ascii=False), None
    except ValueError as problem:
        error = f"json_parse_error: {problem}"

    def yaml_of(x: str) -> object:
        import yaml

        return yaml.load(x, getattr(yaml, "CSafeLoader", yaml.SafeLoader))  # noqa: S506 - both are safe loaders

    for reader in (yaml_of, ast.literal_eval):
        try:
            found = reader(blob)
            if isinstance(found, dict):
                return json.dumps(found, ensure_ascii=False, default=str), None
        except Exception:  # noqa: BLE001, S110 - the next reader tries
            pass
    return None, error


def parsed(df: DataFrame, column: str, json_name: str = "parsed", error_name: str = "parse_error") -> DataFrame:
    """df with the answer's first JSON object as JSON text and the error, one of them NULL.

    Errors: empty_output, json_not_found, json_parse_error: ...
    """

    @F.pandas_udf("json string, error string")
    def slow(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            if text is None:
                rows.append((None, None))
            else:
                blob = first_object(text)
                rows.append((None, "json_not_found") if blob is None else parse_object(blob))
        return pd.DataFrame(rows, columns=["json", "error"])

    bare = strip_code_fences(F.col(column))
    # A first object without objects inside ends at the next brace, if that makes it strict JSON.
    flat = F.regexp_extract(bare, r"\A[^{]*+(\{[^{}]*+\})", 1)
    bare = F.when(bare.startswith("{") & F.try_parse_json(bare).isNotNull(), bare).when(F.try_parse_json(flat).isNotNull(), flat).otherwise(bare)
    whole = F.when(F.col("_bare").startswith("{"), F.try_parse_json("_bare"))
    empty = F.coalesce(strip(F.col(column)) == "", F.lit(True))
    step = df.withColumn("_bare", once(bare)).withColumn("_ok", once(whole.isNotNull()))
    step = step.withColumn("_slow", slow(F.when(~F.col("_ok") & ~empty, F.col("_bare"))))
    return step.withColumn(json_name, F.when(F.col("_ok"), F.col("_bare")).otherwise(F.col("_slow.json"))).withColumn(error_name, F.when(empty, "empty_output").when(~F.col("_ok"), F.col("_slow.error"))).drop("_bare", "_ok", "_slow")


def answer_value(answer: Column, key: str) -> Column:
    """A property's raw value in a parsed answer (variant), as text; the first place that holds it decides, null or not."""
    group, dot, name = key.partition(".")
    paths = [f"$['{key}']", f"$['{name if dot else key}']", f"$.properties['{key}']"]
    if dot:
        paths += [f"$.properties['{group}']['{name}']", f"$.groups['{group}']['{name}']"]
    out = F.lit(None).cast("string")
    for path in reversed(paths):
        found = F.try_variant_get(answer, path, "variant")
        text = F.when(F.schema_of_variant(found).startswith("ARRAY"), F.array_join(F.try_variant_get(found, "$", "array<string>"), ",")).otherwise(F.try_variant_get(found, "$", "string"))
        out = F.when(found.isNotNull(), text).otherwise(out)
    return out


def prediction(answer: Column, key: str, value_type: str, allowed: list[str]) -> Column:
    """A property's normalised prediction; unknown or [] where there is no answer."""
    value = F.coalesce(answer_value(answer, key), F.lit("" if value_type == "multi_categorical" else UNKNOWN))
    return normalize_value(value, F.lit(value_type), F.array(*map(F.lit, allowed)).cast("array<string>"))


def answer_text(answer: Column, name: str) -> Column:
    return strip(F.try_variant_get(answer, f"$.{name}", "string"))


def records(lines: Iterator[str]) -> Iterator[dict]:
    """Objects of JSON lines; blank lines are skipped, bad ones raise."""
    for line in lines:
        if line.strip():
            yield json.loads(line)


__all__ = ["NULL_TOKENS", "answer_text", "answer_value", "first_object", "parse_object", "parsed", "prediction", "records", "strip_code_fences"]
