"""Prompts, messages and reference answers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annolith.functions.text import strip

# Fixed text: the question put to a model for one image and property.
HEAD = '''You are given an image of one product.
The image_id is "{image}". The output JSON must contain exactly this image_id.

Predict ONLY this property: "{key}".

Return ONLY JSON with this structure:
{
  "image_id": "{image}",
  "primary_object": "<short noun phrase>",
  "properties": {
    "{key}": <{hint}>
  },
  "notes": "<short visual evidence>"
}

Rules:
{rule}
- Do not add any other property keys.
- For unknown categorical/boolean value use "unknown".
- For unknown list property use [].
- No markdown, no code fences, no extra text.'''


def _filled(template: str, values: dict[str, Column]) -> Column:
    """template with each {name} replaced, as one concat."""
    parts, rest = [], template
    while rest:
        places = [(rest.find("{" + name + "}"), name) for name in values if "{" + name + "}" in rest]
        if not places:
            parts.append(F.lit(rest))
            break
        at, name = min(places)
        parts += [F.lit(rest[:at]), values[name]]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def property_prompt(image: Column, key: Column, value_type: Column, allowed: Column, description: Column) -> Column:
    names = F.array_join(allowed, "|")
    quoted = F.concat(F.lit('- "'), key, F.lit('" must be '))
    rule = (
        F.when(value_type == "categorical", F.concat(quoted, F.lit("one of ["), names, F.lit("]")))
        .when(value_type == "boolean", F.concat(quoted, F.lit("one of [true|false|unknown]")))
        .otherwise(F.concat(quoted, F.lit("an array with values from ["), names, F.lit("], or []")))
    )
    hint = F.when(value_type.isin("categorical", "boolean"), "string").otherwise("array")
    described = F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit("\nProperty description: "), description)).otherwise("")
    return F.concat(_filled(HEAD, {"image": image, "key": key, "hint": hint, "rule": rule}), described)


def json_string(text: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)\A\{"x":(.*)\}\z', 1)


def demo_response(image: Column, key: Column, value_json: Column) -> Column:
    """A reference answer as JSON text; value_json is the value's JSON."""
    return F.concat(F.lit('{"image_id": '), json_string(image), F.lit(', "primary_object": "object", "properties": {'), json_string(key), F.lit(": "), value_json, F.lit('}, "notes": "reference example"}'))


def user_message(prompt: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))


def training_pair(prompt: Column, response: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")), F.struct(F.lit("assistant").alias("role"), response.alias("content")))


def few_shot_messages(demos: Column, prompt: Column) -> Column:
    """demos: ordered array of struct(prompt, response); then the question."""
    shown = F.flatten(F.transform(demos, lambda d: training_pair(d.prompt, d.response)))
    return F.concat(shown, user_message(prompt))


def fallback_text(messages: Column) -> Column:
    """ROLE: text blocks, a blank line between them; messages without text are left out, a missing role is the user's."""
    shown = F.filter(messages, lambda m: strip(F.coalesce(m.content, F.lit(""))) != "")
    role = lambda m: F.upper(F.coalesce(F.nullif(m.role, F.lit("")), F.lit("user")))
    return F.array_join(F.transform(shown, lambda m: F.concat(role(m), F.lit(": "), strip(m.content))), "\n\n")


def training_schedule(rows: Column, batch: int, accumulate: int, epochs: float, max_steps: int = 0) -> dict[str, Column]:
    """Optimiser steps and epochs for a number of training rows; a positive max_steps decides."""
    per_epoch = F.greatest(F.ceil(rows / F.lit(max(1, batch) * max(1, accumulate))), F.lit(1))
    if max_steps > 0:
        total, rounds = F.lit(max_steps), F.greatest(F.ceil(F.lit(max_steps) / per_epoch), F.lit(1))
    else:
        total, rounds = F.greatest(F.ceil(per_epoch * F.lit(float(epochs))), F.lit(1)), F.greatest(F.ceil(F.lit(float(epochs))), F.lit(1))
    return {"steps_per_epoch": per_epoch.cast("long"), "total_steps": total.cast("long"), "estimated_epochs": rounds.cast("long")}
