"""Model inference as batches of rows: backends are pluggable, one object a worker.

A backend answers a list of prompts; a loader builds it once in each Python worker.  Without a
model at hand, the mock backend answers `unknown` as a Column expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolith.functions.parsing import answer_text, parsed, prediction
from annolith.functions.prompts import json_string
from annolith.operators.metrics import RUN, response_stats


class Backend(Protocol):
    def answer(self, prompts: list[str], paths: list[str | None]) -> list[str]: ...


#: Loaders by name; extended at run time with register().
BACKENDS: dict[str, Callable[[], Backend]] = {}


def register(name: str, loader: Callable[[], Backend]) -> None:
    BACKENDS[name] = loader


_loaded: dict[str, Backend] = {}


def infer(rows: DataFrame, backend: str, prompt: str = "prompt", path: str = "path", batch: int = 8) -> DataFrame:
    """rows with raw_output, infer_error and infer_fallbacks (answers that a single call gave after a batch failed or came back empty).

    A failing call never fails the job: its row has the error and no output.
    """
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend!r}; known: {sorted(BACKENDS)}")
    load = BACKENDS[backend]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if backend not in _loaded:
            _loaded[backend] = load()
        engine = _loaded[backend]
        for part in parts:
            texts, paths = part[prompt].tolist(), part[path].tolist() if path in part else [None] * len(part)
            outputs: list[str | None] = []
            errors: list[str | None] = []
            fallbacks: list[int] = []
            for at in range(0, len(texts), max(1, batch)):
                some, files = texts[at : at + batch], paths[at : at + batch]
                try:
                    got: list[str | None] = list(engine.answer(some, files))
                    if len(got) != len(some):
                        raise ValueError("a batch came back with another length")
                except Exception:  # noqa: BLE001 - each is asked again alone
                    got = [None] * len(some)
                for text, file, answer in zip(some, files, got, strict=True):
                    error, again = None, 0
                    if not (answer or "").strip():
                        again = 1
                        try:
                            answer = engine.answer([text], [file])[0]
                        except Exception as problem:  # noqa: BLE001 - reported in the row
                            answer, error = None, f"{type(problem).__name__}: {problem}"
                    outputs.append(answer)
                    errors.append(error)
                    fallbacks.append(again)
            yield part.assign(raw_output=outputs, infer_error=errors, infer_fallbacks=fallbacks)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", raw_output string, infer_error string, infer_fallbacks int"
    return rows.mapInPandas(run, schema)


def unload(backend: str) -> None:
    """Forget the object that this process holds."""
    _loaded.pop(backend, None)


def mock_output(image: Column, key: Column) -> Column:
    """The mock backend's answer: unknown for the asked property."""
    return F.concat(F.lit('{"image_id":'), json_string(image), F.lit(',"primary_object":"object","properties":{'), json_string(key), F.lit(':"unknown"},"notes":"mock"}'))


def mock_from_prompt(prompt: Column) -> Column:
    """The same, from the prompt alone."""
    return mock_output(F.regexp_extract(prompt, r'The image_id is "([^"]*)"', 1), F.regexp_extract(prompt, r'Predict ONLY this property: "([^"]*)"', 1))


def evaluate(responses: DataFrame, specs: list, threshold: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(long evaluation, run rows) of raw answers: model, variant, image_id, property_key, ord, gt, raw_output.

    Failed calls count as answers without valid JSON; their predictions are unknown.
    """
    rows = parsed(responses, "raw_output").withColumn("_answer", F.try_parse_json("parsed"))
    pred = F.lit(None).cast("string")
    for s in specs:  # a schema's properties
        pred = F.when(F.col("property_key") == s.key, prediction(F.col("_answer"), s.key, s.value_type, list(s.allowed))).otherwise(pred)
    rows = rows.withColumns({"pred": pred, "valid": F.col("_answer").isNotNull(), "primary_object": answer_text(F.col("_answer"), "primary_object"), "notes": answer_text(F.col("_answer"), "notes")})
    rows = rows.withColumns({"id_matched": F.coalesce(answer_text(F.col("_answer"), "image_id") == F.col("image_id"), F.lit(False)), "error": F.col("parse_error")})
    return rows.select(*RUN, "image_id", "property_key", "gt", "pred"), response_stats(rows, threshold)
