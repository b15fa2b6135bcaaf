"""Chat models behind a ladder of fallbacks, with counters that do not depend on how tasks are retried.

A model works in stages: template, prepare, generate, decode.  A batch of conversations goes through them together; where
a stage fails or comes back blank the conversations are asked one by one.  What happened is counted by name in the batch's
own row, so that a task that runs twice is counted once; totals() adds the counters up.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolith.operators.ranking import batches

#: What is counted, for whole conversations (messages) and for single prompts about one image (simple).
COUNTERS = {
    kind: [f"{kind}_batch_{x}" for x in ("calls", "items", "degenerate_to_single", "blank_template_fallback", "processor_exception_fallback", "generate_exception", "decode_exception", "empty_decode_fallback", "success")]
    for kind in ("messages", "simple")
}
SINGLE = ["single_message_calls", "single_message_generate_exception", "single_message_decode_exception"]
SEQUENTIAL = "llava_multi_image_sequential_fallback"

Message = dict[str, str]


class ChatModel(Protocol):
    """Stages of a model.  Optional: one_image (true if a batch may hold one image and one message each), batch_cap (rows that a batch may
    have at most), close()."""

    def template(self, messages: list[Message]) -> str: ...
    def prepare(self, texts: list[str], images: list[list[str]]) -> Any: ...
    def generate(self, inputs: Any) -> Any: ...
    def decode(self, outputs: Any) -> list[str]: ...


# ------------------------------------------------------------------ registry


def with_config(spark: SparkSession, registry: dict[str, dict], key: str, path: str | None, custom_key: str | None = None) -> tuple[dict[str, dict], str]:
    """(registry, key) with the JSON object of a runtime config file in it under custom_key, or the key with `_custom`; unchanged without a path."""
    if path is None:
        return dict(registry), key
    config = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    if not isinstance(config, dict):
        raise ValueError(f"expected a JSON object in {path}")
    name = custom_key or f"{key}_custom"
    return {**registry, name: config}, name


def settings(config: dict) -> dict[str, Any]:
    """What a loader needs of a registry entry: the base model, the adapter or None, and greedy generation by default."""
    adapter = config.get("adapter_path")
    if adapter is not None and not str(adapter).strip():
        raise ValueError("adapter_path is empty")
    return {
        "model_id": config["model_id"],
        "base_model_id": config.get("base_model_id", config["model_id"]),
        "adapter_path": None if adapter is None else str(adapter).strip(),
        "use_4bit": bool(config.get("use_4bit", True)),
        "generation": {"max_new_tokens": int(config.get("max_new_tokens", 512)), "do_sample": bool(config.get("do_sample", False))},
        "batch_cap": config.get("max_prompt_batch_size"),
    }


# ------------------------------------------------------------------ the ladder


def fallback(messages: list[Message]) -> str:
    """ROLE: text, a blank line between; messages without text are left out."""
    return "\n\n".join(f"{(m.get('role') or 'user').upper()}: {m['content'].strip()}" for m in messages if (m.get("content") or "").strip())


def rendered(model: ChatModel, messages: list[Message]) -> str:
    try:
        text = model.template(messages)
        if isinstance(text, str) and text.strip():
            return text
    except Exception:  # noqa: BLE001 - the plain text is the fallback
        pass
    return fallback(messages)


def ask_one(model: ChatModel, messages: list[Message], images: list[str], seen: Counter) -> str:
    if not images:
        raise ValueError("images must not be empty")
    seen["single_message_calls"] += 1
    inputs = model.prepare([rendered(model, messages)], [images])
    try:
        outputs = model.generate(inputs)
    except Exception:
        seen["single_message_generate_exception"] += 1
        raise
    try:
        return model.decode(outputs)[0]
    except Exception:
        seen["single_message_decode_exception"] += 1
        raise


def ask(model: ChatModel, chats: list[list[Message]], images: list[list[str]], seen: Counter, kind: str = "messages") -> list[str]:
    """Answers of a batch; an error of generation or decoding goes to the caller."""
    if not chats:
        return []
    count = lambda name, n=1: seen.update({f"{kind}_batch_{name}": n})
    one_by_one = lambda: [ask_one(model, m, i, seen) for m, i in zip(chats, images, strict=True)]
    count("calls")
    count("items", len(chats))
    if len(chats) == 1:
        count("degenerate_to_single")
        return one_by_one()
    if kind == "messages" and getattr(model, "one_image", False) and any(len(i) > 1 or len(m) > 1 for m, i in zip(chats, images, strict=True)):
        seen[SEQUENTIAL] += 1
        return one_by_one()
    texts = [rendered(model, m) for m in chats]
    if any(not t.strip() for t in texts):
        count("blank_template_fallback")
        return one_by_one()
    try:
        inputs = model.prepare(texts, images)
    except Exception:  # noqa: BLE001 - asked one by one
        count("processor_exception_fallback")
        return one_by_one()
    try:
        outputs = model.generate(inputs)
    except Exception:
        count("generate_exception")
        raise
    try:
        answers = model.decode(outputs)
    except Exception:
        count("decode_exception")
        raise
    if len(answers) != len(chats) or any(not isinstance(a, str) or not a.strip() for a in answers):
        count("empty_decode_fallback")
        return one_by_one()
    count("success")
    return answers


_models: dict[str, ChatModel] = {}

ANSWERS = "answers array<struct<ord:long,raw_output:string,error:string>>, counters map<string,long>"


def chat(rows: DataFrame, name: str, load: Callable[[], ChatModel], keys: list[str], order: str, size: int, kind: str = "messages", cap: int | None = None, keep: bool = False, profile: ResourceProfile | None = None) -> DataFrame:
    """A row a batch: keys, batch, answers (ord, raw_output, error) and counters.

    rows: keys, order (long), messages (array of role and content), images (array of paths).  Batches are chunks of at most
    min(size, cap) rows of a group, so they do not depend on partitions; a batch that fails is asked again one by one, and what
    still fails has its error in place of an answer.  A worker loads the model once; without keep it is closed and forgotten at
    the end of each task.  profile: resources of these tasks, such as GPUs, where the cluster schedules by stage.
    """
    grouped = batches(rows, keys, order, size, cap).groupBy(*keys, "batch").agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("ord"), "messages", "images"))).alias("chats"))
    names = [*keys, "batch"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _models.get(name) or _models.setdefault(name, load())
        try:
            for part in parts:
                answers, counters = [], []
                for chats in part["chats"]:
                    seen: Counter = Counter()
                    talks = [[dict(m) for m in c["messages"]] for c in chats]
                    paths = [list(c["images"]) for c in chats]
                    got: list[tuple[str | None, str | None]] = []
                    try:
                        got = [(a, None) for a in ask(model, talks, paths, seen, kind)]
                    except Exception:  # noqa: BLE001 - each is asked again alone
                        for talk, images in zip(talks, paths, strict=True):
                            try:
                                got.append((ask_one(model, talk, images, seen), None))
                            except Exception as problem:  # noqa: BLE001 - reported in the row
                                got.append((None, f"{type(problem).__name__}: {problem}"))
                    answers.append([{"ord": c["ord"], "raw_output": a, "error": e} for c, (a, e) in zip(chats, got, strict=True)])
                    counters.append(dict(seen))
                yield part[names].assign(answers=answers, counters=counters)
        finally:
            if not keep:
                unload(name)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grouped.select(*names).schema.fields)
    return grouped.mapInPandas(run, f"{schema}, {ANSWERS}", profile=profile)


def unload(name: str) -> None:
    """Close and forget the model that this process holds."""
    model = _models.pop(name, None)
    if model is not None and hasattr(model, "close"):
        model.close()


def answers(batches_: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ord, raw_output and error, a row a conversation."""
    return batches_.select(*keys, F.inline("answers"))


def totals(batches_: DataFrame) -> DataFrame:
    """counter and n over all batches; counters that never rose are left out."""
    return batches_.select(F.explode("counters").alias("counter", "n")).groupBy("counter").agg(F.sum("n").alias("n"))
