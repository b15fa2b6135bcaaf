"""Chat ladders, templates, runtime configs and resumable runs against plain versions."""

import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolith.functions import prompts, templates
from annolith.operators import runtime, segmentation
from annolith.sources.versions import WorkLog


def faulty():
    """A class of this call's own, so that workers get it by value."""

    class Faulty:
        """Stages that fail by what the texts hold."""

        closed = 0

        def template(self, messages):
            text = messages[-1]["content"]
            if "rude" in text:
                raise RuntimeError
            return "  " if "blank" in text else f"<{text}>"

        def prepare(self, texts, images):
            if len(texts) > 1 and any("wide" in t for t in texts):
                raise ValueError("pad")
            return texts

        def generate(self, texts):
            if any("stop" in t for t in texts):
                raise RuntimeError("stop")
            return texts

        def decode(self, texts):
            if any("garbled" in t for t in texts):
                raise UnicodeError("garbled")
            return ["" if len(texts) > 1 and "mute" in t else t.upper() for t in texts]

        def close(self):
            Faulty.closed += 1

    return Faulty


WORDS = ["a", "blank", "rude", "wide", "stop", "garbled", "mute", ""]


def plain_chat(batch):
    """Answers, errors and counters of one batch, written out case by case."""
    seen = Counter(messages_batch_calls=1, messages_batch_items=len(batch))
    text = lambda w: f"<{w}>" if w != "blank" and w != "rude" else f"USER: {w}"

    def one(word):
        seen["single_message_calls"] += 1
        if word == "stop":
            seen["single_message_generate_exception"] += 1
            raise RuntimeError("stop")
        if word == "garbled":
            seen["single_message_decode_exception"] += 1
            raise UnicodeError("garbled")
        return text(word).upper()

    def many():
        if len(batch) == 1:
            seen["messages_batch_degenerate_to_single"] += 1
        elif "wide" in batch:
            seen["messages_batch_processor_exception_fallback"] += 1
        elif "stop" in batch:
            seen["messages_batch_generate_exception"] += 1
            raise RuntimeError
        elif "garbled" in batch:
            seen["messages_batch_decode_exception"] += 1
            raise UnicodeError
        elif "mute" in batch:
            seen["messages_batch_empty_decode_fallback"] += 1
        else:
            seen["messages_batch_success"] += 1
            return [text(w).upper() for w in batch]
        return [one(w) for w in batch]

    try:
        return [(a, None) for a in many()], seen
    except Exception:  # noqa: BLE001
        out = []
        for word in batch:
            try:
                out.append((one(word), None))
            except Exception as problem:  # noqa: BLE001
                out.append((None, f"{type(problem).__name__}: {problem}"))
        return out, seen


def test_counters_of_a_faulty_model(spark):
    r = np.random.default_rng(4)
    chats = {f"c{k}": [WORDS[j] for j in r.choice(8, r.integers(1, 9), p=[0.5, *[0.5 / 7] * 7])] for k in range(60)}
    rows = [(c, n, [{"role": "user", "content": w}], ["i"]) for c, words in chats.items() for n, w in enumerate(words)]
    frame = spark.createDataFrame(rows, "conv string, turn long, messages array<struct<role:string,content:string>>, images array<string>").repartition(5)
    done = runtime.chat(frame, "faulty", faulty(), ["conv"], "turn", 3)
    want, total = {}, Counter()
    for c, words in chats.items():
        for at in range(0, len(words), 3):
            got, seen = plain_chat(words[at : at + 3])
            total += seen
            want |= {(c, at + k): x for k, x in enumerate(got)}
    assert {(x.conv, x.ord): (x.raw_output, x.error) for x in runtime.answers(done, ["conv"]).collect()} == want
    assert {x.counter: x.n for x in runtime.totals(done).collect()} == dict(total)
    assert set(total) <= {*runtime.COUNTERS["messages"], *runtime.SINGLE}


def test_ladder_details():
    seen, Faulty = Counter(), faulty()
    with pytest.raises(ValueError, match="images"):
        runtime.ask_one(Faulty(), [{"role": "user", "content": "a"}], [], seen)
    assert runtime.ask(Faulty(), [], [], seen) == [] and not seen
    one = Faulty()
    one.one_image = True
    talks = [[{"role": "user", "content": "x"}, {"role": "user", "content": "y"}], [{"role": "user", "content": "z"}]]
    assert runtime.ask(one, talks, [["i"], ["i"]], seen) == ["<Y>", "<Z>"] and seen[runtime.SEQUENTIAL] == 1 and seen["single_message_calls"] == 2
    simple = Counter()
    assert runtime.ask(one, talks, [["i"], ["i"]], simple, "simple") == ["<Y>", "<Z>"] and simple["simple_batch_success"] == 1
    runtime._models["x"] = Faulty()
    before = Faulty.closed
    runtime.unload("x")
    runtime.unload("x")
    assert Faulty.closed == before + 1 and "x" not in runtime._models


def test_runtime_config(spark, tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps({"backend": "b", "model_id": "m", "adapter_path": " a ", "max_new_tokens": "9"}, indent=1))
    base = {"m1": {"model_id": "x"}}
    merged, key = runtime.with_config(spark, base, "m1", str(path))
    assert key == "m1_custom" and merged["m1"] == {"model_id": "x"} and "m1_custom" not in base
    assert runtime.with_config(spark, base, "m1", str(path), "own")[1] == "own" and runtime.with_config(spark, base, "m1", None) == (base, "m1")
    got = runtime.settings(merged[key])
    assert got == {"model_id": "m", "base_model_id": "m", "adapter_path": "a", "use_4bit": True, "generation": {"max_new_tokens": 9, "do_sample": False}, "batch_cap": None}
    with pytest.raises(ValueError):
        runtime.settings({"model_id": "m", "adapter_path": " "})
    path.write_text("[1]")
    with pytest.raises(ValueError):
        runtime.with_config(spark, base, "m1", str(path))


def test_templates(spark):
    chats = [
        [("system", " s "), ("user", "u\n"), ("assistant", "a")],
        [("user", "x"), ("tool", "y")],
        [("user", None)],
        [],
    ]
    rows = spark.createDataFrame([(k, [{"role": r, "content": c} for r, c in chat]) for k, chat in enumerate(chats)], "k int, m array<struct<role:string,content:string>>")
    got = {r.k: r for r in rows.select("k", templates.render(templates.CHATML, F.col("m")).alias("c"), templates.render(templates.INSTRUCT, F.col("m"), ask=False).alias("i"), templates.render(None, F.col("m")).alias("n"), prompts.fallback_text(F.col("m")).alias("f")).collect()}
    assert got[0].c == "<|im_start|>system\n s <|im_end|>\n<|im_start|>user\nu\n<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n<|im_start|>assistant\n"
    assert got[0].i == "<s><<SYS>>\ns\n<</SYS>>\n\n[INST] u [/INST] a</s>"
    assert got[1].c == got[1].f == "USER: x\n\nTOOL: y" and got[2].c == got[2].f == "" and got[0].n == got[0].f
    assert got[3].c == "<|im_start|>assistant\n"


def test_a_killed_run_goes_on_and_new_rows_are_added(spark, tmp_path):
    log = WorkLog(spark, str(tmp_path / "log"), "id", buckets=4)
    calls = []

    def work(rows, dies_at=None):
        calls.append(rows.count())
        if len(calls) == dies_at:
            raise KeyboardInterrupt
        return rows.withColumn("twice", F.col("id") * 2)

    rows = spark.range(100)
    with pytest.raises(KeyboardInterrupt):
        log.run(rows, lambda r: work(r, 3))
    done = log.results().count()
    assert 0 < done < 100
    calls.clear()
    got = WorkLog(spark, str(tmp_path / "log"), "id", buckets=4).run(rows, work)
    assert sum(calls) == 100 - done and sorted((r.id, r.twice) for r in got.collect()) == [(k, 2 * k) for k in range(100)]
    calls.clear()
    more = log.run(spark.range(103), work)
    assert sum(calls) == 3 and more.count() == 103
    calls.clear()
    assert log.run(rows, work).count() == 103 and not calls
    assert WorkLog(spark, str(tmp_path / "other"), "id").run(rows.limit(0), work).count() == 0


def test_main_object_and_clean_masks(spark):
    class Two:
        def segment(self, image, method, query):
            big, small = np.zeros((2, 12, 12), bool)
            big[2:10, 2:10] = True
            small[0:2, 0:2] = True
            return np.stack([small, big]), [0.9, 0.1], None

    rows = spark.createDataFrame([("i", bytes(432), 12, 12, None)], "image_name string, data binary, width int, height int, gt binary")
    plain = {r.method: r for r in segmentation.segment(rows, {"main_object": None, "rug": "rug."}, Two).collect()}
    assert plain["main_object"].mask_area == 64 and plain["rug"].mask_area == 4 and plain["rug"].iou is None
    clean = {r.method: r for r in segmentation.segment(rows, {"main_object": None, "rug": "rug."}, Two, {"radius": 1, "least": 10}).collect()}
    assert clean["main_object"].mask_area == 64 and clean["rug"].mask_area == 0
