"""Whole runs on small inputs."""

import json
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

from annolith import api
from annolith.functions import masks
from annolith.sources.specs import PropertySpec

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPECS = [PropertySpec("material", "g", "material", "categorical", ("wood", "metal", "unknown")), PropertySpec("hard", "g", "hard", "boolean", ("true", "false", "unknown")), PropertySpec("tags", "g", "tags", "multi_categorical", ("a", "b"))]


def _samples(spark):
    return spark.createDataFrame([("i1", "p1", {"material": "wood", "hard": "true"}), ("i2", "p2", {"material": "metal", "tags": '["a"]'}), ("i3", "p3", {})], "image_id string, path string, gt map<string,string>")


class Echo:
    def answer(self, prompts, paths):
        out = []
        for p in prompts:
            question = p.rsplit("USER: ", 1)[-1]
            image = question.split('The image_id is "')[1].split('"')[0]
            key = question.split('property: "')[1].split('"')[0]
            value = {"material": "Wood", "hard": "yes", "tags": ["a", "zz"]}[key]
            out.append(f"Sure!\n```json\n{json.dumps({'image_id': image, 'primary_object': 'thing', 'properties': {key: value}, 'notes': 'n'})}\n```")
        return out


def test_evaluate_model(spark):
    api.register("echo", Echo)
    for shots in (0, 1):
        got = api.evaluate_model(_samples(spark), SPECS, "echo", "echo", few_shot=shots)
        runs = {r.image_id: r for r in got["runs"].collect()}
        assert runs["i1"].expected_response_count == 2 and runs["i3"].expected_response_count == 3 and all(r.has_valid_json_all and r.image_id_matched_all for r in runs.values())
        rows = {(r.image_id, r.property_key): (r.gt, r.pred) for r in got["evaluation"].collect()}
        assert rows["i1", "material"] == ("wood", "wood") and rows["i2", "material"] == ("metal", "wood") and rows["i2", "tags"] == ('["a"]', '["a"]') and rows["i3", "hard"] == ("unknown", "true")
        measured = {r.property: r for r in got["metrics"].collect()}
        assert measured["material"].accuracy_pct == 50.0 and measured["tags"].accuracy_pct == 100.0 and measured["tags"].macro_f1_pct is None
    summary = api.evaluate_model(_samples(spark), SPECS, "mock", "mock")["summary"].first()
    assert summary.num_samples == 3 and summary.valid_json_pct == 100.0 and summary.mean_accuracy_pct == 0.0


def test_build_subset(spark, tmp_path):
    lines = [{"item_id": f"x{k}", "main_image_id": f"m{k % 7}", "product_type": [{"value": "TABLE" if k % 2 else "LAMP"}], "item_name": "oak wood table durable" if k % 3 else "thing"} for k in range(20)]
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    (tmp_path / "i.csv").write_text("image_id,path\n" + "\n".join(f"m{k},a/{k}.jpg" for k in range(6)))
    got = api.build_subset(spark, str(tmp_path / "l.json"), str(tmp_path / "i.csv"), 4, 3)
    funnel = got["funnel"].first()
    assert (funnel.records_total, funnel.records_with_ids, funnel.records_with_image_rel) == (20, 20, 18)
    selected = got["selected"].collect()
    assert len(selected) == len({r.key for r in selected}) == 4
    assert {r.product_type for r in selected} <= {"TABLE", "LAMP"}


def test_posthoc_and_training(spark):
    from annolith.plans.queries import PRIORS

    rows = spark.createDataFrame([(f"i{k}", "m", "v", "intrinsic.main_material", "Glass", "r") for k in range(3)], "image_id string, model string, variant string, property_key string, gt_value string, pred_value string")
    got = api.kg_posthoc(rows, PRIORS)
    assert got["delta"].first().accuracy_delta == 100.0
    examples = api.training_examples(_samples(spark), SPECS)
    assert examples.count() == 4
    ids = spark.createDataFrame([(f"i{k}", k) for k in (1, 2, 3)], "image_id string, ord int")
    train, val, manifest = api.training_split(examples, ids, 1)
    assert train.count() + val.count() == 4 and {r.part for r in manifest.collect()} == {"train", "val"}
    row = examples.filter("image_id = 'i2' and property_key = 'tags'").first()
    assert json.loads(row.response)["properties"] == {"tags": ["a"]}


class Boxes:
    def segment(self, image, method, query):
        if method == "rug":
            raise RuntimeError("broken")
        mask = image[..., 0] > 100
        return np.stack([np.zeros_like(mask), mask]), [0.1, 0.9], 0.5 if query else None

    def refine(self, image, box):
        out = np.zeros((2, *image.shape[:2]), bool)
        out[1, box[1] : box[3], box[0] : box[2]] = True
        return out, [0.2, 0.8]


def test_segmentation(spark):
    image = np.zeros((20, 30, 3), np.uint8)
    image[5:15, 5:25] = 200
    gt = (image[..., 0] > 100).astype(np.uint8)
    rows = spark.createDataFrame([("i", bytearray(image.tobytes()), 30, 20, bytearray(gt.tobytes())), ("j", bytearray(image.tobytes()), 30, 20, None)], "image_name string, data binary, width int, height int, gt binary")
    got = {(r.image_name, r.method): r for r in api.segment(rows, {"main_object": None, "carpet": "carpet.", "rug": "rug."}, Boxes).collect()}
    assert got["i", "main_object"].iou == 1.0 and got["i", "carpet"].dino_score == 0.5 and got["j", "carpet"].iou is None
    assert got["i", "rug"].error == "RuntimeError: broken" and got["i", "rug"].mask_area == 0
    results = spark.createDataFrame([(r.image_name, r.method, r.iou, r.dice, r.precision, r.recall, r.mask_area, r.area_ratio, r.dino_score, r.sam_score, r.inference_time) for r in got.values()], "image_name string, method string, iou double, dice double, precision double, recall double, mask_area long, area_ratio double, dino_score double, sam_score double, inference_time double")
    tables = api.segmentation_tables(results)
    assert tables["main_object_vs_best_class"].first().winner == "tie" and tables["prompt_win_counts"].first().method == "carpet"
    refined = {r.image_id: r for r in api.refine(rows.select(F.col("image_name").alias("image_id"), "data", "width", "height", F.col("gt").alias("seed")), Boxes).collect()}
    assert refined["i"].status == "written" and refined["i"].overlap > 0.5 and refined["j"].status == "missing_seed"
    shown = rows.filter("gt is not null").select(masks.variant_column("masked")(F.col("data"), F.col("gt"), F.col("width"), F.col("height")).alias("x"), masks.foreground_masks(F.col("data"), F.col("width"), F.col("height")).alias("m")).first()
    assert bytes(shown.x) == image.tobytes() and shown.m.backend == "simple"
    assert masks.fit_canvas(image, 10, 10).shape == (10, 10, 3)


class Counting:
    """Answers and writes one byte a prompt to a file."""

    path = ""

    def answer(self, prompts, paths):
        with open(Counting.path, "a") as out:
            out.write("x" * len(prompts))
        return ['{"material": "wood"}'] * len(prompts)


def test_every_prompt_is_asked_once(spark, tmp_path):
    from annolith.sources import tables

    path = str(tmp_path / "asked")

    def load():
        Counting.path = path
        return Counting()

    api.register("counting", load)
    got = api.evaluate_model(_samples(spark), SPECS, "counting", "counting")
    tables.write_report(got["evaluation"], got["metrics"], got["summary"], str(tmp_path / "report"))
    assert got["runs"].count() == 3
    assert len(open(path).read()) == got["responses"].count()


def test_last_prediction_counts(spark, tmp_path):
    from annolith.plans import pipelines
    from annolith.sources import tables
    from annolith.sources.specs import knowledge_priors

    rows = [("i1", "m", "a", "glass", "wood"), ("i1", "m", "a", "glass", "glass"), ("i2", "m", "a", "wood", "wood"), ("i2", "m", "a", "wood", "glass")]
    (tmp_path / "p.csv").write_text("\n".join(map(",".join, [("image_id", "model", "property_key", "gt_value", "pred_value"), *rows])))
    got = pipelines.kg_posthoc(tables.predictions(spark, str(tmp_path / "p.csv"), ordered=True), knowledge_priors({"properties": ["a"]}))
    assert {(r.image_id, r.pred_value_kg) for r in got["corrected"].collect()} == {("i1", "glass"), ("i2", "glass")}


def test_scratch_tables_go(spark):
    import os

    from annolith.session import kept, scratch, scratch_root

    root = scratch_root(spark).removeprefix("file://") + "/annolith"
    with scratch():
        assert kept(spark.range(3), "numbers").count() == 3
        assert any(x.startswith("numbers-") for x in os.listdir(root))
    assert not any(x.startswith("numbers-") for x in os.listdir(root))
