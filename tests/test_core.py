"""The analytics operators on small tables: edge cases, brute force, and SQL on the driver's tables."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolith.functions import keywords, masks, parsing, prompts, taxonomy, text
from annolith.operators import inference, joins, kg, metrics, ranking
from annolith.plans import join_queries, source_queries, text_queries  # noqa: F401 - they add to the registry
from annolith.plans.queries import ORACLE_SQL, PRIORS, QUERIES
from annolith.sources import specs as specs_
from annolith.sources import tables
from tests_oracle import oracle_rows, spark_rows

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SMALL)) == oracle_rows(SMALL, ORACLE_SQL[name])


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.normalize_token, "  Semi  Glossy-X ", "semi_glossy_x"),
        (text.normalize_token, " A\tb ", "a_b"),
        (text.normalize_boolean, "Y", "true"),
        (text.normalize_boolean, "maybe", "unknown"),
        (text.normalize_boolean, None, "unknown"),
        (text.norm_knowledge, "Ceramic/Stone", "ceramic_stone"),
        (text.norm_knowledge, None, "unknown"),
        (text.norm_knowledge, "a  b", "a__b"),
        (text.safe_strip, " a  b ", "a b"),
        (text.safe_strip, "  ", None),
        (text.product_type, "light fixture", "LIGHT_FIXTURE"),
        (text.product_type, None, "UNKNOWN"),
        (text.primary_object, "LIGHT_FIXTURE", "light fixture"),
        (text.primary_object, "BIG_HAT", "big hat"),
        (text.hint_prompt, " Red_rug-x ", "red rug x"),
        (text.meta_key, " A\\B ", "a/b"),
        (text.detector_prompt, " A rug ", "a rug."),
        (text.metric_key, "a b/c", "a_b_c"),
        (text.slugify, " Area Rug ", "area_rug"),
        (taxonomy.natural_material, "food", "unknown"),
        (taxonomy.pdf_material, "food", "other"),
        (taxonomy.natural_rigidity, "semi rigid", "flexible"),
        (taxonomy.pdf_rigidity, "semi rigid", "unknown"),
        (taxonomy.filled_state, "Half-Full", "partially_filled"),
        (parsing.strip_code_fences, "```JSON\n{}\n```", "{}"),
    ],
)
def test_scalars(spark, f, value, want):
    assert one(spark, value, f) == want


def test_categorical_and_lists(spark):
    allowed = F.array(F.lit("paper/cardboard"), F.lit("a_b"), F.lit("wood"), F.lit("metal"))
    assert one(spark, "Paper/Cardboard", lambda c: text.normalize_categorical(c, allowed)) == "paper/cardboard"
    assert one(spark, "A/B", lambda c: text.normalize_categorical(c, allowed)) == "a_b"
    assert one(spark, "zzz", lambda c: text.normalize_categorical(c, allowed)) == "unknown"
    assert one(spark, "wood, Metal, wood, zzz", lambda c: text.normalize_multi(text.split_list(c), allowed)) == ["wood", "metal"]
    assert one(spark, ["b", "a"], lambda c: text.lists_equal(F.array(F.lit("a"), F.lit("b")), c), "array<string>")
    assert not one(spark, [], lambda c: text.lists_equal(c, c), "array<string>")
    assert one(spark, ["a", 'b"'], text.serialize_list, "array<string>") == '["a", "b\\""]'


@pytest.mark.parametrize(("raw", "want"), [('"x y"', "x y"), ('{"standardized_values": ["s"], "value": "v"}', "s"), ('{"value": " v "}', "v"), ('[{"value": "v"}, {"standardized_values": ["s"]}]', "s"), ('["p", "q"]', "p"), ("null", None), ("7", None), ("{}", None), ('{"standardized_values": [], "value": "v"}', "v")])
def test_pick_value(spark, raw, want):
    assert one(spark, raw, lambda c: text.pick_value(F.try_parse_json(c))) == want


def test_fragility_of_records(spark):
    record = {"groups": {"intrinsic": {"brittleness_class": "brittle", "main_material": "Ceramic", "surface_roughness_class": "medium"}, "affordance": {"breakable": False}, "state": {"is_dirty": "yes"}}}
    row = spark.createDataFrame([(json.dumps(record),)], "x string").select(F.parse_json("x").alias("r"))
    got = row.select(*(c.alias(k) for k, c in taxonomy.pdf_projection(F.col("r")).items())).first().asDict()
    assert (got["fragility"], got["material"], got["state"], got["wetness"]) == ("not_fragile", "ceramic/stone", "unknown", "unknown")
    got = row.select(*(c.alias(k) for k, c in taxonomy.transfer_projection(F.col("r")).items())).first().asDict()
    assert got == {"material": "stone", "rigidity": "unknown", "transparency": "unknown", "surface": "rough", "fragility": "durable"}
    assert row.select(taxonomy.ground_truth(F.col("r"), "intrinsic.main_material").alias("y")).first()["y"] == "Ceramic"


def test_keywords(spark):
    none = F.lit(None).cast("string")
    rows = spark.createDataFrame([("steel and glass", "FURNITURE"), ("", "FURNITURE"), ("дерево металл", "RUG")], "m string, k string")
    got = keywords.with_properties(rows, {"material": F.col("m"), "product_type": F.col("k"), "item_name": none}).collect()
    assert (got[0].material, got[0].material_source) == ("mixed", "material_field_multi")
    assert got[1].surface == "fuzzy" and got[1].material == "unknown"
    assert (got[2].material, got[2].material_source) == ("metal", "material_field")


@pytest.mark.parametrize(
    ("raw", "want", "error"),
    [
        ('x {"a":"}"} y', {"a": "}"}, None),
        ("{'a': 1}", {"a": 1}, None),
        ('{"a": 1, "a": 2}', {"a": 2}, None),
        ("{'a': {1: 2}, }", {"a": {"1": 2}}, None),
        ("", None, "empty_output"),
        (None, None, "empty_output"),
        ("hi", None, "json_not_found"),
        ('{"a":', None, "json_not_found"),
        ('```json\n{"a": {"b": [1]}}\n```', {"a": {"b": [1]}}, None),
        ("{a: [", None, "json_not_found"),
        ("{a: ]}", None, "json_parse_error"),
    ],
)
def test_parsing(spark, raw, want, error):
    row = parsing.parsed(spark.createDataFrame([(raw,)], "x string"), "x").first()
    assert (json.loads(row.parsed) if row.parsed else None) == want
    assert (row.parse_error or "").startswith(error or "") and (row.parse_error is None) == (error is None)


def test_answer_presence(spark):
    get = lambda raw, key: one(spark, raw, lambda c: parsing.answer_value(F.parse_json(c), key))
    assert get('{"material":null,"properties":{"material":"wood"}}', "material") is None
    assert get('{"properties":{"g":{"m":"wood"}}}', "g.m") == "wood"
    assert get('{"groups":{"g":{"m":"wood"}}}', "g.m") == "wood"
    assert get('{"m":["a","b"]}', "g.m") == "a,b"
    assert one(spark, '{"m":null}', lambda c: parsing.prediction(F.parse_json(c), "m", "categorical", ["wood", "unknown"])) == "unknown"


def test_macro_f1_counts_empty_labels_and_rounding(spark):
    rows = spark.createDataFrame([("m", "v", k, "p", "a", "a" if k == 0 else "b") for k in range(32)], "model string, variant string, image_id int, property_key string, gt string, pred string")
    dims = specs_.specs_frame(spark, [specs_.PropertySpec("p", "g", "p", "categorical", ("a", "b", "c", "unknown"))])
    got = metrics.property_metrics(rows, dims).first()
    assert got.accuracy_pct == 3.12 and got.macro_f1_pct == round(100 * (2 * (1 / 32) / (1 + 1 / 32)) / 3, 2)
    none = metrics.property_metrics(rows.withColumn("gt", F.lit("unknown")), dims).first()
    assert none.accuracy_pct is None and none.macro_f1_pct is None and none.selective_accuracy_pct is None


def brute_quota(rows, n, per_type):
    named = sorted({r["material"] for r in rows} - {"unknown"})
    quota, taken, materials, types = max(1, n // max(1, len(named))), [], {}, {}
    for first in (True, False):
        for r in rows:
            if len(taken) >= n or r["key"] in taken or types.get(r["product_type"], 0) >= per_type:
                continue
            if first and (r["material"] == "unknown" or materials.get(r["material"], 0) >= quota):
                continue
            taken.append(r["key"])
            materials[r["material"]] = materials.get(r["material"], 0) + 1
            types[r["product_type"]] = types.get(r["product_type"], 0) + 1
    return taken


@pytest.mark.parametrize("seed", range(4))
def test_quota(spark, seed):
    rng = random.Random(seed)
    rows = [(k, rng.choice(["a", "b", "unknown"]), rng.choice("tuvw"), rng.randint(1, 3)) for k in range(120)]
    pool = spark.createDataFrame(rows, "key int, material string, product_type string, known_count int")
    ordered = [r.asDict() for r in pool.withColumn("h", F.xxhash64("key", F.lit(seed))).orderBy(F.desc("known_count"), "h", "key").collect()]
    for n, cap in ((10, 2), (30, 6), (200, 50)):
        got = [r["key"] for r in ranking.quota_select(pool, n, cap, seed).orderBy("ord").collect()]
        assert got == brute_quota(ordered, n, cap)


def test_rerank(spark):
    rows = spark.createDataFrame([("m", "v", 1, "intrinsic.main_material", "r"), ("m", "v", 1, "intrinsic.transparency_class", "opaque"), ("m", "v", 2, "other", "X-Y"), ("m", None, 3, "intrinsic.main_material", None)], "model string, variant string, image_id int, property_key string, pred_value string")
    got = {(r.image_id, r.property_key): r.pred_value_kg for r in kg.rerank(rows, PRIORS).collect()}
    assert got == {(1, "intrinsic.main_material"): "a", (1, "intrinsic.transparency_class"): "opaque", (2, "other"): "x_y", (3, "intrinsic.main_material"): "unknown"}
    engine = kg.Reranker(PRIORS)
    for material in ("r", "a", "q"):
        for see in ("clear", "opaque", "?"):
            bundle = {"intrinsic.main_material": material, "intrinsic.transparency_class": see}
            original = {k: engine.canonical(k, v) for k, v in bundle.items()}
            assert engine.score(engine.rerank(bundle), original) >= engine.score(original, original)


def test_knowledge_rule_keys_are_normalised():
    priors = specs_.knowledge_priors({"pairwise_rules": [{"left_property": "a", "right_property": "b", "weights": {True: {"X-Y": 1}}}]})
    assert priors.rules == [("a", "b", {"true": {"x_y": 1.0}})]


def test_review_order_and_winner(spark):
    decided = spark.createDataFrame([(1, "a", "rejected"), (2, "a", "approved"), (3, "b", "approved")], "ord int, image_id string, decision string")
    decided = decided.withColumns({"selected_mask_field": F.lit("alt"), "selected_source_field": F.lit(None).cast("string"), "selected_preview_field": F.lit(None).cast("string"), "reviewed_at": F.lit("t")})
    meta = spark.createDataFrame([("a", "m1", "x1"), ("b", "m2", ""), ("c", "m3", "x3")], "image_id string, mask_path string, alt string")
    got = {r.image_id: r.mask_path for r in joins.approved_rows(meta, decided).collect()}
    assert got == {"a": "x1", "b": "m2"}
    ids = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "image_id string, ord int")
    assert ranking.review_start(ids, decided).first()["start"] == 2
    assert ranking.review_start(ids, decided, "b").first()["start"] == 1
    train, val = ranking.holdout_split(ids, 1)
    assert {r.image_id for r in train.collect()} | {r.image_id for r in val.collect()} == {"a", "b", "c"} and val.count() == 1


def test_wide_and_narrow(spark):
    dims = specs_.specs_frame(spark, [specs_.PropertySpec("g.p", "g", "p", "categorical", ("a", "unknown")), specs_.PropertySpec("g.l", "g", "l", "multi_categorical", ("a",))])
    samples = spark.createDataFrame([("i", {"g.p": "a"}, {"g.p": "a"}), ("j", {}, None)], "image_id string, gt map<string,string>, pred map<string,string>")
    rows = joins.long_evaluation(samples, dims)
    wide = joins.wide_evaluation(rows, ["image_id"], ["g.p", "g.l"])
    got = wide.filter("image_id = 'i'").first().asDict()
    assert got["g__p_exact_match"] and got["g__l_gt"] == "[]" and not got["g__l_pred_known"]
    assert joins.narrow_evaluation(wide, ["image_id"], ["g.p", "g.l"]).count() == 4


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"obj_id": "x", "groups": {"intrinsic": {"m": 1}}}\n\n{"obj_id": ""}\n{"obj_id": "y"}\n')
    assert [r.image_id for r in tables.annotations(spark, str(tmp_path / "a.jsonl")).orderBy("ord").collect()] == ["x", "y"]
    (tmp_path / "m.json").write_text('[{"image_id": "i", "path": "p", "notes": "n"}, 3, {"image_id": "j"}]')
    assert [(r.image_id, r.caption) for r in tables.meta(spark, str(tmp_path / "m.json")).collect()] == [("i", "n")]
    (tmp_path / "l.jsonl").write_text('{"item_id": "1", "material": [{"value": "oak"}]}\nbad\n')
    assert tables.listings(spark, str(tmp_path / "l.jsonl")).select(text.pick_value(F.col("material")).alias("m")).first()["m"] == "oak"
    (tmp_path / "i.csv").write_text("image_id,path\na,1\nb,\na,2\n")
    assert [(r.image_id, r.path) for r in tables.image_index(spark, str(tmp_path / "i.csv")).collect()] == [("a", "2")]
    (tmp_path / "ids.json").write_text('{"image_ids": ["a", " b "]}')
    (tmp_path / "ids.txt").write_text("a\n\nb\n")
    for name in ("ids.json", "ids.txt"):
        assert [r.image_id for r in tables.allowed_ids(spark, str(tmp_path / name)).orderBy("ord").collect()] == ["a", "b"]
    (tmp_path / "p.csv").write_text("image_id,model,property_key,gt_value,pred_value\n001,m,k,NA,true\n")
    (tmp_path / "p.json").write_text('{"rows": [{"image_id": "001", "model": "m", "property_key": "k", "gt_value": null, "pred_value": "true"}]}')
    for name in ("p.csv", "p.json"):
        assert [tuple(r) for r in tables.predictions(spark, str(tmp_path / name)).collect()] == [("001", "m", "default", "k", None, "true")]
    (tmp_path / "d.json").write_text('{"b": {"image_id": "b", "decision": "approved"}, "a": {"decision": "rejected"}}')
    assert [(r.image_id, r.decision) for r in tables.decisions(spark, str(tmp_path / "d.json")).orderBy("ord").collect()] == [("b", "approved"), ("a", "rejected")]
    with pytest.raises(ValueError, match="missing columns"):
        tables.predictions(spark, str(tmp_path / "i.csv"))


def test_specs(spark, tmp_path):
    raw = {"enums": {"e": ["A b", "unknown"]}, "groups": {"g": {"properties": {"p": {"type": "categorical", "enum_ref": "e"}, "q": {"type": "boolean"}, "r": {"type": "list<categorical>", "items": {"enum": ["x", "unknown"]}}, "s": {"type": "float"}}}}}
    found = specs_.ontology_specs(raw)
    assert [(s.key, s.value_type, s.allowed) for s in found] == [("g.p", "categorical", ("a_b", "unknown")), ("g.q", "boolean", ("true", "false", "unknown")), ("g.r", "multi_categorical", ("x",))]
    assert [s.key for s in specs_.pick_specs(found, ["g.q", "g.p"])] == ["g.q", "g.p"]
    with pytest.raises(KeyError):
        specs_.pick_specs(found, ["nope"])
    (tmp_path / "c.yaml").write_text("properties:\n  m: {type: categorical, enum: [wood], source_name: mm}\n  n: {type: boolean}\n")
    (spec,) = specs_.protocol_specs(spark, "pdf_protocol", str(tmp_path / "c.yaml"))
    assert (spec.key, spec.source_name, spec.group, spec.allowed) == ("m", "mm", "pdf_compact", ("wood", "unknown"))


def test_backend_errors_stay_in_rows(spark):
    class Flaky:
        def answer(self, prompts_, paths):
            if any("bad" in p for p in prompts_):
                raise RuntimeError("no")
            return ["{}" for _ in prompts_]

    inference.register("flaky", Flaky)
    rows = spark.createDataFrame([(k, "bad" if k == 1 else "ok") for k in range(4)], "k int, prompt string").coalesce(1)
    got = {r.k: (r.raw_output, r.infer_error) for r in inference.infer(rows, "flaky", batch=4).collect()}
    assert got[1] == (None, "RuntimeError: no") and got[0] == ("{}", None)


def test_masks(spark):
    a, b = np.zeros((40, 60), bool), np.zeros((40, 60), bool)
    assert masks.mask_metrics(a, b)["iou"] == 1.0 and masks.binary_iou(a, b) == 0.0
    a[10:30, 10:40] = True
    hole = a.copy()
    hole[15:20, 15:20] = False
    hole[0, 0] = True
    assert (masks.clean_mask(hole, least=50) == a).all()
    assert masks.mask_box(a) == [8, 8, 42, 32] and masks.mask_box(b) is None
    assert masks.components(hole)[1] == 2 and masks.boundary(a).sum() == 2 * 30 + 2 * 18
    assert masks.border_touch(a) == 0.0 and 0 < masks.center_score(a) <= 1
    image = np.full((40, 60, 3), 255, np.uint8)
    image[a] = (10, 120, 30)
    assert (masks.simple_mask(image) == a).all() and masks.background_region(image).sum() == (~a).sum()
    score = masks.context_metrics(image)
    assert score["border_white_ratio"] == 1.0 and 0 <= score["context_score"] <= 1
    row = spark.createDataFrame([(bytearray(a.astype(np.uint8).tobytes()), bytearray(hole.astype(np.uint8).tobytes()), 60, 40)], "a binary, b binary, w int, h int")
    got = row.select(masks.metrics_column(F.col("a"), F.col("b"), F.col("w"), F.col("h")).alias("m")).first()["m"]
    assert got.iou == pytest.approx(575 / 601)


def test_messages(spark):
    rows = spark.createDataFrame([([("a", "b")], "q")], "demos array<struct<prompt:string,response:string>>, p string")
    got = rows.select(prompts.fallback_text(prompts.few_shot_messages(F.col("demos"), F.col("p"))).alias("t")).first()["t"]
    assert got == "USER: a\n\nASSISTANT: b\n\nUSER: q"


def test_streamed_confusion(spark, tmp_path):
    from annolith.streaming import confusion_counts

    rows = spark.createDataFrame([("m", "a", "a"), ("m", "a", "b"), ("n", "b", "b")], "model string, gt string, pred string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = confusion_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["model"])
    query = stream.writeStream.outputMode("complete").format("memory").queryName("confusion").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("confusion").collect())) == [("m", "a", "a", 1), ("m", "a", "b", 1), ("n", "b", "b", 1)]


def test_names():
    assert text.field_choice("masks_hint", text.MASK_FIELDS) == "mask_path_hint" and text.field_choice(" ", text.MASK_FIELDS) is None
    with pytest.raises(ValueError, match="unknown field"):
        text.field_choice("nope", text.PREVIEW_FIELDS)
    assert text.preview_field("mask_path_hint_title") == "seg_preview_path_hint_title" and text.preview_field("x") is None
    assert text.field_suffix("hint-a b") == "_hint_a_b" and text.folder_name("masks", "_x") == "masks_x" and text.hint_suffix("title") == "_hint_title"
    assert text.parse_str_set("light fixture, rug,") == {"LIGHT_FIXTURE", "RUG"} and text.parse_int_list("1, 2,") == [1, 2]


def test_datasets(spark, tmp_path):
    specs_.register_dataset("tiny", "meta_json", "t", "m.json", "s.yaml")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "m.json").write_text('[{"image_id": "i", "path": "p"}]')
    context = specs_.dataset_context("tiny", str(tmp_path))
    assert context.schema.endswith("/t/s.yaml") and tables.samples(spark, context).first()["image_id"] == "i"
    with pytest.raises(ValueError, match="unknown dataset"):
        specs_.dataset_context("nope", "/")
