"""File order, image files, versions, pruning, samples and funnels on small hand-made inputs."""

import json
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolith.functions import masks
from annolith.operators import joins, metrics, order, ranking
from annolith.session import progress
from annolith.sources import images, prune, tables
from annolith.sources.versions import VersionedTable

# ------------------------------------------------------------------ order


def test_the_later_file_wins_whatever_its_size(spark, tmp_path):
    """A small first file and a large second one, which Spark reads first."""
    (tmp_path / "part-0").write_text("image_id,path\na,first\n")
    (tmp_path / "part-1").write_text("image_id,path\na,second\n" + "".join(f"b{k},x{k}\n" for k in range(100)))
    (tmp_path / "part-2").write_text("image_id,path\nc,third\n,\n")
    got = {r.image_id: r.path for r in tables.image_index(spark, str(tmp_path)).collect()}
    assert got["a"] == "second" and got["c"] == "third" and len(got) == 102


def test_ids_keep_the_order_of_files_and_blocks(spark, tmp_path):
    """Files cut into blocks, small ones between large ones."""
    want = []
    for k, n in enumerate([1, 300, 2, 500, 3]):
        ids = [f"{k}-{i}" for i in range(n)]
        want += ids
        (tmp_path / f"part-{k}.jsonl").write_text("".join(json.dumps({"obj_id": i, "caption": "x" * 200}) + "\n" for i in ids))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        rows = tables.id_scan(spark, str(tmp_path))
        got = [r.image_id for r in order.row_index(rows, "ord").orderBy("index").collect()]
        assert rows.rdd.getNumPartitions() > 5 and got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_decisions_of_several_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"x": {"decision": "approved"}, "y": {"decision": "rejected"}}))
    (tmp_path / "b.json").write_text(json.dumps({"z": {"decision": "approved", "image_id": "zz"}}))
    rows = tables.decisions(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.image_id, r.decision) for r in rows] == [("x", "approved"), ("y", "rejected"), ("zz", "approved")]


def test_last_prediction_over_several_files(spark, tmp_path):
    folder = tmp_path / "p.csv"
    folder.mkdir()
    head = "image_id,model,property_key,gt_value,pred_value\n"
    (folder / "part-0.csv").write_text(head + "i,m,k,g,old\n")
    (folder / "part-1.csv").write_text(head + "i,m,k,g,new\n" + "".join(f"j{k},m,k,g,p\n" for k in range(50)))
    rows = tables.keep_last(tables.predictions(spark, str(folder), ordered=True), ["image_id", "property_key"], "ord")
    assert {r.image_id: r.pred_value for r in rows.collect()}["i"] == "new" and rows.count() == 51


@pytest.mark.parametrize("n,k", [(1, 0), (5, 5), (100, 7), (1000, 400)])
def test_exact_sample(spark, n, k):
    rows = spark.range(n).select(F.col("id"), (-F.col("id")).alias("by")).repartition(5)
    got = [r.id for r in order.exact_sample(rows, k, "by", seed=7).orderBy("place").collect()]
    listed = list(range(n - 1, -1, -1))
    assert got == (random.Random(7).sample(listed, k) if n > k else listed)


def test_row_index_of_nothing_and_of_equal_rows(spark):
    assert order.row_index(spark.range(0), "id").count() == 0
    rows = spark.range(500).select(F.lit(1).alias("same"))
    assert sorted(r["index"] for r in order.row_index(rows, "same").collect()) == list(range(500))


def walk(rows, caps, total):
    taken, used = [], {}
    for row in rows:
        if len(taken) < total and all(used.get((g, row[g]), 0) < row[c] for g, c in caps.items()):
            taken.append(row["pos"])
            for g in caps:
                used[g, row[g]] = used.get((g, row[g]), 0) + 1
    return taken


@pytest.mark.parametrize("seed", range(6))
def test_greedy_rounds_equal_the_walk(spark, seed):
    """Chains of full groups, caps of none, a hot group, positions far apart and over several buckets."""
    r = random.Random(seed)
    scale = 3000 if seed % 2 else 1
    rows = [{"pos": k * scale, "a": r.choice("xxxxyz") if seed else "x", "b": r.randrange(12) or None, "ca": 9, "cb": r.randrange(3)} for k in range(90)]
    caps_b = {b: r.randrange(4) for b in [*range(12), None]}
    for row in rows:
        row["cb"] = caps_b[row["b"]]
    frame = spark.createDataFrame([tuple(x.values()) for x in rows], "pos long, a string, b int, ca int, cb int").repartition(4)
    for total in (0, 8, 200):
        got = sorted(x.pos for x in ranking.greedy_take(frame, {"a": "ca", "b": "cb"}, total).collect())
        assert got == walk(rows, {"a": "ca", "b": "cb"}, total)


# ------------------------------------------------------------------ images


def test_masks_written_and_read(spark, tmp_path):
    root = str(tmp_path / "out")
    r = np.random.default_rng(0)
    data = {f"d{k % 3}/deep/é {k}.x.jpg": (r.random((3 + k, 5)) > 0.5).astype(np.uint8) for k in range(12)}
    rows = spark.createDataFrame([(n, m.shape[1], m.shape[0], m.tobytes()) for n, m in data.items()], "relative string, width int, height int, mask binary").repartition(5)
    for _ in range(2):  # a second run replaces the files
        images.write_masks(rows, root)
    got = {x.relative: np.frombuffer(x.mask, np.uint8).reshape(x.height, x.width) for x in images.read_masks(spark, root).collect()}
    assert {n.rpartition(".")[0] + ".png" for n in data} == set(got)
    assert all((got[n.rpartition(".")[0] + ".png"] == m).all() for n, m in data.items())
    assert not [d for d in os.listdir(root) if d.startswith("_staging")]


def test_grey_levels_alpha_and_broken_files(spark, tmp_path):
    """A grey value of 127 is outside, 128 inside; alpha does not count; broken files are NULL; other files are not read."""
    (tmp_path / "a.png").write_bytes(images.png(np.array([[127, 128, 255, 0]], np.uint8)))
    (tmp_path / "b.png").write_bytes(images.png(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [90, 160, 200]]], np.uint8)))
    (tmp_path / "c.png").write_bytes(b"not an image")
    (tmp_path / "d.txt").write_text("x")
    got = {x.relative: x.mask and list(x.mask) for x in images.read_masks(spark, str(tmp_path)).collect()}
    assert got == {"a.png": [0, 1, 1, 0], "b.png": [0, 1, 0, 1], "c.png": None}
    colours = {x.relative: x.data for x in images.read_images(spark, str(tmp_path)).collect()}
    assert list(colours["b.png"][:3]) == [255, 0, 0] and list(colours["a.png"][:6]) == [127] * 3 + [128] * 3 and colours["c.png"] is None


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = spark.createDataFrame([("a.png", 1, 1, 1, b"\x01"), ("b.png", 2, 2, 1, b"\x01")], "path string, width int, height int, channels int, data binary").coalesce(1)
    with pytest.raises(Exception, match="(?i)buffer|size|failed"):
        images.write_png(rows, root)
    assert [f for _, _, files in os.walk(root) for f in files] == []


def test_nearest_takes_the_pixel_under_the_centre():
    row = np.arange(8)[None]
    assert masks.nearest(row, 1, 4).tolist() == [[1, 3, 5, 7]] and masks.nearest(row, 1, 3).tolist() == [[1, 4, 6]]
    assert masks.nearest(row, 2, 16).tolist() == [[k // 2 for k in range(16)]] * 2


def test_closing_loses_the_frame():
    """As with a closing whose outside is empty: a full mask keeps its inner part, and holes are filled."""
    full = np.ones((9, 9), bool)
    want = np.zeros((9, 9), bool)
    want[2:7, 2:7] = True
    assert (masks.clean_mask(full, least=1) == want).all()


def test_collages(spark, tmp_path):
    root = str(tmp_path / "out")
    image, mask = bytes([10, 20, 30] * 12), bytes([1] * 6 + [0] * 6)
    rows = spark.createDataFrame([("s/i.jpg", m, 4, 3, image, gt, mask) for m, gt in (("m1", mask), ("m2", mask))] + [("j.jpg", "m1", 4, 3, image, None, mask)], "relative string, method string, width int, height int, data binary, gt binary, mask binary")
    images.save_collages(rows, root, ["m1", "m2"], columns=2, width=100, height=200)
    got = {x.relative: (x.width, x.height) for x in images.read_images(spark, root).collect()}
    assert got == {"collages/s/i.png": (216, 416), "collages/j.png": (216, 416)}


def test_simple_masks_only_where_there_are_none(spark, tmp_path):
    root = str(tmp_path / "m")
    rows = spark.createDataFrame([(f"{k}.jpg", 6, 6, bytes([255, 255, 255] * 18 + [0, 0, 0] * 18) if k else None) for k in range(3)], "relative string, width int, height int, data binary")
    first = {x.relative: (x.status, round(x.area_ratio, 3)) for x in images.materialise_masks(rows, root).collect()}
    again = {x.relative: (x.status, round(x.area_ratio, 3)) for x in images.materialise_masks(rows, root).collect()}
    assert first == {f"{k}.jpg": ("generated_simple", 0.5) for k in (1, 2)} and again == {f"{k}.jpg": ("mask_exists", 0.5) for k in (1, 2)}


# ------------------------------------------------------------------ versions


def test_a_killed_rewrite_is_continued(spark, tmp_path):
    """The first run dies between two flushes; the second does the rest only, and readers never see half a version."""
    table = VersionedTable(spark, str(tmp_path / "t"), "id", buckets=6)
    table.create(spark.range(200).withColumn("v", F.lit("old")))
    calls = []

    def update(rows, dies_at=None):
        calls.append(1)
        if len(calls) == dies_at:
            raise KeyboardInterrupt
        return rows.withColumn("v", F.when(F.col("id") % 2 == 0, F.lit("new")).otherwise(F.col("v")))

    with pytest.raises(KeyboardInterrupt):
        table.rewrite(lambda rows: update(rows, dies_at=4))
    assert table.latest() == 0 and {r.v for r in table.read().collect()} == {"old"}
    calls.clear()
    report = VersionedTable(spark, str(tmp_path / "t"), "id", buckets=6).rewrite(update)
    assert len(calls) == 3 and (report.steps_found, report.steps_done, report.rows, report.changed) == (3, 3, 200, 100)
    assert table.latest() == 1 and table.read().filter("v = 'new'").count() == 100 and table.read(0).filter("v = 'old'").count() == 200
    assert table.restore() == 2 and table.read().filter("v = 'old'").count() == 200
    assert [h["version"] for h in table.history()] == [0, 1, 2]


def test_a_dry_run_writes_nothing(spark, tmp_path):
    root = tmp_path / "t"
    table = VersionedTable(spark, str(root), "id", buckets=2)
    table.create(spark.range(10).withColumn("v", F.lit(None).cast("string")))
    before = sorted(os.walk(root))
    report = table.rewrite(lambda rows: rows.withColumn("v", F.when(F.col("id") < 3, "x")), dry_run=True)
    assert (report.rows, report.changed, report.dry_run) == (10, 3, True) and sorted(os.walk(root)) == before


def test_two_writers_and_half_an_entry(spark, tmp_path):
    """Only one of two writers gets a version's number; an entry that was cut off does not count."""
    table = VersionedTable(spark, str(tmp_path / "t"), "id", buckets=1)
    table.create(spark.range(3))
    with pytest.raises(ValueError):
        table.create(spark.range(3))
    table.restore()
    with pytest.raises(Exception, match="(?i)exist"):
        table.log.add("00000001.json", {})
    (tmp_path / "t" / "_log" / "00000009.json").write_text('{"folder": "')
    assert table.latest() == 1 and table.read().count() == 3


# ------------------------------------------------------------------ pruning


def test_prune(spark, tmp_path):
    for name in ("a/x.png", "a/y.png", "b/c/z.png", "b/c/d/w.png", "top.png", "used/deep/u.png"):
        path = tmp_path / "r" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("1")
    used = spark.createDataFrame([("a/y.png",), ("used/deep/u.png",), ("nowhere.png",)], "relative string")
    root = str(tmp_path / "r")
    dry = {(r.relative, r.status) for r in prune.prune(spark, root, used, dry_run=True).collect()}
    assert dry == {(n, "would_delete") for n in ("a/x.png", "b/c/z.png", "b/c/d/w.png", "top.png")} and os.path.exists(f"{root}/top.png")
    done = {(r.relative, r.status) for r in prune.prune(spark, root, used).collect()}
    assert done == {(n, "deleted") for n, _ in dry}
    left = sorted(os.path.relpath(os.path.join(d, f), root) for d, _, files in os.walk(root) for f in files if not f.endswith(".crc"))
    assert left == ["a/y.png", "used/deep/u.png"] and not os.path.exists(f"{root}/b")
    assert prune.prune(spark, root, used).count() == 0


# ------------------------------------------------------------------ funnel and progress


def test_funnel_on_the_candidates_own_pass(spark):
    from pyspark.sql import Observation

    rows = spark.createDataFrame([(f"i{k}", f"m{k % 4}" if k % 5 else None, "wood glass vase" if k % 3 else None, "VASE") for k in range(60)], "item_id string, main_image_id string, title string, kind string")
    index = spark.createDataFrame([("m1", "a"), ("m2", "b")], "image_id string, path string")
    texts = {"item_name": F.col("title"), "product_type": F.col("kind")}
    _, counted = joins.candidates(rows, index, texts, 1)
    seen = Observation()
    out, none = joins.candidates(rows, index, texts, 1, observation=seen)
    assert none is None and out._jdf.queryExecution().executedPlan().toString().count("CollectMetrics") == 1
    n = len(out.collect())
    got = joins.with_excluded(metrics.observed(spark, seen, joins.FUNNEL)).first()
    assert got == counted.select(*got.asDict()).first() and got["candidates"] == n


def test_progress_says_something(spark):
    def slow(parts):
        import time

        for part in parts:
            time.sleep(0.5)
            yield part

    said = []
    with progress(spark, said.append, every=0.2):
        spark.range(4, numPartitions=4).mapInPandas(slow, "id long").count()
    assert said and "a second" in said[0]


def test_png_is_a_png():
    body = images.png(np.zeros((2, 3), np.uint8))
    assert body[:8] == b"\x89PNG\r\n\x1a\n" and zlib.decompress(body[41 : 41 + int.from_bytes(body[33:37], "big")]) == b"\0" * 8


def test_a_panel_that_is_nowhere_raises(spark):
    samples = spark.createDataFrame([("a", "x/a.png"), ("b", None)], "image_id string, panel string")
    files = spark.createDataFrame([("d/p/a.png",)], "path string")
    got = tables.panel_paths(samples.filter("image_id = 'a'"), files, "d", "d/p").collect()
    assert [(r.image_id, r.path) for r in got] == [("a", "d/p/a.png")]
    with pytest.raises(Exception, match="panel image not found for b"):
        tables.panel_paths(samples, files, "d", "d/p").collect()


def test_candidate_paths_are_not_broadcast(spark):
    """Neither the exploded candidates nor the listing pass through the driver, however small Spark takes them for."""
    wanted = spark.createDataFrame([(1, "a/1.webp"), (2, "a/2.webp"), (3, "b/3.webp")], "image_id long, relative string")
    files = spark.createDataFrame([("a/1.jpg",), ("a/1.png",), ("2.bmp",), ("c/3.png",)], "path string")
    found = tables.first_existing(wanted, tables.mask_candidates(F.col("relative")), files)
    assert {(r.image_id, r.path) for r in found.collect()} == {(1, "a/1.png"), (2, "2.bmp")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_tasks_list_folders(spark, tmp_path):
    """A listing is a table that tasks wrote: Spark's driver holds none of the files; hidden ones are left out at every level."""
    names = {f"d{k % 3}/é {k % 2}/x{k}.png" for k in range(60)} | {"top.png", "_p=1/in.png"}
    for name in names | {".h/a.png", "_staging-1/b.png", "d0/.c.png.crc", "d0/_d.png", "e/f.png._COPYING_"}:
        path = tmp_path / "r" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("1")
    for root in (str(tmp_path / "r"), f"file://{tmp_path}/r/"):
        rows = prune.listed(spark, root)
        assert not [f for f in rows.inputFiles() if "/r/" in f]
        assert sorted(r.relative for r in rows.collect()) == sorted(names) and all(r.path.endswith(r.relative) for r in rows.collect())


def test_small_files_share_tasks(spark, tmp_path):
    for k in range(640):
        (tmp_path / f"{k}.png").write_bytes(images.png(np.zeros((1, 1), np.uint8)))
    spark.conf.unset("spark.sql.files.openCostInBytes")
    rows = images.read_masks(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() <= 8 and rows.count() == 640


def test_rows_of_one_row_group_are_dealt_before_files_are_made(spark, tmp_path):
    from annolith.plans import image_queries

    spark.range(50).select(F.col("id").alias("vec_id"), F.array_repeat(F.lit(0.5), 64).alias("embedding")).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = image_queries._images(spark, str(tmp_path))
    assert sum(1 for n in rows.rdd.glom().map(len).collect() if n) > 4 and rows.count() == 50
