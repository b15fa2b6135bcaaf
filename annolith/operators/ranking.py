"""Winners, deduplication, quotas, splits and few-shot picks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolith.functions.text import UNKNOWN
from annolith.operators.metrics import share_of_total
from annolith.operators.order import row_index
from annolith.session import kept

CLASS_METHODS = ["carpet", "rug", "area_rug"]


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def _score(name: str) -> Column:
    return F.coalesce(F.when(~F.isnan(name), F.col(name)), F.lit(-1.0))


def prompt_winners(results: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """The best class method of each image: iou, dice, sam and dino score down, method up; missing scores are -1."""
    usable = results.filter(F.col("method").isin(methods or CLASS_METHODS) & F.col("iou").isNotNull() & ~F.isnan("iou"))
    return first_of(usable, ["image_name"], F.desc("iou"), F.desc("dice"), _score("sam_score").desc(), _score("dino_score").desc(), F.asc("method"))


def win_counts(winners: DataFrame) -> DataFrame:
    return share_of_total(winners.groupBy("method").agg(F.count("*").cast("long").alias("win_count")))


def winner(one: Column, two: Column, names: tuple[str, str] = ("main_object", "best_class")) -> Column:
    return F.when(one > two, names[0]).when(two > one, names[1]).otherwise("tie")


def main_vs_best(results: DataFrame, main: str = "main_object", methods: list[str] | None = None) -> DataFrame:
    """(image_name, main_object_iou, main_object_dice, best_class_method, best_class_iou, best_class_dice, winner)."""
    own = results.filter((F.col("method") == main) & F.col("iou").isNotNull() & ~F.isnan("iou")).select("image_name", F.col("iou").alias("main_object_iou"), F.col("dice").alias("main_object_dice"))
    best = prompt_winners(results, methods).select("image_name", F.col("method").alias("best_class_method"), F.col("iou").alias("best_class_iou"), F.col("dice").alias("best_class_dice"))
    return own.join(best, "image_name").withColumn("winner", winner(F.col("main_object_iou"), F.col("best_class_iou")))


def main_vs_best_summary(compared: DataFrame) -> DataFrame:
    count = lambda name: F.count_if(F.col("winner") == name).cast("long")
    means = [F.avg(c).alias(c.replace("object_", "object_mean_").replace("class_", "class_mean_")) for c in ("main_object_iou", "best_class_iou", "main_object_dice", "best_class_dice")]
    return compared.agg(count("main_object").alias("main_object_win_count"), count("best_class").alias("best_class_win_count"), count("tie").alias("tie_count"), *means)


def select_update(results: DataFrame, update: str) -> DataFrame:
    """The result that updates an image: a method's own, best_class (dino, sam, area down; 0 and missing scores are -1;
    empty masks are out; ties in method order), or best_available (else the main object)."""
    rank = F.array_position(F.array(*map(F.lit, CLASS_METHODS)), F.col("method"))
    falsy = lambda c: F.coalesce(F.nullif(F.when(~F.isnan(c), F.col(c)), F.lit(0.0)), F.lit(-1.0))
    best = first_of(results.filter((rank > 0) & (F.col("area_ratio") > 0)), ["image_name"], falsy("dino_score").desc(), falsy("sam_score").desc(), F.desc("area_ratio"), rank.asc())
    if update == "best_class":
        return best
    if update == "best_available":
        rest = results.filter(F.col("method") == "main_object").join(best.select("image_name"), "image_name", "left_anti")
        return best.unionByName(rest.select(*best.columns))
    return results.filter(F.col("method") == update)


def dedup_best(rows: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """The row with the highest score of each key; the first on ties."""
    return first_of(rows, keys, F.desc(score), F.asc(order))


def shuffled(key: str, seed: int) -> Column:
    """A fixed order of rows that has nothing to do with what they hold: a hash of the key and the seed."""
    return F.xxhash64(key, F.lit(seed))


def shuffled_md5(key: str, seed: int) -> Column:
    """The same by md5 of the key's text, a colon and the seed, for engines that must agree."""
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))


#: Positions that share one running count of the total cap.
_BUCKET = 4096


def greedy_take(rows: DataFrame, caps: dict[str, str], total: int) -> DataFrame:
    """The pos of rows that a walk in the order of pos takes, where a row is taken if fewer than `total` rows were taken before and,
    for each column of caps, fewer of the row's own value than the cap in the other column says.

    Rounds instead of a walk: a row is taken for sure if even all rows before it that are not yet refused would leave
    room under each cap, and refused for sure if the rows taken before it fill one; the first open row is always sure.
    Each round is one written table of the rows still open or taken.
    """
    names = [*caps, *caps.values()]
    state = rows.select("pos", *dict.fromkeys(names), F.lit(False).alias("taken"))
    while True:
        count = lambda w: (F.count("*").over(w), F.count(F.when(F.col("taken"), 1)).over(w))
        sure, refused = F.lit(True), F.lit(False)
        found = state
        for k, (group, cap) in enumerate(caps.items()):
            every, taken = count(Window.partitionBy(group).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
            found = found.withColumns({f"_every{k}": every, f"_taken{k}": taken})
            sure, refused = sure & (F.col(f"_every{k}") < F.col(cap)), refused | (F.col(f"_taken{k}") >= F.col(cap))
        # The running total is counted inside buckets of positions, and over the buckets' sums.
        bucket = F.floor(F.col("pos") / _BUCKET)
        sums = state.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n"), F.count(F.when(F.col("taken"), 1)).alias("_t"))
        earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"), F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_t"))
        every, taken = count(Window.partitionBy("_bucket").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
        found = found.withColumn("_bucket", bucket).join(sums, "_bucket").withColumns({"_every": every + F.col("_n"), "_taken": taken + F.col("_t")})
        sure, refused = sure & (F.col("_every") < total), refused | (F.col("_taken") >= total)
        found = found.filter(F.col("taken") | ~refused).withColumn("_open", ~F.col("taken") & ~sure).withColumn("taken", F.col("taken") | sure)
        found = kept(found.select("pos", *dict.fromkeys(names), "taken", "_open"), "greedy")
        state = found.drop("_open")
        if not found.filter("_open").limit(1).count():
            return state.select("pos")


def quota_select(pool: DataFrame, n: int, per_type: int, seed: int = 42, shuffle: Callable[[str, int], Column] = shuffled) -> DataFrame:
    """Two greedy passes over a pool (key, material, product_type, known_count): a quota a material and a cap a type,
    then the type cap alone.  Order: known_count down, then shuffled by key and seed.  ord is the order of taking.

    Of one material and type no more than per_type rows can be taken, and of one material a row is reached only among the
    first 2 * n such rows (at most n are skipped for types that are full), whatever the size of the pool: the passes
    run over those.  Each pass is greedy_take, equal to the sequential walk.  Duplicates of a key count once.
    """
    ranked = pool.dropDuplicates(["key"]).withColumn("_hash", shuffle("key", seed))
    order = [F.desc("known_count"), F.asc("_hash"), F.asc("key")]
    usable = ranked.withColumn("_place", F.row_number().over(Window.partitionBy("material", "product_type").orderBy(*order))).filter(F.col("_place") <= min(n, per_type))
    usable = usable.withColumn("_place", F.row_number().over(Window.partitionBy("material").orderBy(*order))).filter(F.col("_place") <= 2 * n).drop("_place")
    usable = row_index(usable, *order).withColumnRenamed("index", "pos")
    named = usable.filter(F.col("material") != UNKNOWN)
    quota = max(1, n // max(1, named.select("material").distinct().count()))
    first = greedy_take(named.withColumns({"_quota": F.lit(quota), "_cap": F.lit(per_type)}), {"material": "_quota", "product_type": "_cap"}, n)
    taken = usable.join(first, "pos", "left_semi")
    used = taken.groupBy(F.col("product_type").alias("_type")).agg(F.count("*").alias("_used"))
    rest = usable.join(first, "pos", "left_anti").join(used, F.col("product_type").eqNullSafe(F.col("_type")), "left")
    rest = rest.withColumn("_left", F.lit(per_type) - F.coalesce("_used", F.lit(0))).filter("_left > 0")
    second = greedy_take(rest, {"product_type": "_left"}, n - first.count())
    chosen = taken.withColumn("_pass", F.lit(0)).unionByName(usable.join(second, "pos", "left_semi").withColumn("_pass", F.lit(1)))
    return row_index(chosen, "_pass", "pos").select(*pool.columns, F.col("index").cast("int").alias("ord"))


def known_total(samples: DataFrame) -> Column:
    """How many properties of a sample's map gt are known."""
    return F.size(F.filter(F.map_values("gt"), lambda v: ~v.isin(UNKNOWN, "[]", "")))


def few_shot_fixed(samples: DataFrame, k: int) -> DataFrame:
    """(image_id, demos: ids in order): the k samples with most known properties, the sample itself apart."""
    ranked = samples.select(F.col("image_id").alias("demo"), known_total(samples).alias("known")).filter("known > 0").orderBy(F.desc("known"), "demo").limit(k + 1)
    top = ranked.agg(F.array_sort(F.collect_list(F.struct((-F.col("known")).alias("by"), "demo"))).alias("top"))  # k + 1 ids
    return samples.select("image_id").crossJoin(F.broadcast(top)).select("image_id", F.slice(F.filter(F.transform("top", lambda x: x.demo), lambda d: d != F.col("image_id")), 1, k).alias("demos"))


def few_shot_dynamic(rows: DataFrame, k: int) -> DataFrame:
    """(image_id, property_key, demos): the first k images by id with the property known, the image itself apart."""
    known = rows.filter(~F.col("gt").isin(UNKNOWN, "[]", "")).select("property_key", F.col("image_id").alias("demo")).distinct()
    place = F.row_number().over(Window.partitionBy("property_key").orderBy("demo"))
    top = known.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("property_key").agg(F.array_sort(F.collect_list("demo")).alias("top"))
    own = rows.select("image_id", "property_key").distinct().join(top, "property_key", "left")
    return own.select("image_id", "property_key", F.slice(F.filter(F.coalesce("top", F.array().cast("array<string>")), lambda d: d != F.col("image_id")), 1, k).alias("demos"))


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 42, shuffle: Callable[[str, int], Column] = shuffled) -> DataFrame:
    """n rows (all, if fewer) in shuffled order."""
    return rows.orderBy(shuffle(key, seed), key).limit(n)


def holdout_split(ids: DataFrame, n: int, seed: int = 42, shuffle: Callable[[str, int], Column] = shuffled) -> tuple[DataFrame, DataFrame]:
    """(train, val) of (image_id, ord): n validation ids, and all others.  Order is the writer's affair (write_ids)."""
    val = kept(hash_sample(ids, "image_id", n, seed, shuffle), "holdout")
    return ids.join(val.select("image_id"), "image_id", "left_anti"), val


def best_detection(rows: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    return first_of(rows, keys, F.desc_nulls_last(score), F.asc("idx"))


def blended(overlap, model_iou, delta):  # noqa: ANN001, ANN201
    """How good a refined mask is, of numbers or Columns: overlap with the seed, the model's own iou, and change of area."""
    return 0.65 * overlap + 0.30 * model_iou - 0.05 * delta


def refined_choice(rows: DataFrame) -> DataFrame:
    """The mask candidate with the best blend of overlap with the seed, model iou and area change; the first on ties."""
    value = blended(F.col("overlap"), F.col("model_iou"), F.abs(F.col("area") - F.col("seed_area")))
    return first_of(rows.withColumn("blended", value), ["image_name"], F.desc("blended"), F.asc("idx"))


def main_object_choice(rows: DataFrame, area: float = 0.60, center: float = 0.30, border: float = 0.20) -> DataFrame:
    """The candidate with the best heuristic score: area, centre, border, and predicted iou if it is there."""
    value = area * F.col("area_ratio") + center * F.col("center_score") - border * F.col("border_ratio") + F.coalesce(0.05 * F.col("predicted_iou"), F.lit(0.0))
    return first_of(rows.withColumn("heuristic", value), ["image_name"], F.desc("heuristic"), F.asc("idx"))


def batches(rows: DataFrame, keys: list[str], order: str, size: int, cap: int | None = None) -> DataFrame:
    """rows with batch, the number of each row's chunk of at most min(size, cap) rows of its group."""
    n = max(1, min(size, cap) if cap else size)
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1) / n).cast("long"))


def review_start(ids: DataFrame, decisions: DataFrame, wanted: str | None = None) -> DataFrame:
    """One row, start: the wanted id's ord, else the first undecided one's, else 0."""
    first = ids.join(decisions.select("image_id"), "image_id", "left_anti").agg(F.min("ord").alias("first"))
    asked = ids.filter(F.col("image_id") == F.lit(wanted)).agg(F.min("ord").alias("asked"))
    return first.crossJoin(asked).select(F.coalesce("asked", "first", F.lit(0)).cast("long").alias("start"))


def first_n(rows: DataFrame, order: str, n: int) -> DataFrame:
    return rows.orderBy(order).limit(n)
