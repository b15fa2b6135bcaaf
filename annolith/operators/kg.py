"""Re-ranking of property bundles by physical priors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolith.functions.text import UNKNOWN, norm_knowledge
from annolith.operators.metrics import RUN
from annolith.session import kept
from annolith.sources.specs import KnowledgePriors, knowledge_token

MATERIAL = "intrinsic.main_material"


def canonical(rows: DataFrame, aliases: DataFrame, column: str = "pred_value") -> DataFrame:
    """rows (property_key, column) with the column normalised and aliases applied."""
    out = rows.withColumn("_v", norm_knowledge(F.col(column)))
    named = aliases.select(F.col("property").alias("_p"), F.col("value").alias("_a"), F.col("to").alias("_to"))
    out = out.join(F.broadcast(named), (F.col("property_key") == F.col("_p")) & (F.col("_v") == F.col("_a")), "left")  # a config file's rows
    return out.withColumn(column, F.coalesce("_to", "_v")).drop("_v", "_p", "_a", "_to")


def bundle_scores(rows: DataFrame, materials: DataFrame, rules: DataFrame, keep: float = 0.75, change: float = 0.55) -> DataFrame:
    """(model, variant, image_id, score) of candidate bundles (property_key, value, original), by joins and a sum.

    keep for each value left as it was, change off for others, the material's prior of each value, and the weight
    of each ordered pair of values.  Images share few bundles: each different one is scored once, and joined back.
    """
    by = [*RUN, "image_id"]
    packed = kept(rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("property_key", "value", "original"))).alias("bundle")), "candidates")
    different = kept(packed.select("bundle").distinct().withColumn("number", F.monotonically_increasing_id()), "different")
    scored = _scores(different.select("number", F.inline("bundle")), ["number"], materials, rules, keep, change)
    return packed.join(different.join(scored, "number"), "bundle").select(*by, "score")


def _scores(rows: DataFrame, by: list[str], materials: DataFrame, rules: DataFrame, keep: float, change: float) -> DataFrame:
    own = rows.groupBy(*by).agg(F.sum(F.when(F.col("value") == F.coalesce("original", F.lit(UNKNOWN)), keep).otherwise(-change)).alias("s"))
    stuff = rows.filter(F.col("property_key") == MATERIAL).select(*by, F.col("value").alias("material")).filter(F.col("material") != UNKNOWN)
    priors = F.broadcast(materials.select("material", F.col("property").alias("property_key"), "value", "w"))  # a config file's rows
    prior = rows.join(stuff, by).join(priors, ["material", "property_key", "value"]).groupBy(*by).agg(F.sum("w").alias("s"))
    left = rows.select(*by, F.col("property_key").alias("lp"), F.col("value").alias("lv")).join(F.broadcast(rules), ["lp", "lv"])
    pairs = left.join(rows.select(*by, F.col("property_key").alias("rp"), F.col("value").alias("rv")), [*by, "rp", "rv"]).filter("lp <> rp").groupBy(*by).agg(F.sum("w").alias("s"))
    return own.union(prior).union(pairs).groupBy(*by).agg(F.sum("s").alias("score"))


class Reranker:
    """Coordinate ascent over one bundle: properties in the config's order, values in theirs, strictly better ones win."""

    def __init__(self, priors: KnowledgePriors) -> None:
        self.priors = priors
        self.pairs: dict[tuple[str, str], list[dict[str, dict[str, float]]]] = {}
        for lp, rp, weights in priors.rules:
            self.pairs.setdefault((lp, rp), []).append(weights)

    def canonical(self, key: str, value: object) -> str:
        token = knowledge_token(value)
        return self.priors.aliases.get(key, {}).get(token, token)

    def score(self, bundle: dict[str, str], original: dict[str, str]) -> float:
        p, material = self.priors, bundle.get(MATERIAL, UNKNOWN)
        total = sum(p.keep if v == original.get(k, UNKNOWN) else -p.change for k, v in bundle.items())
        if material != UNKNOWN:
            table = p.materials.get(material, {})
            total += sum(table.get(k, {}).get(v, 0.0) for k, v in bundle.items())
        for (lp, rp), tables in self.pairs.items():
            if lp != rp and lp in bundle and rp in bundle:
                total += sum(t.get(bundle[lp], {}).get(bundle[rp], 0.0) for t in tables)
        return total

    def values(self, key: str, bundle: dict[str, str]) -> list[str]:
        found = {bundle[key], *self.priors.materials.get(bundle.get(MATERIAL, UNKNOWN), {}).get(key, {})}
        for (lp, rp), tables in self.pairs.items():
            for t in tables:
                if lp == key:
                    found |= set(t)
                elif rp == key:
                    found |= {v for row in t.values() for v in row}
        return sorted(found)

    def rerank(self, bundle: dict[str, object]) -> dict[str, str]:
        original = {k: self.canonical(k, v) for k, v in bundle.items()}
        state = dict(original)
        for _ in range(self.priors.passes):
            before = dict(state)
            for key in (k for k in self.priors.properties if k in state):
                rated = [(self.score({**state, key: v}, original), v) for v in self.values(key, state)]
                top = max(s for s, _ in rated)
                state[key] = next(v for s, v in rated if s == top)
            if state == before:
                break
        return state


def rerank(rows: DataFrame, priors: KnowledgePriors, order: str | None = None) -> DataFrame:
    """rows with pred_value_kg.

    A bundle's outcome depends on its values alone, and far fewer bundles differ than there are images: each
    different one is re-ranked once, in Arrow batches, and joined back.  Of values for one property the last by
    order counts; without an order, different ones raise.
    """
    by = [*RUN, "image_id"]
    single = F.when((F.count("pred_value") == F.count("*")) & (F.min("pred_value") == F.max("pred_value")) | (F.count("pred_value") == 0) | (F.count("*") == 1), F.max("pred_value"))
    only = single.otherwise(F.raise_error(F.lit("several values for one property: which is the last needs an order")))
    last = rows.groupBy(*by, "property_key").agg((F.max_by("pred_value", order) if order else only).alias("v"))
    # Written, so that the joins with it can be split where one bundle is very common.
    packed = kept(last.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("property_key", F.coalesce("v", F.lit(UNKNOWN)).alias("v")))).alias("bundle")), "bundles")

    def ranked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = Reranker(priors)
        for part in parts:
            yield pd.DataFrame({"bundle": part["bundle"], "better": [engine.rerank({x["property_key"]: x["v"] for x in b}) for b in part["bundle"]]})

    kind = "array<struct<property_key: string, v: string>>"
    best = kept(packed.select("bundle").distinct().mapInPandas(ranked, f"bundle {kind}, better map<string,string>"), "reranked")
    corrected = packed.join(best, "bundle").select(*(F.col(c).alias(f"_{c}") for c in by), F.explode("better").alias("_key", "pred_value_kg"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.col("property_key") == F.col("_key")]
    out = rows.join(corrected, same, "left").drop(*(f"_{c}" for c in by), "_key")
    return out.withColumn("pred_value_kg", F.coalesce("pred_value_kg", "pred_value"))
