"""Registered queries of chat templates and of chat models behind their ladder of fallbacks, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolith.functions import templates
from annolith.operators import runtime
from annolith.plans.queries import _read, query

_SHOWN = "CASE WHEN turn % 5 = 4 THEN 'tool' ELSE role END"


@query(f"""WITH t AS (SELECT conv_id, turn, {_SHOWN} AS role, text FROM conversations), s AS (SELECT *, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM t)
    SELECT conv_id, turn, 'chatml' AS template, CASE WHEN role IN ('system', 'user', 'assistant') THEN '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) ELSE upper(role) || ': ' || body END AS prompt FROM s
    UNION ALL SELECT conv_id, turn, 'instruct', CASE role WHEN 'user' THEN '<s>[INST] ' || body || ' [/INST]' WHEN 'assistant' THEN '<s> ' || body || '</s>' WHEN 'system' THEN '<s><<SYS>>' || chr(10) || body || chr(10) || '<</SYS>>' || chr(10) || chr(10) ELSE upper(role) || ': ' || body END FROM s""")
def chat_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a conversation of its own in two templates; roles that a template lacks come as plain text."""
    rows = _read(spark, sf_dir, "conversations").withColumn("role", F.when(F.col("turn") % 5 == 4, "tool").otherwise(F.col("role")))
    messages = F.array(F.struct(F.col("role"), F.col("text").alias("content")))
    out = None
    for name, template in templates.TEMPLATES.items():
        part = rows.select("conv_id", "turn", F.lit(name).alias("template"), templates.render(template, messages).alias("prompt"))
        out = part if out is None else out.union(part)
    return out


class Moods:
    """Fails by the lengths of its texts: batches with one of a multiple of 7 are not prepared, any of a multiple of 11 is not
    answered, and batches with a multiple of 5 come back partly blank."""

    def template(self, messages: list[runtime.Message]) -> str:
        return "<" + (messages[-1]["content"] or "") + ">"

    def prepare(self, texts: list[str], images: list[list[str]]) -> list[str]:
        if len(texts) > 1 and any(len(t) % 7 == 0 for t in texts):
            raise ValueError("cannot pad")
        return texts

    def generate(self, inputs: list[str]) -> list[str]:
        if any(len(t) % 11 == 0 for t in inputs):
            raise RuntimeError("no answer")
        return inputs

    def decode(self, outputs: list[str]) -> list[str]:
        return ["" if len(outputs) > 1 and len(t) % 5 == 0 else str(len(t)) for t in outputs]


_CALLS = """c AS (SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4 AS batch, length(coalesce(text, '')) + 2 AS n FROM conversations),
    p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, batch ORDER BY turn) AS place FROM c),
    b AS (SELECT conv_id, batch, count(*) AS size, bool_or(n % 7 = 0) AS pads, count(*) FILTER (WHERE n % 11 = 0) AS bad, min(place) FILTER (WHERE n % 11 = 0) AS first_bad, bool_or(n % 5 = 0) AS blank FROM p GROUP BY 1, 2),
    k AS (SELECT *, CASE WHEN size = 1 THEN 'single' WHEN pads THEN 'pads' WHEN bad > 0 THEN 'bad' WHEN blank THEN 'blank' ELSE 'fine' END AS way FROM b)"""


@query("SELECT conv_id, turn, CASE WHEN n % 11 <> 0 THEN CAST(n AS VARCHAR) END AS raw_output, CASE WHEN n % 11 = 0 THEN 'RuntimeError: no answer' END AS error FROM (SELECT conv_id, turn, length(coalesce(text, '')) + 2 AS n FROM conversations)")
def chat_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model that fails in several ways: each turn gets its answer or its error."""
    return runtime.answers(_asked(spark, sf_dir), ["conv_id"]).select("conv_id", F.col("ord").alias("turn"), "raw_output", "error")


@query(f"""WITH {_CALLS}, n AS (SELECT 'messages_batch_calls' AS counter, count(*) AS n FROM k UNION ALL SELECT 'messages_batch_items', sum(size) FROM k UNION ALL SELECT 'messages_batch_degenerate_to_single', count(*) FROM k WHERE way = 'single'
    UNION ALL SELECT 'messages_batch_processor_exception_fallback', count(*) FROM k WHERE way = 'pads' UNION ALL SELECT 'messages_batch_generate_exception', count(*) FROM k WHERE way = 'bad'
    UNION ALL SELECT 'messages_batch_empty_decode_fallback', count(*) FROM k WHERE way = 'blank' UNION ALL SELECT 'messages_batch_success', count(*) FROM k WHERE way = 'fine'
    UNION ALL SELECT 'single_message_calls', sum(CASE WHEN way IN ('single', 'pads') THEN coalesce(first_bad, 0) + size ELSE size END) FROM k WHERE way <> 'fine'
    UNION ALL SELECT 'single_message_generate_exception', sum(bad + CASE WHEN bad > 0 AND way IN ('single', 'pads') THEN 1 ELSE 0 END) FROM k WHERE way <> 'fine')
    SELECT counter, CAST(n AS BIGINT) AS n FROM n WHERE n > 0""")
def chat_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happened on the way, by name."""
    return runtime.totals(_asked(spark, sf_dir))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    message = F.array(F.struct(F.lit("user").alias("role"), F.coalesce("text", F.lit("")).alias("content")))
    return runtime.chat(rows.select("conv_id", "turn", message.alias("messages"), F.array(F.lit("i.png")).alias("images")), "moods", Moods, ["conv_id"], "turn", 4)
