"""The prompt, feed and part functions for SQL users of a session.

The bodies are made of the same wording and values as the column builders, so that a prompt is the same text
whichever way it is built.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

from feedlift.functions.prompts import BATCH_WORDING, INPUT_CUE, BatchWording
from feedlift.functions.scoring import GENERATED_MARK

_EXAMPLES = "ARRAY<STRUCT<id STRING, properties STRING, title STRING, description STRING>>"


def literal(text: str) -> str:
    """A text as a SQL literal."""
    for sign, written in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(sign, written)
    return f"'{text}'"


def batch_prompt_body(target: str, wording: BatchWording) -> str:
    """The batch prompt over the parameters ``language``, ``examples`` and ``properties``."""
    lines = "array_join({}, '\\n', '')".format
    shown = "transform(coalesce(examples, array()), e -> {})".format
    parts = [
        f"replace({literal(wording.task)}, '{{language}}', language)",
        literal(wording.example_inputs),
        lines(shown("e.properties")),
        literal(wording.example_outputs),
        lines(shown(f"concat(e.id, ': ', e.{target})")),
        literal(wording.counter_examples + INPUT_CUE),
        lines("properties"),
        literal(wording.output_cue),
    ]
    return f"concat({', '.join(parts)})"


def create_functions(spark: SparkSession, wording: Mapping[str, BatchWording] | None = None) -> None:
    """Create, for this session: ``titles_prompt`` and ``descriptions_prompt`` (language, examples, properties),
    ``feed_text`` (value, generated) and ``id_part`` (id, parts)."""
    wording = {**BATCH_WORDING, **(wording or {})}
    bodies = {
        f"{target}s_prompt(language STRING, examples {_EXAMPLES}, properties ARRAY<STRING>) RETURNS STRING": batch_prompt_body(target, words)
        for target, words in wording.items()
    }
    mark = f"CASE WHEN generated THEN {literal(GENERATED_MARK)} ELSE '' END"
    bodies["feed_text(value STRING, generated BOOLEAN) RETURNS STRING"] = f"""concat({mark}, ':"', replace(value, '"', '""'), '"')"""
    head = "CAST(conv(substring(md5(id), 1, 8), 16, 10) AS BIGINT)"
    bodies["id_part(id STRING, parts INT) RETURNS BIGINT"] = f"pmod({head}, parts)"
    for signature, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
