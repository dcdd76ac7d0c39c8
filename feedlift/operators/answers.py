"""Answers of batch prompts, brought back to their products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlift.functions.responses import answer_line, answer_lines


def answer_rows(generated: DataFrame) -> DataFrame:
    """``chunk_id, pos, id, text`` for every answer line that bears an id of its prompt."""
    lines = generated.select(
        "chunk_id", "ids", F.posexplode(answer_lines("response", "ids")).alias("pos", "line")
    )
    return (
        lines.select("chunk_id", "ids", "pos", answer_line(F.col("line")).alias("answer"))
        .where(F.array_contains("ids", F.col("answer.id")))
        .select("chunk_id", "pos", F.col("answer.id").alias("id"), F.col("answer.text").alias("text"))
    )


def asked_products(generated: DataFrame) -> DataFrame:
    """``id, text, error, named`` of every product that was asked for: its first answer, whether an
    answer names it at all, and the error of its prompt."""
    asked = generated.select(
        F.explode("ids").alias("id"), F.lit(None).cast(answer_rows(generated).schema["pos"].dataType).alias("pos"),
        F.lit(None).cast("string").alias("text"), "chunk_id", "error",
    )
    rows = asked.unionByName(answer_rows(generated).withColumn("error", F.lit(None).cast("string")))
    named = F.col("pos").isNotNull()
    first = F.min(F.when(named, F.struct("chunk_id", "pos", "text"))).alias("first")
    reduced = rows.groupBy("id").agg(first, F.max("error").alias("error"))
    return reduced.select("id", "first.text", "error", F.col("first").isNotNull().alias("named"))


def first_answers(generated: DataFrame) -> DataFrame:
    """``id, text``: the first answer of each product by prompt and line. An aggregate
    instead of a window: repeated lines of one id are reduced before the shuffle."""
    first = F.min(F.struct("chunk_id", "pos", "text")).alias("first")
    return answer_rows(generated).groupBy("id").agg(first).select("id", "first.text")
