"""The output state of batched generation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlift.operators.selection import tries_column


def merge_answers(state: DataFrame, answers: DataFrame, target: str) -> DataFrame:
    """State after a round: a new text replaces the old one, a missing text does not, and
    every product that was answered at all has one more try behind it.

    ``answers`` has one row per id, so each state row meets at most one of them; a hot
    state id is split by adaptive execution on the state side of the outer join.
    """
    tries = tries_column(state, target)
    updates = answers.select(
        F.col("id").alias("_id"), F.col("text").alias("_text"), F.lit(1).alias("_tried")
    )
    changed = {
        target: F.coalesce(F.col("_text"), F.col(target)),
        tries: F.col(tries) + F.coalesce(F.col("_tried"), F.lit(0)),
    }
    return state.join(updates, F.col("id") == F.col("_id"), "left").select(
        *[changed[c].alias(c) if c in changed else F.col(c) for c in state.columns]
    )


def merge_round(state: DataFrame, answers: DataFrame, target: str, run: str) -> DataFrame:
    """:func:`merge_answers` for the answers of one round of a run (``id, text, named``); products that were asked
    for and that no answer names are marked with the run in ``silent_in`` and keep their tries."""
    tries = tries_column(state, target)
    updates = answers.select(F.col("id").alias("_id"), F.col("text").alias("_text"), F.col("named").alias("_named"))
    named = F.coalesce("_named", F.lit(False))
    changed = {
        target: F.coalesce(F.when(named, F.col("_text")), F.col(target)),
        tries: F.col(tries) + named.cast("int"),
        "silent_in": F.when(F.col("_named") == F.lit(False), F.lit(run)).otherwise(F.col("silent_in")),
    }
    return state.join(updates, F.col("id") == F.col("_id"), "left").select(
        *[changed[c].alias(c) if c in changed else F.col(c) for c in state.columns]
    )
