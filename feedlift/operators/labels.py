"""Labelled answers, taken apart label by label.

One projection per label: the text left for the earlier labels is a column that the next
projection uses twice, so it is computed once, and all of it stays generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlift.functions import responses as r
from feedlift.functions.text import parse_number, trim_ws

_INNER_TITLE_LABELS = {
    k: v for k, v in r.TITLE_LABELS.items() if k not in ("replaced", "title")
}


def _cut(
    df: DataFrame,
    text: str,
    labels: dict[str, str],
    prefix: str,
    head: Callable[[Column, str], Column],
) -> DataFrame:
    """Adds ``prefix + name`` for each label, from the last to the first, and
    ``prefix + name + "_head"``, the text left before it. A missing label leaves NULL for
    all labels before it."""
    for name in reversed(labels):
        df = df.select(
            "*",
            r.after_last(F.col(text), labels[name]).alias(f"{prefix}{name}"),
            head(F.col(text), labels[name]).alias(f"{prefix}{name}_head"),
        )
        text = f"{prefix}{name}_head"
    return df


def with_title_answer(df: DataFrame, response: str) -> DataFrame:
    """Adds ``answer_<label>`` for the labels of a title answer and ``answered``, whether
    the answer is complete. Each label has to stand on an earlier line than the next.
    ``answer_replaced`` is NULL when that label is missing or out of order; the others then
    are looked for without it."""
    labels = r.TITLE_LABELS
    first = next(iter(_INNER_TITLE_LABELS))

    def cut(rows: DataFrame, text: str, wanted: dict[str, str], prefix: str) -> DataFrame:
        return _cut(rows, text, wanted, prefix, r.lines_before)

    out = cut(df, response, {k: labels[k] for k in ("replaced", "title")}, "_end_")
    out = cut(out, "_end_replaced_head", _INNER_TITLE_LABELS, "_full_")
    # Only rows without a full answer are searched once more.
    full = F.col(f"_full_{first}").isNotNull()
    out = out.withColumn("_short_text", F.when(~full, F.col("_end_title_head")))
    out = cut(out, "_short_text", _INNER_TITLE_LABELS, "_short_")
    short = F.col(f"_short_{first}").isNotNull()

    def field(name: str) -> Column:
        return F.when(full, F.col(f"_full_{name}")).when(short, F.col(f"_short_{name}"))

    return out.select(
        *[F.col(c) for c in df.columns],
        (full | short).alias("answered"),
        *[field(name).alias(f"answer_{name}") for name in _INNER_TITLE_LABELS],
        F.when(full, F.col("_end_replaced")).alias("answer_replaced"),
        F.when(full | short, F.col("_end_title")).alias("answer_title"),
    )


def with_description_answer(df: DataFrame, response: str) -> DataFrame:
    """Adds ``answered``, ``answer_description``, ``answer_score`` (NaN when it is no number)
    and ``answer_reasoning``. Score and reasoning start on lines of their own."""
    labels = r.DESCRIPTION_LABELS
    later = {k: labels[k] for k in ("score", "reasoning")}
    out = _cut(df, response, later, "_", r.before_line)
    text = r.after_last(F.col("_score_head"), labels["description"])
    out = out.withColumn("_description", text)
    answered = F.col("_description").isNotNull()
    return out.select(
        *[F.col(c) for c in df.columns],
        answered.alias("answered"),
        F.when(answered, trim_ws("_description")).alias("answer_description"),
        F.when(answered, parse_number(trim_ws("_score"))).alias("answer_score"),
        F.when(answered, trim_ws("_reasoning")).alias("answer_reasoning"),
    )
