"""Row rules for generated titles and descriptions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlift.config import DESCRIPTION_MAX_LENGTH, TITLE_MAX_LENGTH, Status
from feedlift.functions.sets import difference, union
from feedlift.functions.text import (
    as_column,
    bind,
    blank_if_null,
    lower_each,
    trim_ws,
    utf16_length,
    words,
)

# Attributes whose words may be used in a title.
FEATURE_ATTRIBUTES = ("Image Features", "Website Features")

NOT_EVALUATED = "No Evaluation"


def real_value(key: Column, value: Column, *, strip_comma: bool = False) -> Column:
    """'' for a value that only repeats its key or is a lone comma."""

    def unless_echo(text: Column) -> Column:
        shorter = F.regexp_replace(text, r",\z", "")
        name = F.lower(key)
        echo = (name == F.lower(text)) | (name == F.lower(trim_ws(shorter)))
        kept = shorter if strip_comma else text
        return F.when(echo | (text == ","), F.lit("")).otherwise(kept)

    return bind(trim_ws(value), unless_echo)


def attribute_facts(
    keys: Column,
    values: Column,
    original_keys: Column,
    replaced_keys: Column,
    row: Column,
    *,
    prefer_generated: bool,
) -> Column:
    """For each generated attribute, in order: its name, the value it adds as a gap (NULL
    when it fills none) and the value it puts into the title (NULL when it has none).

    A gap is an attribute the feed leaves empty while the answer has a value, provided it
    is new to the title or a feed column; a replaced key counts as well.
    """

    def fact(given: Column, attribute: Column, index: Column) -> Column:
        generated = F.get(given["values"], index)
        fed = blank_if_null(F.try_element_at(given["row"], attribute))
        new_or_column = ~F.array_contains(given["original"], attribute) | F.map_contains_key(
            given["row"], attribute
        )
        replaced = F.array_contains(given["replaced"], F.lower(attribute))
        is_gap = ((fed == "") & (blank_if_null(generated) != "") & new_or_column) | replaced
        gap = trim_ws(real_value(attribute, generated, strip_comma=True))
        chosen = generated if prefer_generated else F.when(fed != "", fed).otherwise(generated)
        used = trim_ws(real_value(attribute, chosen))
        return F.struct(
            attribute.alias("name"),
            F.when(is_gap & (gap != ""), gap).alias("gap"),
            F.when((trim_ws(chosen) != "") & (used != ""), used).alias("used"),
        )

    inputs = F.struct(
        values.alias("values"),
        original_keys.alias("original"),
        replaced_keys.alias("replaced"),
        row.alias("row"),
    )
    return bind(
        inputs, lambda given: F.transform(keys, lambda a, i: fact(given, a, i))
    )


def gap_attributes(facts: Column) -> Column:
    """Map of filled gaps: order of first mention, value of the last one."""

    def as_map(filled: Column) -> Column:
        names = F.array_distinct(F.transform(filled, lambda f: f["name"]))
        return F.map_from_arrays(
            names,
            F.transform(
                names,
                lambda n: F.element_at(F.filter(filled, lambda f: f["name"] == n), -1)["gap"],
            ),
        )

    return bind(F.filter(facts, lambda f: f["gap"].isNotNull()), as_map)


def used_facts(facts: Column) -> Column:
    return F.filter(facts, lambda f: f["used"].isNotNull())


def composed_title(used: Column) -> Column:
    """Used values joined by spaces, without one trailing comma."""
    return F.regexp_replace(F.array_join(F.transform(used, lambda f: f["used"]), " "), r",\z", "")


def feature_words(used: Column) -> Column:
    """Words of the attributes that describe image or page."""
    features = F.filter(used, lambda f: f["name"].isin(*FEATURE_ATTRIBUTES))
    return lower_each(F.flatten(F.transform(features, lambda f: words(f["used"]))))


def without_possessive(c: Column) -> Column:
    return F.replace(c, F.lit("'s"), F.lit(""))


def row_words(row: Column) -> Column:
    """Lower-case words of all column names and values of a row map."""
    texts = F.transform(
        F.map_entries(row), lambda e: F.concat_ws(" ", e["key"], without_possessive(e["value"]))
    )
    return lower_each(words(F.array_join(texts, " ")))


def vocabulary(row: Column, allowed: list[str], extra: Column) -> Column:
    """Words a new title may use without being penalised."""
    permitted = F.array(*[F.lit(w) for w in allowed]).cast("array<string>")
    return union(row_words(row), permitted, extra)


def new_words(title: Column, known: Column) -> Column:
    """Title words outside the vocabulary, in their own case, first mention first."""

    def unknown(found: Column) -> Column:
        return bind(
            difference(lower_each(found), known),
            lambda strange: F.filter(found, lambda w: F.array_contains(strange, F.lower(w))),
        )

    return bind(F.array_distinct(words(without_possessive(title))), unknown)


def removed_words(original: Column, title: Column) -> Column:
    """Words of the old title that the new one lacks. A word that is part of the new
    title, in the same case and apart from apostrophes, is not missing."""
    kept = F.struct(
        lower_each(words(without_possessive(title))).alias("words"),
        F.replace(title, F.lit("'"), F.lit("")).alias("text"),
    )
    found = F.array_distinct(words(without_possessive(original)))
    return bind(
        kept,
        lambda k: F.filter(
            found,
            lambda w: ~F.array_contains(k["words"], F.lower(w)) & ~F.contains(k["text"], w),
        ),
    )


def title_score(new: Column, removed: Column, fills_gap: Column, adds_attribute: Column) -> Column:
    half = F.lit(0.5)
    return (
        F.when(new, F.lit(-1.0))
        .when(removed, F.lit(-0.5))
        .otherwise(F.when(fills_gap, half).otherwise(0.0) + F.when(adds_attribute, half).otherwise(0.0))
    )


def any_name(names: Column) -> Column:
    return F.exists(names, lambda n: n != "")


def compliance_status(title: Column | str, description: Column | str) -> Column:
    fits = utf16_length(title).between(1, TITLE_MAX_LENGTH) & utf16_length(description).between(
        1, DESCRIPTION_MAX_LENGTH
    )
    return F.when(fits, F.lit(Status.SUCCESS)).otherwise(Status.NON_COMPLIANT)


def reaches(score: Column | str, threshold: float) -> Column:
    """``score >= threshold`` where NaN on either side fails; Spark alone ranks NaN first."""
    if math.isnan(threshold):
        return F.lit(False)
    score = as_column(score)
    return ~F.isnan(score) & (score >= F.lit(threshold))


# Fixed value: the mark of generated text in a shopping feed.
GENERATED_MARK = "trained_algorithmic_media"


def feed_text(value: Column | str, generated: Column | bool) -> Column:
    """``mark:"text"`` with quotes doubled, the mark only for generated text."""
    generated = F.lit(generated) if isinstance(generated, bool) else generated
    mark = F.when(generated, F.lit(GENERATED_MARK)).otherwise("")
    quoted = F.replace(as_column(value), F.lit('"'), F.lit('""'))
    return F.concat(mark, F.lit(':"'), quoted, F.lit('"'))
