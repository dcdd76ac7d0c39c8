"""Ordered sets held as arrays: first occurrence decides the place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlift.functions.text import as_column


def difference(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def intersection(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def union(*arrays: Column) -> Column:
    return F.array_distinct(F.flatten(F.array(*arrays)))


def word_set(c: Column | str) -> Column:
    """Distinct plain words (letters, digits, underscore) of a text."""
    return F.array_distinct(F.regexp_extract_all(as_column(c), F.lit(r"[A-Za-z0-9_]+"), F.lit(0)))
