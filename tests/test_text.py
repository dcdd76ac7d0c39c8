from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from feedlift.functions import rows, sets
from feedlift.functions import text as t
from feedlift.functions.vectors import cosine_distance


def lit(v):
    return F.lit(v).cast("string")


@pytest.mark.parametrize(
    ("given", "trimmed"),
    [(" a\n", "a"), (" ﻿a b　\r", "a b"), ("", ""), (" \t", ""), (None, None)],
)
def test_trim_takes_all_white_space(value, given, trimmed):
    assert value(t.trim_ws(lit(given))) == trimmed


@pytest.mark.parametrize(
    ("given", "number"),
    [
        ("0.8", 0.8),
        ("0.8/1", 0.8),
        (" -1.5e2x", -150.0),
        ("1.", 1.0),
        (".5", 0.5),
        ("1e", 1.0),
        ("Infinity", math.inf),
        ("high", math.nan),
        ("", math.nan),
        ("-", math.nan),
    ],
)
def test_number_at_the_start_of_a_text(value, given, number):
    found = value(t.parse_number(lit(given)))
    assert found == number or (math.isnan(found) and math.isnan(number))


@pytest.mark.parametrize(
    ("number", "shown"),
    [(0.8, "0.8"), (-1.0, "-1"), (0.0, "0"), (0.0001, "0.0001"), (math.nan, "NaN")],
)
def test_numbers_are_shown_plainly(value, number, shown):
    assert value(t.show_number(F.lit(number))) == shown


def test_length_counts_utf16_units(value):
    assert value(t.utf16_length(lit("a\U0001f600é"))) == 4


def test_empty_list_parts_go_before_the_trim(value):
    assert value(t.tokens(lit("a||b| |c "), r"\|")) == ["a", "b", "", "c"]


def test_words(value):
    assert value(t.words(lit("Größe: 10×5cm, men's"))) == ["Größe", "10", "5cm", "men", "s"]


def test_base_name(value):
    assert value(t.base_name(lit("gs://b/images/1.png"))) == "1.png"
    assert value(t.base_name(lit("1.png"))) is None


def test_extract_gives_null_without_a_match(value):
    assert value(t.extract_or_null(lit("a1"), "b([0-9])")) is None
    assert value(t.extract_or_null(lit("b: "), "b: (.*)")) == ""


def test_parts_cover_all_ids_once(spark):
    ids = spark.range(5000).select(F.col("id").cast("string"))
    parts = ids.groupBy(t.id_part("id", 7).alias("p")).count().collect()
    assert sorted(r.p for r in parts) == list(range(7))
    assert min(r["count"] for r in parts) > 5000 / 7 / 2


def test_ordered_sets(value):
    a = F.array(*map(F.lit, "cabca"))
    b = F.array(*map(F.lit, "ad"))
    assert value(sets.difference(a, b)) == ["c", "b"]
    assert value(sets.intersection(a, b)) == ["a"]
    assert value(sets.union(b, a)) == ["a", "d", "c", "b"]
    assert value(sets.word_set(lit("the_cat the dog the"))) == ["the_cat", "the", "dog"]


def test_row_json(spark):
    df = spark.createDataFrame([("1", None, 'a"b', 3)], "id string, x string, `t t` string, n int")
    found = df.select(
        rows.row_properties(df.columns).alias("p"),
        rows.row_properties(df.columns, include_id=False).alias("q"),
        rows.row_context(df.columns).alias("c"),
        rows.row_context(df.columns, {"x": F.lit(""), "new": F.lit("n")}).alias("f"),
        rows.row_map(df.columns).alias("m"),
    ).first()
    assert found.p == '{"id":"1","x":null,"t t":"a\\"b","n":3}'
    assert found.q == '{"x":null,"t t":"a\\"b","n":3}'
    assert found.c == '{"id":"1","x":"","t t":"a\\"b","n":"3"}'
    assert found.f == '{"x":"","new":"n","id":"1","t t":"a\\"b","n":"3"}'
    assert found.m == {"id": "1", "x": "", "t t": 'a"b', "n": "3"}


def test_any_column_name(spark):
    df = spark.createDataFrame([("x",)], "`a.b``c d` string")
    assert df.select(rows.row_properties(df.columns).alias("p")).first().p == '{"a.b`c d":"x"}'


def test_cosine_distance(value):
    def vector(*xs):
        return F.array(*[F.lit(float(x)) for x in xs])

    assert value(cosine_distance(vector(1, 0), vector(0, 2))) == 1.0
    assert value(cosine_distance(vector(1, 1), vector(2, 2))) == pytest.approx(0.0)
    assert value(cosine_distance(vector(0, 0), vector(1, 1))) is None
    assert value(cosine_distance(vector(1), vector(1, 1))) is None


def test_bind_evaluates_once(value):
    assert value(t.bind(F.lit(3), lambda x: x * x + x)) == 12


def test_cosine_distances_of_many_rows(spark):
    rng = random.Random(2)
    vector = lambda n: [rng.uniform(-1, 1) for _ in range(n)]
    rows = [(vector(n), vector(n)) for n in (1, 3, 64, 65, 3, 1) for _ in range(9)]
    rows += [([], []), (None, [1.0]), ([1.0, None], [1.0, 1.0]), ([0.0], [1.0]), ([1.0], [1.0, 2.0]), ([float("nan")], [1.0]), ([3.0, 4.0], [3.0, 4.0])]
    got = [r.d for r in spark.createDataFrame(rows, "a array<double>, b array<double>").coalesce(1).select(cosine_distance("a", "b").alias("d")).collect()]
    for (a, b), d in zip(rows[:54], got, strict=False):
        dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
        assert d == pytest.approx(1 - dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)), abs=1e-12)
    assert got[54:59] == [None] * 5 and math.isnan(got[59]) and got[60] == 0.0
