from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from feedlift.functions import responses as r
from feedlift.operators.labels import with_description_answer, with_title_answer

TITLE = list(r.TITLE_LABELS)
LABELS = r.TITLE_LABELS


def title_pattern(names):
    """The answer format as one pattern: each label on a later line than the one before."""
    parts = [rf"^.*{LABELS[n]}\**(?P<{n}>.*)" for n in names]
    return re.compile("".join(parts) + "$", re.I | re.M | re.S)


FULL = title_pattern(TITLE)
SHORT = title_pattern([n for n in TITLE if n != "replaced"])
DESCRIPTION = re.compile(
    r".*description:\**(.*)\n+.*score:\**(.*)\n+.*reasoning:\**(.*)", re.I | re.M | re.S
)


def test_title_answers_equal_one_pattern(spark):
    """Random mixtures of labels, line ends and noise."""
    rng = random.Random(5)
    pieces = [v.title() if rng.random() < 0.5 else v for v in LABELS.values()]
    noise = ["\n", "\n", "\n", " a | b ", "**", "x", "", "\n\n", " ", "é"]
    texts = []
    for _ in range(1500):
        order = list(pieces)
        if rng.random() < 0.5:
            rng.shuffle(order)
        if rng.random() < 0.5:
            order.remove(rng.choice(order))
        if rng.random() < 0.3:
            order.insert(rng.randrange(len(order)), rng.choice(pieces))
        text = "".join(
            "".join(rng.choices(noise, k=rng.randrange(3))) + label + rng.choice(["\n", " v\n", "**v", ""])
            for label in order
        )
        texts.append(text)
    # The usual form as well, in all decorations.
    for _ in range(500):
        bold = rng.choice(["", "**"])
        texts.append(
            "\n".join(
                f"{rng.choice(['', '- ', bold])}{label}{bold} v{i}"
                for i, label in enumerate(pieces)
                if rng.random() < 0.95
            )
        )
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    found = with_title_answer(df, "x").collect()
    matched = 0
    for row in found:
        m = FULL.match(texts[row.i]) or SHORT.match(texts[row.i])
        want = m and {"replaced": None, **m.groupdict()}
        got = {n: row[f"answer_{n}"] for n in TITLE} if row.answered else None
        assert got == (want or None), texts[row.i]
        matched += want is not None
    assert 300 < matched < 1900


def test_description_answers_equal_one_pattern(spark):
    rng = random.Random(6)
    pieces = ["Description:", "score:", "Reasoning:**"]
    texts = []
    for _ in range(1500):
        order = list(pieces)
        if rng.random() < 0.2:
            order.insert(rng.randrange(3), rng.choice(pieces))
        texts.append(
            "".join(
                rng.choice(["", "x ", "**"]) + label + rng.choice([" 0.5", " t", ""])
                + rng.choice(["\n", "\n\n", "\n", " ", "\n \n"])
                for label in order
            )
        )
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    matched = 0
    for row in with_description_answer(df, "x").collect():
        m = DESCRIPTION.match(texts[row.i])
        assert row.answered == bool(m)
        if not m:
            assert row.answer_description is None
            continue
        matched += 1
        assert row.answer_description == m[1].strip()
        assert row.answer_reasoning == m[3].strip()
        number = re.match(r"[0-9.]+", m[2].strip())
        score = row.answer_score
        assert score == float(number[0]) if number else math.isnan(score)
    assert 300 < matched < 1450


def test_repeated_labels_take_linear_time(spark):
    """A pattern with a greedy group per label would try all combinations of lines here."""
    block = "".join(f"{label} v\n" for label in list(LABELS.values())[:-1])
    df = spark.createDataFrame([(block * 2000,)], "x string")
    assert not with_title_answer(df, "x").first().answered


@pytest.mark.parametrize(
    ("line", "parsed"),
    [
        ("12: a title", ("12", "a title")),
        ("12: a: b", ("12", "a: b")),
        ("12: a\r", ("12", "a\r")),
        ("12: ", ("12", "")),
        ("12", ("12", None)),
        ("12:no blank", (None, None)),
        (": no id", (None, None)),
        ("", (None, None)),
    ],
)
def test_answer_line(value, line, parsed):
    assert tuple(value(r.answer_line(F.lit(line)))) == parsed


def test_missing_answer_gives_the_ids(value):
    ids = F.array(F.lit("1"), F.lit("2"))
    assert value(r.answer_lines(F.lit(None).cast("string"), ids)) == ["1", "2"]
    assert value(r.answer_lines(F.lit("a\n\n"), ids)) == ["a", "", ""]


STREAM = '[{"candidates":[{"content":{"parts":[{"text":"%s"}]}}]}]'


@pytest.mark.parametrize(
    ("raw", "text", "error"),
    [
        (STREAM % "a", "a", None),
        (STREAM[:-1] % "a" + "," + (STREAM % "b")[1:], "ab", None),
        ('[{"error":{"code":429}}]', None, "error response"),
        ('[{"candidates":[{"finishReason":"SAFETY"}]}]', None, "blocked"),
        ('[{"candidates":[{"finishReason":"BLOCKLIST"}]}]', None, "blocked"),
        (STREAM % "", None, "no text"),
        ("[{}]", None, "malformed"),
        ("nope", None, "malformed"),
        (None, None, "malformed"),
    ],
)
def test_stream_response(value, raw, text, error):
    found = value(r.stream_response(F.lit(raw).cast("string")))
    assert found.text == text
    assert (error in found.error) if error else found.error is None


@pytest.mark.parametrize(
    ("raw", "text", "error"),
    [
        (STREAM % "a", "a", None),
        ((STREAM % "a")[1:-1], "a", None),  # a single piece
        ('[{"error":{"code":429,"new field":[1]}}]', None, 'error response: [{"error":{"code":429,"new field":[1]}}]'),
        ('[{"error":null,"candidates":[{"content":{"parts":[{"text":"b","more":{"x":1}}]}}]}]', "b", None),
        ('{"predictions":[{"content":"c","safetyAttributes":{"blocked":false,"scores":[0.1]}}],"meta":1}', "c", None),
        ('{"predictions":[{"content":"c","safetyAttributes":{"blocked":true}}]}', None, r.BLOCKED_ERROR),
        ('{"predictions":[{"content":""}]}', None, r.EMPTY_ERROR),
        ('{"predictions":[]}', None, 'error response: {"predictions":[]}'),
        ('{"quota":0}', None, 'malformed response: {"quota":0}'),
        ("[]", None, "the response holds no text: []"),
        ("nope", None, "malformed response: nope"),
        (None, None, "malformed response: "),
    ],
)
def test_responses_of_either_shape(value, raw, text, error):
    found = value(r.model_response(F.lit(raw).cast("string")))
    assert (found.text, found.error) == (text, error)


def test_prediction_fields(spark):
    from feedlift.sources.requests import PREDICTION_SCHEMA

    lines = [
        '{"request":{"contents":[{"parts":[{"text":"p"},{"text":"Id: 7"}]}]},'
        '"response":{"candidates":[{"content":{"parts":[{"text":"red"}]}}]}}',
        '{"request":{"contents":[{"parts":[{"text":"p"}]}]},"response":{"candidates":[]}}',
        '{"request":{"contents":[]},"response":{"candidates":[{"content":{"parts":[]}}]}}',
    ]
    df = spark.createDataFrame([(x,) for x in lines], "x string").select(
        F.from_json("x", PREDICTION_SCHEMA).alias("p")
    )
    found = df.select(
        r.request_id(F.col("p.request")), r.first_candidate_text(F.col("p.response"))
    ).collect()
    assert [tuple(x) for x in found] == [("7", "red"), ("N/A", "N/A"), ("N/A", "N/A")]
