"""Answers of a model, taken apart by column expressions.

Labelled answers are cut from the back, see ``operators.labels``: the last label first,
then what precedes its line is searched for the label before it. Each step is a pass over
the text, so a long or hostile answer costs time linear in its length, while one pattern
with a greedy group per label would try every combination of label positions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlift.functions.text import as_column, bind, blank_if_null

NOT_AVAILABLE = "N/A"

# The labels of a title answer, in order.
TITLE_LABELS = {
    "original_keys": "product attribute keys in original title:",
    "category": "product category:",
    "keys": "product attribute keys:",
    "values": "product attribute values:",
    "replaced": "replaced keys:",
    "title": "generated title:",
}

# The labels of a description answer, in order.
DESCRIPTION_LABELS = {
    "description": "description:",
    "score": "score:",
    "reasoning": "reasoning:",
}

_LINE_ENDS = "\n\r\u2028\u2029"


def _first_match(text: Column, pattern: str) -> Column:
    """First group of a pattern, NULL when it does not match."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0))


def after_last(text: Column, label: str) -> Column:
    """Text behind the last ``label`` and its asterisks; NULL without the label."""
    return _first_match(text, rf"(?is)\A.*{label}\**(.*)\z")


def _before_last(text: Column, label: str) -> Column:
    return _first_match(text, rf"(?is)\A(.*){label}")


def lines_before(text: Column, label: str) -> Column:
    """Whole lines that precede the line of the last ``label``; NULL without the label."""
    return F.regexp_extract(_before_last(text, label), rf"(?s)\A(?:.*[{_LINE_ENDS}])?", 0)


def before_line(text: Column, label: str) -> Column:
    """Text up to the line feed in front of the line of the last ``label``; NULL without
    the label or the line feed."""
    return _first_match(_before_last(text, label), r"(?s)\A(.*)\n")


# --- answers of a batch prompt: one line per product -------------------------------


def answer_line(line: Column) -> Column:
    """Struct ``id, text`` of one answer line ``id: text``, the id being what precedes the
    first colon; a line without a colon is a bare id. Anything else has neither."""
    colon = F.locate(":", line)
    pair = (colon > 1) & (F.substring(line, colon + 1, F.lit(1)) == " ")
    return F.struct(
        F.when(pair, F.substring(line, F.lit(1), colon - 1))
        .when((colon == 0) & (line != ""), line)
        .alias("id"),
        F.when(pair, F.substring(line, colon + 2, F.length(line))).alias("text"),
    )


def answer_lines(response: Column | str, ids: Column | str) -> Column:
    """Lines of an answer; a missing answer gives the ids of its prompt as bare lines,
    so that each of them still counts as tried."""
    return F.coalesce(F.split(as_column(response), "\n", -1), as_column(ids))


# --- raw model responses -----------------------------------------------------------

# Finish reasons that mean the answer was withheld.
BLOCKED_REASONS = ("SAFETY", "BLOCKLIST")

BLOCKED_ERROR = "the request was blocked by a safety filter"
EMPTY_ERROR = "the response holds no text"


def _text_or_error(text: Column, error: Column) -> Column:
    return F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error"))


def _at(v: Column, path: str, kind: str = "string") -> Column:
    """A field of a VARIANT, NULL where it is missing, of another kind, or null in the JSON."""
    return F.try_variant_get(v, path, kind)


def _there(v: Column, path: str) -> Column:
    found = F.try_variant_get(v, path, "variant")
    return found.isNotNull() & ~F.is_variant_null(found)


def _pieces(parsed: Column) -> Column:
    """The pieces of a streamed response; one that is not a list is its only piece."""
    return F.coalesce(
        F.try_variant_get(parsed, "$", "array<variant>"),
        F.when(F.schema_of_variant(parsed).startswith("OBJECT"), F.array(parsed)),
    )


def _stream(parsed: Column, raw: Column) -> Column:
    def problem(p: Column) -> Column:
        return (
            F.when(_there(p, "$.error"), F.concat(F.lit("error response: "), raw))
            .when(_at(p, "$.candidates[0].finishReason").isin(*BLOCKED_REASONS), F.lit(BLOCKED_ERROR))
            .when(~_there(p, "$.candidates[0].content.parts[0]"), F.concat(F.lit("malformed response: "), raw))
        )

    def summary(pieces: Column) -> Column:
        problems = F.filter(F.transform(pieces, problem), lambda e: e.isNotNull())
        texts = F.transform(pieces, lambda p: _at(p, "$.candidates[0].content.parts[0].text"))
        text = F.array_join(texts, "", "")
        error = (
            F.when(pieces.isNull(), F.concat(F.lit("malformed response: "), blank_if_null(raw)))
            .when(F.size(problems) > 0, F.get(problems, F.lit(0)))
            .when(text == "", F.concat(F.lit(f"{EMPTY_ERROR}: "), raw))
        )
        return F.struct(text.alias("text"), error.alias("error"))

    return bind(bind(_pieces(parsed), summary), lambda s: _text_or_error(s["text"], s["error"]))


def _prediction(parsed: Column, raw: Column) -> Column:
    content = _at(parsed, "$.predictions[0].content")
    blocked = F.lower(_at(parsed, "$.predictions[0].safetyAttributes.blocked")) == "true"
    error = (
        F.when(~F.coalesce(_there(parsed, "$.predictions[0]"), F.lit(False)), F.concat(F.lit("error response: "), blank_if_null(raw)))
        .when(blocked, F.lit(BLOCKED_ERROR))
        .when(blank_if_null(content) == "", F.lit(EMPTY_ERROR))
    )
    return _text_or_error(content, error)


def stream_response(c: Column | str) -> Column:
    """Struct ``text, error`` of a streamed response: the texts of its pieces joined, or
    the first thing that went wrong. Read as VARIANT, so fields that are not known here stay in the error text."""
    raw = as_column(c)
    return bind(F.try_parse_json(raw), lambda v: _stream(v, raw))


def prediction_response(c: Column | str) -> Column:
    """Struct ``text, error`` of the older response shape."""
    raw = as_column(c)
    return bind(F.try_parse_json(raw), lambda v: _prediction(v, raw))


def model_response(c: Column | str) -> Column:
    """Struct ``text, error`` of a response of either shape, told apart by its fields."""
    raw = as_column(c)
    return bind(F.try_parse_json(raw), lambda v: F.when(_there(v, "$.predictions"), _prediction(v, raw)).otherwise(_stream(v, raw)))


# --- batch predictions -------------------------------------------------------------

def first_candidate_text(response: Column | str) -> Column:
    """First part of the first candidate, or a fixed mark when there is none."""
    first = F.get(as_column(response)["candidates"], F.lit(0))
    return F.coalesce(F.get(first["content"]["parts"], F.lit(0))["text"], F.lit(NOT_AVAILABLE))


def request_id(request: Column | str) -> Column:
    """Id that the request carries in its ``Id: `` part."""
    texts = F.flatten(
        F.transform(
            as_column(request)["contents"],
            lambda c: F.transform(c["parts"], lambda p: p["text"]),
        )
    )
    marked = F.get(F.filter(texts, lambda t: t.startswith("Id: ")), F.lit(0))
    return F.coalesce(F.replace(marked, F.lit("Id: "), F.lit("")), F.lit(NOT_AVAILABLE))
