"""Queries of requests, model responses and the single-column job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlift.catalog.feed import RAW, key_of, products, table
from feedlift.catalog.registry import query, with_tables
from feedlift.config import FeedConfig, ModelParams, TitleSettings
from feedlift.functions import prompts
from feedlift.functions.responses import prediction_response, stream_response
from feedlift.operators import review as steps
from feedlift.operators.generation import (
    ExpressionCompleter,
    FunctionCompleter,
    RawCompleter,
    generate_text,
)
from feedlift.plans.enrich import build_requests, enrich_column, parse_predictions
from feedlift.sources.requests import REQUEST_TYPE, RESPONSE_TYPE, request_lines

CONFIG = FeedConfig()
_MEANING = 'the "look" of a product'


def _text(expression: str) -> str:
    return f"{{'text': {expression}}}"


def _request_sql(column: str, language: str, meaning: str | None) -> str:
    prompt = prompts.column_prompt(column, language, meaning).replace("'", "''")
    parts = ", ".join(
        [
            _text(f"'{prompt}'"),
            _text("'Title: ' || title"),
            _text("'Id: ' || id"),
            _text("'Description: ' || description"),
        ]
    )
    return (
        f"{{'contents': [{{'role': 'user', 'parts': [{parts}]}}], "
        "'generationConfig': {'temperature': CAST(0.9 AS DOUBLE)}}"
    )


@query(
    "build_requests",
    with_tables(
        RAW,
        f"SELECT CAST(to_json({{'request': {_request_sql('colour', 'English', _MEANING)}}}) AS VARCHAR) "
        "AS value FROM raw",
    ),
)
def build_requests_query(spark: SparkSession, folder: str) -> DataFrame:
    requests = build_requests(products(spark, folder), CONFIG, "colour", "English", _MEANING)
    return request_lines(requests, F.col("request"))


# A stand-in for a batch service reads the title out of the request and answers with its
# first word; every ninth product gets no candidates, the one after it empty parts.
def column_model(request: Column) -> Column:
    texts = F.from_json(request, REQUEST_TYPE)["contents"][0]["parts"]["text"]
    k = F.replace(texts[2], F.lit("Id: "), F.lit("")).cast("bigint")
    word = F.substring_index(F.replace(texts[1], F.lit("Title: "), F.lit("")), " ", 1)
    some = F.array(F.struct(word.alias("text")))
    parts = F.when(k % 9 == 1, F.slice(some, 1, 0)).otherwise(some)
    candidate = F.struct(F.struct(parts.alias("parts")).alias("content"))
    candidates = F.when(k % 9 == 0, F.slice(F.array(candidate), 1, 0)).otherwise(
        F.array(candidate)
    )
    return F.to_json(F.struct(candidates.alias("candidates")))


_VALUE = "CASE WHEN k % 9 < 2 THEN 'N/A' ELSE split_part(title, ' ', 1) END"


@query("parse_predictions", with_tables(RAW, f"SELECT id, {_VALUE} AS colour FROM raw"))
def parse_predictions_query(spark: SparkSession, folder: str) -> DataFrame:
    requests = build_requests(products(spark, folder), CONFIG, "colour", "English")
    lines = requests.select(F.to_json("request").alias("request"))
    answered = lines.select(
        F.from_json("request", REQUEST_TYPE).alias("request"),
        F.from_json(column_model(F.col("request")), RESPONSE_TYPE).alias("response"),
    )
    return parse_predictions(answered, "colour")


@query("enrich_column", with_tables(RAW, f"SELECT id, title, category, {_VALUE} AS colour FROM raw"))
def enrich_column_query(spark: SparkSession, folder: str) -> DataFrame:
    feed = products(spark, folder).select("id", "title", "description", "category")
    return enrich_column(
        feed, CONFIG, "colour", "English", ExpressionCompleter(column_model)
    ).drop("description")


@query(
    "enrich_column_fill",
    with_tables(RAW, f"SELECT id, CASE WHEN size <> '' THEN size ELSE {_VALUE} END AS size FROM raw"),
)
def enrich_column_fill(spark: SparkSession, folder: str) -> DataFrame:
    """An existing column keeps its values; only its gaps are filled."""
    feed = products(spark, folder).select("id", "title", "description", "size")
    enriched = enrich_column(feed, CONFIG, "size", "English", ExpressionCompleter(column_model))
    return enriched.select("id", "size")


_STREAM = """stream AS (
  SELECT id, k, title, CAST(CASE k % 6
    WHEN 0 THEN to_json([{'error': {'code': 429, 'message': title}}])
    WHEN 1 THEN to_json([{'candidates': [{'finishReason': 'SAFETY'}]}])
    WHEN 2 THEN to_json([{'candidates': [{'content': {'parts': [{'text': ''}]}}]}])
    ELSE to_json([{'candidates': [{'content': {'parts': [{'text': title}]}}]},
      {'candidates': [{'content': {'parts': [{'text': ' by ' || brand}]}}]}]) END AS VARCHAR) AS raw_text
  FROM raw)"""


@query(
    "response_text",
    with_tables(
        RAW,
        _STREAM,
        "SELECT id, CASE WHEN k % 6 > 2 THEN title || ' by ' || (SELECT brand FROM raw r WHERE r.id = s.id) "
        "END AS text, CASE k % 6 WHEN 0 THEN 'error response: ' || raw_text "
        "WHEN 1 THEN 'the request was blocked by a safety filter' "
        "WHEN 2 THEN 'the response holds no text: ' || raw_text END AS error FROM stream s",
    ),
)
def response_text(spark: SparkSession, folder: str) -> DataFrame:
    """Texts and failures of streamed model responses."""
    kind = key_of("id") % 6

    def piece(text: Column) -> Column:
        parts = F.array(F.struct(text.alias("text")))
        content = F.struct(parts.alias("parts"))
        return F.struct(F.array(F.struct(content.alias("content"))).alias("candidates"))

    error = F.struct(F.lit(429).alias("code"), F.col("title").alias("message"))
    blocked = F.struct(F.array(F.struct(F.lit("SAFETY").alias("finishReason"))).alias("candidates"))
    raw = (
        F.when(kind == 0, F.to_json(F.array(F.struct(error.alias("error")))))
        .when(kind == 1, F.to_json(F.array(blocked)))
        .when(kind == 2, F.to_json(F.array(piece(F.lit("")))))
        .otherwise(
            F.to_json(F.array(piece(F.col("title")), piece(F.concat(F.lit(" by "), "brand"))))
        )
    )
    rows = products(spark, folder).select("id", raw.alias("raw"))
    return rows.select("id", stream_response("raw").alias("r")).select("id", "r.text", "r.error")


@query(
    "prediction_text",
    with_tables(
        RAW,
        "SELECT id, CASE WHEN k % 4 > 1 THEN description END AS text, CASE k % 4 "
        "WHEN 0 THEN 'error response: {\"error\":\"quota\"}' "
        "WHEN 1 THEN 'the request was blocked by a safety filter' END AS error FROM raw",
    ),
)
def prediction_text(spark: SparkSession, folder: str) -> DataFrame:
    """The older response shape."""
    kind = key_of("id") % 4
    safety = F.struct((kind == 1).alias("blocked"))
    prediction = F.struct(
        F.col("description").alias("content"), safety.alias("safetyAttributes")
    )
    raw = F.when(kind == 0, F.lit('{"error":"quota"}')).otherwise(
        F.to_json(F.struct(F.array(prediction).alias("predictions")))
    )
    rows = products(spark, folder).select("id", raw.alias("raw"))
    return rows.select("id", prediction_response("raw").alias("r")).select(
        "id", "r.text", "r.error"
    )


def _multimodal_sql(prompt: str, image_part: str, config: str) -> str:
    safety = ",".join(
        f'{{"category":"{c}","threshold":{prompts.BLOCK_ONLY_HIGH}}}'
        for c in prompts.SAFETY_CATEGORIES
    )
    return (
        "'{\"contents\":{\"role\":\"user\",\"parts\":[' || CAST(to_json({'text': "
        + prompt
        + "}) AS VARCHAR) || "
        + image_part
        + " || ']},\"generationConfig\":"
        + config
        + ',"safetySettings":['
        + safety
        + "]}'"
    )


@query(
    "multimodal_requests",
    with_tables(
        RAW,
        "SELECT id, "
        + _multimodal_sql(
            "'Look at ' || title",
            "CASE k % 3 WHEN 0 THEN ',{\"fileData\":{\"mimeType\":\"image/png\",\"fileUri\":\"gs://b/' || id "
            "|| '.png\"}}' WHEN 1 THEN ',{\"inlineData\":{\"mimeType\":\"image/jpeg\",\"data\":\"' "
            "|| to_base64(encode(title)) || '\"}}' ELSE '' END",
            '{"temperature":0.4,"maxOutputTokens":256,"topK":40,"topP":0.5}',
        )
        + " AS request FROM raw",
    ),
)
def multimodal_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Stored images by their URI, web images inline, unreadable ones left out."""
    kind = key_of("id") % 3
    uri = F.concat(
        F.when(kind == 0, "gs://b/").otherwise("https://img/"), F.col("id"), F.lit(".png")
    )
    content = F.when(kind == 1, F.col("title").cast("binary"))
    request = prompts.multimodal_request(
        F.concat(F.lit("Look at "), "title"),
        ModelParams(temperature=0.4, max_output_tokens=256, top_k=40, top_p=0.5),
        uri,
        F.lit("image/jpeg"),
        content,
    )
    return products(spark, folder).select("id", request.alias("request"))


@query(
    "title_requests_with_images",
    with_tables(
        RAW,
        "SELECT id, md5("
        + _multimodal_sql(
            "'Write a title.' || chr(10) || 'Context: ' || CAST(to_json({'id': id, 'title': title, "
            "'description': description, 'image_link': image_link}) AS VARCHAR) || chr(10) || chr(10)",
            "',{\"inlineData\":{\"mimeType\":\"image/png\",\"data\":\"' || to_base64(encode(title)) || '\"}}'",
            '{"temperature":0.1,"maxOutputTokens":2048}',
        )
        + ") AS request_hash FROM raw",
    ),
)
def title_requests_with_images(spark: SparkSession, folder: str) -> DataFrame:
    """Title requests of a review that sends the product images along."""
    cfg = FeedConfig(use_images=True, title=TitleSettings(prompt="Write a title.\n"))
    feed = products(spark, folder).select("id", "title", "description", "image_link")
    files = feed.select(
        F.col("image_link").alias("uri"),
        F.lit("image/png").alias("mime_type"),
        F.col("title").cast("binary").alias("content"),
    )
    rows = steps.add_title_prompt(steps.join_images(steps.feed_rows(feed, cfg), files), cfg)
    return rows.select(F.col("item_id").alias("id"), F.md5("title_prompt").alias("request_hash"))


@query(
    "raw_completions",
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 THEN p_name || '!' END AS response, "
    "CASE WHEN p_partkey % 3 = 0 THEN 'the request was blocked by a safety filter' END AS error FROM part",
)
def raw_completions(spark: SparkSession, folder: str) -> DataFrame:
    """A completer that hands out raw responses."""
    blocked = '[{"candidates":[{"finishReason":"BLOCKLIST"}]}]'
    text = F.concat(
        F.lit('[{"candidates":[{"content":{"parts":[{"text":"'),
        "prompt",
        F.lit('"}]}}]},{"candidates":[{"content":{"parts":[{"text":"!"}]},"finishReason":"STOP"}]}]'),
    )
    model = ExpressionCompleter(
        lambda prompt: F.when(F.col("id") % 3 == 0, F.lit(blocked)).otherwise(text)
    )
    asked = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("prompt")
    )
    return generate_text(asked, RawCompleter(model, stream_response)).drop("prompt")


def shouting_model(texts: list[str], params: ModelParams) -> list[str | None]:
    """A stand-in for a remote model: refuses texts without an "o", fails on a blue product."""
    if any("blue" in t for t in texts):
        raise RuntimeError("no quota")
    return [t.upper() if "o" in t else None for t in texts]


@query(
    "function_completions",
    "SELECT p_partkey AS id, CASE WHEN p_name NOT LIKE '%blue%' AND p_name LIKE '%o%' "
    "THEN upper(p_name) END AS response, CASE WHEN p_name LIKE '%blue%' "
    "THEN 'RuntimeError: no quota' END AS error FROM part",
)
def function_completions(spark: SparkSession, folder: str) -> DataFrame:
    """A Python model in Arrow batches: answers, refusals and failures after three attempts."""
    asked = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("prompt")
    )
    completer = FunctionCompleter(
        shouting_model, concurrency=4, partitions=spark.sparkContext.defaultParallelism
    )
    return generate_text(asked, completer).drop("prompt")
