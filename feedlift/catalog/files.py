"""Queries that write the feed in one of its file formats and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlift.catalog.column import CONFIG, column_model
from feedlift.catalog.feed import (
    FILTERED_COLUMNS,
    FILTERED_SQL,
    RAW,
    STATE,
    filtered,
    products,
    state,
    table,
)
from feedlift.catalog.registry import query, with_tables
from feedlift.functions import prompts
from feedlift.functions.responses import request_id
from feedlift.operators.export import supplemental_feed
from feedlift.operators.generation import ExpressionCompleter, describe_images
from feedlift.operators.pages import page_div_texts
from feedlift.plans.enrich import build_requests, collect_batch, parse_predictions, write_batch
from feedlift.session import new_path
from feedlift.sources import feeds, requests
from feedlift.sources.tables import VersionedTable


@query(
    "csv_feed",
    with_tables(
        RAW,
        "SELECT id, title || ', \"' || category || '\"' || chr(10) || 'second line' AS title, "
        "NULLIF(brand, '') AS brand FROM raw",
    ),
)
def csv_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Cells with commas, quotes and line breaks."""
    path = new_path(spark, "feed-csv")
    title = F.concat("title", F.lit(', "'), "category", F.lit('"\nsecond line'))
    feeds.write_csv(
        products(spark, folder).select(
            "id", title.alias("title"), F.nullif("brand", F.lit("")).alias("brand")
        ),
        path,
    )
    return feeds.read_feed_csv(spark, path, ["id", "title"], multi_line=True)


@query(
    "tsv_feed",
    with_tables(
        RAW,
        STATE,
        "SELECT id, 'trained_algorithmic_media:\"' || replace(title, '\"', '\"\"') || '\"' AS structured_title, "
        "'trained_algorithmic_media:\"' || description || '\"' AS structured_description "
        "FROM state WHERE title IS NOT NULL AND description IS NOT NULL",
    ),
)
def tsv_feed(spark: SparkSession, folder: str) -> DataFrame:
    """A supplemental feed keeps its own quotes."""
    path = new_path(spark, "feed-tsv")
    feeds.write_tsv(supplemental_feed(state(spark, folder)), path)
    return feeds.read_tsv(spark, path)


@query(
    "page_text_file",
    "SELECT CAST(page_id AS VARCHAR) AS id, NULLIF(replace(replace(array_to_string("
    "regexp_extract_all(html, '<div class=\"ad\">([^<]*)</div>', 1), ' '), chr(10), ' '), chr(13), ''), '') "
    "AS content FROM pages",
)
def page_text_file(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "page-texts")
    feeds.write_page_texts(page_div_texts(table(spark, folder, "pages"), "ad", "page_id"), path)
    texts = feeds.read_page_texts(spark, path)
    return texts.select("id", F.nullif("content", F.lit("")).alias("content"))


@query("feed_position", "SELECT p_partkey, p_partkey AS feed_pos FROM part")
def feed_position(spark: SparkSession, folder: str) -> DataFrame:
    """The parts are stored in the order of their keys."""
    return feeds.with_feed_position(table(spark, folder, "part").select("p_partkey"))


@query(
    "versioned_state",
    with_tables(
        RAW,
        STATE,
        "SELECT id, title, description, CAST(tries + 2 AS INTEGER) AS tries, 3 AS version FROM state",
    ),
)
def versioned_state(spark: SparkSession, folder: str) -> DataFrame:
    """Two updates of a table from its own rows."""
    versions = VersionedTable(spark, new_path(spark, "state"))
    rows = versions.write(state(spark, folder))
    for _ in range(2):
        rows = versions.write(rows.withColumn("tries", F.col("tries") + 1))
    return versions.read().withColumn("version", F.lit(versions.latest()))


@query(
    "cleared_table",
    with_tables(RAW, f"SELECT {FILTERED_SQL} FROM raw WHERE false"),
)
def cleared_table(spark: SparkSession, folder: str) -> DataFrame:
    versions = VersionedTable(spark, new_path(spark, "review"))
    versions.write(filtered(spark, folder))
    return versions.clear().select(*FILTERED_COLUMNS)


@query(
    "latest_predictions",
    with_tables(
        RAW,
        "SELECT id, CASE WHEN k % 9 < 2 THEN 'N/A' ELSE split_part(title, ' ', 1) END AS colour, "
        "'done' AS status FROM raw",
    ),
)
def latest_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of two runs in one folder; the later one counts."""
    base = new_path(spark, "runs")
    sent = build_requests(products(spark, folder), CONFIG, "colour", "English")
    request = F.to_json("request")
    for run, status in (("run-2024-01-01", "stale"), ("run-2024-02-01", "done")):
        lines = sent.select(
            F.concat(
                F.lit(f'{{"status":"{status}","processed_time":"now","request":'),
                request,
                F.lit(',"response":'),
                column_model(request),
                F.lit("}"),
            )
        )
        requests.write_requests(lines, f"{base}/{run}/predictions.jsonl")
    found = requests.read_predictions(spark, base)
    status_of = found.select(request_id("request").alias("id"), "status")
    return parse_predictions(found, "colour").join(status_of, "id")


@query(
    "collected_batch",
    with_tables(
        RAW,
        "SELECT id, title, CASE WHEN size <> '' THEN size WHEN k % 9 < 2 THEN 'N/A' ELSE split_part(title, ' ', 1) END AS size "
        "FROM raw",
    ),
)
def collected_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Both halves of a run through a batch service: its request file, and the feed written with the predictions."""
    base = new_path(spark, "batch")
    feed = products(spark, folder).select("id", "title", "description", "size")
    write_batch(feed, CONFIG, "size", "English", f"{base}/requests.jsonl")
    request = F.get_json_object("value", "$.request")
    answered = F.concat(F.lit('{"status":"done","request":'), request, F.lit(',"response":'), column_model(request), F.lit("}"))
    requests.write_requests(spark.read.text(f"{base}/requests.jsonl").select(answered), f"{base}/out/run-1/predictions.jsonl")
    path = collect_batch(feed, CONFIG, "size", f"{base}/out")
    return feeds.read_feed_csv(spark, path, ["id", "title", "size"], multi_line=True).select("id", "title", "size")


@query(
    "image_descriptions",
    with_tables(
        RAW,
        "SELECT 'gs://b/images/' || id || '.png' AS uri, 'seen on gs://b/images/' || id || '.png' "
        "AS description, CAST(NULL AS VARCHAR) AS error FROM raw",
    ),
)
def image_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """A stand-in for a model names the file it was sent, with blanks around."""
    images = filtered(spark, folder).select(
        F.concat(F.lit("gs://b/images/"), "id", F.lit(".png")).alias("uri")
    )
    model = ExpressionCompleter(
        lambda request: F.concat(
            F.lit("\n seen on "),
            F.get_json_object(request, "$.contents.parts[1].fileData.fileUri"),
            F.lit(" \n"),
        )
    )
    return describe_images(images, model)


@query(
    "image_description_requests",
    with_tables(
        RAW,
        "SELECT 'gs://b/images/' || id || '.png' AS uri, md5('{\"contents\":{\"role\":\"user\",\"parts\":"
        f"[{{\"text\":\"{prompts.IMAGE_PROMPT}\"}},{{\"fileData\":{{\"mimeType\":\"image/png\",\"fileUri\":"
        "\"gs://b/images/' || id || '.png\"}}]},\"generationConfig\":{\"temperature\":0.0,"
        "\"maxOutputTokens\":1024},\"safetySettings\":["
        + ",".join(
            f'{{"category":"{c}","threshold":{prompts.BLOCK_ONLY_HIGH}}}'
            for c in prompts.SAFETY_CATEGORIES
        )
        + "]}') AS request_hash FROM raw",
    ),
)
def image_description_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One request per image with the constant image prompt."""
    uri = F.concat(F.lit("gs://b/images/"), "id", F.lit(".png"))
    request = prompts.multimodal_request(F.lit(prompts.IMAGE_PROMPT), prompts.IMAGE_PARAMS, uri)
    return filtered(spark, folder).select(uri.alias("uri"), F.md5(request).alias("request_hash"))
