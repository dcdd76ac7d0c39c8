"""Queries of options and failures that the other queries do not enter."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlift.catalog.column import CONFIG as COLUMN_CONFIG
from feedlift.catalog.column import column_model
from feedlift.catalog.feed import RAW, filtered, key_of, products, table
from feedlift.catalog.registry import query, with_tables
from feedlift.catalog.review import (
    CONFIG,
    FACTS,
    TITLE_ANSWERS,
    TITLE_FIELDS,
    answered_titles,
    feed,
)
from feedlift.catalog.warehouse import page_contents, prompt_reader, run_batched, top_examples
from feedlift.config import DescriptionSettings, FeedConfig, TitleSettings
from feedlift.operators import review as steps
from feedlift.operators import selection
from feedlift.operators.generation import ExpressionCompleter, describe_images
from feedlift.plans.batched import BatchOptions, batched_update
from feedlift.plans.enrich import enrich_column
from feedlift.plans.review_feed import review_feed
from feedlift.session import materialise, new_path
from feedlift.sources import feeds
from feedlift.sources.tables import StateTable

# --- lists of ids, image files ------------------------------------------------------

# Ids as a user would type them: texts, some of which are no id of the table.
LISTED_IDS = [str(3 * i) for i in range(1, 2001)] + ["007", "z", ""]


@query(
    "filter_by_listed_ids",
    "SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 = 0 AND p_partkey BETWEEN 3 AND 6000",
)
def filter_by_listed_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Two thousand listed ids and two of them select the same rows where both list them."""
    rows = table(spark, folder, "part").select("p_partkey", "p_name")
    some = selection.by_ids(rows, LISTED_IDS[:2] + ["007", "z"], "p_partkey")
    rest = selection.by_ids(rows, LISTED_IDS[2:], "p_partkey")
    return some.unionByName(rest)


@query(
    "images_from_files",
    with_tables(
        RAW, "SELECT 'image/png' AS mime_type, CAST(sum(length(id) + 1) AS BIGINT) AS bytes, 'yes' AS typed FROM raw "
        "UNION ALL SELECT 'none', CAST(sum(length(id) + 1) AS BIGINT), 'no' FROM raw",
    ),
)
def images_from_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files with a known suffix and files without; none is left out."""
    path = new_path(spark, "image-files")
    ids = filtered(spark, folder).select("id")
    ids.write.option("extension", "png").csv(f"{path}/typed")
    ids.write.option("extension", "raw").csv(f"{path}/untyped")
    files = feeds.read_images(spark, path, with_content=True)
    typed = F.when(F.col("uri").contains("/typed/"), "yes").otherwise("no").alias("typed")
    return (
        files.groupBy(typed, F.coalesce("mime_type", F.lit("none")).alias("mime_type"))
        .agg(F.sum("length").alias("bytes"))
        .select("mime_type", "bytes", "typed")
    )


@query(
    "image_descriptions_without_image",
    with_tables(
        RAW,
        "SELECT CASE k % 3 WHEN 0 THEN 's3a://b/' ELSE 'gs://b/' END || id || '.png' AS uri, "
        "CASE WHEN k % 3 = 1 THEN 'seen' END AS description, "
        "CASE k % 3 WHEN 0 THEN 'the image was not read, so nothing was asked' WHEN 2 THEN 'down' END AS error "
        "FROM raw",
    ),
)
def image_descriptions_without_image(spark: SparkSession, folder: str) -> DataFrame:
    """Images that cannot be sent are not asked about; failed calls give no description."""
    store = F.when(key_of() % 3 == 0, "s3a://b/").otherwise("gs://b/")
    rows = filtered(spark, folder).select(F.concat(store, "id", F.lit(".png")).alias("uri"))
    return describe_images(rows, FailingCompleter(F.regexp_extract("uri", "([0-9]+)", 1).cast("bigint") % 3 == 2))


class FailingCompleter:
    """Fails where a condition holds, else answers ``seen``."""

    def __init__(self, failed: Column, answer: Column | None = None) -> None:
        self._failed, self._answer = failed, F.lit("seen") if answer is None else answer

    def complete(self, df: DataFrame, prompt: str, response: str, error: str) -> DataFrame:
        return df.withColumn(response, F.when(~self._failed, self._answer)).withColumn(
            error, F.when(self._failed, F.lit("down"))
        )


# --- batched generation --------------------------------------------------------------

_ALL_DONE = (
    "SELECT id, CASE WHEN k % 10 > 1 THEN upper(title) END AS title, "
    "CAST(NULL AS VARCHAR) AS description, "
    "CAST(CASE k % 10 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 1 END AS INTEGER) AS tries FROM raw"
)


@query("batched_update_in_rounds", with_tables(RAW, _ALL_DONE))
def batched_update_in_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Bounded rounds give the same state as one; products no answer names end the run all the same. The
    bound follows the feed, so that there are a few rounds of it at any size."""
    items = max(60, table(spark, folder, "part").count() // 3)
    return run_batched(spark, folder, BatchOptions("title", items_per_iteration=items))


@query("batched_update_in_parts", with_tables(RAW, _ALL_DONE))
def batched_update_in_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Four runs over the parts of one table; each works on buckets of its own."""
    inputs = filtered(spark, folder)
    state = StateTable(spark, new_path(spark, "state"))
    state.create(selection.init_state(inputs))
    examples = materialise(top_examples(spark, folder), "examples")  # four runs read them
    for part in range(4):
        options = BatchOptions("title", parts=4, part=part)
        batched_update(state, inputs, examples, prompt_reader("title"), options)
    return state.read()


# --- one column ----------------------------------------------------------------------

_VALUE = "CASE WHEN k % 9 < 2 THEN 'N/A' ELSE split_part(title, ' ', 1) END"


@query("enrich_replace", with_tables(RAW, f"SELECT id, {_VALUE} AS size FROM raw"))
def enrich_replace(spark: SparkSession, folder: str) -> DataFrame:
    """An existing column is overwritten."""
    rows = products(spark, folder).select("id", "title", "description", "size")
    model = ExpressionCompleter(column_model)
    return enrich_column(rows, COLUMN_CONFIG, "size", "English", model, mode="replace").select("id", "size")


@query(
    "enrich_column_failures",
    with_tables(
        RAW,
        f"SELECT id, CASE WHEN k % 4 <> 0 THEN {_VALUE} END AS colour, CASE WHEN k % 4 = 0 THEN 'down' END AS problem "
        "FROM raw",
    ),
)
def enrich_column_failures(spark: SparkSession, folder: str) -> DataFrame:
    """A failed call leaves no value and tells why."""
    rows = products(spark, folder).select("id", "title", "description")
    k = F.regexp_extract("prompt", 'Id: ([0-9]+)"', 1).cast("bigint")
    model = FailingCompleter(k % 4 == 0, column_model(F.col("prompt")))
    done = enrich_column(rows, COLUMN_CONFIG, "colour", "English", model, error_column="problem")
    return done.select("id", "colour", "problem")


@query(
    "enrich_repeated_ids",
    with_tables(RAW, f"SELECT id, copy, {_VALUE} AS colour FROM raw, range(1, 4) AS r(copy)"),
)
def enrich_repeated_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Each row of a repeated id stays one row."""
    rows = products(spark, folder).select("id", "title", "description")
    rows = rows.withColumn("copy", F.explode(F.array(*[F.lit(c).cast("bigint") for c in (1, 2, 3)])))
    done = enrich_column(rows, COLUMN_CONFIG, "colour", "English", ExpressionCompleter(column_model))
    return done.select("id", "copy", "colour")


# --- titles --------------------------------------------------------------------------


def _composed(spark: SparkSession, folder: str, **settings) -> DataFrame:
    cfg = replace(CONFIG, title=replace(CONFIG.title, **settings))
    parsed = steps.parse_titles(answered_titles(spark, folder))
    return steps.compose_titles(parsed, cfg).select(F.col("item_id").alias("id"), "title_generated")


_PREFERRING = FACTS.replace("COALESCE(NULLIF(fed, ''), generated)", "generated")


@query(
    "title_prefer_generated",
    with_tables(
        RAW,
        TITLE_ANSWERS,
        TITLE_FIELDS,
        _PREFERRING,
        "SELECT raw.id, c.new_title AS title_generated FROM raw LEFT JOIN composed c ON raw.id = c.id",
    ),
)
def title_prefer_generated(spark: SparkSession, folder: str) -> DataFrame:
    """Values of the answer go before those of the feed; failed rows have no title."""
    return _composed(spark, folder, prefer_generated_values=True)


@query(
    "title_by_model",
    with_tables(RAW, TITLE_ANSWERS, TITLE_FIELDS, "SELECT id, trim(f_title) AS title_generated FROM title_fields"),
)
def title_by_model(spark: SparkSession, folder: str) -> DataFrame:
    """The title of the answer instead of the composed one."""
    return _composed(spark, folder, use_model_titles=True)


@query(
    "title_feature_words",
    with_tables(
        RAW,
        "SELECT id, title || ' Glowing zig-zag' AS title_generated, "
        "CASE WHEN k % 3 = 2 THEN 'Glowing | zig | zag' ELSE '' END AS new_words_added FROM raw",
    ),
)
def title_feature_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words of attributes that describe image or page may be new, those of others may not."""
    name = F.element_at(F.array(F.lit("Image Features"), F.lit("Website Features"), F.lit("Finish")), (key_of("item_id") % 3 + 1).cast("int"))
    answer = F.concat(
        F.lit("Product attribute keys in original title: product type\nProduct category: c\nProduct attribute keys: product type | "),
        name, F.lit("\nProduct attribute values: "), "title_original", F.lit(" | Glowing zig-zag\nGenerated title: t\n"),
    )
    rows = steps.feed_rows(feed(spark, folder), CONFIG).withColumn("title_response", answer)
    parsed = steps.parse_titles(rows.withColumn("title_error", F.lit(None).cast("string")))
    scored = steps.score_titles(steps.compose_titles(parsed, CONFIG), CONFIG)
    return scored.select(F.col("item_id").alias("id"), "title_generated", "new_words_added")


@query(
    "review_with_pages",
    with_tables(
        RAW,
        "SELECT id AS item_id, title AS title_generated, 'seen ' || COALESCE(url, 'nothing') AS description_generated, "
        "CAST(0.5 AS DOUBLE) AS description_score FROM raw LEFT JOIN pages ON k = page_id",
    ),
)
def review_with_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Page texts reach the prompt of the description."""
    cfg = FeedConfig(generate_titles=False, title=TitleSettings(), description=DescriptionSettings(prompt="Go.\n", use_page_text=True))

    def model(prompt: Column) -> Column:
        seen = F.coalesce(F.nullif(F.regexp_extract(prompt, r"(?s)Website: (.*?)\n\n", 1), F.lit("")), F.lit("nothing"))
        return F.concat(F.lit("Description: seen "), seen, F.lit("\n\nScore: 0.5\nReasoning: r"))

    rows = review_feed(
        feed(spark, folder), cfg, None, ExpressionCompleter(model), page_texts=page_contents(spark, folder)
    )
    return rows.select("item_id", "title_generated", "description_generated", "description_score")
