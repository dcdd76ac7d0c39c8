"""From a feed row and two model answers to a review row.

Each step is one ``select`` over named columns, all of them JVM expressions. A row whose
answer failed carries ``failure`` from there on and ends as a failed review row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlift.config import FeedConfig, ModelParams, Status
from feedlift.functions import scoring
from feedlift.functions.prompts import multimodal_request, row_prompt
from feedlift.functions.responses import NOT_AVAILABLE
from feedlift.functions.rows import row_context, row_map
from feedlift.functions.sets import difference
from feedlift.functions.text import (
    as_column,
    blank_if_null,
    bracketed,
    lower_each,
    show_number,
    tokens,
    trim_ws,
    utf16_length,
)
from feedlift.operators.labels import with_description_answer, with_title_answer
from feedlift.operators.joins import left_join, one_per_key

REVIEW_COLUMNS = (
    "approval",
    "status",
    "item_id",
    "title_generated",
    "title_original",
    "title_score",
    "title_changed",
    "title_length",
    "new_words_added",
    "words_removed",
    "template_original",
    "template_generated",
    "attributes_added",
    "attributes_removed",
    "gap_attributes",
    "description_generated",
    "description_original",
    "description_changed",
    "description_length",
    "description_score",
    "category_generated",
    "full_response",
    "original_input",
)

FAILED_STATUS = f"{Status.FAILED}. See the column full_response for details."

_LIST_SEPARATOR = " | "
# The context of a description prompt starts with the new title under this name.
_NEW_TITLE_FIELD = "Generated Title"


def feed_rows(
    feed: DataFrame, cfg: FeedConfig, page_text: str | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """What a review needs of each feed row: id, old texts, image link, the row as map and
    as JSON. Columns in ``keep`` and the page text stay out of the row."""
    columns = [c for c in feed.columns if c and c != page_text and c not in keep]

    def optional(name: str) -> Column:
        return blank_if_null(name) if name in columns else F.lit("")

    return feed.select(
        *[as_column(c) for c in keep],
        blank_if_null(cfg.id_col).alias("item_id"),
        blank_if_null(cfg.title_col).alias("title_original"),
        blank_if_null(cfg.description_col).alias("description_original"),
        optional(cfg.image_col).alias("image"),
        row_map(columns).alias("row"),
        row_context(columns).alias("original_input"),
        (blank_if_null(page_text) if page_text else F.lit("")).alias("page_text"),
    )


def join_images(rows: DataFrame, images: DataFrame) -> DataFrame:
    """Rows with the type and the bytes of their image, from files ``uri, mime_type,
    content`` whose URI is the link of the row. Rows without a link would meet in one key;
    they get keys of their own, which no file has."""
    files = images.select(
        F.col("uri").alias("_uri"),
        F.col("mime_type").alias("image_type"),
        F.col("content").alias("image_bytes"),
    )
    alone = F.concat(F.lit("\u0000"), F.col("item_id"))
    link = F.coalesce(F.nullif("image", F.lit("")), alone)
    return left_join(rows, one_per_key(files, "_uri"), link, "_uri")


def _sent(rows: DataFrame, cfg: FeedConfig, prompt: Column, params: ModelParams) -> Column:
    """What the completer gets: the prompt, or a request with the prompt and the image."""
    if not cfg.use_images:
        return prompt
    inline = "image_bytes" in rows.columns
    return multimodal_request(
        prompt,
        params,
        F.nullif("image", F.lit("")),
        F.col("image_type") if inline else None,
        F.col("image_bytes") if inline else None,
    )


def add_title_prompt(rows: DataFrame, cfg: FeedConfig) -> DataFrame:
    page = F.col("page_text") if cfg.title.use_page_text else None
    prompt = row_prompt(cfg.title.prompt, F.col("original_input"), page)
    return rows.withColumn("title_prompt", _sent(rows, cfg, prompt, cfg.title.params))


def parse_titles(rows: DataFrame) -> DataFrame:
    """Adds the lists of a title answer, or the failure of a row without a complete one."""
    no_keys = F.array().cast("array<string>")
    lists = {
        "original_keys": tokens("answer_original_keys", r"\|"),
        "keys": tokens("answer_keys", r"\|"),
        "values": tokens("answer_values", r"\|"),
        "replaced_keys": F.coalesce(lower_each(tokens("answer_replaced", ",")), no_keys),
        "category_generated": trim_ws("answer_category"),
        "model_title": trim_ws("answer_title"),
    }
    incomplete = F.concat(F.lit("incomplete title answer: "), blank_if_null("title_response"))
    return with_title_answer(rows, "title_response").select(
        *[F.col(c) for c in rows.columns],
        F.coalesce("title_error", F.when(~F.col("answered"), incomplete)).alias("failure"),
        *[v.alias(k) for k, v in lists.items()],
    )


def compose_titles(parsed: DataFrame, cfg: FeedConfig) -> DataFrame:
    """Adds the new title, the gaps it fills and the attributes it uses."""
    facts = scoring.attribute_facts(
        F.col("keys"),
        F.col("values"),
        F.col("original_keys"),
        F.col("replaced_keys"),
        F.col("row"),
        prefer_generated=cfg.title.prefer_generated_values,
    )
    composed = (
        F.col("model_title") if cfg.title.use_model_titles else scoring.composed_title(F.col("used"))
    )
    kept = [c for c in parsed.columns if c not in ("keys", "values", "replaced_keys", "model_title")]
    return (
        parsed.withColumn("facts", facts)
        .withColumn("used", scoring.used_facts(F.col("facts")))
        .select(
            *kept,
            composed.alias("title_generated"),
            scoring.gap_attributes(F.col("facts")).alias("gaps"),
            F.transform("used", lambda f: f["name"]).alias("used_keys"),
            scoring.feature_words(F.col("used")).alias("extra_words"),
        )
    )


def score_titles(composed: DataFrame, cfg: FeedConfig) -> DataFrame:
    """Adds words and attributes won and lost, and the title score."""
    known = scoring.vocabulary(F.col("row"), cfg.title.allowed(), F.col("extra_words"))
    title = F.col("title_generated")
    found = composed.select(
        "*",
        scoring.new_words(title, known).alias("new_words"),
        scoring.removed_words(F.col("title_original"), title).alias("lost_words"),
        difference(F.col("used_keys"), F.col("original_keys")).alias("won_keys"),
        difference(F.col("original_keys"), F.col("used_keys")).alias("lost_keys"),
    )
    score = scoring.title_score(
        F.size("new_words") > 0,
        F.size("lost_words") > 0,
        F.size("gaps") > 0,
        scoring.any_name(F.col("won_keys")),
    )
    kept = [
        c
        for c in composed.columns
        if c not in ("original_keys", "used_keys", "extra_words", "row", "gaps")
    ]
    return found.select(
        *kept,
        score.alias("title_score"),
        (score != 0).alias("title_changed"),
        F.array_join("new_words", _LIST_SEPARATOR).alias("new_words_added"),
        F.array_join("lost_words", _LIST_SEPARATOR).alias("words_removed"),
        bracketed(F.col("original_keys")).alias("template_original"),
        bracketed(F.col("used_keys")).alias("template_generated"),
        bracketed(F.col("won_keys")).alias("attributes_added"),
        bracketed(F.col("lost_keys")).alias("attributes_removed"),
        F.when(F.size("gaps") > 0, F.to_json("gaps")).otherwise("").alias("gap_attributes"),
    )


def keep_titles(rows: DataFrame) -> DataFrame:
    """The title side of a run that generates no titles: old title, fixed values."""
    fixed = {
        "new_words_added": "0",
        "words_removed": "0",
        "template_original": "",
        "template_generated": "",
        "attributes_added": "[]",
        "attributes_removed": "[]",
        "gap_attributes": "",
        "category_generated": "",
        "title_response": NOT_AVAILABLE,
    }
    return rows.drop("row").select(
        *[c for c in rows.columns if c != "row"],
        F.lit(None).cast("string").alias("failure"),
        F.col("title_original").alias("title_generated"),
        F.lit(1.0).alias("title_score"),
        F.lit(False).alias("title_changed"),
        *[F.lit(v).alias(k) for k, v in fixed.items()],
    )


def add_description_prompt(rows: DataFrame, cfg: FeedConfig) -> DataFrame:
    """Adds the prompt with the new title in front of the context; NULL, and so never
    sent, for a row that failed before."""
    page = F.col("page_text") if cfg.description.use_page_text else None
    title = F.to_json(F.struct(F.col("title_generated").alias(_NEW_TITLE_FIELD)))
    context = F.col("original_input")
    # Joins {"Generated Title":"..."} and {...}; a feed column of that name is kept as it is.
    joined = F.concat(
        F.regexp_replace(title, r"\}\z", ","), F.substring(context, F.lit(2), F.length(context))
    )
    has_field = F.get_json_object(context, f"$['{_NEW_TITLE_FIELD}']").isNotNull()
    prompt = row_prompt(
        cfg.description.prompt, F.when(has_field, context).otherwise(joined), page
    )
    sent = _sent(rows, cfg, prompt, cfg.description.params)
    return rows.withColumn("description_prompt", F.when(F.col("failure").isNull(), sent))


def parse_descriptions(rows: DataFrame) -> DataFrame:
    """Adds new description, its score and its evaluation."""
    incomplete = F.concat(
        F.lit("incomplete description answer: "), blank_if_null("description_response")
    )
    failure = F.coalesce("failure", "description_error", F.when(~F.col("answered"), incomplete))
    return with_description_answer(rows, "description_response").select(
        *[F.col(c) for c in rows.columns if c != "failure"],
        failure.alias("failure"),
        F.col("answer_description").alias("description_generated"),
        F.col("answer_score").alias("description_score"),
        F.col("answer_reasoning").alias("evaluation"),
    )


def keep_descriptions(rows: DataFrame) -> DataFrame:
    """The description side of a run that generates none."""
    return rows.select(
        "*",
        F.col("description_original").alias("description_generated"),
        F.lit(-1.0).alias("description_score"),
        F.lit(scoring.NOT_EVALUATED).alias("evaluation"),
    )


def gate(rows: DataFrame, cfg: FeedConfig) -> DataFrame:
    """Compliance status, final title score and approval."""
    described = (
        scoring.reaches("description_score", cfg.description.min_approval_score)
        if cfg.generate_descriptions
        else F.lit(True)
    )
    checked = rows.withColumn(
        "status", scoring.compliance_status("title_generated", "description_generated")
    ).withColumn(
        "title_score",
        F.when(F.col("status") == Status.NON_COMPLIANT, F.lit(-1.0)).otherwise(F.col("title_score")),
    )
    return checked.withColumn(
        "approval", scoring.reaches("title_score", cfg.title.min_approval_score) & described
    )


def review_rows(gated: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The review schema. A failed row only has its status, its id and its error."""
    audit = F.concat(
        trim_ws(blank_if_null("title_response")),
        F.lit("\nProduct description: "),
        F.col("description_generated"),
        F.lit("\nDescription evaluation: Score: "),
        show_number("description_score"),
        F.lit("\n"),
        F.col("evaluation"),
    )
    full = gated.select(
        "*",
        utf16_length("title_generated").alias("title_length"),
        utf16_length("description_generated").alias("description_length"),
        (F.col("description_generated") != F.col("description_original")).alias(
            "description_changed"
        ),
        audit.alias("audit"),
    )
    failed = F.col("failure").isNotNull()

    def final(name: str) -> Column:
        if name == "item_id":
            return F.col(name)
        if name == "status":
            return F.when(failed, F.lit(FAILED_STATUS)).otherwise(F.col(name)).alias(name)
        if name == "full_response":
            return F.when(failed, F.col("failure")).otherwise(F.col("audit")).alias(name)
        return F.when(~failed, F.col(name)).alias(name)

    return full.select(*[final(c) for c in REVIEW_COLUMNS], *[as_column(c) for c in keep])
