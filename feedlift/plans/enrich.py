"""One column of a feed, filled by a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlift.config import FeedConfig
from feedlift.functions.prompts import column_prompt, column_request
from feedlift.functions.responses import NOT_AVAILABLE, first_candidate_text, request_id
from feedlift.functions.text import as_column
from feedlift.operators.generation import Completer, generate_text
from feedlift.operators.joins import left_join, one_per_key
from feedlift.session import materialise
from feedlift.sources.feeds import write_csv
from feedlift.sources.requests import (
    PREDICTION_SCHEMA,
    REQUEST_TYPE,
    RESPONSE_TYPE,
    latest_predictions,
    request_lines,
    write_requests,
)


def build_requests(
    feed: DataFrame, cfg: FeedConfig, column: str, language: str, meaning: str | None = None
) -> DataFrame:
    """``request``: one request object per product."""
    prompt = column_prompt(column, language, meaning)
    return feed.select(
        column_request(prompt, cfg.title_col, cfg.id_col, cfg.description_col).alias("request")
    )


def parse_predictions(predictions: DataFrame, column: str) -> DataFrame:
    """``id`` and the generated column, read from request and response; with a column ``error``
    that too, and no value where it is set."""
    value = first_candidate_text("response")
    if "error" not in predictions.columns:
        return predictions.select(request_id("request").alias("id"), value.alias(column))
    return predictions.select(
        request_id("request").alias("id"), F.when(F.col("error").isNull(), value).alias(column), "error"
    )


def join_column(
    feed: DataFrame,
    values: DataFrame,
    column: str,
    id_col: str = "id",
    *,
    mode: str = "fill",
    error_column: str | None = None,
) -> DataFrame:
    """Feed with the generated column. ``fill`` keeps the values a feed has already,
    ``replace`` overwrites them. Predictions without an id belong to no product; they
    would meet in one key and go first. Of several predictions for an id one is taken, so a feed
    keeps its rows. ``error_column`` adds the errors of the failed ones (``error`` of ``values``)."""
    failed = F.col("error") if "error" in values.columns else F.lit(None).cast("string")
    generated = values.where(F.col("id") != NOT_AVAILABLE).select(
        F.col("id").alias("_id"), F.col(column).alias("_value"), failed.alias("_error")
    )
    joined = left_join(feed, one_per_key(generated, "_id"), as_column(id_col).cast("string"), "_id")
    value = F.col("_value")
    if mode == "fill" and column in feed.columns:
        old = as_column(column)
        value = F.when(F.coalesce(old, F.lit("")) != "", old).otherwise(value)
    kept = [as_column(c) for c in feed.columns if c != column]
    errors = [F.col("_error").alias(error_column)] if error_column else []
    return joined.select(*kept, value.alias(column), *errors)


def write_batch(
    feed: DataFrame,
    cfg: FeedConfig,
    column: str,
    language: str,
    path: str,
    meaning: str | None = None,
) -> None:
    """First half of a run through a batch service: its request file, one line per product."""
    requests = build_requests(feed, cfg, column, language, meaning)
    write_requests(request_lines(requests, F.col("request")), path)


def collect_batch(
    feed: DataFrame, cfg: FeedConfig, column: str, folder: str, *, mode: str = "fill"
) -> str:
    """Second half: joins the predictions of the latest run in ``folder`` to the feed and
    writes the feed as CSV beside them. Returns where. A run without predictions is an
    error."""
    spark = feed.sparkSession
    predictions = latest_predictions(spark, folder)
    found = spark.read.schema(PREDICTION_SCHEMA).json(predictions)
    path = f"{predictions.rsplit('/', 1)[0]}/feed_enriched.csv"
    write_csv(
        join_column(feed, parse_predictions(found, column), column, cfg.id_col, mode=mode), path
    )
    return path


def enrich_column(
    feed: DataFrame,
    cfg: FeedConfig,
    column: str,
    language: str,
    completer: Completer,
    *,
    meaning: str | None = None,
    mode: str = "fill",
    error_column: str | None = None,
) -> DataFrame:
    """The whole job: requests, answers of a completer that takes the request as JSON and
    gives the response as JSON, and the feed with the new column. A product whose call failed has no
    value, so that a later run fills it, and its error in ``error_column``."""
    requests = build_requests(feed, cfg, column, language, meaning).select(
        F.to_json("request").alias("prompt")
    ).distinct()  # a repeated row is asked for once
    answered = materialise(generate_text(requests, completer), "predictions")
    values = parse_predictions(
        answered.select(
            F.from_json("prompt", REQUEST_TYPE).alias("request"),
            F.from_json("response", RESPONSE_TYPE).alias("response"),
            "error",
        ),
        column,
    )
    return join_column(feed, values, column, cfg.id_col, mode=mode, error_column=error_column)
