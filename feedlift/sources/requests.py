"""Batch requests and predictions as JSON lines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CONTENTS = "array<struct<role:string,parts:array<struct<text:string>>>>"
REQUEST_TYPE = f"struct<contents:{_CONTENTS},generationConfig:struct<temperature:double>>"
RESPONSE_TYPE = (
    "struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>>>>"
)
PREDICTION_SCHEMA = (
    f"status string, processed_time string, request {REQUEST_TYPE}, response {RESPONSE_TYPE}"
)


def request_lines(rows: DataFrame, request: Column) -> DataFrame:
    """One JSON line ``{"request": ...}`` per row."""
    return rows.select(F.to_json(F.struct(request.alias("request"))).alias("value"))


def write_requests(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def latest_predictions(spark: SparkSession, folder: str) -> str:
    """Path of ``predictions.jsonl``, a file or a folder of part files, in the run folder
    that sorts last. Only names are listed; no file is opened."""
    pattern = f"{folder.rstrip('/')}/*/predictions.jsonl"
    try:
        files = spark.read.format("binaryFile").load(pattern)
    except AnalysisException as problem:
        raise FileNotFoundError(f"no {pattern}") from problem
    run = F.regexp_extract("path", r"\A(.*/predictions\.jsonl)", 1)
    return files.agg(F.max(run)).first()[0]


def read_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of the latest run."""
    return spark.read.schema(PREDICTION_SCHEMA).json(latest_predictions(spark, folder))
