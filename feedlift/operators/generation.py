"""The pluggable model step.

A completer turns a prompt column into a ``response`` and an ``error`` column. The model
itself is the caller's: a Python function, a table of stored answers, or an expression.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.types import _parse_datatype_string as parse_type

from feedlift.config import ModelParams
from feedlift.functions.prompts import IMAGE_PARAMS, IMAGE_PROMPT, multimodal_request
from feedlift.functions.text import as_column, trim_ws
from feedlift.session import materialise

NO_IMAGE = "the image was not read, so nothing was asked"


class Completer(Protocol):
    def complete(self, df: DataFrame, prompt: str, response: str, error: str) -> DataFrame: ...


@dataclass(frozen=True)
class ExpressionCompleter:
    """Answers by a column expression over the prompt and the other columns."""

    answer: Callable[[Column], Column]

    def complete(self, df: DataFrame, prompt: str, response: str, error: str) -> DataFrame:
        return df.withColumn(response, self.answer(as_column(prompt))).withColumn(
            error, F.lit(None).cast("string")
        )


@dataclass(frozen=True)
class ReplayCompleter:
    """Answers stored before: a table with ``response``, an optional ``error`` and the key
    columns ``on``. A prompt without a stored answer gets none; of several it gets the
    smallest, so that each prompt stays one row."""

    responses: DataFrame
    on: Sequence[str]

    def complete(self, df: DataFrame, prompt: str, response: str, error: str) -> DataFrame:
        stored = self.responses
        failed = F.col("error") if "error" in stored.columns else F.lit(None).cast("string")
        answer = F.struct(F.col("response").alias(response), failed.cast("string").alias(error))
        one = stored.groupBy(*self.on).agg(F.min(answer).alias("_answer"))
        return df.join(one, list(self.on), "left").select(
            *[as_column(c) for c in df.columns], f"_answer.{response}", f"_answer.{error}"
        )


@dataclass(frozen=True)
class RawCompleter:
    """A completer whose answers are raw model responses: ``parse`` turns each into a struct
    ``text, error``, as ``stream_response`` and ``prediction_response`` do."""

    inner: Completer
    parse: Callable[[Column], Column]

    def complete(self, df: DataFrame, prompt: str, response: str, error: str) -> DataFrame:
        raw = self.inner.complete(df, prompt, "_raw", "_failed")
        answered = F.col("_failed").isNull() & as_column(prompt).isNotNull()
        parsed = raw.withColumn("_parsed", F.when(answered, self.parse(F.col("_raw"))))
        return parsed.select(
            *[as_column(c) for c in df.columns],
            F.col("_parsed.text").alias(response),
            F.coalesce("_failed", "_parsed.error").alias(error),
        )


def call_with_retries(call: Callable[[], Any], attempts: int, delay: float = 0.0) -> Any:
    """Result of ``call``; after the last failed attempt its error is raised."""
    for left in range(attempts - 1, -1, -1):
        try:
            return call()
        except Exception:
            if delay:
                time.sleep(delay)
            if not left:
                raise
    return None


@dataclass(frozen=True)
class FunctionCompleter:
    """Answers of a Python function ``(prompts, params) -> answers`` in Arrow batches.

    ``batch_size`` prompts go into one call, ``concurrency`` calls run at a time in each
    task, and ``partitions`` sets the number of tasks: prompts are spread evenly over them,
    so their cost does not follow the layout of the feed. A call that fails in all its
    attempts marks its prompts with the error and never fails the job. Prompts that are
    NULL are not sent.
    """

    function: Callable[[list[str], ModelParams], Sequence[Any]]
    params: ModelParams = field(default_factory=ModelParams)
    batch_size: int = 1
    concurrency: int = 1
    partitions: int | None = None
    attempts: int = 3
    delay: float = 0.0
    answer_type: str = "string"

    def complete(self, df: DataFrame, prompt: str, response: str, error: str) -> DataFrame:
        spread = df.repartition(self.partitions) if self.partitions else df
        answer = StructType(
            [
                StructField("response", parse_type(self.answer_type)),
                StructField("error", StringType()),
            ]
        )
        kind = to_arrow_type(answer)

        def run(prompts: pa.Array) -> pa.Array:
            with ThreadPoolExecutor(self.concurrency) as pool:
                answers, errors = self.answer(prompts.to_pylist(), pool)
            pairs = zip(answers, errors, strict=True)
            return pa.array([{"response": a, "error": e} for a, e in pairs], kind)

        # Only the prompt travels to Python, and no plan may run the model twice for a row.
        asked = F.arrow_udf(run, answer).asNondeterministic()(as_column(prompt))
        return spread.withColumn("_answer", asked).select(
            *[as_column(c) for c in df.columns],
            F.col("_answer.response").alias(response),
            F.col("_answer.error").alias(error),
        )

    def answer(self, prompts: list, pool: ThreadPoolExecutor) -> tuple[list, list]:
        """Answers and errors of prompts, in calls of ``batch_size``."""
        answers: list = [None] * len(prompts)
        errors: list = [None] * len(prompts)
        sent = [i for i, p in enumerate(prompts) if p is not None]
        calls = [sent[i : i + self.batch_size] for i in range(0, len(sent), self.batch_size)]

        def call(places: list[int]) -> None:
            texts = [prompts[i] for i in places]
            try:
                found = call_with_retries(
                    lambda: self.function(texts, self.params), self.attempts, self.delay
                )
                for i, answer in zip(places, found, strict=True):
                    answers[i] = answer
            except Exception as problem:
                for i in places:
                    answers[i], errors[i] = None, f"{type(problem).__name__}: {problem}"

        list(pool.map(call, calls))
        return answers, errors


def generate_text(
    df: DataFrame,
    completer: Completer,
    prompt: str = "prompt",
    response: str = "response",
    error: str = "error",
) -> DataFrame:
    """One answer per row. Freeze the result before it is used twice: the model may
    answer otherwise the next time."""
    return completer.complete(df, prompt, response, error)


def describe_images(
    images: DataFrame,
    completer: Completer,
    prompt: str = IMAGE_PROMPT,
    params: ModelParams = IMAGE_PARAMS,
) -> DataFrame:
    """``uri, description, error`` of image files: one constant prompt per file, answers trimmed,
    asked once and frozen. The completer gets the JSON request; files outside of storage go inline
    when the frame has ``mime_type`` and ``content``. A file that cannot be sent is not asked about."""
    inline = {"mime_type", "content"} <= set(images.columns)
    request = multimodal_request(
        F.lit(prompt),
        params,
        F.col("uri"),
        F.col("mime_type") if inline else None,
        F.col("content") if inline else None,
    )
    there = F.coalesce(F.col("uri").startswith("gs://"), F.lit(False))
    if inline:
        there = there | (F.col("mime_type").isNotNull() & F.col("content").isNotNull())
    asked = images.select("uri", F.when(there, request).alias("prompt"))
    answered = generate_text(asked, completer).select(
        "uri",
        F.when(F.col("prompt").isNotNull(), trim_ws("response")).alias("description"),
        F.when(F.col("prompt").isNull(), F.lit(NO_IMAGE)).otherwise(F.col("error")).alias("error"),
    )
    return materialise(answered, "image-descriptions")


def embed_text(
    df: DataFrame, completer: Completer, content: str = "content", embedding: str = "embedding"
) -> DataFrame:
    """One vector per row and its ``error``, by a completer that answers with arrays. Asked once
    and frozen."""
    return materialise(completer.complete(df, content, embedding, "error"), "embeddings")
