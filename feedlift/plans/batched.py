"""Batched generation of titles or descriptions into a state table."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from feedlift.functions.prompts import BatchWording, batch_prompt
from feedlift.functions.rows import row_properties
from feedlift.functions.text import as_column
from feedlift.operators.answers import asked_products
from feedlift.operators.generation import Completer, generate_text
from feedlift.operators.joins import example_sections, section_texts
from feedlift.operators.numbering import number_rows, pack_chunks
from feedlift.operators.selection import by_ids, in_part, pending, random_batch
from feedlift.operators.state import merge_round
from feedlift.session import materialise, scratch, temporary_path
from feedlift.sources.tables import BucketedRows, StateTable


#: Prompts that one task builds and gets answered; more only where the shuffles of the session have no more partitions.
PROMPTS_PER_TASK = 256


@dataclass(frozen=True)
class BatchOptions:
    """``target`` is ``title`` or ``description``. ``items_per_iteration`` bounds a round, so
    that progress is saved in between; None takes all pending products at once. ``ids``
    asks for these products once, done or not."""

    target: str
    language: str = "English"
    items_per_prompt: int = 10
    items_per_iteration: int | None = None
    parts: int | None = None
    part: int | None = None
    ids: Sequence[str] | DataFrame | None = None
    max_tries: int = 3
    max_iterations: int | None = None
    seed: int = 0
    wording: BatchWording | None = None


def wanted_rows(state: DataFrame, options: BatchOptions) -> DataFrame:
    """State rows a round may work on."""
    rows = in_part(state, options.parts, options.part)
    if options.ids is not None:
        return by_ids(rows, options.ids)
    return pending(rows, options.target, options.max_tries)


def input_rows(inputs: DataFrame) -> DataFrame:
    """``id, properties`` of the products; of a repeated id one row."""
    rows = inputs.select(
        as_column("id").cast("string").alias("id"),
        row_properties(inputs.columns).alias("properties"),
    )
    return rows.groupBy("id").agg(F.min("properties").alias("properties"))


def waiting_rows(rows: DataFrame, feed: DataFrame, options: BatchOptions, run: str) -> DataFrame:
    """``id, bucket`` of the products that a run has yet to ask for: wanted ones with a row in the feed, without
    those it has asked for in vain."""
    open_ = wanted_rows(rows, options).where(~F.col("silent_in").eqNullSafe(F.lit(run)))
    return open_.select("id", "bucket").distinct().join(feed.select("id"), "id", "left_semi")


def build_prompts(
    ids: DataFrame, inputs: DataFrame, examples: DataFrame | None, options: BatchOptions
) -> DataFrame:
    """``chunk_id, ids, prompt`` for the products of ``inputs`` with these ids."""
    sections = None if examples is None else example_sections(examples, options.target)
    return _prompts(number_rows(ids.select("id"), ["id"]), input_rows(inputs), sections, options)


def _prompts(
    numbered: DataFrame, feed: DataFrame, sections: DataFrame | None, options: BatchOptions, tasks: int | None = None
) -> DataFrame:
    """Only the ids are numbered; the rows of the products (``id, properties``) come in with the join that gives
    them their chunk."""
    lines = None if sections is None else section_texts(sections)
    prompt = batch_prompt(
        options.target, options.language, "properties", wording=options.wording, lines=lines
    )
    return pack_chunks(numbered.join(feed, "id"), options.items_per_prompt, partitions=tasks).select(
        "chunk_id", "ids", prompt.alias("prompt")
    )


def generate_round(
    ids: DataFrame, feed: DataFrame, sections: DataFrame | None, completer: Completer, options: BatchOptions, products: int
) -> DataFrame:
    """``chunk_id, ids, response, error`` for these products (a frame that is stored, of so many rows), written before
    anything is parsed: the model must not be asked again when a later stage is repeated. ``sections`` are those of
    :func:`example_sections`."""
    tasks = -(-products // (options.items_per_prompt * PROMPTS_PER_TASK))
    tasks = max(1, min(tasks, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    prompts = _prompts(number_rows(ids.select("id"), ["id"], frozen=True), feed, sections, options, tasks)
    generated = generate_text(prompts, completer).select("chunk_id", "ids", "response", "error")
    return materialise(generated, "generated")


def _per_bucket(waiting: DataFrame) -> dict[int, int]:
    """Waiting products of each bucket; a row for each bucket comes to the driver."""
    return {r["bucket"]: r["n"] for r in waiting.groupBy("bucket").agg(F.count("*").alias("n")).collect()}


def _next_buckets(waiting: dict[int, int], options: BatchOptions) -> list[int]:
    """Buckets in a random order of the seed, as many as hold the products of a round."""
    order = sorted(waiting, key=lambda b: (hashlib.md5(f"{options.seed}:{b}".encode()).hexdigest(), b))
    if options.items_per_iteration is None:
        return order
    taken, n = [], 0
    for b in order:
        if n >= options.items_per_iteration:
            break
        taken.append(b)
        n += waiting[b]
    return taken


def batched_update(
    table: StateTable,
    inputs: DataFrame,
    examples: DataFrame | None,
    completer: Completer,
    options: BatchOptions,
) -> list[int]:
    """Rounds of generation until nothing is pending. Returns the number of products answered per round.

    The run reads state and feed once, counts what waits in each bucket, and stores the feed for its rounds, in the same
    buckets if they are of bounded size; examples are turned into text once. Such a round takes its products, in a random order, from as few buckets as hold enough of
    them; it reads and replaces these buckets alone, so its cost follows the round, not the state.

    A product that no answer names gains no tries, and is not asked for again in this run. So each
    round leaves fewer products or tries, and every run ends. Runs over different parts may work on one table side by
    side; one part takes one run at a time.
    """
    spark = inputs.sparkSession
    state = table.rows() if options.parts is None else table.part(options.parts, options.part)
    answered: list[int] = []
    run = uuid.uuid4().hex
    with scratch(spark):
        whole = input_rows(in_part(inputs, options.parts, options.part))
        if options.items_per_iteration is None and options.ids is None:  # listed products take one round
            whole = materialise(whole, "feed")
        feed_in: Callable[[list[int] | None], DataFrame] = lambda _: whole
        if options.items_per_iteration is not None:
            stored = BucketedRows(spark, temporary_path(spark, "feed"), table.buckets)
            stored.create(whole)
            feed_in = lambda buckets: stored.rows(buckets).drop("bucket")
        sections = None if examples is None else materialise(example_sections(examples, options.target), "examples")
        waiting = _per_bucket(waiting_rows(state, feed_in(None), options, run))
        while waiting and (options.max_iterations is None or len(answered) < options.max_iterations):
            chosen = _next_buckets(waiting, options)
            feed = feed_in(chosen)
            products = sum(waiting[b] for b in chosen)
            answered.append(_round(table, feed, chosen, products, sections, completer, options, run, len(answered)))
            if options.ids is not None or len(answered) == options.max_iterations:
                break
            left = _per_bucket(waiting_rows(table.rows(chosen), feed, options, run))
            waiting = {b: n for b, n in waiting.items() if b not in set(chosen)} | left
    return answered


def _round(
    table: StateTable, feed: DataFrame, buckets: list[int], products: int, sections: DataFrame | None, completer: Completer,
    options: BatchOptions, run: str, round_no: int,
) -> int:
    """One round over some buckets, in which so many products wait; how many products an answer names."""
    with scratch(feed.sparkSession):
        waiting = materialise(waiting_rows(table.rows(buckets), feed, options, run), "waiting")
        ids = random_batch(waiting, options.items_per_iteration, f"{options.seed}.{round_no}")
        asking = products if options.items_per_iteration is None else min(products, options.items_per_iteration)
        generated = generate_round(ids, feed, sections, completer, options, asking)
        seen = Observation()
        asked = asked_products(generated).withColumn("target", F.lit(options.target))
        asked = asked.observe(seen, F.count_if("named").alias("named"))
        answers = table.save_answers(asked, run, round_no)
        table.replace(merge_round(table.rows(buckets), answers, options.target, run))
    return seen.get["named"]
