"""How far generated titles have moved from the old ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlift.functions.text import as_column
from feedlift.functions.vectors import cosine_distance, distance_bucket
from feedlift.operators.generation import Completer, embed_text
from feedlift.operators.selection import random_batch, with_title
from feedlift.session import materialise


def drift_sample(state: DataFrame, size: int = 1000, seed: int | str = 0) -> DataFrame:
    """Random generated titles as ``id, content``."""
    titled = with_title(state).select("id", F.col("title").alias("content"))
    return random_batch(titled, size, seed)


def originals_of(
    sample: DataFrame, inputs: DataFrame, id_col: str = "id", title_col: str = "title"
) -> DataFrame:
    """Old titles of the sampled products as ``id, content``."""
    rows = inputs.select(
        as_column(id_col).cast("string").alias("id"), as_column(title_col).alias("content")
    )
    return rows.join(sample.select("id"), "id", "left_semi")


def embedding_distances(original: DataFrame, generated: DataFrame) -> DataFrame:
    """``id, distance`` of two tables ``id, embedding``, where both have a vector."""
    left = original.select("id", F.col("embedding").alias("_original")).where("_original is not null")
    right = generated.select("id", F.col("embedding").alias("_generated")).where("_generated is not null")
    return left.join(right, "id").select(
        "id", cosine_distance("_original", "_generated").alias("distance")
    )


def distance_histogram(distances: DataFrame) -> DataFrame:
    """Products per tenth of distance, in order."""
    return (
        distances.groupBy(distance_bucket("distance").alias("distance_bucket"))
        .agg(F.count("*").alias("products"))
        .orderBy("distance_bucket")
    )


def semantic_drift(
    state: DataFrame,
    inputs: DataFrame,
    embedder: Completer,
    *,
    size: int = 1000,
    seed: int | str = 0,
    id_col: str = "id",
    title_col: str = "title",
) -> DataFrame:
    """Histogram of the distance between old and new titles of a random sample. The sample
    is drawn before anything is embedded."""
    sample = materialise(drift_sample(state, size, seed), "drift-sample")
    old = originals_of(sample, inputs, id_col, title_col)
    return distance_histogram(
        embedding_distances(embed_text(old, embedder), embed_text(sample, embedder))
    )
