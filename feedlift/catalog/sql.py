"""Queries through the SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlift.catalog.column import shouting_model
from feedlift.catalog.feed import FILTERED_COLUMNS, PROPERTIES_SQL, RAW, filtered, state, table
from feedlift.catalog.registry import SQL, query, with_tables
from feedlift.catalog.warehouse import _EXAMPLES, _NUMBERED, _prompt_sql, top_examples
from feedlift.config import ModelParams
from feedlift.functions.rows import row_properties
from feedlift.functions.sql import create_functions
from feedlift.operators.generation import FunctionCompleter
from feedlift.operators.joins import collected_examples
from feedlift.operators.numbering import number_rows, pack_chunks
from feedlift.operators.table_functions import table_function
from feedlift.session import new_path
from feedlift.sources.tables import BucketedRows


@query(
    "prompts_by_sql",
    with_tables(
        RAW,
        _NUMBERED,
        _EXAMPLES,
        f"SELECT chunk_id, count(*) AS products, md5({_prompt_sql('title', 'English')}) AS title_hash, "
        f"md5({_prompt_sql('description', 'German')}) AS description_hash FROM numbered GROUP BY chunk_id",
    ),
)
def prompts_by_sql(spark: SparkSession, folder: str) -> DataFrame:
    """Both batch prompts by the SQL functions."""
    create_functions(spark)
    rows = filtered(spark, folder).select("id", row_properties(FILTERED_COLUMNS).alias("properties"))
    tables = {"chunks": pack_chunks(number_rows(rows, ["id"]), 10), "shown": collected_examples(top_examples(spark, folder))}
    return spark.sql(
        "SELECT chunk_id, CAST(size(ids) AS BIGINT) AS products, "
        "md5(titles_prompt('English', (SELECT examples FROM {shown}), properties)) AS title_hash, "
        "md5(descriptions_prompt('German', (SELECT examples FROM {shown}), properties)) AS description_hash FROM {chunks}",
        **tables,
    )


@query("supplemental_by_sql", SQL["supplemental_feed"])
def supplemental_by_sql(spark: SparkSession, folder: str) -> DataFrame:
    create_functions(spark)
    return spark.sql(
        "SELECT id, feed_text(title, true) AS structured_title, feed_text(description, true) AS structured_description "
        "FROM {state} WHERE title IS NOT NULL AND description IS NOT NULL",
        state=state(spark, folder),
    )


@query("parts_by_sql", SQL["feed_partition"])
def parts_by_sql(spark: SparkSession, folder: str) -> DataFrame:
    create_functions(spark)
    return spark.sql("SELECT id, id_part(id, 4) AS part FROM {feed}", feed=filtered(spark, folder))


@query("generate_text_by_sql", SQL["function_completions"])
def generate_text_by_sql(spark: SparkSession, folder: str) -> DataFrame:
    """A Python model as a table function over a query."""
    spark.udtf.register("generate_text", table_function(FunctionCompleter(shouting_model, concurrency=4)))
    return spark.sql(
        "SELECT id, response, error FROM generate_text(TABLE(SELECT p_partkey AS id, p_name AS prompt FROM {part}), "
        "temperature => 0.1, max_output_tokens => 2048)",
        part=table(spark, folder, "part"),
    )


def letter_counts(texts: list[str], params: ModelParams) -> list[list[float]]:
    """A stand-in for a model of embeddings."""
    return [[float(len(t)), float(t.count("e"))] for t in texts]


@query(
    "generate_embeddings_by_sql",
    "SELECT p_partkey AS id, CAST(length(p_name) AS DOUBLE) AS letters, "
    "CAST(length(p_name) - length(replace(p_name, 'e', '')) AS DOUBLE) AS e FROM part",
)
def generate_embeddings_by_sql(spark: SparkSession, folder: str) -> DataFrame:
    """The same for a model of embeddings."""
    model = FunctionCompleter(letter_counts, batch_size=50, answer_type="array<double>")
    spark.udtf.register("generate_embedding", table_function(model, "content", "embedding"))
    return spark.sql(
        "SELECT id, embedding[0] AS letters, embedding[1] AS e "
        "FROM generate_embedding(TABLE(SELECT p_partkey AS id, p_name AS content FROM {part}))",
        part=table(spark, folder, "part"),
    )


@query(
    "feed_parts_on_disk",
    with_tables(RAW, f"SELECT raw.id, {PROPERTIES_SQL} AS properties, "
                "CAST('0x' || substr(md5(raw.id), 1, 8) AS BIGINT) % 4 AS part FROM raw"),
)
def feed_parts_on_disk(spark: SparkSession, folder: str) -> DataFrame:
    """A feed stored by parts; each part is read from its own folders."""
    stored = BucketedRows(spark, new_path(spark, "parts"), 8)
    stored.create(filtered(spark, folder).select("id", row_properties(FILTERED_COLUMNS).alias("properties")))
    parts = [stored.part(4, p).withColumn("part", F.lit(p).cast("bigint")) for p in range(4)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).drop("bucket")
