"""The registered queries of this package; what each returns is told by its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlift.llm.frames import small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from feedlift.llm import quality

    docs = table(spark, folder, "documents").select("doc_id", "text")
    judged = quality.judged(docs, quality.fit(docs, table(spark, folder, "labels")))
    counts = [f"stats.{n}" for n in quality.COUNTS[:5]]
    return judged.select("doc_id", *counts, "base_failed", "kept", "stats.anomaly")


@query
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from feedlift.llm import line_dedup

    return line_dedup.line_digests(table(spark, folder, "documents"))


def tokenizer(spark: SparkSession):
    import public_tokenizers

    from feedlift.llm import bpe

    return bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs.select("doc_id", tokenizer(spark).digests("text").alias("d")).select("doc_id", "d.*")


@query
def op10_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    from feedlift.llm import jaccard

    groups = jaccard.similar(table(spark, folder, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id", "class_id")


@query
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from feedlift.llm import decontaminate

    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("key")


@query
def op2_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    from feedlift.llm import repeats

    return repeats.repeat_digests(table(spark, folder, "documents"))


@query
def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    from feedlift.llm import secrets

    return secrets.secret_digests(table(spark, folder, "documents"))


@query
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from feedlift.llm import language

    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = language.fit(docs.filter(~held_out))
    return language.predicted(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


@query
def op8_token_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents are counted; those labelled toxic are taken out; those labelled poor are counted anew by a
    later tokenizer; one batch is delivered twice."""
    from feedlift.llm import rollup
    from feedlift.llm.bitmap import bitmap_of, possible
    from feedlift.session import new_path

    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    labels = table(spark, folder, "labels")
    counts = rollup.Rollup(spark, new_path(spark, "rollup"))
    counts.apply("load", rollup.counts(docs, "words-1", rollup.words_1("text")))
    toxic = rollup.deletes(labels.filter("toxic = 1").select("doc_id"), "words-1")
    counts.apply("take-down", toxic)
    poor = labels.filter("quality = 0 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
    # Only texts that may be among them are shuffled.
    hashed = F.xxhash64(F.col("doc_id").cast("long"))
    some = docs.filter(possible(bitmap_of(poor.select(hashed.alias("key")), "key"), hashed))
    recounted = rollup.counts(some.join(poor, "doc_id", "left_semi"), "words-2", rollup.words_2("text"))
    moved = rollup.deletes(recounted, "words-1").unionByName(recounted)
    counts.apply("recount", moved)
    counts.apply("take-down", toxic)
    return counts.totals()


SQL["op8_token_rollup"] = r"""
WITH told AS (
  SELECT doc_id, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic, max(CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END) AS poor
  FROM labels GROUP BY doc_id
), kept AS (
  SELECT d.source, d.lang, CASE WHEN poor = 1 THEN 'words-2' ELSE 'words-1' END AS version,
    len(regexp_extract_all(coalesce(text, ''), CASE WHEN poor = 1 THEN '[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]' ELSE '[^\x20\x09-\x0D]+' END)) AS n
  FROM documents d LEFT JOIN told USING (doc_id)
  WHERE d.doc_id IS NOT NULL AND (coalesce(toxic, 0) = 0 OR coalesce(poor, 0) = 1)
)
SELECT source, lang, version, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM kept GROUP BY source, lang, version
"""

ORDER_KEY = 20_250_101


@query
def op4_training_order(spark: SparkSession, folder: str) -> DataFrame:
    from feedlift.llm import shards

    _, rows = shards.materialise_order(table(spark, folder, "documents"), ORDER_KEY)
    return rows


@query
def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    from feedlift.llm import resampling

    docs, target = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    drawn = resampling.resample(docs, target, resampling.Features(runs=1, buckets=10_000), seed=2024, percent=10, least_words=20)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op13_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    from feedlift.llm import topk

    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, 5, scale=256)


SQL["op13_exact_topk"] = """
WITH q AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@query
def op11_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from feedlift.llm import alignment

    files = [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.alignment(table(spark, folder, "documents"), alignment.load(*files, public_tokenizers.PATTERN))
