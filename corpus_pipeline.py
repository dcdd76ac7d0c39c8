"""A corpus pipeline over ``documents``: each stage applies one operator to what the last one kept.

Stages take any frame with the columns ``doc_id`` and ``text``; other columns are carried along, whatever their names.
Documents with equal id and text are told apart by nothing, so one of them stays where only one may.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlift.llm import decontaminate, jaccard, line_dedup, quality
from feedlift.llm.frames import ROW, packed, small_batches, unpacked
from feedlift.llm.queries import table, tokenizer
from feedlift.session import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the isolation forest accept. The forest learns from labelled ones among them."""
    small_batches(spark)
    forest = quality.fit(docs, table(spark, sf_dir, "labels"))
    judged = quality.judged(packed(docs), forest, f"{ROW}.text")
    return unpacked(judged.filter("kept"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that others repeat. A column ``n_chars`` follows the text."""
    small_batches(spark)
    rows = line_dedup.with_bitmaps(packed(docs), line_dedup.keep_bitmaps(docs))
    text = F.when(F.col("keep_bitmap").isNull(), F.col(f"{ROW}.text")).otherwise(line_dedup.kept_text(f"{ROW}.text", "keep_bitmap"))
    row = F.col(ROW).withField("text", F.col("new_text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("keep_bitmap").isNull(), F.col(f"{ROW}.n_chars")).otherwise(F.length("new_text")).cast(docs.schema["n_chars"].dataType))
    return unpacked(rows.withColumn("new_text", text).select(row.alias(ROW)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    small_batches(spark)
    groups = jaccard.similar(docs).groupBy("key").agg(F.max("first").alias("first"), F.count("*").alias("copies"))
    rows = packed(docs).join(groups.filter("first").drop("first").hint("shuffle_hash"), "key")
    repeated = rows.filter("copies > 1").dropDuplicates(["key"])
    return unpacked(rows.filter("copies = 1").unionByName(repeated))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    small_batches(spark)
    leaks = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select("key").distinct()
    return unpacked(packed(docs).join(leaks, "key", "left_anti"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of what is left, encoded and decoded again."""
    small_batches(spark)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", tokenizer(spark).digests("text").alias("d")).select("doc_id", "d.*")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", encode),
]

#: Scores, hashes and token ids cannot be had in SQL; the tests run plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
