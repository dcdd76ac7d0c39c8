"""Frames of documents: what identifies a row, and rows carried along whatever their columns are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "row"


#: Rows in a batch that goes to Python: whole texts travel, and two tasks share an executor's memory.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let batches of texts be small, unless the session asks for smaller ones still."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells rows apart: id and text. Rows equal in both are the same document. The hash depends on the type, so
    both are taken as :func:`keyed` gives them."""
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return F.xxhash64(doc_id.isNull(), doc_id, text.isNull(), text)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, key``: the columns the operators work on, free of clashing names."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.withColumn("key", row_key())


def packed(docs: DataFrame) -> DataFrame:
    """All columns in one struct named ``row``, beside ``key``: nothing added later can clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW)
    return docs.select(row).withColumn("key", row_key(f"{ROW}.doc_id", f"{ROW}.text"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select(f"{ROW}.*")


def apart(df: DataFrame, *results: str) -> DataFrame:
    """``df`` with the columns that are named like a result (in any case) renamed to ``input_`` and their name."""
    taken = {c.lower() for c in df.columns} | {r.lower() for r in results}
    names = []
    for c in df.columns:
        if c.lower() in {r.lower() for r in results}:
            c = f"input_{c}"
            while c.lower() in taken:
                c = f"input_{c}"
            taken.add(c.lower())
        names.append(c)
    return df.toDF(*names)


def buckets(df: DataFrame, factor: int = 1) -> int:
    """Partitions for a frame that is dealt out by range: those of the session's shuffles."""
    return factor * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
