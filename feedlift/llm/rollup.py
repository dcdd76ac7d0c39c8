"""Token counts (8): rollups kept up to date by signed deltas.

A batch of changes holds, for documents and tokenizer versions, a new count (an insert, or a revision of an
earlier count) or a delete. Against the ledger of earlier batches each change becomes signed rows: what was
counted before goes out with -1, what counts now comes in with +1. Totals by source, language and
tokenizer version are sums of signed rows, so each batch adds only its own small sums.

A batch is written to a folder of its own attempt, and counts from the moment its commit record, which names
that folder, is there. A batch id that is committed already is not applied again, so a batch may be
delivered any number of times; an attempt that was lost leaves files that nobody reads. One
writer at a time: the record is written with ``errorifexists``, and the loser of a race fails. Should both have
looked before either wrote, one of the two attempts counts.

Within a batch one change per (document, version) has effect: counts go before deletes, and of several counts
the largest has it (then the greatest source and language). A delete of something never counted, or deleted before, changes nothing.
Changes with a null id, version or count are dropped, as no later batch could take them back; null sources and
languages are groups like others. An empty batch commits and adds nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGES = "doc_id long, version string, source string, lang string, n_tokens long, deleted boolean"
_LEDGER = "doc_id long, version string, source string, lang string, n_tokens long, sign int"
_SUMS = "source string, lang string, version string, n_docs long, n_tokens long"
_COMMIT = "batch_id string, attempt string, place long"
_GROUP = ("source", "lang", "version")


def words_1(text: Column | str) -> Column:
    """Tokens of version ``words-1``: words between ASCII white space; of null 0."""
    return _matches(text, r"[^\x20\x09-\x0D]+")


def words_2(text: Column | str) -> Column:
    """Tokens of version ``words-2``: runs of ASCII letters and digits, and every other character that is no
    ASCII white space; of null 0."""
    return _matches(text, r"[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]")


def _matches(text: Column | str, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(pattern)), F.lit(0)).cast("long")


class Rollup:
    """Rollups and their ledger in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        at = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._path}/{name}")
        return at.getFileSystem(self._spark._jsc.hadoopConfiguration()).exists(at)

    def commits(self) -> list[tuple[str, str]]:
        """(batch, attempt) in order of commit. One row per batch comes to the driver."""
        if not self._exists("commits"):
            return []
        rows = self._spark.read.schema(_COMMIT).option("recursiveFileLookup", "true").parquet(f"{self._path}/commits").collect()
        # Two writers may both have found no record of a batch; one attempt of it counts.
        first: dict[str, str] = {}
        for r in sorted(rows, key=lambda r: (r["place"], r["attempt"])):
            first.setdefault(r["batch_id"], r["attempt"])
        return list(first.items())

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self._path}/{kind}/{attempt}" for _, attempt in self.commits()]
        return self._spark.read.schema(schema).parquet(*paths) if paths else self._spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """Signed rows of all committed batches."""
        return self._read("ledger", _LEDGER)

    def counted(self) -> DataFrame:
        """What counts now, a row per document and version."""
        kinds = ("doc_id", "version", "source", "lang", "n_tokens")
        return self.ledger().groupBy(*kinds).agg(F.sum("sign").alias("sign")).filter("sign > 0").drop("sign")

    def totals(self) -> DataFrame:
        """``source, lang, version, n_docs, n_tokens`` of the groups that have documents."""
        sums = self._read("sums", _SUMS).groupBy(*_GROUP)
        return sums.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0")

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch of :data:`CHANGES`; False if it is committed already."""
        if not batch_id or not all(c.isalnum() or c in "-_." for c in batch_id):
            raise ValueError("a batch id has letters, digits, '-', '_' and '.' only")
        done = self.commits()
        if batch_id in (b for b, _ in done):
            return False
        attempt = f"{batch_id}-{uuid.uuid4().hex}"
        self._signed(changes).write.parquet(f"{self._path}/ledger/{attempt}")
        rows = self._spark.read.schema(_LEDGER).parquet(f"{self._path}/ledger/{attempt}")
        sums = rows.groupBy(*_GROUP).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        sums.write.parquet(f"{self._path}/sums/{attempt}")
        record = self._spark.createDataFrame([(batch_id, attempt, len(done))], _COMMIT)
        record.coalesce(1).write.mode("errorifexists").parquet(f"{self._path}/commits/{batch_id}")
        return True

    def _signed(self, changes: DataFrame) -> DataFrame:
        changes = changes.filter("doc_id is not null and version is not null and (coalesce(deleted, false) or n_tokens is not null)")
        # Booleans sort false first: a count is more than a delete.
        word = F.struct((~F.coalesce("deleted", F.lit(False))).alias("lives"), "n_tokens", "source", "lang")
        last = changes.groupBy("doc_id", "version").agg(F.max(word).alias("w"))
        last = last.select("doc_id", "version", F.col("w.source").alias("source"), F.col("w.lang").alias("lang"), F.col("w.n_tokens").alias("n_tokens"), F.col("w.lives").alias("lives"))
        before = self.counted().join(last.select("doc_id", "version"), ["doc_id", "version"], "left_semi")
        out = before.withColumn("sign", F.lit(-1))
        now = last.filter("lives").drop("lives").withColumn("sign", F.lit(1))
        # What stays as it is cancels out.
        kinds = ("doc_id", "version", "source", "lang", "n_tokens")
        both = now.unionByName(out).groupBy(*kinds).agg(F.sum("sign").cast("int").alias("sign"))
        return both.filter("sign <> 0")


def counts(docs: DataFrame, version: str, n_tokens: Column) -> DataFrame:
    """Changes that count ``docs`` (doc_id, source, lang, text) under a tokenizer version."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(version).alias("version"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), n_tokens.alias("n_tokens"), F.lit(False).alias("deleted"),
    )


def deletes(ids: DataFrame, version: str) -> DataFrame:
    """Changes that take the documents of ``ids`` (doc_id) out of a version."""
    none = F.lit(None).cast("string")
    return ids.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(version).alias("version"), none.alias("source"), none.alias("lang"),
        F.lit(None).cast("long").alias("n_tokens"), F.lit(True).alias("deleted"),
    )
