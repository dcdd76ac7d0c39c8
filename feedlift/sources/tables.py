"""Result tables on plain parquet.

Parquet has no MERGE, and a table cannot be overwritten as a whole while it is read. A result that is
replaced as a whole goes to a new folder per write. The state of batched generation lies in buckets by id, one folder
each, so a round of generation reads and replaces only the buckets of its products (dynamic partition overwrite).

Several writers of one table, and the clearing up of old versions, are left to table formats and retention rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlift.functions.text import as_column, id_part
from feedlift.session import file_names


class VersionedTable:
    """A table of which every write is a folder of its own; readers take the last one that is complete."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark = spark
        self._path = path.rstrip("/")

    def _versions(self, pattern: str) -> list[int]:
        names = file_names(self._spark, f"{self._path}/{pattern}")
        return sorted(int(m[1]) for m in (re.search(r"/version=(\d+)", n) for n in names) if m)

    def latest(self) -> int | None:
        """Number of the last complete version."""
        done = self._versions("version=*/_SUCCESS")
        return done[-1] if done else None

    def read(self, version: int | None = None) -> DataFrame:
        """A version, the last one by default."""
        done = self._versions("version=*/_SUCCESS")
        if not done or (version is not None and version not in done):
            raise FileNotFoundError(f"{self._path} has no version {version or ''}")
        return self._spark.read.parquet(f"{self._path}/version={version or done[-1]}")

    def write(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as the next version and return it as read back."""
        begun = self._versions("version=*")
        version = begun[-1] + 1 if begun else 1
        df.write.parquet(f"{self._path}/version={version}")
        return self.read(version)

    def clear(self) -> DataFrame:
        """An empty version of the same schema."""
        return self.write(self.read().limit(0))


BUCKET = "bucket"
_SILENT = "silent_in"


class BucketedRows:
    """Rows in ``buckets`` folders by a hash of their id. Choose the number so that a bucket holds about as many
    products as a round takes."""

    def __init__(self, spark: SparkSession, path: str, buckets: int) -> None:
        self._spark = spark
        self._path = f"{path.rstrip('/')}/buckets-{buckets}"
        self.buckets = buckets
        self._schema: T.StructType | None = None

    def bucket_of(self, id_col: Column | str = "id") -> Column:
        """The bucket of an id. A part of a feed (:func:`selection.in_part`) is whole buckets if the number of parts
        divides that of buckets."""
        return F.coalesce(id_part(as_column(id_col), self.buckets), F.lit(0)).cast("int")

    def create(self, df: DataFrame) -> None:
        """All rows; the schema is kept beside them, so that empty tables can be read."""
        self._schema = None
        df.limit(0).write.mode("overwrite").parquet(f"{self._path}/schema")
        self._write(df, "static")

    def replace(self, df: DataFrame) -> None:
        """Put ``df`` in place of the buckets its rows are in. It may be made from these buckets."""
        self._write(df, "dynamic")

    def _write(self, df: DataFrame, how: str) -> None:
        # Rows of a bucket side by side; a large bucket is spread over tasks.
        rows = df.withColumn(BUCKET, self.bucket_of()).hint("rebalance", F.col(BUCKET))
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", how)
        writer.partitionBy(BUCKET).parquet(f"{self._path}/rows")

    def rows(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of all buckets, or of some that have rows: no other folder is listed or read. With the column
        ``bucket``."""
        self._schema = self._schema or self._spark.read.parquet(f"{self._path}/schema").schema
        whole = T.StructType([*self._schema.fields, T.StructField(BUCKET, T.IntegerType())])
        base = f"{self._path}/rows"
        paths = [base] if buckets is None else [f"{base}/{BUCKET}={b}" for b in sorted(buckets)]
        if not paths:
            return self._spark.createDataFrame([], whole)
        return self._spark.read.schema(whole).option("basePath", base).parquet(*paths)


    def part(self, parts: int, part: int) -> DataFrame:
        """The rows of one part of a feed, from the folders of that part."""
        if self.buckets % parts:
            raise ValueError(f"{parts} parts do not divide {self.buckets} buckets")
        return self.rows().where(F.col(BUCKET) % parts == part)


class StateTable:
    """The state of batched generation in buckets, and beside it all answers as they came, a folder for each run and round."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 8) -> None:
        self._spark = spark
        self._answers = f"{path.rstrip('/')}/answers"
        self._rows = BucketedRows(spark, path, buckets)

    @property
    def buckets(self) -> int:
        return self._rows.buckets

    def bucket_of(self, id_col: Column | str = "id") -> Column:
        return self._rows.bucket_of(id_col)

    def create(self, df: DataFrame) -> None:
        """Begin with these rows."""
        self._rows.create(df.withColumn(_SILENT, F.lit(None).cast("string")))

    def read(self) -> DataFrame:
        """The state as of now."""
        return self._rows.rows().drop(BUCKET, _SILENT)

    def rows(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The state of some buckets, with ``bucket`` and ``silent_in``, the run that last asked for a product in vain."""
        return self._rows.rows(buckets)

    def part(self, parts: int, part: int) -> DataFrame:
        """The state of one part, from its own buckets."""
        return self._rows.part(parts, part)

    def replace(self, df: DataFrame) -> None:
        """New rows in place of those of their buckets."""
        self._rows.replace(df.drop(BUCKET))

    def save_answers(self, answers: DataFrame, run: str, round_no: int) -> DataFrame:
        """Keep the answers of a round, errors included; they are paid for, whatever becomes of the state. Returned as
        read back."""
        path = f"{self._answers}/run={run}/round={round_no}"
        answers.write.parquet(path)
        return self._spark.read.schema(answers.schema).parquet(path)

    def answers(self) -> DataFrame:
        """All answers so far: ``id, target, text, error, named, run, round``."""
        kinds = "id string, target string, text string, error string, named boolean, run string, round int"
        if not file_names(self._spark, f"{self._answers}/run=*"):
            return self._spark.createDataFrame([], kinds)
        return self._spark.read.schema(kinds).parquet(self._answers)
