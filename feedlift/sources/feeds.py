"""Feeds, page texts, images and exports as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlift.functions.text import as_column
from feedlift.operators.numbering import number_rows
from feedlift.operators.selection import non_empty_rows

PAGE_TEXT_SCHEMA = "id string, content string"
# The image types a model accepts.
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}
# The first bytes of such files, in hexadecimal.
IMAGE_LEADS = {"89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg"}


def read_feed_csv(
    spark: SparkSession, path: str, required: Sequence[str] = (), *, multi_line: bool = False
) -> DataFrame:
    """A CSV feed as texts, header first, quotes doubled, wholly empty rows dropped.

    ``multi_line`` allows line breaks in cells, at the price that Spark cannot split a file.
    """
    feed = spark.read.csv(path, header=True, multiLine=multi_line, escape='"', inferSchema=False)
    missing = [c for c in required if c not in feed.columns]
    if missing:
        raise ValueError(f"the feed lacks the columns {missing}")
    return non_empty_rows(feed)


def read_feed_parquet(spark: SparkSession, path: str) -> DataFrame:
    return non_empty_rows(spark.read.parquet(path))


def with_feed_position(feed: DataFrame, column: str = "feed_pos") -> DataFrame:
    """Position of each row in its files, from 0. Only for a frame that still is a scan
    of files; other frames are numbered by columns of theirs."""
    located = feed.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    return number_rows(located, ["_file", "_block", "_line"], column, frozen=True).drop(
        "_file", "_block", "_line"
    )


def page_links(feed: DataFrame, id_col: str = "id", link_col: str = "web_url") -> DataFrame:
    return feed.select(as_column(id_col), as_column(link_col))


def image_links(feed: DataFrame, link_col: str = "image_link") -> DataFrame:
    return feed.select(as_column(link_col)).distinct()


def read_page_texts(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """Scraped texts ``id, content`` from CSV without a header, quotes doubled. ``multi_line``
    allows line breaks in texts, at the price that Spark cannot split a file."""
    return spark.read.schema(PAGE_TEXT_SCHEMA).csv(path, multiLine=multi_line, escape='"')


def write_page_texts(texts: DataFrame, path: str) -> None:
    """Scraped texts as such a CSV, each on one line."""
    texts.select(
        as_column("id").cast("string").alias("id"),
        F.translate("content", "\n\r", " ").alias("content"),
    ).write.mode("overwrite").csv(path, escape='"', quoteAll=True)


def read_images(
    spark: SparkSession, path: str, *, with_content: bool = False, mime_type: str | None = None
) -> DataFrame:
    """All files as ``uri, mime_type, length`` and, when asked, ``content``.

    The type is the given one, or that of the suffix; with the content also that of the leading
    bytes, for files without a known suffix. It is NULL for files that are no image a model takes.
    Spark does not open the files unless the content is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)\z", 1))
    types = F.create_map(*[F.lit(v) for pair in IMAGE_TYPES.items() for v in pair])
    kind = F.try_element_at(types, suffix)
    if with_content:
        for lead, found in IMAGE_LEADS.items():
            starts = F.hex(F.substring("content", 1, len(lead) // 2)) == lead
            kind = F.coalesce(kind, F.when(starts, F.lit(found)))
    columns = [
        F.col("path").alias("uri"),
        (kind if mime_type is None else F.lit(mime_type)).alias("mime_type"),
        "length",
        *(["content"] if with_content else []),
    ]
    return files.select(*columns)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """An export with a header, quotes doubled. Maps and arrays go out as JSON."""
    kinds = dict(df.dtypes)
    df.select(
        *[
            F.to_json(as_column(c)).alias(c)
            if kinds[c].startswith(("map", "array", "struct"))
            else as_column(c)
            for c in df.columns
        ]
    ).write.mode("overwrite").csv(path, header=True, escape='"')


def write_tsv(df: DataFrame, path: str) -> None:
    """A feed as tab-separated text. Its texts are quoted already, so the writer quotes
    nothing; tabs and line ends inside a cell become spaces."""
    cells = [
        F.regexp_replace(as_column(c).cast("string"), "[\t\n\r]", " ").alias(c) for c in df.columns
    ]
    df.select(*cells).write.mode("overwrite").csv(
        path, header=True, sep="\t", quote="", emptyValue=""
    )


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, sep="\t", quote="", inferSchema=False)
