"""A product feed made of the test tables, and the same feed as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlift.operators.numbering import number_rows, pack_chunks
from feedlift.operators.selection import init_state


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def products(spark: SparkSession, folder: str) -> DataFrame:
    """One product per part; brand and size have gaps."""
    key = F.col("p_partkey")
    name, kind, brand = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    size = F.col("p_size").cast("string")
    text = F.concat(
        name, F.lit(" of type "), kind, F.lit(". Made by "), brand, F.lit(". Size "), size, F.lit(".")
    )
    return table(spark, folder, "part").select(
        key.cast("string").alias("id"),
        name.alias("title"),
        text.alias("description"),
        F.lit("new").alias("condition"),
        F.when(key % 7 == 0, F.lit("")).otherwise(brand).alias("brand"),
        kind.alias("category"),
        F.when(key % 5 == 0, F.lit("")).otherwise(size).alias("size"),
        F.concat(F.lit("https://img/"), key.cast("string"), F.lit(".png")).alias("image_link"),
        F.concat(F.lit("https://shop/"), key.cast("string")).alias("web_url"),
    )


def raw_feed(spark: SparkSession, folder: str) -> DataFrame:
    """The products with their clicks, counted from the order lines."""
    clicks = (
        table(spark, folder, "lineitem")
        .groupBy("l_partkey")
        .agg(F.count("*").alias("clicks"))
    )
    sold = clicks.select(F.col("l_partkey").cast("string").alias("id"), "clicks")
    return products(spark, folder).join(sold, "id", "left")


RAW = """raw AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey AS k, p_name AS title,
    p_name || ' of type ' || p_type || '. Made by ' || p_brand || '. Size '
      || CAST(p_size AS VARCHAR) || '.' AS description,
    'new' AS condition,
    CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS brand,
    p_type AS category,
    CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS size,
    'https://img/' || CAST(p_partkey AS VARCHAR) || '.png' AS image_link,
    'https://shop/' || CAST(p_partkey AS VARCHAR) AS web_url,
    c.clicks
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS clicks FROM lineitem GROUP BY 1) c
    ON p_partkey = l_partkey)"""

FILTERED_COLUMNS = ["id", "title", "description", "condition", "brand", "category"]


def filtered(spark: SparkSession, folder: str) -> DataFrame:
    """The fields that go into prompts."""
    return products(spark, folder).select(*FILTERED_COLUMNS)


FILTERED_SQL = ", ".join(FILTERED_COLUMNS)

# JSON of a filtered row, with and without its id.
PROPERTIES_SQL = (
    "CAST(to_json({" + ", ".join(f"'{c}': {c}" for c in FILTERED_COLUMNS) + "}) AS VARCHAR)"
)
PROPERTIES_NO_ID_SQL = (
    "CAST(to_json({" + ", ".join(f"'{c}': {c}" for c in FILTERED_COLUMNS[1:]) + "}) AS VARCHAR)"
)


def key_of(c: Column | str = "id") -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def state(spark: SparkSession, folder: str) -> DataFrame:
    """A half-done output state."""
    k = key_of()
    return init_state(filtered(spark, folder)).select(
        "id",
        F.when(k % 3 != 0, F.concat(F.lit('New "'), "id", F.lit('" title'))).alias("title"),
        F.when(k % 4 != 0, F.concat(F.lit("New text "), "id")).alias("description"),
        (k % 5).cast("int").alias("tries"),
    )


STATE = """state AS (
  SELECT id,
    CASE WHEN k % 3 <> 0 THEN 'New "' || id || '" title' END AS title,
    CASE WHEN k % 4 <> 0 THEN 'New text ' || id END AS description,
    CAST(k % 5 AS INTEGER) AS tries
  FROM raw)"""


def answered_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """``chunk_id, ids, response``: ten products per chunk, with all the ways an answer goes
    wrong, by the last digit of the id; every eleventh chunk has no answer."""
    rows = filtered(spark, folder).select("id", F.col("title").alias("properties"))
    chunks = pack_chunks(number_rows(rows, ["id"]), 10)

    def lines(i: Column, name: Column) -> Column:
        digit = i.cast("bigint") % 10
        good = F.concat(i, F.lit(": "), name)
        return (
            F.when(digit == 0, F.array().cast("array<string>"))
            .when(digit == 1, F.array(i))
            .when(digit == 2, F.array(F.concat(F.lit("x"), good)))
            .when(digit == 3, F.array(good, F.concat(good, F.lit(" again"))))
            .when(digit == 4, F.array(F.concat(good, F.lit("\r"))))
            .when(digit == 5, F.array(F.concat(i, F.lit(": "))))
            .otherwise(F.array(good))
        )

    answer = F.array_join(F.flatten(F.zip_with("ids", "properties", lines)), "\n")
    return chunks.select(
        "chunk_id", "ids", F.when(F.col("chunk_id") % 11 != 0, answer).alias("response")
    )


# Lines of the answered chunks: chunk_id, pos, line, ids.
ANSWER_LINES = """numbered AS (
  SELECT id, k, title, (row_number() OVER (ORDER BY id) - 1) // 10 AS chunk_id FROM raw),
chunks AS (
  SELECT chunk_id, list(id ORDER BY id) AS ids,
    CASE WHEN chunk_id % 11 = 0 THEN list(id ORDER BY id)
    ELSE string_split(string_agg(CASE k % 10
      WHEN 1 THEN id
      WHEN 2 THEN 'x' || id || ': ' || title
      WHEN 3 THEN id || ': ' || title || chr(10) || id || ': ' || title || ' again'
      WHEN 4 THEN id || ': ' || title || chr(13)
      WHEN 5 THEN id || ': '
      ELSE id || ': ' || title END, chr(10) ORDER BY id) FILTER (k % 10 <> 0), chr(10)) END AS lines
  FROM numbered GROUP BY chunk_id),
lines AS (
  SELECT chunk_id, ids, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM chunks),
answers AS (
  SELECT chunk_id, pos, ids,
    CASE WHEN strpos(line, ': ') > 1 THEN split_part(line, ': ', 1)
         WHEN line <> '' AND strpos(line, ':') = 0 THEN line END AS id,
    CASE WHEN strpos(line, ': ') > 1 THEN substr(line, strpos(line, ': ') + 2) END AS text
  FROM lines),
matched AS (
  SELECT chunk_id, pos, id, text FROM answers WHERE list_contains(ids, id))"""
