"""Queries of batched generation: selection, chunks, prompts, answers, state, feeds."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlift.catalog.feed import (
    ANSWER_LINES,
    FILTERED_COLUMNS,
    FILTERED_SQL,
    PROPERTIES_NO_ID_SQL,
    PROPERTIES_SQL,
    RAW,
    STATE,
    answered_chunks,
    filtered,
    key_of,
    products,
    raw_feed,
    state,
    table,
)
from feedlift.catalog.registry import SQL, query, with_tables
from feedlift.functions import prompts
from feedlift.functions.rows import row_context, row_properties
from feedlift.functions.sets import difference, intersection, union, word_set
from feedlift.functions.text import id_part, parse_number, trim_ws, utf16_length, words
from feedlift.operators import joins, quality, selection
from feedlift.operators.answers import answer_rows, first_answers
from feedlift.operators.export import full_feed, supplemental_feed
from feedlift.operators.generation import ExpressionCompleter, ReplayCompleter
from feedlift.operators.numbering import number_rows, pack_chunks, stream_chunks
from feedlift.operators.state import merge_answers
from feedlift.plans.batched import BatchOptions, batched_update, build_prompts, wanted_rows
from feedlift.session import new_path
from feedlift.sources import feeds
from feedlift.sources.tables import StateTable

# --- selection ---------------------------------------------------------------------

_SHIPPED = "SELECT DISTINCT CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_quantity = 50"


@query(
    "filter_by_ids",
    with_tables(RAW, f"SELECT {FILTERED_SQL} FROM raw WHERE id IN ({_SHIPPED})"),
)
def filter_by_ids(spark: SparkSession, folder: str) -> DataFrame:
    wanted = table(spark, folder, "lineitem").where("l_quantity = 50").select("l_partkey")
    return selection.by_ids(filtered(spark, folder), wanted)


@query(
    "filter_mid_clicks",
    with_tables(
        RAW,
        "span AS (SELECT quantile_disc(clicks, 0.0) AS lo, quantile_disc(clicks, 0.99) AS hi FROM raw)",
        f"SELECT {FILTERED_SQL} FROM raw, span "
        "WHERE clicks BETWEEN lo + 0.1 * (hi - lo) AND lo + 0.9 * (hi - lo)",
    ),
)
def filter_mid_clicks(spark: SparkSession, folder: str) -> DataFrame:
    return selection.mid_range(raw_feed(spark, folder), "clicks").select(*FILTERED_COLUMNS)


@query(
    "click_quantiles",
    with_tables(
        RAW,
        "q AS (SELECT quantile_disc(clicks, list_transform(range(101), lambda i: i / 100.0)) AS b "
        "FROM raw)",
        "SELECT CAST(unnest(range(101)) AS INTEGER) AS percent, unnest(b) AS clicks FROM q",
    ),
)
def click_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    return selection.quantiles(raw_feed(spark, folder), "clicks").select(
        F.posexplode("boundaries").alias("percent", "clicks")
    )


@query(
    "init_output",
    with_tables(
        RAW,
        "SELECT id, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS description, "
        "0 AS tries FROM raw",
    ),
)
def init_output(spark: SparkSession, folder: str) -> DataFrame:
    return selection.init_state(filtered(spark, folder))


@query(
    "pending_items",
    with_tables(RAW, STATE, "SELECT * FROM state WHERE title IS NULL AND tries < 3"),
)
def pending_items(spark: SparkSession, folder: str) -> DataFrame:
    return selection.pending(state(spark, folder), "title")


@query(
    "pending_by_ids",
    with_tables(RAW, STATE, f"SELECT * FROM state WHERE id IN ({_SHIPPED})"),
)
def pending_by_ids(spark: SparkSession, folder: str) -> DataFrame:
    wanted = table(spark, folder, "lineitem").where("l_quantity = 50").select("l_partkey")
    return wanted_rows(state(spark, folder), BatchOptions("title", ids=wanted))


@query(
    "feed_partition",
    with_tables(
        RAW, "SELECT id, CAST('0x' || substr(md5(id), 1, 8) AS BIGINT) % 4 AS part FROM raw"
    ),
)
def feed_partition(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of a split feed, put together again: a disjoint cover of all rows."""
    rows = filtered(spark, folder).select("id")
    parts = [
        selection.in_part(rows, 4, part).select("id", id_part("id", 4).alias("part"))
        for part in range(4)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "sample_batch",
    with_tables(
        RAW,
        f"SELECT id, {PROPERTIES_SQL} AS properties FROM raw ORDER BY md5('7:' || id), id LIMIT 600",
    ),
)
def sample_batch(spark: SparkSession, folder: str) -> DataFrame:
    rows = filtered(spark, folder).select(
        "id", row_properties(FILTERED_COLUMNS).alias("properties")
    )
    return selection.random_batch(rows, 600, 7)


@query(
    "sample_large_batch",
    "SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id "
    "FROM lineitem ORDER BY md5('7:' || id), id LIMIT 12000",
)
def sample_large_batch(spark: SparkSession, folder: str) -> DataFrame:
    """A batch beyond the size of a top-k, cut by distributed row numbers."""
    lines = table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id")
    )
    return selection.random_batch(lines, 12_000, 7)


@query(
    "nonempty_rows",
    "SELECT * FROM (SELECT CASE WHEN p_partkey % 6 = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR) END "
    "AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS title FROM part) "
    "WHERE id || COALESCE(title, '') <> ''",
)
def nonempty_rows(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    cells = table(spark, folder, "part").select(
        F.when(k % 6 == 0, "").otherwise(k.cast("string")).alias("id"),
        F.when(k % 3 != 0, F.col("p_name")).alias("title"),
    )
    return selection.non_empty_rows(cells)


@query("page_links", with_tables(RAW, "SELECT id, web_url FROM raw"))
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    return feeds.page_links(products(spark, folder))


@query(
    "image_links",
    "SELECT DISTINCT 'https://img/' || p_brand || '.png' AS image_link FROM part",
)
def image_links(spark: SparkSession, folder: str) -> DataFrame:
    shared = F.concat(F.lit("https://img/"), "p_brand", F.lit(".png")).alias("image_link")
    return feeds.image_links(table(spark, folder, "part").select(shared))


# --- text and set functions --------------------------------------------------------


@query(
    "text_measures",
    "SELECT doc_id, length(text) + length(regexp_replace(text, '[\\x{0}-\\x{FFFF}]', '', 'g')) "
    "AS utf16_units, "
    "len(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ0-9]+')) AS words, "
    "md5(trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(65279))) "
    "AS trimmed, "
    "COALESCE(TRY_CAST(NULLIF(regexp_extract(text, '^[\\s]*([+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+))', 1), '') "
    "AS DOUBLE), -1.0) AS leading_number FROM documents",
)
def text_measures(spark: SparkSession, folder: str) -> DataFrame:
    number = parse_number("text")
    return table(spark, folder, "documents").select(
        "doc_id",
        utf16_length("text").cast("bigint").alias("utf16_units"),
        F.size(words("text")).cast("bigint").alias("words"),
        F.md5(trim_ws("text")).alias("trimmed"),
        F.when(F.isnan(number), F.lit(-1.0)).otherwise(number).alias("leading_number"),
    )


_WORD_LISTS = (
    "SELECT id, regexp_extract_all(title, '[A-Za-z0-9_]+') AS a, "
    "regexp_extract_all(description, '[A-Za-z0-9_]+') AS b FROM raw"
)


@query(
    "word_sets",
    with_tables(
        RAW,
        f"lists AS ({_WORD_LISTS})",
        "sets AS (SELECT id, list_filter(a, lambda x, i: list_position(a, x) = i) AS a, "
        "list_filter(b, lambda x, i: list_position(b, x) = i) AS b FROM lists)",
        "SELECT id, "
        "array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), ' ') AS only_description, "
        "array_to_string(list_filter(a, lambda x: list_contains(b, x)), ' ') AS in_both, "
        "array_to_string(a || list_filter(b, lambda x: NOT list_contains(a, x)), ' ') AS in_any "
        "FROM sets",
    ),
)
def word_sets(spark: SparkSession, folder: str) -> DataFrame:
    rows = products(spark, folder).select(
        "id", word_set("title").alias("a"), word_set("description").alias("b")
    )
    a, b = F.col("a"), F.col("b")
    return rows.select(
        "id",
        F.array_join(difference(b, a), " ").alias("only_description"),
        F.array_join(intersection(a, b), " ").alias("in_both"),
        F.array_join(union(a, b), " ").alias("in_any"),
    )


# --- chunks and prompts ------------------------------------------------------------


@query(
    "number_and_chunk",
    with_tables(
        RAW,
        "SELECT id, row_number() OVER (ORDER BY id) - 1 AS row_id, "
        "(row_number() OVER (ORDER BY id) - 1) // 10 AS chunk_id FROM raw",
    ),
)
def number_and_chunk(spark: SparkSession, folder: str) -> DataFrame:
    numbered = number_rows(filtered(spark, folder).select("id"), ["id"])
    return numbered.select("id", "row_id", F.expr("row_id div 10").alias("chunk_id"))


@query(
    "pack_chunks",
    with_tables(
        RAW,
        f"numbered AS (SELECT id, {PROPERTIES_SQL} AS properties, "
        "(row_number() OVER (ORDER BY id) - 1) // 7 AS chunk_id FROM raw)",
        "SELECT chunk_id, string_agg(id, ',' ORDER BY id) AS ids, "
        "string_agg(properties, chr(10) ORDER BY id) AS properties FROM numbered GROUP BY chunk_id",
    ),
)
def pack_chunks_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = filtered(spark, folder).select(
        "id", row_properties(FILTERED_COLUMNS).alias("properties")
    )
    return pack_chunks(number_rows(rows, ["id"]), 7).select(
        "chunk_id",
        F.array_join("ids", ",").alias("ids"),
        F.array_join("properties", "\n").alias("properties"),
    )


@query("stream_chunks", SQL["pack_chunks"])
def stream_chunks_query(spark: SparkSession, folder: str) -> DataFrame:
    """The same from the stored order of the rows."""
    rows = filtered(spark, folder).select(
        "id", row_properties(FILTERED_COLUMNS).alias("properties")
    )
    return stream_chunks(number_rows(rows, ["id"]), 7).select(
        "chunk_id",
        F.array_join("ids", ",").alias("ids"),
        F.array_join("properties", "\n").alias("properties"),
    )


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _prompt_sql(target: str, language: str) -> str:
    """The batch prompt over ``numbered`` and ``examples`` as SQL."""
    w = prompts.BATCH_WORDING[target]
    parts = [
        _quote(w.task.replace("{language}", language) + w.example_inputs),
        "(SELECT string_agg(properties, chr(10) ORDER BY id) FROM examples)",
        _quote(w.example_outputs),
        f"(SELECT string_agg(id || ': ' || {target}, chr(10) ORDER BY id) FROM examples)",
        _quote(w.counter_examples + prompts.INPUT_CUE),
        "string_agg(properties, chr(10) ORDER BY id)",
        _quote(w.output_cue),
    ]
    return " || ".join(parts)


_NUMBERED = (
    f"numbered AS (SELECT id, {PROPERTIES_SQL} AS properties, "
    "(row_number() OVER (ORDER BY id) - 1) // 10 AS chunk_id FROM raw)"
)
_EXAMPLES = (
    f"examples AS (SELECT id, {PROPERTIES_NO_ID_SQL} AS properties, title, description FROM raw "
    "ORDER BY clicks DESC NULLS LAST, id LIMIT 3)"
)


def top_examples(spark: SparkSession, folder: str) -> DataFrame:
    best = selection.top_by(raw_feed(spark, folder), "clicks", 3)
    return joins.examples_from_feed(best.select(*FILTERED_COLUMNS))


def _prompts(spark: SparkSession, folder: str, target: str, language: str) -> DataFrame:
    rows = filtered(spark, folder).select(*FILTERED_COLUMNS)
    shown = top_examples(spark, folder)
    return build_prompts(rows, rows, shown, BatchOptions(target, language)).select(
        "chunk_id",
        F.size("ids").cast("bigint").alias("products"),
        F.md5("prompt").alias("prompt_hash"),
    )


for _target, _language in (("title", "English"), ("description", "German")):

    @query(
        f"pack_{_target}_prompts",
        with_tables(
            RAW,
            _NUMBERED,
            _EXAMPLES,
            f"SELECT chunk_id, count(*) AS products, md5({_prompt_sql(_target, _language)}) "
            "AS prompt_hash FROM numbered GROUP BY chunk_id",
        ),
    )
    def pack_prompts(
        spark: SparkSession, folder: str, target=_target, language=_language
    ) -> DataFrame:
        return _prompts(spark, folder, target, language)


@query("examples_top_clicks", with_tables(RAW, _EXAMPLES, "SELECT * FROM examples"))
def examples_top_clicks(spark: SparkSession, folder: str) -> DataFrame:
    return top_examples(spark, folder)


@query(
    "examples_joined",
    with_tables(
        RAW,
        f"SELECT id, {PROPERTIES_NO_ID_SQL} AS properties, upper(title) AS title, "
        f"lower(description) AS description FROM raw WHERE id IN ({_SHIPPED})",
    ),
)
def examples_joined(spark: SparkSession, folder: str) -> DataFrame:
    """Texts given for some ids, the rest from the feed."""
    texts = filter_by_ids(spark, folder).select(
        "id", F.upper("title").alias("title"), F.lower("description").alias("description")
    )
    return joins.examples_from_texts(texts, filtered(spark, folder))


@query(
    "examples_by_ids",
    with_tables(
        RAW,
        f"SELECT id, {PROPERTIES_NO_ID_SQL} AS properties, title, description FROM raw "
        f"WHERE id IN ({_SHIPPED})",
    ),
)
def examples_by_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Feed rows that serve as examples with the texts they have."""
    return joins.examples_from_feed(filter_by_ids(spark, folder))


@query(
    "examples_renamed",
    with_tables(
        RAW,
        "SELECT id, CAST(to_json({'name': title, 'maker': brand}) AS VARCHAR) AS properties, "
        "title, description FROM raw",
    ),
)
def examples_renamed(spark: SparkSession, folder: str) -> DataFrame:
    return joins.examples_from_feed(
        products(spark, folder), properties={"name": "title", "maker": "brand"}
    )


@query(
    "few_shot_block",
    with_tables(
        RAW,
        "best AS (SELECT id, 'Context: ' || CAST(to_json({'title': title, 'brand': brand}) AS VARCHAR) "
        "|| chr(10) || 'keys: brand | title' AS block FROM raw "
        "ORDER BY clicks DESC NULLS LAST, id LIMIT 3)",
        "SELECT CAST(count(*) AS INTEGER) AS examples, "
        "string_agg(block, chr(10) || chr(10) ORDER BY id) AS block FROM best",
    ),
)
def few_shot_block(spark: SparkSession, folder: str) -> DataFrame:
    """The three best clicked products as the few-shot section of a row prompt."""
    best = selection.top_by(raw_feed(spark, folder), "clicks", 3).select(
        "id", row_context(["title", "brand"]).alias("context"), F.lit("brand | title").alias("keys")
    )
    rows = F.array_sort(F.collect_list(F.struct("id", "context", "keys")))
    return best.agg(rows.alias("rows")).select(
        F.size("rows").alias("examples"), prompts.few_shot_block("rows", ["keys"]).alias("block")
    )


@query(
    "row_properties",
    with_tables(
        RAW,
        "SELECT id, CAST(to_json({'id': id, 'title': title, 'brand': NULLIF(brand, ''), "
        "'clicks': clicks}) AS VARCHAR) AS properties, "
        "CAST(to_json({'title': title, 'brand': NULLIF(brand, ''), 'clicks': clicks}) AS VARCHAR) "
        "AS bare FROM raw",
    ),
)
def row_properties_query(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["id", "title", "brand", "clicks"]
    rows = raw_feed(spark, folder).withColumn("brand", F.nullif("brand", F.lit("")))
    return rows.select(
        "id",
        row_properties(columns).alias("properties"),
        row_properties(columns, include_id=False).alias("bare"),
    )


@query(
    "context_json",
    "SELECT CAST(l_partkey AS VARCHAR) AS id, CAST(to_json({"
    "'l_partkey': CAST(l_partkey AS VARCHAR), 'l_orderkey': CAST(l_orderkey AS VARCHAR), "
    "'l_returnflag': l_returnflag}) AS VARCHAR) AS context FROM lineitem "
    f"WHERE CAST(l_partkey AS VARCHAR) IN ({_SHIPPED}) "
    "QUALIFY row_number() OVER (PARTITION BY l_partkey "
    "ORDER BY l_orderkey, l_linenumber, l_returnflag) = 1",
)
def context_json(spark: SparkSession, folder: str) -> DataFrame:
    """First row of each wanted id in a feed that repeats its ids."""
    lines = table(spark, folder, "lineitem")
    feed = lines.select(
        "l_partkey",
        "l_orderkey",
        "l_returnflag",
        F.struct("l_orderkey", "l_linenumber", "l_returnflag").alias("place"),
    )
    wanted = lines.where("l_quantity = 50").select("l_partkey")
    return joins.context_of_ids(feed, wanted, "place", "l_partkey")


# --- answers and state -------------------------------------------------------------

_FIRST = (
    "first AS (SELECT id, text FROM matched "
    "QUALIFY row_number() OVER (PARTITION BY id ORDER BY chunk_id, pos) = 1)"
)


@query(
    "parse_lines",
    with_tables(RAW, ANSWER_LINES, "SELECT chunk_id, CAST(pos AS INTEGER) AS pos, id, text FROM matched"),
)
def parse_lines(spark: SparkSession, folder: str) -> DataFrame:
    return answer_rows(answered_chunks(spark, folder))


@query("dedupe_answers", with_tables(RAW, ANSWER_LINES, _FIRST, "SELECT id, text FROM first"))
def dedupe_answers(spark: SparkSession, folder: str) -> DataFrame:
    return first_answers(answered_chunks(spark, folder))


@query(
    "merge_state",
    with_tables(
        RAW,
        STATE,
        ANSWER_LINES,
        _FIRST,
        "SELECT s.id, COALESCE(f.text, s.title) AS title, s.description, "
        "CAST(s.tries + CASE WHEN f.id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS tries "
        "FROM state s LEFT JOIN first f ON s.id = f.id",
    ),
)
def merge_state(spark: SparkSession, folder: str) -> DataFrame:
    answers = first_answers(answered_chunks(spark, folder))
    return merge_answers(state(spark, folder), answers, "title")


def prompt_reader(write: str) -> ExpressionCompleter:
    """A stand-in for a model that reads the products out of the prompt. It leaves out ids
    that end in 0 and gives nothing but the id for those that end in 1."""

    def answer(prompt: Column) -> Column:
        products = F.substring_index(prompt, prompts.INPUT_CUE, -1)
        pattern = F.lit('"id":"([^"]*)","title":"([^"]*)"')
        ids = F.regexp_extract_all(products, pattern, F.lit(1))
        titles = F.regexp_extract_all(products, pattern, F.lit(2))

        def line(i: Column, title: Column) -> Column:
            digit = i.cast("bigint") % 10
            text = F.upper(title) if write == "title" else F.concat(F.lit("All about "), title)
            return F.when(digit == 1, i).when(digit != 0, F.concat(i, F.lit(": "), text))

        found = F.filter(F.zip_with(ids, titles, line), lambda t: t.isNotNull())
        return F.array_join(found, "\n")

    return ExpressionCompleter(answer)


def run_batched(
    spark: SparkSession, folder: str, options: BatchOptions, start: DataFrame | None = None
) -> DataFrame:
    """A whole run of batched generation; the state after it."""
    inputs = filtered(spark, folder)
    state_table = StateTable(spark, new_path(spark, "state"))
    state_table.create(selection.init_state(inputs) if start is None else start)
    examples = top_examples(spark, folder)
    batched_update(state_table, inputs, examples, prompt_reader(options.target), options)
    return state_table.read()


@query(
    "batched_update_titles",
    with_tables(
        RAW,
        "SELECT id, CASE WHEN k % 10 > 1 THEN upper(title) END AS title, "
        "CAST(NULL AS VARCHAR) AS description, "
        "CAST(CASE k % 10 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 1 END AS INTEGER) AS tries FROM raw",
    ),
)
def batched_update_titles(spark: SparkSession, folder: str) -> DataFrame:
    """All rounds: bare answers are tried three times, omitted products never count."""
    return run_batched(spark, folder, BatchOptions("title"))


@query(
    "batched_update_descriptions",
    with_tables(
        RAW,
        STATE,
        "SELECT s.id, s.title, CASE WHEN s.description IS NULL AND tries < 3 AND k % 10 > 1 "
        "THEN 'All about ' || raw.title ELSE s.description END AS description, "
        "CAST(CASE WHEN s.description IS NULL AND tries < 3 AND k % 10 > 1 THEN tries + 1 "
        "WHEN s.description IS NULL AND tries < 3 AND k % 10 = 1 THEN 3 ELSE tries END AS INTEGER) "
        "AS tries FROM state s JOIN raw ON s.id = raw.id",
    ),
)
def batched_update_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """All rounds over a half-done state."""
    return run_batched(spark, folder, BatchOptions("description", "German"), state(spark, folder))


@query(
    "batched_update_by_ids",
    with_tables(
        RAW,
        STATE,
        f"wanted AS ({_SHIPPED})",
        "SELECT s.id, CASE WHEN s.id IN (SELECT * FROM wanted) AND k % 10 > 1 THEN upper(raw.title) "
        "ELSE s.title END AS title, s.description, CAST(tries + CASE WHEN s.id IN (SELECT * FROM wanted) "
        "AND k % 10 > 0 THEN 1 ELSE 0 END AS INTEGER) AS tries "
        "FROM state s JOIN raw ON s.id = raw.id",
    ),
)
def batched_update_by_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Products asked for by id are done once, whatever their state."""
    wanted = table(spark, folder, "lineitem").where("l_quantity = 50").select("l_partkey").distinct()
    options = replace(BatchOptions("title"), ids=wanted)
    return run_batched(spark, folder, options, state(spark, folder))


# --- sources joined to the feed ----------------------------------------------------


def page_contents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        F.col("page_id").cast("string").alias("id"), F.col("url").alias("content")
    )


def images(spark: SparkSession, folder: str) -> DataFrame:
    """An image file per product."""
    return filtered(spark, folder).select(
        F.concat(F.lit("gs://b/images/"), "id", F.lit(".png")).alias("uri"),
        F.concat(F.lit("picture of "), "title").alias("description"),
    )


_IMAGES = (
    "images AS (SELECT id || '.png' AS name, 'picture of ' || title AS image_description FROM raw)"
)


@query(
    "merge_sources",
    with_tables(
        RAW,
        _IMAGES,
        "SELECT raw.id, title, description, brand, category, url AS webpage_content, "
        "image_description FROM raw LEFT JOIN pages ON k = page_id "
        "LEFT JOIN images ON image_link = 'https://img/' || name",
    ),
)
def merge_sources(spark: SparkSession, folder: str) -> DataFrame:
    return joins.merge_sources(
        products(spark, folder),
        ["title", "description", "brand", "category"],
        page_contents(spark, folder),
        images(spark, folder),
    )


@query(
    "image_join_basename",
    with_tables(
        RAW,
        _IMAGES,
        "SELECT id, image_link, image_description FROM raw "
        "LEFT JOIN images ON image_link = 'https://img/' || name",
    ),
)
def image_join_basename(spark: SparkSession, folder: str) -> DataFrame:
    feed = products(spark, folder).select("id", "image_link")
    return joins.join_images_by_name(feed, images(spark, folder))


@query(
    "image_join_contains",
    with_tables(
        RAW,
        _IMAGES,
        "SELECT id, image_link, image_description FROM raw "
        "LEFT JOIN images ON image_link LIKE '%' || name || '%'",
    ),
)
def image_join_contains(spark: SparkSession, folder: str) -> DataFrame:
    """File names that are contained in the link of other products hit those as well."""
    feed = products(spark, folder).select("id", "image_link")
    return joins.join_images_containing(feed, images(spark, folder))


@query(
    "image_join_wildcards",
    with_tables(
        RAW,
        "links AS (SELECT id, 'https://img/' || brand || '/' || id || 'x_front.png' AS image_link FROM raw)",
        "names AS (SELECT '_' || id || '%front.png' AS name, title AS image_description FROM raw)",
        "SELECT id, image_link, image_description FROM links "
        "LEFT JOIN names ON image_link LIKE '%' || name || '%'",
    ),
)
def image_join_wildcards(spark: SparkSession, folder: str) -> DataFrame:
    """File names with the wildcards of LIKE in them."""
    feed = products(spark, folder).select(
        "id",
        F.concat(
            F.lit("https://img/"), "brand", F.lit("/"), "id", F.lit("x_front.png")
        ).alias("image_link"),
    )
    files = filtered(spark, folder).select(
        F.concat(F.lit("gs://b/_"), "id", F.lit("%front.png")).alias("uri"),
        F.col("title").alias("description"),
    )
    return joins.join_images_containing(feed, files)


# --- feeds -------------------------------------------------------------------------

_WRAP = "'trained_algorithmic_media:\"' || replace({0}, '\"', '\"\"') || '\"'"


@query(
    "supplemental_feed",
    with_tables(
        RAW,
        STATE,
        f"SELECT id, {_WRAP.format('title')} AS structured_title, "
        f"{_WRAP.format('description')} AS structured_description "
        "FROM state WHERE title IS NOT NULL AND description IS NOT NULL",
    ),
)
def supplemental(spark: SparkSession, folder: str) -> DataFrame:
    return supplemental_feed(state(spark, folder))


def _best(new: str, old: str) -> str:
    return (
        f"CASE WHEN {new} IS NULL THEN '' ELSE 'trained_algorithmic_media' END || ':\"' || "
        f"replace(COALESCE({new}, {old}), '\"', '\"\"') || '\"'"
    )


@query(
    "full_feed",
    with_tables(
        RAW,
        STATE,
        "SELECT raw.id, condition, brand, category, size, image_link, web_url, clicks, "
        f"{_best('s.title', 'raw.title')} AS structured_title, "
        f"{_best('s.description', 'raw.description')} AS structured_description "
        "FROM raw LEFT JOIN (SELECT * FROM state WHERE tries < 4) s ON raw.id = s.id",
    ),
)
def full(spark: SparkSession, folder: str) -> DataFrame:
    """The state lacks some products, whose texts stay as they are."""
    return full_feed(raw_feed(spark, folder), state(spark, folder).where("tries < 4"))


# --- semantic drift ----------------------------------------------------------------


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "embedding")


@query(
    "distance_histogram",
    "SELECT ceil(list_cosine_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) "
    "* 10) / 10 AS distance_bucket, count(*) AS products FROM embeddings a "
    "JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings) "
    "GROUP BY 1",
)
def distance_histogram(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _vectors(spark, folder)
    total = vectors.agg(F.count("*")).scalar()
    new = vectors.select(F.col("vec_id").alias("id"), "embedding")
    old = vectors.select(((F.col("vec_id") - 1 + total) % total).alias("id"), "embedding")
    return quality.distance_histogram(quality.embedding_distances(old, new))


@query(
    "semantic_drift",
    with_tables(
        RAW,
        STATE,
        "sample AS (SELECT s.id, k FROM state s JOIN raw ON s.id = raw.id WHERE s.title IS NOT NULL "
        "ORDER BY md5('3:' || s.id), s.id LIMIT 1000)",
        "n AS (SELECT count(*) AS n FROM embeddings)",
        "SELECT ceil(list_cosine_distance(CAST(a.embedding AS DOUBLE[]), "
        "CAST(b.embedding AS DOUBLE[])) * 10) / 10 AS distance_bucket, count(*) AS products "
        "FROM sample, n JOIN embeddings a ON a.vec_id = k % n "
        "JOIN embeddings b ON b.vec_id = (k + 7) % n GROUP BY 1",
    ),
)
def semantic_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Old and new titles get stored vectors, found by their text and id."""
    vectors = _vectors(spark, folder)
    total = vectors.agg(F.count("*")).scalar()

    def stored(ids: DataFrame, shift: int) -> DataFrame:
        place = (key_of("id") + shift) % total
        return ids.withColumn("_vec", place).join(vectors, F.col("_vec") == F.col("vec_id")).select(
            "id", "content", F.col("embedding").alias("response")
        )

    texts = state(spark, folder).select("id", F.col("title").alias("content")).where("content is not null")
    old_texts = filtered(spark, folder).select("id", F.col("title").alias("content"))
    replay = ReplayCompleter(
        stored(old_texts, 0).unionByName(stored(texts, 7)), ["id", "content"]
    )
    return quality.semantic_drift(
        state(spark, folder), filtered(spark, folder), replay, size=1000, seed=3
    )
