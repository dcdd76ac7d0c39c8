"""Queries of the row-by-row review: answers, attributes, words, scores, gates, exports."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlift.catalog.feed import RAW, key_of, products, table
from feedlift.catalog.registry import query, with_tables
from feedlift.config import DescriptionSettings, FeedConfig, TitleSettings
from feedlift.functions.scoring import compliance_status
from feedlift.functions.text import bind, trim_ws, utf16_length
from feedlift.operators import review as steps
from feedlift.operators import selection
from feedlift.operators.export import attribute_keys, export_approved, structured_export, write_wide_export
from feedlift.operators.generation import ExpressionCompleter, generate_text
from feedlift.operators.labels import with_description_answer, with_title_answer
from feedlift.plans.review_feed import review_feed
from feedlift.session import materialise, new_path

CONFIG = FeedConfig(
    title=TitleSettings(prompt="Write a title.\n\n", allowed_words="Size, , deluxe"),
    description=DescriptionSettings(prompt="Write a description.\n\n", min_approval_score=0.5),
)
FEED_COLUMNS = [
    "id",
    "title",
    "description",
    "condition",
    "brand",
    "category",
    "size",
    "image_link",
    "web_url",
]


def feed(spark: SparkSession, folder: str) -> DataFrame:
    return products(spark, folder).select(*FEED_COLUMNS)


def _context(prompt: Column) -> Column:
    """The product a row prompt shows, read back from its JSON."""
    text = F.regexp_extract(prompt, r"(?s)Context: (\{.*?\})\n\n", 1)
    return F.from_json(text, "map<string,string>")


# A stand-in for a model writes six labelled lines from the product it is shown. What it
# gets right depends on the remainder of the id by 8: 0 echoes the name of an attribute,
# 1 leaves out the replaced keys, 2 the title, 3 invents a word, 4 drops one, 5 replaces
# the size, 6 adds the brand, 7 adds brand and size. Every third answer has bold labels.
def title_model(prompt: Column) -> Column:
    return bind(_context(prompt), _title_answer)


def _title_answer(row: Column) -> Column:
    k = row["id"].cast("bigint")
    kind = k % 8
    title = row["title"]
    maker = F.regexp_extract(row["description"], r"Made by ([^ .]+)\.", 1)
    size = F.regexp_extract(row["description"], r"Size ([0-9]+)\.", 1)
    first = F.substring_index(title, " ", 1)
    bold = F.when(k % 3 == 0, "**").otherwise("")

    def line(label: str, value: Column) -> Column:
        return F.concat(bold, F.lit(label), bold, F.lit(" "), value, F.lit("\n"))

    old_keys = F.when(kind.isin(6, 7), "product type").otherwise("brand | product type")
    keys = (
        F.when(kind == 3, "brand | product type | Finish")
        .when(kind.isin(5, 7), "brand | product type | size")
        .otherwise("brand | product type")
    )
    values = (
        F.when(kind == 0, F.concat(F.lit("Brand | "), title))
        .when(kind == 3, F.concat(maker, F.lit(" | "), title, F.lit(" | Glossy")))
        .when(kind == 4, F.concat(maker, F.lit(" | "), first))
        .when(kind == 5, F.concat(maker, F.lit(" | "), title, F.lit(" | "), size, F.lit(",")))
        .when(kind == 7, F.concat(maker, F.lit(" | "), title, F.lit(" | "), size))
        .otherwise(F.concat(maker, F.lit(" | "), title))
    )
    replaced = F.when(kind == 5, " SIZE ,").otherwise("")
    return F.concat(
        line("Product attribute keys in original title:", old_keys),
        line("Product category:", row["category"]),
        line("Product attribute keys:", keys),
        line("Product attribute values:", values),
        F.when(kind == 1, F.lit("")).otherwise(line("Replaced keys:", replaced)),
        F.when(kind == 2, F.lit("")).otherwise(
            line("Generated title:", F.concat(maker, F.lit(" "), title))
        ),
    )


_BOLD = "CASE WHEN k % 3 = 0 THEN '**' ELSE '' END"


def _sql_line(label: str, value: str) -> str:
    return f"({_BOLD} || '{label}' || {_BOLD} || ' ' || {value} || chr(10))"


_MAKER = "regexp_extract(description, 'Made by ([^ .]+)\\.', 1)"
_SIZE = "regexp_extract(description, 'Size ([0-9]+)\\.', 1)"

TITLE_ANSWERS = f"""title_answers AS (
  SELECT *, {_sql_line("Product attribute keys in original title:",
    "CASE WHEN k % 8 IN (6, 7) THEN 'product type' ELSE 'brand | product type' END")}
  || {_sql_line("Product category:", "category")}
  || {_sql_line("Product attribute keys:",
    "CASE k % 8 WHEN 3 THEN 'brand | product type | Finish' "
    "WHEN 5 THEN 'brand | product type | size' WHEN 7 THEN 'brand | product type | size' "
    "ELSE 'brand | product type' END")}
  || {_sql_line("Product attribute values:",
    f"CASE k % 8 WHEN 0 THEN 'Brand | ' || title WHEN 3 THEN {_MAKER} || ' | ' || title || ' | Glossy' "
    f"WHEN 4 THEN {_MAKER} || ' | ' || split_part(title, ' ', 1) "
    f"WHEN 5 THEN {_MAKER} || ' | ' || title || ' | ' || {_SIZE} || ',' "
    f"WHEN 7 THEN {_MAKER} || ' | ' || title || ' | ' || {_SIZE} "
    f"ELSE {_MAKER} || ' | ' || title END")}
  || CASE WHEN k % 8 = 1 THEN '' ELSE {_sql_line("Replaced keys:",
    "CASE WHEN k % 8 = 5 THEN ' SIZE ,' ELSE '' END")} END
  || CASE WHEN k % 8 = 2 THEN '' ELSE {_sql_line("Generated title:",
    f"{_MAKER} || ' ' || title")} END AS response
  FROM raw)"""


def _labelled(label: str) -> str:
    """One labelled line of an answer, NULL without it."""
    pattern = f"(?im)^\\**{label}:\\**(.*)$"
    return (
        f"CASE WHEN regexp_matches(response, '{pattern}') "
        f"THEN regexp_extract(response, '{pattern}', 1) END"
    )


TITLE_FIELDS = f"""title_fields AS (
  SELECT *, {_labelled("product attribute keys in original title")} AS f_original,
    {_labelled("product category")} AS f_category,
    {_labelled("product attribute keys")} AS f_keys,
    {_labelled("product attribute values")} AS f_values,
    {_labelled("replaced keys")} AS f_replaced,
    {_labelled("generated title")} AS f_title
  FROM title_answers)"""


def answered_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Answers, frozen as after any model: later filters must not repeat the model."""
    spread = feed(spark, folder).repartition(spark.sparkContext.defaultParallelism)
    rows = steps.add_title_prompt(steps.feed_rows(spread, CONFIG), CONFIG)
    answered = generate_text(
        rows, ExpressionCompleter(title_model), "title_prompt", "title_response", "title_error"
    )
    return materialise(answered.drop("title_prompt"), "titles")


@query(
    "parse_title_response",
    with_tables(
        RAW,
        TITLE_ANSWERS,
        TITLE_FIELDS,
        "SELECT id, trim(f_original) AS original_keys, trim(f_category) AS category, "
        "trim(f_keys) AS keys, trim(f_values) AS attribute_values, trim(f_replaced) AS replaced, "
        "trim(f_title) AS title FROM (SELECT id, f_title, "
        + ", ".join(
            f"CASE WHEN f_title IS NOT NULL THEN {c} END AS {c}"
            for c in ("f_original", "f_category", "f_keys", "f_values", "f_replaced")
        )
        + " FROM title_fields)",
    ),
)
def parse_title_response(spark: SparkSession, folder: str) -> DataFrame:
    found = with_title_answer(answered_titles(spark, folder), "title_response")
    names = {"values": "attribute_values"}
    fields = ("original_keys", "category", "keys", "values", "replaced", "title")
    return found.select(
        F.col("item_id").alias("id"),
        *[trim_ws(f"answer_{f}").alias(names.get(f, f)) for f in fields],
    )


# A list written with bars: empty parts go, the rest is trimmed.
def _bars(column: str) -> str:
    return (
        f"list_transform(list_filter(string_split(trim({column}), '|'), lambda x: x <> ''), "
        "lambda x: trim(x))"
    )


_WORDS = "regexp_extract_all({0}, '[A-Za-zÀ-ÖØ-öø-ÿ0-9]+')"


def _word_list(text: str) -> str:
    return _WORDS.format(f"replace({text}, '''s', '')")


def _ordered_set(column: str) -> str:
    return f"list_filter({column}, lambda x, i: list_position({column}, x) = i)"


# For each attribute of an answer: its place, feed value, gap value and value in the title.
FACTS = f"""lists AS (
  SELECT *, {_bars('f_original')} AS old_keys, {_bars('f_keys')} AS keys,
    {_bars('f_values')} AS vals,
    CASE WHEN f_replaced IS NULL THEN [] ELSE list_transform(list_filter(
      string_split(trim(f_replaced), ','), lambda x: x <> ''), lambda x: lower(trim(x))) END AS swapped
  FROM title_fields WHERE f_title IS NOT NULL),
exploded AS (
  SELECT lists.*, unnest(keys) AS key, unnest(range(1, len(keys) + 1)) AS place FROM lists),
valued AS (
  SELECT *, vals[place] AS generated,
    CASE key WHEN 'brand' THEN brand WHEN 'size' THEN size END AS fed FROM exploded),
facts AS (
  SELECT *,
    CASE WHEN ((COALESCE(fed, '') = '' AND COALESCE(generated, '') <> ''
        AND (NOT list_contains(old_keys, key) OR fed IS NOT NULL))
        OR list_contains(swapped, lower(key)))
      AND lower(rtrim(generated, ',')) <> lower(key) AND rtrim(generated, ',') <> ''
      THEN trim(rtrim(generated, ',')) END AS gap,
    CASE WHEN COALESCE(NULLIF(fed, ''), generated) <> ''
      AND lower(rtrim(COALESCE(NULLIF(fed, ''), generated), ',')) <> lower(key)
      THEN COALESCE(NULLIF(fed, ''), generated) END AS used
  FROM valued),
composed AS (
  SELECT id, any_value(title) AS title, any_value(description) AS description,
    any_value(old_keys) AS old_keys, any_value(f_category) AS f_category, any_value(response) AS response,
    any_value(k) AS k,
    COALESCE(rtrim(string_agg(used, ' ' ORDER BY place), ','), '') AS new_title,
    COALESCE(list(key ORDER BY place) FILTER (used IS NOT NULL), []) AS used_keys,
    COALESCE('{{' || string_agg(to_json(key) || ':' || to_json(gap), ',' ORDER BY place)
      FILTER (gap IS NOT NULL) || '}}', '') AS gaps
  FROM facts GROUP BY id),
vocab AS (
  SELECT raw.id, list_transform({_WORDS.format(
    "concat_ws(' ', " + ", ".join(f"'{c}', replace({c}, '''s', '')" for c in FEED_COLUMNS) + ")"
  )}, lambda x: lower(x)) || ['size', '', 'deluxe'] AS known FROM raw),
wordy AS (
  SELECT c.*, known, {_word_list('new_title')} AS new_list, {_word_list('title')} AS old_list
  FROM composed c JOIN vocab v ON c.id = v.id),
scored AS (
  SELECT *, list_filter({_ordered_set('new_list')}, lambda x: NOT list_contains(known, lower(x)))
      AS strange,
    list_filter({_ordered_set('old_list')}, lambda x: NOT list_contains(
      list_transform(new_list, lambda y: lower(y)), lower(x))
      AND strpos(replace(new_title, '''', ''), x) = 0) AS lost,
    list_filter({_ordered_set('used_keys')}, lambda x: NOT list_contains(old_keys, x)) AS won_keys,
    list_filter({_ordered_set('old_keys')}, lambda x: NOT list_contains(used_keys, x)) AS lost_keys
  FROM wordy),
titled AS (
  SELECT *, CASE WHEN len(strange) > 0 THEN -1.0 WHEN len(lost) > 0 THEN -0.5
    ELSE (CASE WHEN gaps <> '' THEN 0.5 ELSE 0.0 END)
       + (CASE WHEN len(won_keys) > 0 THEN 0.5 ELSE 0.0 END) END::DOUBLE AS score
  FROM scored)"""


def composed_titles(spark: SparkSession, folder: str) -> DataFrame:
    parsed = steps.parse_titles(answered_titles(spark, folder))
    return materialise(steps.compose_titles(parsed, CONFIG), "composed")


def scored_titles(spark: SparkSession, folder: str) -> DataFrame:
    return steps.score_titles(composed_titles(spark, folder), CONFIG)


_TITLES = (RAW, TITLE_ANSWERS, TITLE_FIELDS, FACTS)


def by_item(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """``id`` and some columns of every row; a row whose answer failed has none of them."""
    found = [F.col(c) if isinstance(c, str) else c for c in columns]
    done = F.col("failure").isNull()
    names = rows.select(*found).columns
    return rows.select(F.col("item_id").alias("id"), *[F.when(done, c).alias(n) for c, n in zip(found, names, strict=True)])


@query(
    "title_compose",
    with_tables(
        *_TITLES,
        "SELECT raw.id, new_title AS title_generated, array_to_string(used_keys, ',') AS used_keys "
        "FROM raw LEFT JOIN composed c ON raw.id = c.id",
    ),
)
def title_compose(spark: SparkSession, folder: str) -> DataFrame:
    return by_item(
        composed_titles(spark, folder), "title_generated", F.array_join("used_keys", ",").alias("used_keys")
    )


@query(
    "gap_attributes",
    with_tables(
        *_TITLES, "SELECT raw.id, gaps AS gap_attributes FROM raw LEFT JOIN composed c ON raw.id = c.id"
    ),
)
def gap_attributes(spark: SparkSession, folder: str) -> DataFrame:
    return by_item(scored_titles(spark, folder), "gap_attributes")


def _angled(column: str) -> str:
    return (
        f"array_to_string(list_transform(list_filter({column}, lambda x: x <> ''), "
        "lambda x: '<' || x || '>'), ' ')"
    )


@query(
    "title_words",
    with_tables(
        *_TITLES,
        "SELECT raw.id, array_to_string(strange, ' | ') AS new_words_added, "
        f"array_to_string(lost, ' | ') AS words_removed, {_angled('won_keys')} AS attributes_added, "
        f"{_angled('lost_keys')} AS attributes_removed, {_angled('old_keys')} AS template_original, "
        f"{_angled('used_keys')} AS template_generated FROM raw LEFT JOIN titled t ON raw.id = t.id",
    ),
)
def title_words(spark: SparkSession, folder: str) -> DataFrame:
    return by_item(
        scored_titles(spark, folder), "new_words_added", "words_removed", "attributes_added", "attributes_removed",
        "template_original", "template_generated",
    )


@query(
    "title_score",
    with_tables(
        *_TITLES,
        "SELECT raw.id, score AS title_score, score <> 0 AS title_changed FROM raw LEFT JOIN titled t ON raw.id = t.id",
    ),
)
def title_score(spark: SparkSession, folder: str) -> DataFrame:
    return by_item(scored_titles(spark, folder), "title_score", "title_changed")


# Descriptions: by the remainder of the id by 5 a good score, a fraction, no number, no
# reasoning, a text of two lines with a low score; every eleventh text is empty.
def description_model(prompt: Column) -> Column:
    return bind(_context(prompt), _description_answer)


def _description_answer(row: Column) -> Column:
    k = row["id"].cast("bigint")
    kind = k % 5
    text = F.concat(row["Generated Title"], F.lit(" - "), row["description"])
    text = F.when(kind == 4, F.concat(text, F.lit("\nSecond line."))).otherwise(text)
    text = F.when(k % 11 == 0, F.lit("")).otherwise(text)
    score = F.when(kind == 0, "0.8").when(kind == 1, "0.6/1").when(kind == 2, "high").otherwise("0.2")
    return F.concat(
        F.lit("Description:** "),
        text,
        F.lit("\n\nScore: "),
        score,
        F.when(kind == 3, F.lit("")).otherwise(F.lit("\nReasoning: as told")),
    )


def _description_answers(title: str, source: str) -> str:
    return f"""description_answers AS (
  SELECT *, 'Description:** ' || CASE WHEN k % 11 = 0 THEN '' ELSE {title} || ' - ' || description
      || CASE WHEN k % 5 = 4 THEN chr(10) || 'Second line.' ELSE '' END END
    || chr(10) || chr(10) || 'Score: '
    || CASE k % 5 WHEN 0 THEN '0.8' WHEN 1 THEN '0.6/1' WHEN 2 THEN 'high' ELSE '0.2' END
    || CASE WHEN k % 5 = 3 THEN '' ELSE chr(10) || 'Reasoning: as told' END AS answer
  FROM {source}),
described AS (
  SELECT *, trim(regexp_extract(answer, '(?s)Description:\\**(.*)\\nScore:', 1), chr(10) || ' ') AS text,
    CASE k % 5 WHEN 0 THEN 0.8 WHEN 1 THEN 0.6 WHEN 2 THEN 'nan'::DOUBLE ELSE 0.2 END::DOUBLE AS grade,
    regexp_extract(answer, 'Reasoning: (.*)', 1) AS reasoning
  FROM description_answers)"""


@query(
    "parse_description_response",
    with_tables(
        RAW,
        _description_answers("title", "raw"),
        "SELECT id, CASE WHEN k % 5 <> 3 THEN text END AS description, "
        "CASE WHEN k % 5 = 2 THEN -9.0 WHEN k % 5 <> 3 THEN grade END AS score, "
        "CASE WHEN k % 5 <> 3 THEN reasoning END AS reasoning FROM described",
    ),
)
def parse_description_response(spark: SparkSession, folder: str) -> DataFrame:
    rows = steps.feed_rows(feed(spark, folder), CONFIG).withColumn(
        "title_generated", F.col("title_original")
    )
    asked = steps.add_description_prompt(
        rows.withColumn("failure", F.lit(None).cast("string")), CONFIG
    )
    answered = asked.select(
        F.col("item_id").alias("id"), description_model(F.col("description_prompt")).alias("r")
    )
    score = F.when(F.isnan("answer_score"), F.lit(-9.0)).otherwise(F.col("answer_score"))
    return with_description_answer(answered, "r").select(
        "id",
        F.col("answer_description").alias("description"),
        score.alias("score"),
        F.col("answer_reasoning").alias("reasoning"),
    )


def _measure(text: str) -> str:
    return f"(length({text}) + length(regexp_replace({text}, '[\\x{{0}}-\\x{{FFFF}}]', '', 'g')))"


@query(
    "compliance_gate",
    "SELECT conv_id, turn, CASE WHEN title_units BETWEEN 1 AND 150 AND text_units BETWEEN 1 AND 5000 "
    "THEN 'Success' ELSE 'Failed compliance checks' END AS status, title_units, text_units FROM ("
    f"SELECT conv_id, turn, {_measure('split_part(text, chr(10), 1)')} AS title_units, "
    f"{_measure('text')} AS text_units FROM conversations)",
)
def compliance_gate(spark: SparkSession, folder: str) -> DataFrame:
    """First lines and whole texts of messages against the limits for titles and texts."""
    texts = table(spark, folder, "conversations").select(
        "conv_id", "turn", "text", F.substring_index("text", "\n", 1).alias("first_line")
    )
    return texts.select(
        "conv_id",
        "turn",
        compliance_status("first_line", "text").alias("status"),
        utf16_length("first_line").cast("bigint").alias("title_units"),
        utf16_length("text").cast("bigint").alias("text_units"),
    )


def reviewed(
    spark: SparkSession, folder: str, cfg: FeedConfig = CONFIG, rows: DataFrame | None = None
) -> DataFrame:
    source = feed(spark, folder) if rows is None else rows
    return review_feed(
        source.withColumn("feed_pos", key_of("id")),
        cfg,
        ExpressionCompleter(title_model),
        ExpressionCompleter(description_model),
        keep=["feed_pos"],
        partitions=spark.sparkContext.defaultParallelism,
    )


_INPUT_JSON = "CAST(to_json({" + ", ".join(f"'{c}': raw.{c}" for c in FEED_COLUMNS) + "}) AS VARCHAR)"

REVIEW = f"""{_description_answers('new_title', 'titled')},
gated AS (
  SELECT *, CASE WHEN length(new_title) BETWEEN 1 AND 150 AND length(text) BETWEEN 1 AND 5000
    THEN 'Success' ELSE 'Failed compliance checks' END AS status FROM described),
final AS (
  SELECT *, CASE WHEN status = 'Success' THEN score ELSE -1.0 END AS final_score FROM gated),
review AS (
  SELECT raw.id AS item_id, raw.k AS feed_pos,
    CASE WHEN raw.k % 8 = 2 THEN 'incomplete title answer: ' || t.response
      WHEN raw.k % 5 = 3 THEN 'incomplete description answer: ' || answer END AS failure,
    CASE WHEN raw.k % 8 = 2 OR raw.k % 5 = 3 THEN
      'Failed. See the column full_response for details.' ELSE status END AS status,
    final_score >= 0 AND raw.k % 5 < 2 AS approval,
    new_title, raw.title AS title_original, final_score, score, strange, lost, old_keys, used_keys,
    won_keys, lost_keys, gaps, text, raw.description AS description_original, grade, reasoning,
    trim(t.f_category) AS category, t.response, {_INPUT_JSON} AS original_input
  FROM raw JOIN title_fields t ON raw.id = t.id LEFT JOIN final f ON raw.id = f.id)"""


def _unless_failed(expression: str, name: str) -> str:
    return f"CASE WHEN failure IS NULL THEN {expression} END AS {name}"


@query(
    "review_rows",
    with_tables(
        *_TITLES,
        REVIEW,
        "SELECT item_id, feed_pos, status, "
        + ", ".join(
            [
                _unless_failed("CAST(approval AS VARCHAR)", "approval"),
                _unless_failed("new_title", "title_generated"),
                _unless_failed("title_original", "title_original"),
                _unless_failed("CAST(final_score AS VARCHAR)", "title_score"),
                _unless_failed("CAST(score <> 0 AS VARCHAR)", "title_changed"),
                _unless_failed("CAST(length(new_title) AS VARCHAR)", "title_length"),
                _unless_failed("array_to_string(strange, ' | ')", "new_words_added"),
                _unless_failed("array_to_string(lost, ' | ')", "words_removed"),
                _unless_failed(_angled("old_keys"), "template_original"),
                _unless_failed(_angled("used_keys"), "template_generated"),
                _unless_failed(_angled("won_keys"), "attributes_added"),
                _unless_failed(_angled("lost_keys"), "attributes_removed"),
                _unless_failed("gaps", "gap_attributes"),
                _unless_failed("text", "description_generated"),
                _unless_failed("description_original", "description_original"),
                _unless_failed("CAST(text <> description_original AS VARCHAR)", "description_changed"),
                _unless_failed("CAST(length(text) AS VARCHAR)", "description_length"),
                _unless_failed("lower(CAST(grade AS VARCHAR))", "description_score"),
                _unless_failed("category", "category_generated"),
                "COALESCE(failure, rtrim(response, chr(10) || ' ') || chr(10) || 'Product description: ' || text "
                "|| chr(10) || 'Description evaluation: Score: ' || CASE WHEN isnan(grade) THEN 'NaN' "
                "ELSE CAST(grade AS VARCHAR) END || chr(10) || reasoning) AS full_response",
                _unless_failed("original_input", "original_input"),
            ]
        )
        + " FROM review",
    ),
)
def review_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The whole review; flags, lengths and scores as texts, since failed rows have none."""
    rows = reviewed(spark, folder)
    return rows.select(
        *[
            c if kind in ("string", "bigint") else F.lower(F.col(c).cast("string")).alias(c)
            for c, kind in rows.dtypes
        ]
    )


@query(
    "review_without_titles",
    with_tables(
        RAW,
        _description_answers("title", "raw"),
        "SELECT id AS item_id, CASE WHEN k % 5 = 3 THEN 'Failed. See the column full_response for details.' "
        "WHEN text = '' THEN 'Failed compliance checks' ELSE 'Success' END AS status, "
        "CASE WHEN k % 5 <> 3 THEN title END AS title_generated, "
        "CASE WHEN k % 5 <> 3 THEN (CASE WHEN text = '' THEN -1.0 ELSE 1.0 END)::DOUBLE END AS title_score, "
        "CASE WHEN k % 5 <> 3 THEN '[]' END AS attributes_added, "
        "CASE WHEN k % 5 <> 3 THEN text END AS description_generated, "
        "CASE WHEN k % 5 <> 3 THEN CAST(text <> '' AND k % 5 < 2 AS VARCHAR) END AS approval "
        "FROM described",
    ),
)
def review_without_titles(spark: SparkSession, folder: str) -> DataFrame:
    cfg = FeedConfig(generate_titles=False, title=CONFIG.title, description=CONFIG.description)
    return reviewed(spark, folder, cfg).select(
        "item_id",
        "status",
        "title_generated",
        "title_score",
        "attributes_added",
        "description_generated",
        F.col("approval").cast("string").alias("approval"),
    )


@query(
    "review_without_descriptions",
    with_tables(
        *_TITLES,
        "SELECT raw.id AS item_id, CASE WHEN t.id IS NULL THEN 'Failed. See the column full_response for details.' "
        "ELSE 'Success' END AS status, new_title AS title_generated, score AS title_score, "
        "t.description AS description_generated, CASE WHEN t.id IS NOT NULL THEN -1.0::DOUBLE END AS description_score, "
        "CASE WHEN t.id IS NOT NULL THEN 'false' END AS description_changed, "
        "CAST(score >= 0 AS VARCHAR) AS approval FROM raw LEFT JOIN titled t ON raw.id = t.id",
    ),
)
def review_without_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    cfg = FeedConfig(generate_descriptions=False, title=CONFIG.title)
    return reviewed(spark, folder, cfg).select(
        "item_id",
        "status",
        "title_generated",
        "title_score",
        "description_generated",
        "description_score",
        F.col("description_changed").cast("string").alias("description_changed"),
        F.col("approval").cast("string").alias("approval"),
    )


@query(
    "unprocessed_rows",
    with_tables(
        *_TITLES,
        REVIEW,
        f"SELECT {', '.join('raw.' + c for c in FEED_COLUMNS)} FROM raw JOIN review ON id = item_id "
        "WHERE failure IS NOT NULL",
    ),
)
def unprocessed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """After a run: the rows that failed, to be done first the next time."""
    return selection.unprocessed(feed(spark, folder), reviewed(spark, folder))


@query(
    "approve_filtered",
    with_tables(
        *_TITLES,
        REVIEW,
        "SELECT item_id, CASE WHEN failure IS NULL AND final_score >= 0.5 THEN 'true' "
        "WHEN failure IS NULL THEN CAST(approval AS VARCHAR) ELSE 'none' END AS approval FROM review",
    ),
)
def approve_filtered(spark: SparkSession, folder: str) -> DataFrame:
    rows = reviewed(spark, folder)
    flag = F.coalesce(F.col("approval").cast("string"), F.lit("none"))
    return selection.approve_where(rows, F.col("title_score") >= 0.5).select(
        "item_id", flag.alias("approval")
    )


_GAP_KEYS = (
    "gap_keys AS (SELECT feed_pos, item_id, new_title, text, gaps, json_keys(gaps) AS names "
    "FROM review WHERE failure IS NULL AND approval AND gaps <> '')"
)


def every_review(spark: SparkSession, folder: str) -> DataFrame:
    """All finished rows approved, so that new attributes are among them."""
    return selection.approve_where(reviewed(spark, folder), F.col("status") == "Success")


_ALL_APPROVED = REVIEW.replace("final_score >= 0 AND raw.k % 5 < 2 AS approval", "status = 'Success' AS approval")


@query(
    "attribute_keys",
    with_tables(
        *_TITLES,
        _ALL_APPROVED,
        _GAP_KEYS,
        "named AS (SELECT feed_pos, unnest(names) AS key, unnest(range(len(names))) AS pos FROM gap_keys)",
        f"SELECT key, CASE WHEN key IN ({', '.join(repr(c) for c in FEED_COLUMNS)}) THEN 'gap' "
        "ELSE 'new' END AS kind, struct_extract(min({'row': feed_pos, 'pos': pos}), 'row') AS row, "
        "CAST(struct_extract(min({'row': feed_pos, 'pos': pos}), 'pos') AS INTEGER) AS pos FROM named GROUP BY key",
    ),
)
def attribute_keys_query(spark: SparkSession, folder: str) -> DataFrame:
    return attribute_keys(every_review(spark, folder), "feed_pos").select("key", "kind", "place.*")


_STAMP = datetime.datetime(2024, 5, 6, 7, 8, 9, 120000, datetime.timezone.utc)
_EXPORT_LEAD = (
    "'2024-05-06T07:08:09.120Z' AS modified_at, item_id AS \"Item ID\", new_title AS {title}, "
    "text AS {text}"
)


def _exported(title: str, text: str, mark: str = "") -> str:
    lead = _EXPORT_LEAD.format(title=title, text=text)
    lead = lead.replace("new_title AS", f"{mark}new_title AS").replace(", text AS", f", {mark}text AS")
    keys = (("size", "size"), ("brand", "brand"), ("Finish", "new-Finish"))
    values = ", ".join(
        f"COALESCE(json_extract_string(NULLIF(gaps, ''), '$.{k}'), '') AS \"{n}\"" for k, n in keys
    )
    return f"SELECT {lead}, {values} FROM review WHERE failure IS NULL AND approval"


@query("export_approved", with_tables(*_TITLES, _ALL_APPROVED, _exported('"Title"', '"Description"')))
def export_approved_query(spark: SparkSession, folder: str) -> DataFrame:
    return export_approved(
        every_review(spark, folder), CONFIG, position="feed_pos", modified_at=_STAMP, layout="wide"
    )


@query(
    "structured_export",
    with_tables(
        *_TITLES,
        _ALL_APPROVED,
        _exported("structured_title", "structured_description", "'trained_algorithmic_media:' || "),
    ),
)
def structured_export_query(spark: SparkSession, folder: str) -> DataFrame:
    return structured_export(export_approved_query(spark, folder))


@query(
    "export_as_maps",
    with_tables(
        *_TITLES,
        _ALL_APPROVED,
        "SELECT item_id AS \"Item ID\", new_title AS \"Title\", "
        "CASE WHEN json_extract_string(NULLIF(gaps, ''), '$.brand') IS NULL THEN '' ELSE 'brand' END "
        "|| CASE WHEN json_extract_string(NULLIF(gaps, ''), '$.size') IS NULL THEN '' ELSE 'size' END "
        "AS gap_keys, COALESCE(json_extract_string(NULLIF(gaps, ''), '$.Finish'), '') AS new_values "
        "FROM review WHERE failure IS NULL AND approval",
    ),
)
def export_as_maps(spark: SparkSession, folder: str) -> DataFrame:
    export = export_approved(every_review(spark, folder), CONFIG, layout="map")
    return export.select(
        "Item ID",
        "Title",
        F.array_join(F.array_sort(F.map_keys("gap_attributes")), "").alias("gap_keys"),
        F.array_join(F.map_values("new_attributes"), "").alias("new_values"),
    )


_CELLS = [f"c{i}" for i in range(7)]


@query(
    "export_wide_files",
    with_tables(
        *_TITLES,
        _ALL_APPROVED,
        "SELECT '2024-05-06T07:08:09.120Z' AS c0, item_id AS c1, new_title AS c2, text AS c3, "
        + ", ".join(f"COALESCE(json_extract_string(NULLIF(gaps, ''), '$.{k}'), '') AS c{i}" for i, k in enumerate(("size", "brand", "Finish"), 4))
        + " FROM review WHERE failure IS NULL AND approval UNION ALL "
        "SELECT unnest(['modified_at', 'Item ID', 'Title', 'Description', 'size', 'brand', 'new-Finish']), '', '', '', '', '', ''",
    ),
)
def export_wide_files(spark: SparkSession, folder: str) -> DataFrame:
    """The wide export as delimited files, whatever the number of attributes: its rows, and the names of its columns."""
    path = new_path(spark, "wide")
    write_wide_export(every_review(spark, folder), path, CONFIG, position="feed_pos", modified_at=_STAMP)
    cells = spark.read.csv(f"{path}/rows", ", ".join(f"{c} string" for c in _CELLS), multiLine=True, escape='"')
    names = spark.read.text(f"{path}/header").select(F.col("value").alias("c0"), *[F.lit("").alias(c) for c in _CELLS[1:]])
    return cells.na.fill("").union(names)
