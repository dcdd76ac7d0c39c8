"""Queries over raw web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlift.catalog.feed import RAW, products, table
from feedlift.catalog.registry import query, with_tables
from feedlift.config import DescriptionSettings, FeedConfig, TitleSettings
from feedlift.functions.html import break_lines, rule_text
from feedlift.functions.prompts import page_text_section
from feedlift.functions.text import one_line
from feedlift.operators import review as steps
from feedlift.operators.joins import join_page_texts
from feedlift.operators.pages import page_div_texts, page_texts

_LINE = "[^\\n\\r\u2028\u2029]*"


def _rule_sql(source: str) -> str:
    """Rule text of the column ``html`` of a source, as SQL."""
    text = "regexp_replace(html, '(?s)<head.*</head>', '', 'g')"
    cuts = [("<script", "</script"), ("<svg", "</svg"), ("<path", "</path"),
            ("<iframe", "</iframe"), ("<a ", "</a")]
    for tag, not_next in cuts:
        text = f"regexp_replace({text}, '{tag}[^{not_next}]{_LINE}', '', 'g')"
    keep = " || ".join(
        f"regexp_extract_all(cleaned, '{tag}[^{not_next}]{_LINE}')"
        for tag, not_next in (("<span", "</span"), ("<p", "</p"))
    )
    inner = f"list_transform({keep}, lambda x: regexp_extract(x, '(?s)>(.*)<', 1))"
    return (
        f"(SELECT page_id, array_to_string(list_filter({inner}, lambda x: x <> ''), ' ') AS content "
        f"FROM (SELECT page_id, {text} AS cleaned FROM {source}))"
    )


_BROKEN = "(SELECT page_id, replace(html, '><', '>' || chr(10) || '<') AS html FROM pages)"


@query("page_text_rules", f"SELECT page_id, content FROM {_rule_sql('pages')}")
def page_text_rules(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", rule_text("html").alias("content"))


@query("page_text_rules_by_tag", f"SELECT page_id, content FROM {_rule_sql(_BROKEN)}")
def page_text_rules_by_tag(spark: SparkSession, folder: str) -> DataFrame:
    """The same rules with a line break between adjacent tags."""
    return table(spark, folder, "pages").select(
        "page_id", rule_text(break_lines("html")).alias("content")
    )


_TYPED = (
    "typed AS (SELECT page_id, html, CASE WHEN page_id % 9 = 0 THEN 'application/json; charset=utf-8' "
    "ELSE 'text/html' END AS kind FROM pages)"
)


@query(
    "page_text_by_type",
    with_tables(
        _TYPED,
        f"ruled AS {_rule_sql('pages')}",
        "SELECT CAST(t.page_id AS VARCHAR) AS id, CASE WHEN kind LIKE 'application/json%' THEN html "
        "ELSE content END AS content FROM typed t JOIN ruled r ON t.page_id = r.page_id",
    ),
)
def page_text_by_type(spark: SparkSession, folder: str) -> DataFrame:
    """JSON pages pass unparsed."""
    kind = F.when(F.col("page_id") % 9 == 0, "application/json; charset=utf-8")
    pages = table(spark, folder, "pages").withColumn("content_type", kind.otherwise("text/html"))
    return page_texts(pages, "page_id")


@query(
    "page_text_div",
    "SELECT CAST(page_id AS VARCHAR) AS id, replace(replace(array_to_string(regexp_extract_all(html, "
    "'<div class=\"ad\">([^<]*)</div>', 1), ' '), chr(10), ' '), chr(13), '') AS content FROM pages",
)
def page_text_div(spark: SparkSession, folder: str) -> DataFrame:
    return page_div_texts(table(spark, folder, "pages"), "ad", "page_id")


@query(
    "page_texts_on_one_line",
    "SELECT page_id, md5(replace(replace(html, chr(10), ' '), chr(13), '')) AS text_hash FROM pages",
)
def page_texts_on_one_line(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        "page_id", F.md5(one_line("html")).alias("text_hash")
    )


_PRODUCT_PAGES = f"ruled AS {_rule_sql(_BROKEN)}"


@query(
    "product_page_texts",
    with_tables(
        RAW,
        _PRODUCT_PAGES,
        "SELECT id, CASE WHEN COALESCE(content, '') <> '' THEN 'Website: ' || content || chr(10) || chr(10) "
        "ELSE '' END AS section FROM raw LEFT JOIN ruled ON k = page_id",
    ),
)
def product_page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The page section of each product's prompt."""
    texts = page_texts(table(spark, folder, "pages"), "page_id", one_line_pages=True)
    joined = join_page_texts(products(spark, folder).select("id"), texts)
    return joined.select("id", page_text_section("webpage_content").alias("section"))


_ROW_COLUMNS = ["id", "title", "description", "brand"]
_ROW_JSON = "CAST(to_json({" + ", ".join(f"'{c}': {c}" for c in _ROW_COLUMNS) + "}) AS VARCHAR)"


@query(
    "title_row_prompts",
    with_tables(
        RAW,
        _PRODUCT_PAGES,
        f"SELECT id, 'Write a title.' || chr(10) || 'Context: ' || {_ROW_JSON} || chr(10) || chr(10) "
        "|| CASE WHEN COALESCE(content, '') <> '' THEN 'Website: ' || content || chr(10) || chr(10) "
        "ELSE '' END AS prompt FROM raw LEFT JOIN ruled ON k = page_id",
    ),
)
def title_row_prompts(spark: SparkSession, folder: str) -> DataFrame:
    cfg = FeedConfig(title=TitleSettings(prompt="Write a title.\n", use_page_text=True))
    texts = page_texts(table(spark, folder, "pages"), "page_id", one_line_pages=True)
    feed = join_page_texts(products(spark, folder).select(*_ROW_COLUMNS), texts)
    rows = steps.add_title_prompt(steps.feed_rows(feed, cfg, "webpage_content"), cfg)
    return rows.select(F.col("item_id").alias("id"), F.col("title_prompt").alias("prompt"))


@query(
    "description_row_prompts",
    with_tables(
        RAW,
        "SELECT id, 'Describe.' || chr(10) || 'Context: ' || CAST(to_json({'Generated Title': upper(title), "
        + ", ".join(f"'{c}': {c}" for c in _ROW_COLUMNS)
        + "}) AS VARCHAR) || chr(10) || chr(10) AS prompt FROM raw",
    ),
)
def description_row_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The new title leads the context of the description prompt."""
    cfg = FeedConfig(description=DescriptionSettings(prompt="Describe.\n"))
    rows = steps.feed_rows(products(spark, folder).select(*_ROW_COLUMNS), cfg).select(
        "*",
        F.upper("title_original").alias("title_generated"),
        F.lit(None).cast("string").alias("failure"),
    )
    asked = steps.add_description_prompt(rows, cfg)
    return asked.select(F.col("item_id").alias("id"), F.col("description_prompt").alias("prompt"))
