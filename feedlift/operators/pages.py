"""Page texts per product, from a table of pages fetched before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlift.functions.html import div_text, page_text
from feedlift.functions.text import as_column


def page_texts(
    pages: DataFrame,
    id_col: str = "id",
    body_col: str = "html",
    type_col: str = "content_type",
    *,
    one_line_pages: bool = False,
) -> DataFrame:
    """``id, content`` by the line rules; JSON bodies pass unchanged."""
    kind = as_column(type_col) if type_col in pages.columns else F.lit("text/html")
    return pages.select(
        as_column(id_col).cast("string").alias("id"),
        page_text(body_col, kind, one_line_pages=one_line_pages).alias("content"),
    )


def page_div_texts(
    pages: DataFrame, css_class: str, id_col: str = "id", body_col: str = "html"
) -> DataFrame:
    """``id, content`` from the divs of one class."""
    return pages.select(
        as_column(id_col).cast("string").alias("id"),
        div_text(body_col, css_class).alias("content"),
    )
