"""Review of a whole feed: a title and a description per product, scored and gated."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame

from feedlift.config import FeedConfig
from feedlift.operators import review as steps
from feedlift.operators.generation import Completer, generate_text
from feedlift.operators.joins import join_page_texts
from feedlift.session import materialise, scratch


def review_feed(
    feed: DataFrame,
    cfg: FeedConfig,
    title_completer: Completer | None = None,
    description_completer: Completer | None = None,
    *,
    page_texts: DataFrame | None = None,
    images: DataFrame | None = None,
    keep: Sequence[str] = (),
    partitions: int | None = None,
    freeze: bool = True,
) -> DataFrame:
    """Review rows of all products in ``feed``.

    Two generation stages, the second of which needs the new title of the first; each is
    frozen behind it. So is the review: what reads it later, such as an export, scans the few
    columns it needs instead of parsing the answers again. ``freeze=False`` leaves the plan
    lazy, which is safe only for completers that always answer the same. Page texts join
    once for both prompts, image files (``uri, mime_type, content``) as well; with
    ``use_images`` the completers get JSON requests.
    ``partitions`` spreads the rows evenly over so many tasks, where the layout of the feed
    would leave the model stage to few of them.
    """
    build = partial(
        _review,
        feed,
        cfg,
        title_completer,
        description_completer,
        page_texts,
        images,
        keep,
        partitions,
    )
    if not freeze:
        return build(lambda df, label: df)
    # The answers are emptied once the review is written.
    with scratch(feed.sparkSession):
        return materialise(build(materialise), "review", keep=True)


def _review(
    feed: DataFrame,
    cfg: FeedConfig,
    title_completer: Completer | None,
    description_completer: Completer | None,
    page_texts: DataFrame | None,
    images: DataFrame | None,
    keep: Sequence[str],
    partitions: int | None,
    after_model: Callable[[DataFrame, str], DataFrame],
) -> DataFrame:
    page = None
    if page_texts is not None and (cfg.title.use_page_text or cfg.description.use_page_text):
        feed = join_page_texts(feed, page_texts, cfg.id_col, unique=True)
        page = "webpage_content"
    rows = steps.feed_rows(feed.repartition(partitions) if partitions else feed, cfg, page, keep)
    def with_images(df: DataFrame) -> DataFrame:
        return df if images is None or not cfg.use_images else steps.join_images(df, images)

    # The bytes of an image are in its request; beside it they would be frozen with every answer.
    if cfg.generate_titles:
        asked = generate_text(
            steps.add_title_prompt(with_images(rows), cfg).drop("image_type", "image_bytes"),
            title_completer,
            "title_prompt",
            "title_response",
            "title_error",
        ).drop("title_prompt")
        if not cfg.description.use_page_text:
            asked = asked.drop("page_text")
        parsed = steps.parse_titles(after_model(asked, "titles"))
        titled = steps.score_titles(steps.compose_titles(parsed, cfg), cfg)
    else:
        titled = steps.keep_titles(rows)
    if cfg.generate_descriptions:
        asked = generate_text(
            steps.add_description_prompt(with_images(titled), cfg).drop("image_type", "image_bytes"),
            description_completer,
            "description_prompt",
            "description_response",
            "description_error",
        ).drop("description_prompt")
        described = steps.parse_descriptions(after_model(asked, "descriptions"))
    else:
        described = steps.keep_descriptions(titled)
    return steps.review_rows(steps.gate(described, cfg), keep)
