"""Which rows to work on."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from feedlift.config import Status
from feedlift.functions.text import as_column, blank_if_null, id_part, shuffle_key
from feedlift.operators.numbering import number_rows

_WHOLE = re.compile(r"0|-?[1-9][0-9]*", re.ASCII)

DONE = (Status.SUCCESS, Status.NON_COMPLIANT)


def by_ids(df: DataFrame, ids: Sequence[str] | DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is listed. ``ids`` is a list or a frame with the ids in its first column;
    ids are compared as texts either way."""
    as_text = as_column(id_col).cast("string")
    if not isinstance(ids, DataFrame):
        listed = [str(i) for i in ids]
        if isinstance(df.select(as_column(id_col).alias("id")).schema["id"].dataType, IntegralType):
            # The same comparison in a form that a scan can use: a whole number has one text.
            whole = [i for i in listed if _WHOLE.fullmatch(i) and abs(int(i)) < 1 << 63]
            return df.where(as_column(id_col).isin([int(i) for i in whole]))
        return df.where(as_text.isin(listed))
    wanted = ids.select(F.col(ids.columns[0]).cast("string").alias("_wanted"))
    # Distinct first: a repeated id is reduced before the shuffle.
    return df.join(wanted.distinct(), as_text == F.col("_wanted"), "left_semi")


def quantiles(df: DataFrame, metric: str, precision: int = 100) -> DataFrame:
    """One row with ``boundaries``: minimum, the quantiles between, maximum. The sketch is
    merged from partial ones, so it is bounded whatever the table."""
    points = [i / precision for i in range(precision + 1)]
    return df.agg(F.percentile_approx(metric, points, 10_000).alias("boundaries"))


def mid_range(
    df: DataFrame, metric: str, low: float = 0.1, high: float = 0.9, precision: int = 100
) -> DataFrame:
    """Rows whose metric lies in the middle of the span from the lowest value to the last
    quantile but one. The span is linear, so an outlier does not widen it, and rows without the
    metric fall out. The bounds are scalar subqueries: no join, one pass for both."""
    ends = df.agg(
        F.percentile_approx(metric, [0.0, (precision - 1) / precision], 10_000).alias("ends")
    ).select(F.col("ends")[0].cast("double").alias("lo"), F.col("ends")[1].cast("double").alias("hi"))

    def bound(share: float) -> Column:
        return ends.select(F.col("lo") + share * (F.col("hi") - F.col("lo"))).scalar()

    return df.where(as_column(metric).between(bound(low), bound(high)))


def in_part(df: DataFrame, parts: int | None, part: int | None, id_col: str = "id") -> DataFrame:
    """One of ``parts`` disjoint parts of a feed; all of it without ``parts``."""
    return df if parts is None else df.where(id_part(id_col, parts) == part)


def init_state(df: DataFrame, id_col: str = "id", *, separate_tries: bool = False) -> DataFrame:
    """Empty output state for the products of ``df``."""
    text = F.lit(None).cast("string")
    tries = ["title_tries", "description_tries"] if separate_tries else ["tries"]
    return df.select(
        as_column(id_col).cast("string").alias("id"),
        text.alias("title"),
        text.alias("description"),
        *[F.lit(0).alias(t) for t in tries],
    )


def tries_column(state: DataFrame, target: str) -> str:
    """The counter that limits ``target``: its own when the state has one, else the shared."""
    own = f"{target}_tries"
    return own if own in state.columns else "tries"


def pending(state: DataFrame, target: str, max_tries: int = 3) -> DataFrame:
    """Rows that still lack ``target`` and have tries left."""
    tries = F.col(tries_column(state, target))
    return state.where(F.col(target).isNull() & (tries < max_tries))


# Hex digits of a key that one histogram tells apart, and rows that are sorted at most: both bound what one
# task or the driver gets.
_DIGITS, _SLIVER = 3, 10_000
_KEY_LENGTH = 32


def key_threshold(keys: DataFrame, size: int) -> tuple[str, int, int] | None:
    """Where the ``size`` smallest of the MD5 texts in column ``key`` end: a prefix that the last of them has, how
    many are taken of those with this prefix, and how many there are. None if there are no more than ``size``.

    A histogram of the first digits tells which prefix the last one has; the next digits tell apart the keys with that
    prefix, until all of them are taken or few are left. Nothing is sorted, and only counts leave the tasks."""
    prefix, wanted = "", size
    while len(prefix) < _KEY_LENGTH:
        longer = min(_KEY_LENGTH, len(prefix) + _DIGITS)
        some = keys.where(F.col("key").startswith(prefix)) if prefix else keys
        counts = some.groupBy(F.substring("key", 1, longer).alias("head")).agg(F.count("*").alias("n")).toArrow()
        for head, n in sorted(zip(*counts.to_pydict().values(), strict=True)):
            if n >= wanted:
                prefix = head
                break
            wanted -= n
        else:
            return None
        if n == wanted or n <= _SLIVER:
            break
    return prefix, wanted, n


def random_batch(
    df: DataFrame, size: int | None, seed: int | str = 0, id_col: str = "id"
) -> DataFrame:
    """``size`` rows, the first in the repeatable random order of ``seed``; all rows without a size.

    A filter on the key of that order, so the table is neither sorted nor shuffled whatever the size: see
    :func:`key_threshold`. Only the few rows around the last one are ranked; of many rows with one id, some are numbered
    and cut. ``df`` is read several times: store what gives other rows each time."""
    if size is None:
        return df
    # Rows without an id come first.
    key = F.coalesce(shuffle_key(id_col, seed), F.lit("0" * _KEY_LENGTH))
    end = key_threshold(df.select(key.alias("key")), size) if size > 0 else ("", 0, 1)
    if end is None:
        return df
    prefix, wanted, found = end
    if not wanted:
        return df.limit(0)
    head = F.substring(key, 1, len(prefix))
    if wanted == found:
        return df.where(head <= prefix)
    last = df.where(head == prefix)
    if found <= _SLIVER:
        last = last.orderBy(key, as_column(id_col)).limit(wanted)
    else:
        last = number_rows(last, [id_col], "_rank").where(F.col("_rank") < wanted).drop("_rank")
    return df.where(head < prefix).unionByName(last)


def top_by(df: DataFrame, metric: str, size: int = 3, id_col: str = "id") -> DataFrame:
    """The ``size`` rows with the highest metric, ties by id."""
    return df.orderBy(as_column(metric).desc_nulls_last(), as_column(id_col)).limit(size)


def non_empty_rows(df: DataFrame) -> DataFrame:
    """Rows with at least one non-empty cell."""
    return df.where(F.concat_ws("", *[as_column(c).cast("string") for c in df.columns]) != "")


def completed_ids(review: DataFrame, *, retry_non_compliant: bool = False) -> DataFrame:
    """Ids that need no further work. Rows that failed the compliance checks count as done
    unless asked otherwise."""
    done = (Status.SUCCESS,) if retry_non_compliant else DONE
    return review.where(F.col("status").isin(*done)).select("item_id")


def unprocessed(
    feed: DataFrame, review: DataFrame, id_col: str = "id", *, skip_done: bool = True, **options
) -> DataFrame:
    """Feed rows that no finished review row covers."""
    if not skip_done:
        return feed
    done = completed_ids(review, **options).select(blank_if_null("item_id").alias("item_id"))
    own = blank_if_null(as_column(id_col).cast("string"))
    return feed.join(done.distinct(), own == F.col("item_id"), "left_anti")


def approve_where(review: DataFrame, condition: Column) -> DataFrame:
    """Approve all rows that meet a condition; the others keep their flag."""
    return review.withColumn(
        "approval", F.when(condition, F.lit(True)).otherwise(F.col("approval"))
    )


def approved(review: DataFrame) -> DataFrame:
    return review.where(F.col("approval"))


def with_both_texts(state: DataFrame) -> DataFrame:
    return state.dropna(subset=["title", "description"])


def with_title(state: DataFrame) -> DataFrame:
    return state.where(F.col("title").isNotNull())
