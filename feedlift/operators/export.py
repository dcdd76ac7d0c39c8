"""Feeds that leave the engine."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlift.config import FeedConfig
from feedlift.functions.scoring import GENERATED_MARK, feed_text
from feedlift.functions.text import as_column
from feedlift.operators.joins import left_join, one_per_key
from feedlift.operators.numbering import number_rows
from feedlift.operators.selection import approved, with_both_texts
from feedlift.session import materialise, scratch

_TEXT_MAP = "map<string,string>"
# The columns before the attributes of an export.
_LEAD = ("modified_at", "Item ID", "Title", "Description")


def supplemental_feed(state: DataFrame) -> DataFrame:
    """Id and marked texts of the products that have both."""
    return with_both_texts(state).select(
        "id",
        feed_text("title", True).alias("structured_title"),
        feed_text("description", True).alias("structured_description"),
    )


def full_feed(
    raw: DataFrame,
    state: DataFrame,
    id_col: str = "id",
    title_col: str = "title",
    description_col: str = "description",
) -> DataFrame:
    """The raw feed with the best texts: generated ones marked, old ones as they are."""
    texts = state.select(
        F.col("id").alias("_id"), F.col("title").alias("_title"), F.col("description").alias("_text")
    )

    def best(new: str, old: str) -> Column:
        return feed_text(F.coalesce(F.col(new), as_column(old)), F.col(new).isNotNull())

    kept = [c for c in raw.columns if c not in (title_col, description_col)]
    return left_join(raw, one_per_key(texts, "_id"), as_column(id_col).cast("string"), "_id").select(
        *[as_column(c) for c in kept],
        best("_title", title_col).alias("structured_title"),
        best("_text", description_col).alias("structured_description"),
    )


def attribute_keys(review: DataFrame, position: str | None = None) -> DataFrame:
    """``key, kind, place`` of every gap attribute of the approved rows: kind ``gap`` when
    any approved input row carries the key, else ``new``.

    ``place`` orders by first mention, as the row and the place in it, when ``position`` (a row
    number) is given; else it is null and keys order by name. All rows are reduced to their distinct keys map-side.
    """
    rows = approved(review)
    row_place = as_column(position) if position else F.lit(0)
    found = rows.where(F.col("gap_attributes") != "").select(
        row_place.cast("long").alias("_row"),
        F.posexplode(F.json_object_keys("gap_attributes")).alias("_pos", "key"),
    )
    mention = F.struct(F.col("_row").alias("row"), F.col("_pos").alias("pos"))
    place = mention if position else F.lit(None).cast("struct<row:long,pos:int>")
    gaps = found.groupBy("key").agg(F.min(place).alias("place"))
    # Rows of one feed share their columns: distinct key lists first, then their keys.
    inputs = (
        rows.select(F.json_object_keys("original_input").alias("_keys"))
        .distinct()
        .select(F.explode("_keys").alias("key"))
        .distinct()
        .withColumn("_known", F.lit(True))
    )
    return gaps.join(inputs, "key", "left").select(
        "key",
        F.when(F.col("_known"), F.lit("gap")).otherwise("new").alias("kind"),
        "place",
    )


def _distinct_names(names: list[str]) -> list[str]:
    """Names that differ from each other and from the leading columns even without regard to
    case, as files need them: a repeated one gets a number."""
    taken = {n.lower() for n in _LEAD}
    found = []
    for name in names:
        unique, count = name, 1
        while unique.lower() in taken:
            count += 1
            unique = f"{name}_{count}"
        taken.add(unique.lower())
        found.append(unique)
    return found


def utc_text(stamp: Column) -> Column:
    """A time as ISO text in UTC with milliseconds, whatever the session's time zone."""
    millis = F.unix_millis(stamp)
    day, rest = F.floor(millis / 86_400_000).cast("int"), F.pmod(millis, F.lit(86_400_000))

    def digits(unit: int, span: int, width: int) -> Column:
        return F.lpad((F.floor(rest / unit) % span).cast("string"), width, "0")

    date = F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string")
    clock = F.concat_ws(":", digits(3_600_000, 24, 2), digits(60_000, 60, 2), digits(1000, 60, 2))
    return F.concat(date, F.lit("T"), clock, F.lit("."), digits(1, 1000, 3), F.lit("Z"))


def export_approved(
    review: DataFrame,
    cfg: FeedConfig | None = None,
    *,
    position: str | None = None,
    modified_at: datetime.datetime | None = None,
    layout: str = "map",
) -> DataFrame | None:
    """Approved rows with their gap attributes in one map and the new ones in another, whatever
    their number.

    ``layout="wide"`` gives one column per gap attribute, then one per new attribute, whose name gets
    the prefix of the settings. The column names are data, so the keys are read first. It is None
    when no row is approved, so that a caller leaves an older export in place.
    """
    cfg = cfg or FeedConfig()
    rows = approved(review)
    stamp = F.lit(modified_at) if modified_at else F.current_timestamp()
    lead = [
        utc_text(stamp).alias("modified_at"),
        F.col("item_id").alias("Item ID"),
        F.col("title_generated").alias("Title"),
        F.col("description_generated").alias("Description"),
    ]
    gaps = F.from_json(F.when(F.col("gap_attributes") != "", F.col("gap_attributes")), _TEXT_MAP)
    if layout == "map":
        inputs = F.json_object_keys("original_input")
        empty = F.map_from_arrays(F.array(), F.array()).cast(_TEXT_MAP)
        some = F.coalesce(gaps, empty)
        known = F.map_filter(some, lambda k, v: F.array_contains(inputs, k))
        new = F.map_filter(some, lambda k, v: ~F.array_contains(inputs, k))
        return rows.select(
            *lead, known.alias("gap_attributes"), new.alias("new_attributes")
        )
    keys = attribute_keys(review, position).collect()
    if not keys and rows.isEmpty():
        return None
    keys.sort(key=lambda k: (k["kind"], k["place"] or (), k["key"]))

    def value(key: str) -> Column:
        return F.coalesce(F.try_element_at("_gaps", F.lit(key)), F.lit(""))

    prefix = {"gap": "", "new": cfg.new_attribute_prefix}
    names = _distinct_names([prefix[k["kind"]] + k["key"] for k in keys])
    return rows.withColumn("_gaps", gaps).select(
        *lead, *[value(k["key"]).alias(name) for k, name in zip(keys, names, strict=True)]
    )


def attribute_columns(review: DataFrame, cfg: FeedConfig, position: str | None = None) -> DataFrame:
    """``place, key, name`` of the columns that follow the leading ones in a wide export: gap attributes, then new ones with
    their prefix. Names that differ in nothing but case, from each other or from a leading column, get a number."""
    keys = attribute_keys(review, position).select(
        "key", F.when(F.col("kind") == "new", F.concat(F.lit(cfg.new_attribute_prefix), "key")).otherwise(F.col("key")).alias("name"),
        "kind", F.col("place.row").alias("row"), F.col("place.pos").alias("pos"),
    )
    columns = materialise(number_rows(keys, ["kind", "row", "pos", "key"], "place").select("place", "key", "name"), "columns")
    while True:
        lead = columns.sparkSession.createDataFrame([(n,) for n in _LEAD], "name string")
        named = columns.unionByName(lead.select(F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("key"), "name"))
        nth = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("place"))
        repeated = materialise(named.withColumn("nth", nth).filter("nth > 1 and place >= 0"), "repeated-columns")
        if repeated.isEmpty():
            return columns
        others = repeated.select("place", F.concat_ws("_", "name", "nth").alias("_new"))
        columns = columns.join(others, "place", "left").select("place", "key", F.coalesce("_new", "name").alias("name"))
        columns = materialise(columns, "columns")


def _cell(text: Column, separator: str) -> Column:
    """A value as delimited text: quoted where it holds a separator, a quote or a line end."""
    special = text.contains(separator) | text.rlike('["\\r\\n]')
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(special, quoted).otherwise(text)


def write_wide_export(
    review: DataFrame,
    path: str,
    cfg: FeedConfig | None = None,
    *,
    position: str | None = None,
    modified_at: datetime.datetime | None = None,
    separator: str = ",",
) -> bool:
    """The wide export as files: ``path/header`` names one column a line, the files and lines in order; ``path/rows`` has one delimited line
    per approved row. False, and nothing is touched, when no row is approved.

    Any number of attributes: the columns are a table, each value gets its place by a join, and a row is laid out from the
    values it has. Neither keys nor rows come to the driver. With ``position`` the lines follow it."""
    cfg = cfg or FeedConfig()
    spark = review.sparkSession
    with scratch(spark):
        rows = materialise(approved(review), "approved")
        if rows.isEmpty():
            return False
        columns = attribute_columns(rows, cfg, position)
        order = as_column(position).cast("long") if position else F.lit(None).cast("long")
        stamp = utc_text(F.lit(modified_at) if modified_at else F.current_timestamp())
        lead = [stamp, F.col("item_id"), F.col("title_generated"), F.col("description_generated")]
        lead = [_cell(F.coalesce(c.cast("string"), F.lit("")), separator) for c in lead]
        gaps = F.from_json(F.when(F.col("gap_attributes") != "", F.col("gap_attributes")), _TEXT_MAP)
        rows = rows.select(
            F.monotonically_increasing_id().alias("row"), order.alias("order"), F.concat_ws(separator, *lead).alias("lead"), gaps.alias("gaps")
        )
        values = rows.select("row", F.explode("gaps").alias("key", "value")).join(columns.select("key", "place"), "key")
        cell = F.struct(F.col("place").cast("int").alias("place"), _cell(F.coalesce("value", F.lit("")), separator).alias("text"))
        cells = values.groupBy("row").agg(F.array_sort(F.collect_list(cell)).alias("cells"))

        def after(previous: Column, text: Column, place: Column) -> Column:
            return F.concat(F.repeat(F.lit(separator), place - previous), text)

        # Each value stands behind the separators that lead to its place; the leading columns come before all places.
        width = columns.agg(F.count("*").cast("int")).scalar()
        some = F.coalesce("cells", F.array().cast("array<struct<place:int,text:string>>"))
        before = lambda i: F.coalesce(F.get(some, i - 1)["place"], F.lit(-1))
        body = F.transform(some, lambda c, i: after(before(i), c["text"], c["place"]))
        rest = F.repeat(F.lit(separator), width - 1 - before(F.size(some)))
        lines = rows.join(cells, "row", "left").select("order", "row", F.concat("lead", F.array_join(body, ""), rest).alias("line"))
        ordered = lines.repartitionByRange("order", "row").sortWithinPartitions("order", "row")
        first = spark.createDataFrame([(i - len(_LEAD), n) for i, n in enumerate(_LEAD)], "place long, name string")
        header = first.union(columns.select("place", "name")).repartitionByRange("place").sortWithinPartitions("place")
        header.select("name").write.mode("overwrite").text(f"{path}/header")
        ordered.select("line").write.mode("overwrite").text(f"{path}/rows")
    return True


def structured_export(export: DataFrame) -> DataFrame:
    """An approved export with its texts renamed and marked as generated."""
    names = {"Title": "structured_title", "Description": "structured_description"}
    return export.select(
        *[
            F.concat(F.lit(f"{GENERATED_MARK}:"), F.col(c)).alias(names[c])
            if c in names
            else as_column(c)
            for c in export.columns
        ]
    )
