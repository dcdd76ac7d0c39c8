"""Joins that bring page texts, image descriptions and examples to the feed.

No join is hinted: Spark broadcasts a side only when its size is below the session's
threshold, and adaptive execution splits a hot key of a sort-merge join on the side of the feed.
Building a join starts no job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlift.functions.prompts import example_lines
from feedlift.functions.rows import row_context, row_properties
from feedlift.functions.text import as_column, base_name
from feedlift.operators.selection import by_ids


def left_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: str) -> DataFrame:
    """``left`` LEFT JOIN ``right``, without ``right_key`` in the result."""
    return left.join(right, left_key == F.col(right_key), "left").drop(right_key)


def one_per_key(right: DataFrame, key: str) -> DataFrame:
    """One row per key, for a side whose keys are unique by contract: a repeated one must not
    multiply the rows it meets. Combined before the shuffle."""
    rest = F.struct(*[as_column(c) for c in right.columns if c != key])
    one = right.groupBy(key).agg(F.max(rest).alias("_one"))
    return one.select(key, "_one.*")


def join_page_texts(
    feed: DataFrame, pages: DataFrame, id_col: str = "id", *, unique: bool = False
) -> DataFrame:
    """Feed with ``webpage_content`` from a table ``id, content``. ``unique`` takes one text per
    id, so that each feed row stays one row."""
    texts = pages.select(
        F.col("id").cast("string").alias("_page_id"), F.col("content").alias("webpage_content")
    )
    texts = one_per_key(texts, "_page_id") if unique else texts
    return left_join(feed, texts, as_column(id_col).cast("string"), "_page_id")


def join_images_by_name(
    feed: DataFrame, images: DataFrame, link_col: str = "image_link"
) -> DataFrame:
    """Feed with ``image_description`` from a table ``uri, description``, where the file
    name in the link (without query or fragment) equals that of the image."""
    link_name = base_name(F.split(as_column(link_col), "[?#]")[0])
    named = images.select(
        base_name("uri").alias("_name"), F.col("description").alias("image_description")
    )
    return left_join(feed, named, link_name, "_name")


# Names in one automaton, and links that one task puts through it. A link is sent to a task for every so many names, and
# a name for every so many links.
_NAMES, _LINKS = 1 << 16, 1 << 17


def _pieces(name: Column) -> Column:
    """Parts of a LIKE pattern between its wildcards."""
    return F.array_distinct(F.filter(F.split(name, "[_%]", -1), lambda p: p != ""))


def _rarest_pieces(names: DataFrame) -> DataFrame:
    """For each file name the literal piece that the fewest names have."""
    pieces = names.select("_name", F.explode(_pieces(F.col("_name"))).alias("_piece"))
    shared = pieces.groupBy("_piece").agg(F.count("*").alias("_names"))
    rank = F.struct(F.col("_names"), (-F.length("_piece")).alias("_short"), F.col("_piece"))
    best = pieces.join(shared, "_piece").groupBy("_name").agg(F.min(rank).alias("_best"))
    return best.select("_name", F.col("_best._piece").alias("_piece"))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_link, _name`` where the link holds the piece of the name. Rows come sorted by cell of the grid, names before
    links: the names of a cell make an automaton, through which its links are streamed."""
    import ahocorasick

    cell, automaton, words = None, None, {}
    for batch in batches:
        links, names = [], []
        rows = zip(*(batch.column(c).to_pylist() for c in ("_block", "_slice", "_text", "_name")), strict=True)
        for block, part, text, name in rows:
            if (block, part) != cell:
                cell, automaton, words = (block, part), None, {}
            if name is not None:
                words.setdefault(text, []).append(name)
                continue
            if automaton is None:
                automaton = ahocorasick.Automaton()
                for word, of in words.items():
                    automaton.add_word(word, of)
                automaton.make_automaton()
            if words:
                hits = {n for _, of in automaton.iter(text) for n in of}
                links += [text] * len(hits)
                names += hits
        yield pa.RecordBatch.from_arrays([pa.array(links, pa.string()), pa.array(names, pa.string())], names=["_link", "_name"])


def _candidates(links: DataFrame, names: DataFrame) -> DataFrame:
    """``_link, _name`` of every distinct link and the names whose rarest piece it holds.

    Names are cut into blocks and links into slices, both by hash and as many as their counts ask for; each cell of that
    grid is a task's work, so its memory follows a block and no key can make it large."""
    blocks = names.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / _NAMES)).cast("int")).scalar()
    slices = links.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / _LINKS)).cast("int")).scalar()
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    hashed = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    patterns = _rarest_pieces(names).select(
        hashed("_name", blocks).alias("_block"), each(slices).alias("_slice"), F.col("_piece").alias("_text"), "_name"
    )
    texts = links.select(
        each(blocks).alias("_block"), hashed("_link", slices).alias("_slice"), F.col("_link").alias("_text"), F.lit(None).cast("string").alias("_name")
    )
    cells = patterns.union(texts).repartition("_block", "_slice")
    sorted_ = cells.sortWithinPartitions("_block", "_slice", F.col("_name").isNull())
    return sorted_.mapInArrow(_found, "_link string, _name string")


def join_images_containing(
    feed: DataFrame, images: DataFrame, link_col: str = "image_link", *, allow_bare: bool = False
) -> DataFrame:
    """Feed with ``image_description`` of every image whose file name occurs in the link;
    ``_`` and ``%`` in a name are wildcards, and several hits give several rows.

    A LIKE join compares each link with each name. Here distinct links run through automata (Aho-Corasick) that
    find all pieces of names in one pass; of each name it is the piece that the fewest names share. LIKE then confirms
    names with wildcards. A link shared by many rows is matched once.

    A name of wildcards alone fits every link that is long enough, so its result is a product: it is
    an error unless ``allow_bare`` is set.
    """
    named = images.select(
        base_name("uri").alias("_name"), F.col("description").alias("image_description")
    ).where(F.col("_name").isNotNull())
    bare = F.size(_pieces(F.col("_name"))) == 0
    if not allow_bare:
        problem = F.concat(F.lit("a file name of wildcards alone fits every link: "), F.col("_name"))
        named = named.withColumn("_name", F.when(bare, F.raise_error(problem)).otherwise(F.col("_name")))
    links = feed.select(as_column(link_col).alias("_link")).where("_link is not null").distinct()
    # The escape sign is a character that no file name holds: a backslash means itself.
    pattern = F.concat(F.lit("%"), F.col("_name"), F.lit("%"))
    hits = (
        _candidates(links, named.select("_name").distinct())
        .where(F.like(F.col("_link"), pattern, F.lit("\u0001")))
        .join(named, "_name")
        .select("_link", "image_description")
    )
    if allow_bare:
        least = F.length(F.translate("_name", "%", ""))
        some = named.where(bare).select(least.alias("_least"), "image_description")
        hits = hits.unionByName(
            links.join(some, F.length("_link") >= F.col("_least")).select("_link", "image_description")
        )
    return feed.join(hits, as_column(link_col) == F.col("_link"), "left").drop("_link")


def merge_sources(
    feed: DataFrame,
    fields: Sequence[str],
    pages: DataFrame | None = None,
    images: DataFrame | None = None,
    *,
    id_col: str = "id",
    link_col: str = "image_link",
    image_match: str = "basename",
) -> DataFrame:
    """The fields that go into prompts, plus page text and image description. The link is
    only used for the join unless it is among the fields."""
    wanted = list(dict.fromkeys([id_col, *fields]))
    needed = [*wanted] if images is None or link_col in wanted else [*wanted, link_col]
    out = feed.select(*[as_column(c) for c in needed])
    result = list(wanted)
    if pages is not None:
        out = join_page_texts(out, pages, id_col)
        result.append("webpage_content")
    if images is not None:
        join = {"basename": join_images_by_name, "contains": join_images_containing}[image_match]
        out = join(out, images, link_col)
        result.append("image_description")
    return out.select(*[as_column(c) for c in result])


def literal_examples(spark: SparkSession, examples: Sequence[dict[str, str]]) -> DataFrame:
    """Examples written out by the user, as ``id, properties, title, description``."""
    fields = ("id", "properties", "title", "description")
    return spark.createDataFrame(
        [tuple(e.get(f) for f in fields) for e in examples], ", ".join(f"{f} string" for f in fields)
    )


def examples_from_texts(texts: DataFrame, inputs: DataFrame, id_col: str = "id") -> DataFrame:
    """Examples ``id, properties, title, description``: given texts, properties from the feed."""
    rows = inputs.select(
        as_column(id_col).cast("string").alias("id"),
        row_properties(inputs.columns, id_col=id_col, include_id=False).alias("properties"),
    )
    return texts.select("id", "title", "description").join(rows, "id").select(
        "id", "properties", "title", "description"
    )


def examples_from_feed(
    rows: DataFrame,
    id_col: str = "id",
    title_col: str = "title",
    description_col: str = "description",
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Feed rows as examples. ``properties`` maps property names to columns where the
    raw feed names them otherwise; all columns but the id go in without it."""
    if properties is None:
        props = row_properties(rows.columns, id_col=id_col, include_id=False)
    else:
        renamed = [as_column(c).alias(name) for name, c in properties.items()]
        props = F.to_json(F.struct(*renamed), {"ignoreNullFields": "false"})
    return rows.select(
        as_column(id_col).cast("string").alias("id"),
        props.alias("properties"),
        as_column(title_col).alias("title"),
        as_column(description_col).alias("description"),
    )


def collected_examples(examples: DataFrame) -> DataFrame:
    """All examples, by id, as one array ``examples`` in one row: they go into every prompt."""
    fields = ("id", "properties", "title", "description")
    rows = F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("_last"), *fields)))
    shown = F.transform(rows, lambda r: F.struct(*[r[f].alias(f) for f in fields]))
    return examples.agg(shown.alias("examples"))


def example_sections(examples: DataFrame, target: str) -> DataFrame:
    """The two example sections of a batch prompt, ``inputs, outputs``, in one row."""
    inputs, outputs = example_lines(F.col("examples"), target)
    return collected_examples(examples).select(inputs.alias("inputs"), outputs.alias("outputs"))


def section_texts(sections: DataFrame) -> tuple[Column, Column]:
    """Those sections as scalar subqueries, computed once for each plan they are in."""
    return sections.select("inputs").scalar(), sections.select("outputs").scalar()


def example_texts(examples: DataFrame, target: str) -> tuple[Column, Column]:
    return section_texts(example_sections(examples, target))


def context_of_ids(
    feed: DataFrame, ids: Sequence[str] | DataFrame, position: str, id_col: str = "id"
) -> DataFrame:
    """JSON context of the first feed row of each id. The first row is an aggregate, so a
    repeated id is reduced before the shuffle."""
    columns = [c for c in feed.columns if c and c != position]
    rows = by_ids(feed, ids, id_col).select(
        as_column(id_col).cast("string").alias("id"),
        as_column(position).alias("_position"),
        row_context(columns).alias("context"),
    )
    return rows.groupBy("id").agg(F.min_by("context", "_position").alias("context"))
