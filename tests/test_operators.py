"""Selection, numbering, joins and skew against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from feedlift.functions.html import _CODED_CLASS, rule_text
from feedlift.functions.prompts import batch_prompt, column_prompt, few_shot_block, page_text_section
from feedlift.operators import joins, numbering, selection
from feedlift.operators.answers import first_answers
from feedlift.operators.pages import page_div_texts, page_texts
from feedlift.operators.state import merge_answers
from tests.conftest import plan_of


def rows(df):
    return Counter(tuple(r) for r in df.collect())


# --- numbering ---------------------------------------------------------------------


def test_numbers_follow_the_order(spark):
    values = random.Random(1).sample(range(100_000), 5000)
    df = spark.createDataFrame([(f"{v:06d}",) for v in values], "id string").repartition(16)
    numbered = numbering.number_rows(df, ["id"]).collect()
    want = {f"{v:06d}": i for i, v in enumerate(sorted(values))}
    assert {r.id: r.row_id for r in numbered} == want


def test_a_hot_key_is_spread_and_stays_whole(spark):
    df = spark.range(0, 30_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"),
        F.lit("same").alias("properties"),
    )
    numbered = numbering.number_rows(df, ["id"])
    assert sorted(r.row_id for r in numbered.select("row_id").collect()) == list(range(30_000))
    found = numbered.select("id").where("id = 'hot'").count()
    assert found == 10_000
    chunks = numbering.pack_chunks(numbered, 7)
    sizes = chunks.select("chunk_id", F.size("ids").alias("n")).collect()
    assert sum(r.n for r in sizes) == 30_000
    assert all(r.n == 7 for r in sizes if r.chunk_id < 30_000 // 7)


def test_no_single_partition_in_the_row_numbers(spark):
    df = spark.range(1000).select(F.col("id").cast("string"))
    numbered = numbering.number_rows(df, ["id"])
    plan = plan_of(numbered)
    # The only rows that meet in one task are the counts per partition.
    scans = [line for line in plan.splitlines() if "SinglePartition" in line]
    assert len(scans) <= 1
    assert "BroadcastExchange" in plan


def test_chunks_keep_null_properties(spark):
    df = spark.createDataFrame(
        [("a", "x", 0), ("b", None, 1), ("c", "z", 2)], "id string, properties string, row_id long"
    )
    chunk = numbering.pack_chunks(df, 5).first()
    assert (chunk.ids, chunk.properties) == (["a", "b", "c"], ["x", None, "z"])


# --- selection ---------------------------------------------------------------------


@pytest.mark.parametrize("per_chunk", [1, 7, 50, 5000])
def test_streamed_chunks_equal_shuffled_ones(spark, per_chunk):
    rows = [(f"{i % 700:03d}", None if i % 11 == 0 else f"p{i}") for i in range(1003)]
    df = spark.createDataFrame(rows, "id string, properties string").repartition(6)
    numbered = numbering.number_rows(df, ["id"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        for frame in (numbered, numbered.repartition(5)):  # stored in order, and dealt out at random
            got = numbering.stream_chunks(frame, per_chunk)
            assert rows_of(got) == rows_of(numbering.pack_chunks(frame, per_chunk))
        pieces = numbering.chunk_pieces(numbered, per_chunk)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert pieces.where(F.size("ids") < per_chunk).count() <= 2 * numbered.rdd.getNumPartitions()
    assert numbering.stream_chunks(numbered.limit(0), per_chunk).count() == 0


def rows_of(chunks):
    return {r.chunk_id: (r.ids, r.properties) for r in chunks.collect()}


def test_ids_as_list_long_list_and_frame(spark):
    df = spark.range(5000).select(F.col("id").cast("string"))
    few = [str(i) for i in range(10)]
    many = [str(i) for i in range(2000)]
    assert selection.by_ids(df, few).count() == 10
    assert selection.by_ids(df, [*many, "x", "1"]).count() == 2000
    assert selection.by_ids(df, spark.range(7).union(spark.range(7))).count() == 7


def test_large_and_small_batches_agree(spark):
    df = spark.range(30_000).select(F.col("id").cast("string"))
    large = selection.random_batch(df, 15_000, 9)
    small = selection.random_batch(df, 9_000, 9)
    large_ids = {r.id for r in large.collect()}
    assert len(large_ids) == 15_000
    assert {r.id for r in small.collect()} < large_ids


@pytest.mark.parametrize("sliver", [10_000, 5])
def test_batches_with_repeated_and_missing_ids(spark, monkeypatch, sliver):
    monkeypatch.setattr(selection, "_SLIVER", sliver)
    ids = ["a"] * 50 + ["b"] * 7 + [None] * 3 + [f"x{i}" for i in range(40)]
    df = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id string, n int").repartition(4)
    key = lambda i: "0" * 32 if i is None else hashlib.md5(f"5:{i}".encode()).hexdigest()
    order = sorted(map(key, ids))
    for size in (0, 1, 3, 10, 40, 77, 99, 100, 200):
        batch = selection.random_batch(df, size, 5).collect()
        assert sorted(key(r.id) for r in batch) == order[:size]
        assert len({r.n for r in batch}) == min(size, 100)


def test_mid_range_leaves_out_both_ends_and_null(spark):
    df = spark.createDataFrame(
        [(i, i) for i in range(101)] + [(500, None), (501, 100_000)], "id long, clicks long"
    )
    kept = {r.id for r in selection.mid_range(df, "clicks").collect()}
    span = 99 + 1
    assert kept == {i for i in range(101) if 0.1 * span <= i <= 0.9 * span}


def test_non_empty_rows(spark):
    df = spark.createDataFrame([("", None), (None, None), ("", "a"), (" ", "")], "x string, y string")
    assert selection.non_empty_rows(df).count() == 2


def test_completed_ids_and_the_retry_option(spark):
    review = spark.createDataFrame(
        [("1", "Success"), ("2", "Failed compliance checks"), ("3", "Failed. See"), ("4", None)],
        "item_id string, status string",
    )
    feed = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    left = lambda **o: sorted(r.id for r in selection.unprocessed(feed, review, **o).collect())
    assert left() == [3, 4, 5]
    assert left(retry_non_compliant=True) == [2, 3, 4, 5]
    assert left(skip_done=False) == [1, 2, 3, 4, 5]


def test_blank_ids_are_done_once_reviewed(spark):
    review = spark.createDataFrame([("", "Success"), ("1", "Success")], "item_id string, status string")
    feed = spark.createDataFrame([(None,), ("",), ("1",), ("2",)], "id string")
    assert [r.id for r in selection.unprocessed(feed, review).collect()] == ["2"]


def test_separate_tries(spark):
    state = selection.init_state(spark.range(2), separate_tries=True)
    assert state.columns == ["id", "title", "description", "title_tries", "description_tries"]
    answers = spark.createDataFrame([("0", "t")], "id string, text string")
    merged = merge_answers(state, answers, "title").orderBy("id").collect()
    assert [tuple(r) for r in merged] == [("0", "t", None, 1, 0), ("1", None, None, 0, 0)]


# --- joins -------------------------------------------------------------------------


def test_left_join_and_one_row_per_key(spark):
    left = spark.createDataFrame(
        [("a", 1), ("a", 2), ("b", 3), ("c", 4), (None, 5)], "k string, n int"
    )
    right = spark.createDataFrame(
        [("a", "x"), ("a", "y"), ("b", None), ("d", "z"), (None, "q")], "_r string, v string"
    )
    found = joins.left_join(left, right, F.col("k"), "_r")
    assert found.columns == ["k", "n", "v"]
    assert rows(found) == rows(left.join(right, F.col("k") == F.col("_r"), "left").drop("_r"))
    single = joins.left_join(left, joins.one_per_key(right, "_r"), F.col("k"), "_r")
    assert single.count() == left.count()


def like(text, pattern):
    parts = {"%": ".*", "_": "."}
    regex = "".join(parts.get(c, re.escape(c)) for c in pattern)
    return re.fullmatch(regex, text, re.S) is not None


@pytest.mark.parametrize(("names_per_block", "links_per_slice"), [(1 << 16, 1 << 17), (7, 1 << 17), (7, 20)])
def test_containing_join_equals_like(spark, monkeypatch, names_per_block, links_per_slice):
    monkeypatch.setattr(joins, "_NAMES", names_per_block)
    monkeypatch.setattr(joins, "_LINKS", links_per_slice)
    rng = random.Random(3)
    def part(n):
        return "".join(rng.choice("ab1_%.\\") for _ in range(rng.randrange(1, n)))

    links = [None if rng.random() < 0.05 else "h/" + part(9).replace("%", "x") for _ in range(150)]
    links += [links[0]] * 50
    names = [part(5) for _ in range(60)] + ["_", "%", "a", "__"]
    names = [n for n in names if "/" not in n]
    feed = spark.createDataFrame(list(enumerate(links)), "id int, image_link string")
    images = spark.createDataFrame(
        [(f"gs://b/{n}", f"d{i}") for i, n in enumerate(names)], "uri string, description string"
    )
    want = Counter()
    for i, link in enumerate(links):
        hits = [j for j, n in enumerate(names) if link is not None and like(link, f"%{n}%")]
        want.update([(i, link, f"d{j}") for j in hits] or [(i, link, None)])
    assert rows(joins.join_images_containing(feed, images, allow_bare=True)) == want
    with pytest.raises(Exception, match="wildcards alone"):
        joins.join_images_containing(feed, images).collect()
    plan = plan_of(joins.join_images_containing(feed, images))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_name_join_ignores_query_and_has_no_nested_loop(spark):
    feed = spark.createDataFrame(
        [(1, "https://x/a.png?w=1"), (2, "https://x/b.png#t"), (3, "none"), (4, None)],
        "id int, image_link string",
    )
    images = spark.createDataFrame(
        [("gs://b/1/a.png", "A"), ("gs://b/2/a.png", "A2"), ("gs://b/b.png", "B")],
        "uri string, description string",
    )
    found = joins.join_images_by_name(feed, images)
    got = Counter((r.id, r.image_description) for r in found.collect())
    assert got == Counter([(1, "A"), (1, "A2"), (2, "B"), (3, None), (4, None)])
    assert "NestedLoop" not in plan_of(found)


def test_any_number_of_examples_by_id(spark):
    df = spark.range(3000).select(
        F.col("id").cast("string"), *[F.lit("x").alias(c) for c in ("properties", "title", "description")]
    )
    shown = joins.collected_examples(df).first().examples
    assert [e.id for e in shown] == sorted(str(i) for i in range(3000))
    inputs, outputs = joins.example_texts(df, "title")
    made = spark.range(2).select(inputs.alias("i"), outputs.alias("o")).first()
    assert made.i == "\n".join(["x"] * 3000) and made.o.startswith("0: x\n1: x\n10: x")
    assert joins.collected_examples(df.limit(0)).first().examples == []


def test_ids_are_compared_as_texts_in_lists_of_any_length(spark):
    numbers = spark.range(3000).select("id")
    texts = numbers.select(F.col("id").cast("string"))
    short, long = ["007", "8", "z"], ["007", "8", "z", *map(str, range(1000, 3000))]
    for df in (numbers, texts):
        assert [str(r.id) for r in selection.by_ids(df, short).collect()] == ["8"]
        assert selection.by_ids(df, long).count() == 2001
        wanted = spark.createDataFrame([(i,) for i in long], "x string")
        assert rows(selection.by_ids(df, wanted)) == rows(selection.by_ids(df, long))


def test_literal_examples(spark):
    found = joins.literal_examples(spark, [{"id": "1", "title": "t"}])
    assert [tuple(r) for r in found.collect()] == [("1", None, "t", None)]


def test_first_row_of_a_repeated_id(spark):
    feed = spark.createDataFrame([("1", "b", 2), ("1", "a", 1), ("2", "c", 3)], "id string, x string, pos int")
    found = joins.context_of_ids(feed, ["1", "9"], "pos").collect()
    assert [tuple(r) for r in found] == [("1", '{"id":"1","x":"a"}')]


# --- prompts -----------------------------------------------------------------------


def test_batch_prompt_sections(spark):
    one = F.struct(
        F.lit("7").alias("id"),
        F.lit('{"x":1}').alias("properties"),
        F.lit("A title").alias("title"),
        F.lit(None).cast("string").alias("description"),
    )
    props = F.array(F.lit("p1"), F.lit(None).cast("string"), F.lit("p2"))
    made = spark.range(1).select(
        batch_prompt("title", "German", props, F.array(one)).alias("t"),
        batch_prompt("description", "German", props, F.array(one)).alias("d"),
        batch_prompt("title", "German", props).alias("n"),
    ).first()
    assert "Answer in German" in made.t
    assert "\n7: A title\n" in made.t and '{"x":1}' in made.t
    # A missing text gives an empty line, a missing product as well; nothing turns NULL.
    assert "p1\n\np2" in made.t
    assert "p1\n\np2" in made.d
    assert made.n is not None


def test_other_prompt_parts(value):
    e = F.array(F.struct(F.lit("{}").alias("context"), F.lit("a | b").alias("keys")))
    assert value(few_shot_block(e, ["keys"])) == "Context: {}\nkeys: a | b"
    assert value(page_text_section(F.lit("t"))) == "Website: t\n\n"
    assert value(page_text_section(F.lit(None).cast("string"))) == ""
    assert "holds the hue" in column_prompt("colour", "English", "the hue")


# --- answers and pages -------------------------------------------------------------


def test_first_answer_wins_and_strangers_fall_out(spark):
    generated = spark.createDataFrame(
        [
            (1, ["a", "b", "c"], "b: late\nz: other\nb: later"),
            (0, ["b", "d"], "c: not mine\nb: early\nd"),
            (2, ["e", "f"], None),
        ],
        "chunk_id long, ids array<string>, response string",
    )
    found = {r.id: r.text for r in first_answers(generated).collect()}
    assert found == {"b": "early", "d": None, "e": None, "f": None}


def test_answers_are_reduced_before_the_shuffle(spark):
    generated = spark.createDataFrame(
        [(0, ["a"], "a: x\n" * 50_000)], "chunk_id long, ids array<string>, response string"
    )
    found = first_answers(generated)
    assert rows(found) == Counter([("a", "x")])
    assert "partial_min" in plan_of(found)


def test_page_texts(spark):
    html = (
        "<html><head><p>no</p></head>\n<p>one <b>two</b></p>\n<span class='x'>three</span>\n"
        "<p>lost <a href='x'>link</a></p>\n<script src='x'>code</script>\n<pre>kept</pre>"
    )
    pages = spark.createDataFrame(
        [("1", "text/html", html), ("2", "application/json", '{"p":1}'), ("3", "text/html", None)],
        "id string, content_type string, html string",
    )
    found = {r.id: r.content for r in page_texts(pages).collect()}
    assert found == {"1": "three one <b>two</b> kept", "2": '{"p":1}', "3": ""}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        # From the first bracket to the last one of the line.
        ("<span>a</span><span>b</span>", "a</span><span>b"),
        # Spans go before paragraphs, whatever their order on the page.
        ("<p>q</p>\n<span class='x'>s</span>", "s q"),
        # A paragraph that ends on another line has no last bracket.
        ("<p>x\n</p>", ""),
        # The head goes to its last end tag.
        ("<head><p>h</p></head><p>b</p></head>\n<p>c</p>", "c"),
        # Cut to the end of the line, not to the end tag.
        ("<iframe src='1'></iframe><p>gone</p>\n<p>stay</p>", "stay"),
        ("<p>a</p><svg x='1'><p>gone</p>\n<path d='m'/>\n<p>b</p>", "a b"),
        # The sign after the tag decides: none of its own letters.
        ("<scripts><p>kept</p>", "kept"),
        ("<a a='1'><p>kept</p>", "kept"),
        ("<a b='1'><p>gone</p>", ""),
        ("<pp>not a paragraph</pp>", ""),
        # Other line ends count as well.
        ("<p>a</p>\u2028<p>b</p>\r<p>c</p>", "a b c"),
        ("", ""),
    ],
)
def test_page_rules(value, html, text):
    assert value(rule_text(F.lit(html))) == text


def test_div_texts(spark):
    html = (
        '<div class="a b">x<br>y<div class="a">in\r\nner</div><script>no</script><!-- no --></div>'
        '<div class="ab">not</div><p class="a">not</p><div class="a">z &amp; <i>w</i>'
    )
    pages = spark.createDataFrame([("1", html), ("2", None)], "id string, html string")
    found = {r.id: r.content for r in page_div_texts(pages, "a").collect()}
    assert found == {"1": "xyin ner in ner z & w", "2": None}
    coded = ["<p>none</p>", '<div class="&#97;">coded</div>', "<div CLASS = '&#97; x'>q</div>", "<div class=&#97;>bare</div>", "<p>R&D, x & y</p>"]
    others = spark.createDataFrame([(str(i), h) for i, h in enumerate(coded)], "id string, html string")
    assert [r.content for r in page_div_texts(others, "a").orderBy("id").collect()] == ["", "coded", "q", "bare", ""]
    # Only pages that may name the class go to the parser.
    assert [r.n for r in others.orderBy("id").select(F.col("html").rlike(_CODED_CLASS).alias("n")).collect()] == [False, True, True, True, False]
