from __future__ import annotations

import csv
import datetime
import itertools
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from feedlift.catalog.review import CONFIG
from feedlift.config import FeedConfig, TitleSettings
from feedlift.functions import scoring as s
from feedlift.operators import review as steps
from feedlift.operators.selection import approve_where
from feedlift.operators.export import attribute_keys, export_approved, utc_text, write_wide_export
from feedlift.operators.generation import ExpressionCompleter
from feedlift.plans.review_feed import review_feed

# Products of our own making.
OLD = "Halvard Garden Folding Chair With Armrests"
TEXT = OLD + ", light frame of oiled acacia, seat of quick drying canvas."


def answer(original, keys, values, replaced="", title=""):
    return (
        f"product attribute keys in original title: {original}\nproduct category: Tops\n"
        f"product attribute keys: {keys}\nproduct attribute values: {values}\n"
        f"replaced keys: {replaced}\ngenerated title: {title}"
    )


def review(spark, row, response, cfg=CONFIG, description=None):
    feed = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` string" for k in row))
    described = description or "description: new text\nscore: 0.9\nreasoning: fine"
    return review_feed(
        feed,
        cfg,
        ExpressionCompleter(lambda p: F.lit(response)),
        ExpressionCompleter(lambda p: F.lit(described)),
        freeze=False,
    )


BRAND_TO_TYPE = "Brand | Place | Category | Product Type"
BASE = {
    "id": "1",
    "title": OLD,
    "description": TEXT,
    "Brand": "Halvard",
    "Place": "Garden",
    "Category": "Folding",
    "Height": "Height 46cm",
    "Finish": "Walnut",
    "Material": "Acacia",
}


@pytest.mark.parametrize(
    ("change", "keys", "values", "score"),
    [
        # A feature that no column mentions counts as invented.
        ({}, BRAND_TO_TYPE + " | Height | Weather",
         "Halvard | Garden | Folding | Chair With Armrests | Height 46cm | Rainproof", -1.0),
        # "With Armrests" is lost.
        ({}, BRAND_TO_TYPE + " | Height", "Halvard | Garden | Folding | Chair | Height 46cm", -0.5),
        # Only the height is added.
        ({}, BRAND_TO_TYPE + " | Height",
         "Halvard | Garden | Folding | Chair With Armrests | Height 46cm", 0.5),
        # Height added and finish gap filled, the finish being named elsewhere in the row.
        ({"Finish": "", "Notes": "walnut stain"}, BRAND_TO_TYPE + " | Finish | Height",
         "Halvard | Garden | Folding | Chair With Armrests | Walnut | Height 46cm", 1.0),
        # A filled gap is no part of the vocabulary by itself.
        ({"Finish": ""}, BRAND_TO_TYPE + " | Finish | Height",
         "Halvard | Garden | Folding | Chair With Armrests | Walnut | Height 46cm", -1.0),
        # Nothing changed.
        ({}, BRAND_TO_TYPE, "Halvard | Garden | Folding | Chair With Armrests", 0.0),
    ],
)
def test_documented_title_scores(spark, change, keys, values, score):
    row = review(spark, {**BASE, **change}, answer(BRAND_TO_TYPE, keys, values)).first()
    assert row.title_score == score
    assert row.title_changed == (score != 0)
    assert row.approval == (score >= 0)


def test_score_table(value):
    for new, removed, gap, added in itertools.product([True, False], repeat=4):
        want = -1.0 if new else -0.5 if removed else 0.5 * gap + 0.5 * added
        assert value(s.title_score(*map(F.lit, (new, removed, gap, added)))) == want


def test_new_attribute_is_extracted_and_prefixed(spark):
    row = {
        "id": "1",
        "title": "Tolva Kitchen Stoneware Mug Speckled",
        "description": "d",
        "Brand": "Tolva",
        "Room": "Kitchen",
    }
    text = answer(
        "Brand | Room | Product Type",
        "Brand | Room | Product Type | Glaze",
        "Tolva | Kitchen | Stoneware Mug | Speckled",
    )
    reviewed = review(spark, row, text)
    assert reviewed.first().gap_attributes == '{"Glaze":"Speckled"}'
    assert [tuple(r) for r in attribute_keys(reviewed).collect()] == [("Glaze", "new", None)]
    export = export_approved(reviewed, FeedConfig(new_attribute_prefix="made-"), layout="wide")
    assert export.columns == ["modified_at", "Item ID", "Title", "Description", "made-Glaze"]
    assert export.first()["made-Glaze"] == "Speckled"


@pytest.mark.parametrize(
    ("key", "given", "kept"),
    [
        ("Size", "size", ""),
        ("Size", "SIZE,", ""),
        ("Size", "size ,", ""),
        ("Size", ",", ""),
        ("Size", " M, ", "M"),
        ("Size", "Size M", "Size M"),
    ],
)
def test_echoed_keys_are_no_values(value, key, given, kept):
    assert value(s.real_value(F.lit(key), F.lit(given), strip_comma=True)) == kept


def test_only_one_trailing_comma_goes(value):
    assert value(s.real_value(F.lit("k"), F.lit("a,,"), strip_comma=True)) == "a,"
    assert value(s.real_value(F.lit("k"), F.lit("a,"))) == "a,"


def facts_of(spark, keys, values, original=(), replaced=(), row=None, prefer=False):
    df = spark.createDataFrame(
        [(list(keys), list(values), list(original), list(replaced), row or {})],
        "k array<string>, v array<string>, o array<string>, r array<string>, m map<string,string>",
    )
    facts = s.attribute_facts(
        F.col("k"), F.col("v"), F.col("o"), F.col("r"), F.col("m"), prefer_generated=prefer
    )
    gaps = F.map_entries(s.gap_attributes(F.col("f"))).alias("g")
    found = df.select(facts.alias("f")).select("f", gaps).first()
    return [tuple(f) for f in found.f], dict(tuple(e) for e in found.g)


def test_gap_rules(spark):
    row = {"brand": "Acme", "size": "", "color": None}
    facts, gaps = facts_of(
        spark,
        ["brand", "size", "fit", "style", "color"],
        ["Other", "M", "slim", "old", "color,"],
        original=["style", "size"],
        row=row,
    )
    # size is a gap though it is in the old template, being a column; style is not.
    assert gaps == {"size": "M", "fit": "slim"}
    assert facts[0] == ("brand", None, "Acme")
    assert facts[3] == ("style", None, "old")
    assert facts[4] == ("color", None, None)


def by_hand(keys, values, original, replaced, row, prefer):
    """The attribute rules, one attribute after the other."""

    def real(key, value):
        value = value.strip()
        bare = value[:-1] if value.endswith(",") else value
        echo = key.lower() in (value.lower(), bare.strip().lower())
        return ("", "") if echo or value == "," else (value, bare.strip())

    gaps, used = {}, []
    for place, key in enumerate(keys):
        made = values[place] if place < len(values) else None
        fed = row.get(key) or ""
        open_gap = fed == "" and made and (key not in original or key in row)
        if made is not None and (open_gap or key.lower() in replaced) and real(key, made)[1]:
            gaps[key] = real(key, made)[1]
        chosen = made if prefer or fed == "" else fed
        if chosen is not None and chosen.strip() and real(key, chosen)[0]:
            used.append((key, real(key, chosen)[0]))
    return gaps, used


@pytest.mark.parametrize("prefer", [False, True])
def test_random_attribute_lists(spark, prefer):
    rng = random.Random(11)
    names = ["Size", "size", "Color", "fit", "", "Brand"]
    texts = ["M", "m,", ",", "", " ", "Size", "size,", "fit ,", "Acme", "Color", "a,,"]
    cases = []
    for _ in range(400):
        keys = rng.choices(names, k=rng.randrange(6))
        values = rng.choices(texts, k=max(0, len(keys) + rng.randrange(-2, 2)))
        original = rng.choices(names, k=rng.randrange(4))
        replaced = [n.lower() for n in rng.choices(names, k=rng.randrange(2))]
        row = {n: rng.choice([*texts, None]) for n in rng.sample(names, 3)}
        cases.append((len(cases), keys, values, original, replaced, row))
    df = spark.createDataFrame(
        cases,
        "i int, k array<string>, v array<string>, o array<string>, r array<string>, "
        "m map<string,string>",
    )
    facts = s.attribute_facts(
        F.col("k"), F.col("v"), F.col("o"), F.col("r"), F.col("m"), prefer_generated=prefer
    )
    found = df.select("i", facts.alias("f")).select(
        "i",
        # As entries: a collected map has no order.
        F.map_entries(s.gap_attributes(F.col("f"))).alias("g"),
        s.used_facts(F.col("f")).alias("u"),
    )
    for r in found.collect():
        gaps, used = by_hand(*cases[r.i][1:], prefer)
        assert [tuple(e) for e in r.g] == list(gaps.items()), cases[r.i]
        assert [(u.name, u.used) for u in r.u] == used, cases[r.i]


def test_replaced_keys_count_as_gaps_and_need_a_value(spark):
    _, gaps = facts_of(
        spark, ["Brand", "fit"], ["Other"], replaced=["brand", "fit"], row={"Brand": "Acme"}
    )
    assert gaps == {"Brand": "Other"}


def test_repeated_attribute_keeps_its_first_place_and_last_value(spark):
    _, gaps = facts_of(spark, ["a", "b", "a"], ["1", "2", "3"])
    assert list(gaps.items()) == [("a", "3"), ("b", "2")]


def test_generated_values_can_be_preferred(spark):
    facts, _ = facts_of(spark, ["brand"], ["Other"], row={"brand": "Acme"}, prefer=True)
    assert facts == [("brand", None, "Other")]


def test_random_titles(spark):
    rng = random.Random(12)
    bits = ["Men's", "men", "MEN", "Mens", "Größe", "größe", "10×5cm", "5cm", "O'Neil", "Oneil", "-", "x,"]

    def title():
        return " ".join(rng.choices(bits, k=rng.randrange(6)))

    cases = [(i, title(), title(), rng.choices(["men", "größe", "10", "o"], k=2)) for i in range(500)]
    df = spark.createDataFrame(cases, "i int, old string, new string, known array<string>")
    found = df.select(
        "i",
        s.new_words(F.col("new"), F.col("known")).alias("n"),
        s.removed_words(F.col("old"), F.col("new")).alias("r"),
    )

    def words(text):
        return re.findall("[A-Za-zÀ-ÖØ-öø-ÿ0-9]+", text.replace("'s", ""))

    for row in found.collect():
        _, old, new, known = cases[row.i]
        fresh = [w for w in dict.fromkeys(words(new)) if w.lower() not in known]
        kept = {w.lower() for w in words(new)}
        bare = new.replace("'", "")
        lost = [w for w in dict.fromkeys(words(old)) if w.lower() not in kept and w not in bare]
        assert (row.n, row.r) == (fresh, lost), cases[row.i]


def test_removed_words_are_part_of_text_tests(value):
    # "Men" is inside "Mens"; "men" is found in lower case; "Old" is gone.
    assert value(s.removed_words(F.lit("Men's Men men Old"), F.lit("Mens MEN swim"))) == ["Old"]


def test_new_words_keep_their_case(value):
    known = F.array(F.lit("acme"))
    assert value(s.new_words(F.lit("Acme's Blue blue ACME Blue"), known)) == ["Blue", "blue"]


def test_image_words_and_allowed_words_may_be_used(spark):
    text = answer("title", "title | Image Features", "a b | striped,")
    row = {"id": "1", "title": "a b", "description": "d"}
    found = review(spark, row, text).first()
    assert found.title_generated == "a b striped"
    assert found.title_score == 0.5 + 0.0 + 0.5
    cfg = FeedConfig(
        title=TitleSettings(allowed_words="Size", use_model_titles=True),
        description=CONFIG.description,
    )
    found = review(spark, row, answer("title", "title", "x", title=" a b SIZE "), cfg).first()
    assert (found.title_generated, found.new_words_added) == ("a b SIZE", "")


@pytest.mark.parametrize(
    ("title", "text", "status"),
    [
        ("", "t", "Failed compliance checks"),
        ("a", "t", "Success"),
        ("a" * 150, "t" * 5000, "Success"),
        ("a" * 151, "t", "Failed compliance checks"),
        ("a", "", "Failed compliance checks"),
        ("a", "t" * 5001, "Failed compliance checks"),
        ("a" * 149 + "\U0001f600", "t", "Failed compliance checks"),
    ],
)
def test_compliance_limits(value, title, text, status):
    assert value(s.compliance_status(F.lit(title), F.lit(text))) == status


@pytest.mark.parametrize(
    ("score", "threshold", "ok"),
    [(0.5, 0.5, True), (0.4, 0.5, False), (math.nan, 0.5, False), (1.0, math.nan, False)],
)
def test_nan_never_reaches_a_threshold(value, score, threshold, ok):
    assert value(s.reaches(F.lit(score), threshold)) is ok


def test_feed_text(value):
    assert value(s.feed_text(F.lit('a "b"'), True)) == 'trained_algorithmic_media:"a ""b"""'
    assert value(s.feed_text(F.lit("a"), False)) == ':"a"'
    assert value(s.feed_text(F.lit(None).cast("string"), True)) is None


def test_failed_rows_only_carry_their_error(spark):
    row = review(spark, BASE, "no labels at all").first()
    assert row.status == steps.FAILED_STATUS
    assert row.item_id == "1"
    assert row.full_response == "incomplete title answer: no labels at all"
    assert [row[c] for c in steps.REVIEW_COLUMNS if c not in ("status", "item_id", "full_response")] == [None] * 20
    row = review(spark, BASE, answer("a", "a", "b"), description="none").first()
    assert row.full_response == "incomplete description answer: none"


def test_nothing_is_approved_gives_no_export(spark):
    rejected = approve_where(review(spark, BASE, "x"), F.lit(False))
    assert export_approved(rejected, layout="wide") is None
    assert export_approved(rejected).isEmpty()


def test_stamps_are_utc_in_any_session(spark):
    stamps = ["2024-03-10T02:30:00.007Z", "2024-11-03T05:59:59.999Z", "1969-12-31T23:59:59.999Z", "2024-02-29T00:00:00.000Z"]
    for zone in ("UTC", "America/New_York", "America/Sao_Paulo", "Pacific/Apia"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = [spark.range(1).select(utc_text(F.lit(x).cast("timestamp")).alias("t")).first().t for x in stamps]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == stamps


def test_columns_keep_the_order_of_first_mention_in_wide_rows(spark):
    keys = [f"k{i:05d}" for i in range(5000)]
    rows = [(1, "{" + ",".join(f'"{k}":"v"' for k in keys) + "}"), (2, '{"early":"v"}')]
    review = spark.createDataFrame([(p, g, True, "{}") for p, g in rows], "pos long, gap_attributes string, approval boolean, original_input string")
    found = sorted(attribute_keys(review, "pos").collect(), key=lambda k: k["place"])
    assert [k["key"] for k in found] == [*keys, "early"]


def lines_of(path):
    files = sorted(path.glob("part-*"))
    return [row for f in files for row in csv.reader(f.open(newline=""))]


def test_wide_files_of_many_attributes(spark, tmp_path):
    n = 100_000
    sets = [{f"k{i}": f"v{i}" for i in range(0, n, 7)}, {f"k{i}": f"w{i}" for i in range(n)}, {}, {"k5": 'a "b", c', "K5": "line\nend"}]
    rows = [(p, f"id{p}", "t,1", None, json.dumps(g) if g else "", True, '{"k5":"x"}') for p, g in enumerate(sets)]
    kinds = "pos long, item_id string, title_generated string, description_generated string, gap_attributes string, approval boolean, original_input string"
    review = spark.createDataFrame(rows, kinds)
    stamp = datetime.datetime(2024, 1, 2, tzinfo=datetime.timezone.utc)
    assert write_wide_export(review, str(tmp_path / "e"), FeedConfig(new_attribute_prefix=""), position="pos", modified_at=stamp)
    names = [r[0] for r in lines_of(tmp_path / "e" / "header")]
    first = [*sets[0], *[k for k in sets[1] if k not in sets[0]], "K5"]
    order = ["k5", *[k for k in first if k != "k5"]]  # attributes of the input before new ones
    assert names[:4] == ["modified_at", "Item ID", "Title", "Description"]
    assert names[4:-1] == order[:-1] and names[-1] == "K5_2"
    got = lines_of(tmp_path / "e" / "rows")
    assert [len(r) for r in got] == [len(names)] * 4
    for row, given in zip(got, sets, strict=True):
        assert row[:1] + row[2:4] == ["2024-01-02T00:00:00.000Z", "t,1", ""]
        assert row[4:] == [given.get(k, "") for k in order]


def test_wide_files_agree_with_wide_columns(spark, tmp_path):
    text = answer("title", "title | fit | Fit | Title", "a b | slim | long | c")
    reviewed = approve_where(review(spark, {"id": "1", "title": "slim long c a b", "description": "d"}, text), F.lit(True))
    stamp = datetime.datetime(2024, 1, 2, tzinfo=datetime.timezone.utc)
    for prefix in ("", "new-"):
        cfg = FeedConfig(new_attribute_prefix=prefix)
        wide = export_approved(reviewed, cfg, modified_at=stamp, layout="wide")
        path = tmp_path / f"e{prefix}"
        assert write_wide_export(reviewed, str(path), cfg, modified_at=stamp)
        assert [r[0] for r in lines_of(path / "header")] == wide.columns
        assert lines_of(path / "rows") == [list(wide.first())]
    rejected = reviewed.withColumn("approval", F.lit(False))
    assert not write_wide_export(rejected, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_attributes_go_into_maps(spark):
    text = answer("title", "title | Fit | Cut", "a b | slim | long")
    reviewed = review(spark, {"id": "1", "title": "slim long a b", "description": "d"}, text)
    rows = approve_where(reviewed, F.lit(True))
    found = export_approved(rows).first()
    assert found.new_attributes == {"Fit": "slim", "Cut": "long"}


def test_export_columns_that_only_differ_in_case(spark, tmp_path):
    text = answer("title", "title | fit | Fit | Title", "a b | slim | long | c")
    reviewed = review(spark, {"id": "1", "title": "slim long c a b", "description": "d"}, text)
    export = export_approved(approve_where(reviewed, F.lit(True)), layout="wide")
    assert export.columns[4:] == ["new-Fit", "new-Title", "new-fit_2"]
    export.write.parquet(str(tmp_path / "e"))
    cfg = FeedConfig(new_attribute_prefix="")
    export = export_approved(approve_where(reviewed, F.lit(True)), cfg, layout="wide")
    assert export.columns[4:] == ["Fit", "Title_2", "fit_2"]
    row = export.first()
    assert (row["Fit"], row["Title_2"], row["fit_2"]) == ("long", "c", "slim")


def test_new_title_leads_the_context(spark):
    rows = spark.createDataFrame([("N", "{\"a\":\"1\"}", None, "")],
        "title_generated string, original_input string, failure string, page_text string")
    prompt = steps.add_description_prompt(rows, FeedConfig()).first().description_prompt
    assert prompt == 'Context: {"Generated Title":"N","a":"1"}\n\n'
    kept = rows.withColumn("original_input", F.lit('{"Generated Title":"mine"}'))
    prompt = steps.add_description_prompt(kept, FeedConfig()).first().description_prompt
    assert prompt == 'Context: {"Generated Title":"mine"}\n\n'
