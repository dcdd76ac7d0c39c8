from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

from feedlift.llm import arrays, bitmap, decontaminate
from feedlift.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.conftest import ODD


def _tokens(text):
    return re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", (text or "").translate(brute.LOWER))


def _leaks(docs, items, least=13):
    """Pairs with a diagonal on which a seed of the operator could lie and enough words agree."""
    out = set()
    split = [(j, _tokens(t)) for j, t in items]
    for i, text in docs:
        d = _tokens(text)
        where = {}
        for k, x in enumerate(d):
            where.setdefault(x, []).append(k)
        for j, w in split:
            if len(w) < decontaminate.SHORTEST:
                continue
            for at in {p - k for k, x in enumerate(w) for p in where.get(x, ())}:
                equal = [0 <= at + k < len(d) and d[at + k] == x for k, x in enumerate(w)]
                s, e = decontaminate.best_stretch(np.array(equal))
                n = sum(equal[s:e])
                if n >= least or 5 * n >= 4 * len(w):
                    out.add((i, j))
    return out


def test_query_against_brute_force(spark, table):
    folder, rows = table
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op1_decontamination"](spark, folder).collect()}
    assert got == _leaks(rows, items)
    assert got


def _text(rng, n):
    return [rng.choice("bcdfg") + str(rng.randrange(3000)) for _ in range(n)]


@pytest.fixture
def planted(spark, docs):
    rng = random.Random(11)
    items = [(j, _text(rng, n)) for j, n in enumerate([6, 11, 12, 14, 20, 40, 300])]
    rows = []
    for j, w in items:
        for changed in (0, 1) if len(w) > 12 else (0,):
            copy = list(w)
            for k in range(changed):
                copy[len(w) // 2 + k] = "other"
            rows.append((100 * j + changed, " ".join(_text(rng, 70)) + ".\n(" + ", ".join(copy).upper() + "!) " + " ".join(_text(rng, 50)), j))
    rows += [(9000 + k, " ".join(_text(rng, 200)), None) for k in range(20)]
    benchmark = spark.createDataFrame([(j, " ".join(w)) for j, w in items], "item_id long, text string")
    return docs([r[:2] for r in rows]), benchmark, rows


def test_planted_passages_are_found_and_clean_texts_left_alone(planted):
    frame, benchmark, rows = planted
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, benchmark).collect()}
    assert got == {(i, j) for i, _, j in rows if j is not None}


def test_spans(planted):
    frame, benchmark, _ = planted
    r = next(r for r in decontaminate.leaks(frame, benchmark).collect() if r.doc_id == 500)
    assert (r.n_matched, r.n_compared, r.doc_from, r.doc_to, r.item_from, r.item_to) == (40, 40, 70, 110, 0, 40)


def _most_of(doc, item):
    """The most words of the item that are equal on one diagonal, and the most on a stretch with the highest score."""
    whole = stretch = 0
    for at in range(1 - len(item), len(doc)):
        equal = [0 <= at + k < len(doc) and doc[at + k] == x for k, x in enumerate(item)]
        whole = max(whole, sum(equal))
        if sum(equal) > 1:
            spans = [(sum(1 if x else -3 for x in equal[s:e]), sum(equal[s:e])) for s in range(len(equal)) for e in range(s + 1, len(equal) + 1)]
            stretch = max(stretch, max(spans)[1])
    return whole, stretch


def test_four_fifths_of_an_item_wherever_its_changed_words_are(spark, docs):
    rng = random.Random(5)
    items = [(j, _text(rng, n)) for j, n in enumerate([15, 16, 20, 25, 30, 59])]
    rows = []
    for j, w in items:
        for changed in [len(w) // 5] * 8 + [len(w) // 3]:
            copy = list(w)
            for k in rng.sample(range(len(w)), changed):
                copy[k] = "other"
            rows.append((len(rows), _text(rng, 20) + copy + _text(rng, 20)))
    benchmark = spark.createDataFrame([(j, " ".join(w)) for j, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs([(i, " ".join(d)) for i, d in rows]), benchmark).collect()}
    best = {(i, j): (*_most_of(d, w), len(w)) for i, d in rows for j, w in items}
    assert {p for p, (whole, _, n) in best.items() if 5 * whole >= 4 * n} <= set(got)
    assert set(got) <= {p for p, (whole, stretch, n) in best.items() if stretch >= 13 or 5 * whole >= 4 * n}
    assert [p for p, (whole, stretch, n) in best.items() if stretch < 13 and 5 * stretch < 4 * n and 5 * whole >= 4 * n]
    for p, r in got.items():
        assert r.n_matched in best[p][:2]
        assert r.doc_from - r.item_from == 20
        assert r.n_compared == r.item_to - r.item_from


def test_short_items_with_any_words_changed(spark, docs):
    rng = random.Random(6)
    items = [(n, _text(rng, n)) for n in range(2, 15)]
    rows, lost = [], []
    for n, w in items:
        for changed in combinations(range(n), n // 5):
            copy = ["other" if k in changed else x for k, x in enumerate(w)]
            rows.append((1000 * n + len(rows), [*_text(rng, 3), *copy, *_text(rng, 3)], n))
        rows.append((100_000 + n, w[1 if n >= 5 else 0 :], n))  # the document begins within the item
        wrong = rng.sample(range(n), n // 5 + 1)
        lost.append((200_000 + n, ["other" if k in wrong else x for k, x in enumerate(w)]))
    benchmark = spark.createDataFrame([(j, " ".join(w)) for j, w in items], "item_id long, text string")
    frame = docs([(r[0], " ".join(r[1])) for r in rows + lost])
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, benchmark).collect()} == {(i, j) for i, _, j in rows}


def test_scripts_without_spaces(spark, docs):
    items = [(1, "中国的首都是哪里?"), (2, "日本で一番高い山は、富士山です。"), (3, "เมืองหลวงของประเทศไทยคืออะไร"), (4, "𠀀𠀁𠀂")]
    rows = [
        (1, "今天我们学习:中国的首都是哪里,请回答"), (2, "問い:日本で一番高い山は富士山です。続き"), (3, "คำถามเมืองหลวงของประเทศไทยคืออะไรตอบ"), (4, "漢𠀀𠀁𠀂字"),
        (5, "今天中国的首府是哪里呢"), (6, "今天我们去公园里看花"), (7, "富士山は日本の高い山"), (8, None), (9, "中国"), (10, "的首都"),
    ]
    got = decontaminate.leaks(docs(rows, 1), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 1)}


def test_odd_texts_and_empty_tables(spark, docs):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (None, "no id at all no id at all no id at all"), (3, "a")], "item_id long, text string")
    got = decontaminate.leaks(docs(ODD), benchmark).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(None, None)]
    assert decontaminate.leaks(docs([], 1), benchmark).count() == 0
    assert decontaminate.leaks(docs(ODD), benchmark.limit(0)).count() == 0


def test_clashing_columns_are_not_read(spark, docs):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    frame = docs([(1, text)]).withColumnsRenamed({"lang": "key", "source": "item_id", "n_chars": "seeds"})
    benchmark = spark.createDataFrame([(5, text, 1)], "item_id long, text string, doc_id int")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, benchmark).collect()] == [(1, 5)]


def test_bitmap_loses_nothing(spark):
    h = arrays.random_table(5000, 3)
    found = bitmap.bitmap_of(spark.createDataFrame([(int(x),) for x in arrays.signed(h)], "seed long"), "seed")
    assert bitmap.maybe_in(found.value, h).all()
    assert bitmap.maybe_in(found.value, arrays.random_table(5000, 10**9)).mean() < 0.01
