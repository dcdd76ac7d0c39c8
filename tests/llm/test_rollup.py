from __future__ import annotations

import random

import pytest

from feedlift.llm import rollup
from feedlift.llm.queries import QUERIES, SQL
from tests import compare
from tests.llm.conftest import ODD


@pytest.fixture
def changes(spark):
    return lambda rows: spark.createDataFrame(rows, rollup.CHANGES)


@pytest.fixture
def book(spark, tmp_path):
    return rollup.Rollup(spark, str(tmp_path / "rollup"))


def _totals(book):
    return {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in book.totals().collect()}


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    names, rows = compare.rows_of_spark(QUERIES["op8_token_rollup"](spark, folder))
    sql_names, sql_rows = compare.rows_of_sql(compare.duck(folder), SQL["op8_token_rollup"])
    assert names == sql_names
    assert not compare.difference(rows, sql_rows)


def test_random_batches_against_a_dictionary(book, changes):
    rng, state = random.Random(4), {}
    for b in range(6):
        rows = {}
        for _ in range(40):
            key = (rng.randrange(30), rng.choice(["v1", "v2"]))
            deleted = rng.random() < 0.3
            rows[key] = (*key, rng.choice(["a", "b", None]), rng.choice(["en", None]), None if deleted else rng.randrange(100), deleted)
        assert book.apply(f"b{b}", changes(list(rows.values())))
        for key, r in rows.items():
            state.pop(key, None)
            if not r[5]:
                state[key] = r
        want = {}
        for (_, v), r in state.items():
            n, t = want.get((r[2], r[3], v), (0, 0))
            want[r[2], r[3], v] = (n + 1, t + r[4])
        assert _totals(book) == want
    assert book.counted().count() == len(state)


def test_two_records_of_a_batch_count_once(spark, book, changes):
    assert book.apply("one", changes([(1, "v", "s", "en", 10, False)]))
    (_, attempt), = book.commits()
    for kind in ("ledger", "sums"):
        spark.read.parquet(f"{book._path}/{kind}/{attempt}").write.parquet(f"{book._path}/{kind}/one-other")
    record = spark.createDataFrame([("one", "one-other", 0)], "batch_id string, attempt string, place long")
    record.write.mode("append").parquet(f"{book._path}/commits/one")
    assert len(book.commits()) == 1
    assert _totals(book) == {("s", "en", "v"): (1, 10)}
    assert book.apply("two", changes([(2, "v", "s", "en", 5, False)]))
    assert _totals(book) == {("s", "en", "v"): (2, 15)}


def test_a_batch_may_come_again(book, changes):
    batch = changes([(1, "v", "s", "en", 10, False), (2, "v", "s", "en", 5, False)])
    assert book.apply("one", batch)
    assert not book.apply("one", batch)
    assert _totals(book) == {("s", "en", "v"): (2, 15)}
    assert book.apply("two", changes([(1, "v", "s", "en", 11, False), (9, "v", None, None, None, True)]))
    assert _totals(book) == {("s", "en", "v"): (2, 16)}


def test_a_lost_attempt_is_not_counted(book, changes, monkeypatch):
    batch = changes([(1, "v", "s", "en", 10, False)])
    spark = book._spark

    class Fails:
        def __getattr__(self, name):
            if name == "createDataFrame":
                raise OSError("lost")
            return getattr(spark, name)

    monkeypatch.setattr(book, "_spark", Fails())
    with pytest.raises(OSError):
        book.apply("one", batch)
    monkeypatch.setattr(book, "_spark", spark)
    assert _totals(book) == {}
    assert book.apply("one", batch)
    assert _totals(book) == {("s", "en", "v"): (1, 10)}


def test_repeats_nulls_and_empty_batches(book, changes):
    assert book.apply("empty", changes([]))
    rows = [(1, "v", "s", "en", 3, False)] * 3 + [(1, "v", "s", "en", 7, False), (None, "v", "s", "en", 1, False)]
    rows += [(2, None, "s", "en", 1, False), (3, "v", "s", "en", None, False), (4, "v", None, None, 0, None), (5, "v", "s", "en", 1, False), (5, "v", None, None, None, True)]
    assert book.apply("odd", changes(rows))
    assert _totals(book) == {("s", "en", "v"): (2, 8), (None, None, "v"): (1, 0)}
    with pytest.raises(ValueError):
        book.apply("a/b", changes([]))


def test_token_counts_of_odd_texts(docs):
    frame = docs(ODD).withColumnRenamed("n_chars", "version")
    got = rollup.counts(frame, "w", rollup.words_1("text")).collect()
    assert len(got) == len(ODD)
    want = sorted((str(i), len((t or "").encode().split())) for i, t in ODD)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want
