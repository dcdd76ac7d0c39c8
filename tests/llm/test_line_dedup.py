from __future__ import annotations

import random

import numpy as np
import pytest

from feedlift.llm import line_dedup, runs
from feedlift.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.conftest import ODD


def _rows(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()}


def test_query_against_brute_force(spark, table):
    folder, rows = table
    assert _rows(QUERIES["op9_line_dedup"](spark, folder)) == brute.line_digests(rows)


def test_hot_line_over_many_partitions(spark, docs):
    hot = "This line stands in every document, as a licence would do."
    rng = random.Random(3)
    rows = []
    for i in range(400):
        lines = [f"line {rng.randrange(60)} of a text that is long enough to count here" for _ in range(5)]
        lines += ["  " + hot.upper() + "\t"] * rng.randrange(1, 4) + ["short"]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    assert _rows(line_dedup.line_digests(docs(rows, 11))) == brute.line_digests(rows)


def test_odd_texts(docs):
    rows = [r for r in dict(ODD).items()]
    assert _rows(line_dedup.line_digests(docs(rows))) == brute.line_digests(rows)
    assert line_dedup.line_digests(docs([], 1)).count() == 0
    assert line_dedup.line_digests(docs(ODD)).count() == len(ODD)  # repeated rows stay rows


def test_repeated_rows_are_one_document(docs):
    line = "a line that has far more than forty code points in it"
    got = line_dedup.line_digests(docs([(1, line)] * 3 + [(2, line)] * 2)).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in got) == [(1, 0)] * 3 + [(2, 0)] * 2
    got = line_dedup.line_digests(docs([(i, line) for i in range(1, 6) for _ in range(7)], 11)).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in got) == [(i, int(i < 5)) for i in range(1, 6) for _ in range(7)]


def test_repeated_rows_against_brute_force(docs):
    rng = random.Random(31)
    rows = {i: "\n".join(f"line {rng.randrange(40)} of a text that is long enough to be counted" for _ in range(4)) for i in range(60)}
    many = [(i, t) for i, t in rows.items() for _ in range(rng.choice([1, 1, 2, 9]))]
    rng.shuffle(many)
    got = line_dedup.line_digests(docs(many, 13)).collect()
    want = brute.line_digests(list(rows.items()))
    assert len(got) == len(many) and all((r.n_lines, r.n_dropped, r.kept_sha256) == want[r.doc_id] for r in got)


def test_clashing_columns_are_not_read(docs):
    frame = docs([(1, "a\nb")]).withColumnsRenamed({"lang": "hash", "source": "member", "n_chars": "key"})
    assert line_dedup.line_digests(frame).count() == 1


def test_bitmap_round_trip():
    dropped = np.array([0, 3, 9])
    keep = line_dedup.unpack_bitmap(line_dedup.pack_bitmap(dropped), 12)
    assert list(np.flatnonzero(~keep)) == [0, 3, 9]
    assert line_dedup.unpack_bitmap(None, 3).all()


@pytest.mark.parametrize("least", [2, 5])
@pytest.mark.parametrize("partitions", [1, 7, 23])
def test_runs(spark, least, partitions):
    rng = random.Random(least * partitions)
    rows = [(min(rng.randrange(90), 12) if rng.random() < 0.5 else 1000 + rng.randrange(200), rng.randrange(2), k) for k in range(900)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "hash long, more long, member long").repartition(5)
    for keys in (["hash"], ["hash", "more"]):
        stream = runs.repeated(frame, keys, ["member"], least, partitions)
        got = {r.member: r.first_member for r in runs.settled(stream, keys, least).collect()}
        groups = {}
        for *key, m in rows:
            groups.setdefault(tuple(key[: len(keys)]), []).append(m)
        assert got == {m: min(g) for g in groups.values() if len(g) >= least for m in g}
