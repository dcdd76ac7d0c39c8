from __future__ import annotations

import random

import numpy as np
import pytest

from feedlift.llm import arrays, repeats
from feedlift.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.conftest import ODD


def _rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def _expected(rows, k=35):
    return sorted(brute.repeated_words(rows, k), key=str)


def test_query_against_brute_force(spark, table):
    folder, rows = table
    assert _rows(QUERIES["op2_repeated_passages"](spark, folder)) == _expected(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_cut_and_joined_at_random(docs, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdef") + str(rng.randrange(50))
    sources = [[word() for _ in range(rng.randrange(40, 300))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(1, 5)):
            s = rng.choice(sources)
            a = rng.randrange(len(s))
            words += s[a : a + rng.randrange(20, 120)]
            words += [word() for _ in range(rng.randrange(0, 30))]
            if rng.random() < 0.3:
                words[rng.randrange(len(words))] = "edited"
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(100, "a b " * 80), (101, "z " * 36), (102, "y " * 35), (103, "x " * 34)]
    assert _rows(repeats.repeat_digests(docs(rows, 7))) == _expected(rows)


def test_odd_texts(docs):
    assert _rows(repeats.repeat_digests(docs(ODD))) == _expected(ODD)
    assert repeats.repeat_digests(docs([], 1)).count() == 0


def test_clashing_columns_are_not_read(docs):
    rows = [(1, "q " * 40 + "end"), (2, "one two")]
    frame = docs(rows).withColumnsRenamed({"lang": "key", "source": "member", "n_chars": "starts"})
    assert _rows(repeats.repeat_digests(frame)) == _expected(rows)


def test_sliding_min():
    v = np.random.default_rng(1).integers(0, 99, 200)
    for width in (1, 2, 5, 8, 28):
        assert list(repeats._sliding_min(v, width)) == [v[i : i + width].min() for i in range(200 - width + 1)]


def test_edges_hold_every_window_once():
    text = " ".join(str(i * i % 97) for i in range(500)).encode()
    raw, offsets = np.frombuffer(text * 2, np.uint8), np.array([0, len(text), 2 * len(text)])
    doc, anchor, content, start, n = repeats.edges_of(arrays.words(raw, offsets), 35, 8)
    for d in (0, 1):
        mine = doc == d
        covered = np.concatenate([np.arange(s, s + k) for s, k in zip(start[mine], n[mine], strict=True)])
        assert list(covered) == list(range(500 - 34))
    assert list(content[doc == 0]) == list(content[doc == 1])


def test_long_paths_are_compacted(spark):
    links = [(i, i + 1, 2) for i in range(100)] + [(1000 + i, 1001 + i, 3) for i in range(7)]
    random.Random(1).shuffle(links)
    got = {r.node: (r["head"], r.offset) for r in repeats.compacted(spark.createDataFrame(links, "node long, next long, step int")).collect()}
    assert got == {i: (0, 2 * i) for i in range(1, 101)} | {1000 + i: (1000, 3 * i) for i in range(1, 8)}
