from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from feedlift.llm import resampling
from feedlift.llm.queries import QUERIES
from tests.llm.conftest import ODD

LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall((text or "").translate(LOWER))


def _features(text, runs):
    w = _words(text)
    return [" ".join(w[i : i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]


def _bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def brute(rows, target, *, runs=1, buckets=10_000, seed=2024, percent=10, least=20):
    """(doc_id, n_features, weight, score, rank) of every row, from the definition."""
    source = Counter(_bucket(f, buckets) for _, t in rows for f in _features(t, runs))
    wanted = Counter(_bucket(f, buckets) for t in target for f in _features(t, runs))
    whole, aim = sum(source.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (whole + buckets) / ((source[b] + 1) * (aim + buckets)))) for b in source}
    out = []
    for i, t in rows:
        f = _features(t, runs)
        weight, score = sum(gain[_bucket(x, buckets)] for x in f), None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, len(_words(t))])
    may = sorted((r for r in out if r[5] >= least and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


def _got(df):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


def test_crc_of_spans():
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 256, 300_000, dtype=np.uint8)
    start = rng.integers(0, 290_000, 400)
    end = start + rng.choice([1, 2, 63, 64, 65, 127, 128, 129, 1_000, 9_999], 400)
    start, end = np.append(start, 0), np.append(end, len(raw))  # one much longer than a piece's share
    assert resampling.crc32_spans(raw, start, end).tolist() == [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(start, end, strict=True)]
    assert len(resampling.crc32_spans(raw, start[:0], end[:0])) == 0


def test_query_against_brute_force(spark, table):
    folder, rows = table
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert _got(QUERIES["op12_importance_resampling"](spark, folder)) == brute(rows, target)


@pytest.mark.parametrize("runs", [1, 2, 3])
def test_runs_of_words(spark, docs, monkeypatch, runs):
    monkeypatch.setattr(resampling, "PIECE", 50)  # many pieces to a text
    rows = [(i, " ".join(f"w{(i * k) % 23}-{'ab'[k % 2]}É" for k in range(i % 40))) for i in range(150)] + ODD
    target = ["w1 a w2 b", None, "", "W3-a w4-b " * 20, "ü" * 90]
    features = resampling.Features(runs=runs, buckets=97)
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs(rows), frame, features, seed=7, percent=33, least_words=5)
    assert _got(got) == brute(rows, target, runs=runs, buckets=97, seed=7, percent=33, least=5)


def test_ties_repeated_rows_and_ranks(spark, docs):
    rows = [(5, "a b c " * 9)] * 6 + [(3, "a b c " * 9), (8, None), (None, "a b c " * 9)]
    target = spark.createDataFrame([("a",)], "text string")
    got = resampling.resample(docs(rows), target, seed=1, percent=60).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4]  # 60 % of 7 with an id
    assert {r.doc_id for r in got if r["rank"] is None} >= {8, None}


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(docs([], 1), none, seed=1, percent=10).count() == 0
    rows = [(1, "one two three " * 10), (2, "four five six " * 10)]
    assert _got(resampling.resample(docs(rows), none, seed=1, percent=50)) == brute(rows, [], seed=1, percent=50)


def test_clashing_columns_are_not_read(spark, docs):
    frame = docs([(1, "one two three")]).withColumnsRenamed({"lang": "key", "source": "rank", "n_chars": "score"})
    target = spark.createDataFrame([("one", 1)], "text string, weight long")
    assert _got(resampling.resample(frame, target, seed=2024, percent=10)) == brute([(1, "one two three")], ["one"])
