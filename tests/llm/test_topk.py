from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from feedlift.llm import topk
from feedlift.llm.queries import QUERIES, SQL
from tests import compare

ROWS = "vec_id long, embedding array<double>"


def brute(rows, every, k, scale=256):
    """rows: (vec_id, vector); each query's best by the definition, as a Counter of result rows."""
    ok = lambda i, v: i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if ok(i, v)]
    out = Counter()
    for n, (q, a) in enumerate(good):
        if q % every:
            continue
        found = [(min(max(sum(x * y for x, y in zip(a, b, strict=True)), topk.LOW), topk.HIGH), i) for m, (i, b) in enumerate(good) if m != n and len(a) == len(b)]
        for rank, (score, i) in enumerate(sorted(found, key=lambda x: (-x[0], x[1]))[:k]):
            out[(q, rank + 1, i, score)] += 1
    return out


def got(df):
    return Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def search(spark, rows, every=5, k=5, parts=3, **options):
    frame = spark.createDataFrame(rows, ROWS).repartition(parts)
    return got(topk.top_k(frame, F.col("vec_id") % every == 0, k, **options))


def test_query_against_sql_and_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    names, rows = compare.rows_of_spark(QUERIES["op13_exact_topk"](spark, folder))
    assert (names, rows) == compare.rows_of_sql(compare.duck(folder), SQL["op13_exact_topk"])
    table = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert Counter((q, n, v, s) for q, n, s, v in rows.elements()) == brute(table, 50, 5)


@pytest.mark.parametrize("k", [1, 5, 40])
def test_ties_copies_and_groups_of_queries(spark, monkeypatch, k):
    monkeypatch.setattr(topk, "GROUP", 7)
    rng = random.Random(k)
    hot = [0.5, -0.25, 0.125]
    rows = [(i, hot if i % 3 else [rng.randrange(-4, 5) / 8 for _ in range(3)]) for i in range(160)]
    rows += [(10, hot), (10, hot), (-15, [1.0, 0.0, 0.0])]  # repeated rows and ids, a negative id
    assert search(spark, rows, k=k) == brute(rows, 5, k)


def test_small_bins_take_more_rounds(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(9)]) for i in range(90)]
    assert search(spark, rows) == brute(rows, 5, 5)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 3)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 2)
    assert search(spark, rows) == brute(rows, 5, 5)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.0, -1.0]), (None, [1.0, 1.0]),
        (6, [1.0]), (10, [3.0]), (15, [1.0, 1.0, 1.0]), (20, []), (25, []), (7, [-0.001, 0.0]), (30, [0.0, 0.0]),
    ]
    assert search(spark, rows) == brute(rows, 5, 5)  # 15 has no row of its length: no result


def test_large_components_are_exact(spark):
    rows = [(i, [3.0e9 * (i % 7 - 3) + i / 256, 1.0e8 * i]) for i in range(30)] + [(50, [1e300, 1.0]), (51, [-1e300, 1.0])]
    assert search(spark, rows) == brute(rows, 5, 5)


def test_empty_tables_and_no_queries(spark):
    assert not search(spark, [(None, [1.0])])
    assert not search(spark, [(1, [1.0]), (2, [1.0])])
    frame = spark.createDataFrame([(0, [1.0, 2.0], 7, "x"), (1, [1.0, 2.0], 8, "y")], ROWS + ", place long, score string")
    assert got(topk.top_k(frame, F.col("vec_id") % 5 == 0, 5)) == Counter({(0, 1, 1, 256 * 256 * 5): 1})
    floats = frame.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    assert got(topk.top_k(floats, F.col("vec_id") % 5 == 0, 5)) == Counter({(0, 1, 1, 256 * 256 * 5): 1})
