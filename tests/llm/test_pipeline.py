from __future__ import annotations

import random

import numpy as np
import public_tokenizers as vocabularies
import pytest
import tiktoken

import corpus_pipeline
from feedlift.llm import bpe, decontaminate
from feedlift.llm.frames import packed, unpacked
from feedlift.session import materialise
from tests.llm import brute
from tests.llm.conftest import DOCS, ODD
from tests.llm.test_decontaminate import _leaks


@pytest.fixture(scope="module")
def stages(spark):
    """Documents before and after each stage, as rows."""
    folder = "/root/testdata/sf0.01"
    docs, frames = spark.read.parquet(f"{folder}/documents.parquet"), []
    frames.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, folder))
        frames.append(docs)
    return folder, frames


def _rows(frame):
    return [(r.doc_id, r.text) for r in frame.collect()]


def test_columns_stay_and_clean_documents_too(spark, stages):
    folder, frames = stages
    for f in frames[1:-1]:
        assert f.dtypes == frames[0].dtypes
    for r in frames[2].collect():
        assert r.n_chars == len(r.text)
    kept = {r.doc_id for r in frames[1].collect()}
    judged = {i: brute.quality_counts(t) for i, t in _rows(frames[0])}
    bad = {i for i, (n, _, _, _, repeat) in judged.items() if n < 50 or 100 * repeat > 50 * n}
    assert not kept & bad
    told = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert np.mean([i in kept for i, q in told.items() if q == 1 and i not in bad]) > 0.99
    assert np.mean([i in kept for i, q in told.items() if q == 0 and i not in bad]) < 0.05


def test_lines(stages):
    _, frames = stages
    before, after = _rows(frames[1]), dict(_rows(frames[2]))
    assert {i: brute.sha(t) for i, t in after.items()} == {i: v[2] for i, v in brute.line_digests(before).items()}


def test_near_copies(stages):
    _, frames = stages
    before = _rows(frames[2])
    found = brute.components(before, brute.jaccard_links(before))
    assert sorted(_rows(frames[3])) == sorted((i, t) for i, t in before if found[i] == i)


def test_leaks(spark, stages):
    folder, frames = stages
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    before = _rows(frames[3])
    leaks = {i for i, _ in _leaks(before, items)}
    assert leaks
    assert sorted(_rows(frames[4])) == sorted((i, t) for i, t in before if i not in leaks)


def test_tokens_and_run(spark, stages):
    folder, frames = stages
    raw = open(vocabularies.path("byte_bpe_50k.tiktoken"), "rb").read()
    library = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=bpe.read_ranks(raw), special_tokens={})
    want = set()
    for i, t in _rows(frames[4]):
        ids = library.encode_ordinary(t or "")
        want.add((i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t or "")))
    assert {tuple(r) for r in frames[5].collect()} == want
    assert {tuple(r) for r in corpus_pipeline.run(spark, folder).collect()} == want


def test_odd_documents(spark, tmp_path):
    folder = str(tmp_path)
    filler = " ".join(f"word{k}" for k in range(60))
    rows = [(i, t, None, None, None) for i, t in ODD] + [(50, filler, "en", "s", 1)] * 2 + [(51, filler.upper(), None, "s", 2)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = [r.doc_id for r in corpus_pipeline.run(spark, folder).collect()]
    assert got == [50]  # the others have few words or are one phrase over and over; of copies one stays


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
    names = ["row", "key", "stats", "kept", "keep_bitmap", "new_text", "first", "copies", "anomaly"]
    text = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text, *range(len(names)))], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert [tuple(r) for r in out.collect()] == [tuple(r) for r in docs.collect()]


def test_int_ids(spark):
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice("bcdfg") + str(rng.randrange(3000)) for _ in range(n))
    line, copy, item = words(12), words(60), words(20)
    rows = [(i, f"{words(60)}\n{line}") for i in (1, 2, 7, 8, 9)]
    rows += [(3, copy), (4, copy + " end"), (5, f"{words(30)} {item} {words(30)}"), (6, words(60))]
    out = {}
    for kind in ("long", "int"):
        docs, kept = spark.createDataFrame(rows, f"doc_id {kind}, text string"), []
        lines = corpus_pipeline.drop_repeated_lines(spark, docs, None)
        kept.append(sorted(map(tuple, lines.collect())))
        kept.append(sorted(map(tuple, corpus_pipeline.drop_near_copies(spark, docs, None).collect())))
        leaks = decontaminate.leaks(docs, spark.createDataFrame([(1, item)], "item_id int, text string")).select("key")
        kept.append(sorted(map(tuple, unpacked(packed(docs).join(leaks, "key", "left_anti")).collect())))
        assert lines.dtypes == docs.dtypes
        out[kind] = kept
    assert out["int"] == out["long"]
    lines, copies, clean = out["int"]
    assert sum(line in t for _, t in lines) == 1
    assert [i for i, _ in copies] == [1, 2, 3, 5, 6, 7, 8, 9]
    assert [i for i, _ in clean] == [1, 2, 3, 4, 6, 7, 8, 9]
