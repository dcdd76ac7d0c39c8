from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa

from feedlift.llm import language
from feedlift.llm.queries import QUERIES
from tests.llm.conftest import ODD


def test_held_out_accuracy(spark, table):
    folder, rows = table
    got = {r.doc_id: r for r in QUERIES["op5_language_id"](spark, folder).collect()}
    told = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert set(got) == set(told)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in told)
    held = [got[i].lang_pred == told[i] for i in told if got[i].held_out]
    assert len(held) > 200 and np.mean(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_kernel_is_the_mean_cosine_of_ngram_sets():
    texts = ["abc de", "abd, DE!", "xyz"]
    x = language.normalised(np.concatenate(list(language.presence(pa.array(texts)))))
    kernel = x @ x.T

    def grams(text):
        clean = "".join(c.lower() if c.isalpha() else " " for c in text).split()
        s = " ".join(clean) + (" " if not text[-1].isalpha() else "")
        return [{s[i : i + n] for i in range(len(s) - n + 1)} for n in (1, 2, 3, 4)]

    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            want = np.mean([len(p & q) / np.sqrt(len(p) * len(q)) if p and q else 0 for p, q in zip(grams(a), grams(b), strict=True)])
            assert abs(kernel[i, j] - want) < 1e-5


def test_a_text_is_scored_alike_in_any_company():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdé fgh. ") for _ in range(rng.randrange(0, 400))) for _ in range(60)]
    alone = [np.concatenate(list(language.presence(pa.array([t]))))[0] for t in texts]
    assert (np.concatenate(list(language.presence(pa.array(texts)))) == np.array(alone)).all()


def _two(n=40):
    rng = random.Random(3)
    say = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(40))
    return [(i, say(["tha", "ing", "wh"]) if i % 2 else say(["eux", "oi", "ré"]), "x" if i % 2 else "y") for i in range(n)]


def test_learns_from_labelled_rows_only(spark):
    rows = [*_two(), (None, "tha ing wh", "y"), (900, None, "x"), (901, "123 456", "y"), (902, "tha ing whtha whing", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(frame)
    got = {r.doc_id: r for r in language.predicted(frame.drop("lang"), model).collect()}
    assert model.languages == ["x", "y"]
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:40])
    assert got[902].lang_pred == "x"
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901)] == [("und", 0.0)] * 2


def test_nothing_to_learn_from(spark, docs):
    frame = docs(ODD).select("doc_id", "text", "lang")
    assert language.fit(frame.limit(0)) is None
    assert {r.lang_pred for r in language.predicted(frame, None).collect()} == {"und"}


def test_odd_texts(spark, docs):
    model = language.fit(spark.createDataFrame(_two(), "doc_id long, text string, lang string"))
    frame = docs(ODD).withColumnsRenamed({"lang": "prediction", "source": "lang_pred", "n_chars": "score"})
    got = language.predicted(frame, model)
    assert got.columns == ["doc_id", "text", "prediction", "input_lang_pred", "input_score", "lang_pred", "score"]
    got = got.collect()
    assert len(got) == len(ODD) and {(r.prediction, r.input_lang_pred) for r in got} == {("en", "s")}
    assert language.predicted(frame, None).columns[3:] == ["input_lang_pred", "input_score", "lang_pred", "score"]
    for r in got:
        if not any(c.isalpha() for c in r.text or ""):
            assert r.lang_pred == "und"
        else:
            assert r.lang_pred in ("x", "y")
    assert language.predicted(docs([], 1), model).count() == 0


def test_one_language(spark):
    frame = spark.createDataFrame([r for r in _two() if r[2] == "x"], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.predicted(frame.drop("lang"), language.fit(frame)).collect()} == {"x"}


def test_every_language_is_learned(spark):
    """More languages than landmarks: each has letters of its own."""
    rng = random.Random(7)
    rows = []
    for k in range(700):
        own = [chr(0xAC00 + 15 * k + i) for i in range(15)]
        rows += [(3 * k + i, "".join(rng.choice(own) for _ in range(60)), f"l{k:03d}") for i in range(2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(frame, in_all=900)
    assert len(model.languages) == 700 and len(model.landmarks) == 700
    right = [r.lang == r.lang_pred for r in language.predicted(frame, model).collect()]
    assert np.mean(right) > 0.95


def test_the_sample_is_bounded_whatever_ids_repeat(spark, monkeypatch):
    rows = [(1, f"tha ing wh {'ab' * (i % 500)}", "x") for i in range(3000)] + [(2, "eux oi", "y")]
    seen = []
    monkeypatch.setattr(language, "train", lambda bits, languages: seen.append(languages))
    language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=50)
    assert seen[0].count("x") <= 50 and seen[0].count("y") == 1


def test_predictions_against_plain_kernels(spark):
    """Kernel ridge regression in the span of the landmarks, written out with sets and loops."""
    rows = _two(30)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(frame)
    bits = [np.concatenate(list(language.presence(pa.array([t]))))[0] for _, t, _ in rows]
    edges = np.concatenate(([0], np.cumsum([1 << p for p in language.PLACES])))

    def kernel(a, b):
        parts = [(a[s:e], b[s:e]) for s, e in zip(edges[:-1], edges[1:], strict=True)]
        return np.mean([(x & y).sum() / np.sqrt(max(x.sum(), 1e-18) * max(y.sum(), 1e-18)) for x, y in parts])

    # All rows are landmarks here, so the fit is that of the whole kernel matrix.
    assert len(model.landmarks) == len(rows)
    k = np.array([[kernel(a, b) for b in bits] for a in bits])
    target = np.array([[1.0 if lang == n else -1.0 for n in model.languages] for *_, lang in rows])
    n = len(rows)
    weights = np.linalg.solve(k.T @ k + language.RIDGE * n * k + 1e-8 * n * np.eye(n), k.T @ target)
    got = {r.doc_id: r for r in language.predicted(frame.drop("lang"), model).collect()}
    for (i, *_), margins in zip(rows, k @ weights, strict=True):
        assert got[i].lang_pred == model.languages[int(margins.argmax())]
        assert abs(got[i].score - min(1, max(0, (margins.max() + 1) / 2))) < 1e-3
