"""Language ID (5): blended-spectrum string kernels, Nyström landmarks, kernel ridge regression.

A text is the set of its byte n-grams, n from 1 to 4, after letters are lower-cased and every run of
ASCII characters that are no letters becomes one space. Sets are presence vectors: n-grams are hashed to places,
a block of places for each n. The kernel of two texts is the mean over n of the cosine of their
presence vectors. Landmarks are texts of the training sample; the regression weights of each language
against the rest are found in their span (Nyström), and a text is scored by two matrix products: its
kernel with all landmarks, and that with the weights.

Every language seen is learned. Training reads about ``PER_LANGUAGE`` rows of each, or ``IN_ALL`` divided by the
languages if that is less, picked by a hash of id and text, and one row at least; every language has a landmark. Whole
texts count, as they do when they are scored. Rows whose language, id or text is null, or whose
text has no letter, are not learned from. Text without a letter, or null, is ``und`` with score 0, and so is every text if there is nothing to learn from.
Rows are scored one by one, so repeated rows get equal results, and they are learned from once; columns other than those
named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlift.llm import arrays
from feedlift.llm.frames import apart
from feedlift.session import materialise

UNKNOWN = "und"
_TOLD = "_prediction_of_language"
PER_LANGUAGE, IN_ALL, LANDMARKS, RIDGE = 500, 20_000, 160, 1e-4
#: Places for the n-grams of each n, as powers of two.
PLACES = (8, 11, 12, 13)
_STARTS = np.concatenate(([0], np.cumsum([1 << p for p in PLACES])))
WIDTH = int(_STARTS[-1])

_LETTERS = np.zeros(256, bool)
_LETTERS[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True


def presence(column: pa.Array) -> Iterator[np.ndarray]:
    """Presence vectors of blocks of texts, a row for each text."""
    for _, _, raw, offsets in arrays.blocks(column):
        letters = _LETTERS[raw]
        doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
        # One space for each run of other characters, and none where a text begins.
        keep = letters.copy()
        if len(raw):
            keep[1:] |= letters[:-1] & (doc[1:] == doc[:-1])
        clean, doc = np.where(letters, arrays.LOWER[raw], 32)[keep].astype(np.uint64), doc[keep]
        out = np.zeros((len(offsets) - 1, WIDTH), bool)
        code = np.zeros(len(clean), np.uint64)
        for k, bits in enumerate(PLACES):
            n = k + 1
            if len(clean) < n:
                break
            code = (code[: len(clean) - k] << np.uint64(8)) + clean[k:]  # of the n bytes from here
            place = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
            within = doc[: len(place)] == doc[k:]
            out[doc[: len(place)][within], _STARTS[k] + place[within].astype(np.int64)] = True
            code = code[:-1] if len(code) > 1 else code[:0]
        yield out


def normalised(rows: np.ndarray) -> np.ndarray:
    """Presence vectors scaled so that their products are the blended kernel."""
    x = rows.astype(np.float32)
    for a, b in zip(_STARTS[:-1], _STARTS[1:], strict=True):
        size = np.sqrt(rows[:, a:b].sum(axis=1, dtype=np.float32) * np.float32(len(PLACES)))
        x[:, a:b] /= np.maximum(size, 1e-9)[:, None]
    return x


@dataclass(frozen=True)
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def predict(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the best language, and its score between 0 and 1."""
        kernel = normalised(rows) @ self.landmarks.T
        margins = kernel @ self.weights
        best = margins.argmax(axis=1)
        return best, np.clip((margins[np.arange(len(best)), best] + 1) / 2, 0, 1)


def train(rows: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    names = sorted(set(languages))
    x = normalised(rows)
    # Landmarks take turns among the languages.
    place = {n: iter(np.flatnonzero(np.array(languages) == n)) for n in names}
    chosen: list[int] = []
    landmarks = max(landmarks, len(names))
    while place and len(chosen) < landmarks:
        for n in list(place):
            at = next(place[n], None)
            if at is None:
                del place[n]
            elif len(chosen) < landmarks:
                chosen.append(int(at))
    marks = x[chosen]
    to_marks, among = (x @ marks.T).astype(np.float64), (marks @ marks.T).astype(np.float64)
    target = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    left = to_marks.T @ to_marks + ridge * len(x) * among + 1e-8 * len(x) * np.eye(len(chosen))
    weights = np.linalg.solve(left, to_marks.T @ target)
    return Model(names, marks.astype(np.float32), weights.astype(np.float32))


def _packed(text: pa.Array) -> pa.Array:
    return pa.array([r.tobytes() for block in presence(text) for r in np.packbits(block, axis=1)], pa.binary())


def has_letter(text: Column | str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}") if isinstance(text, str) else text.rlike(r"\p{L}"), F.lit(False))


def fit(
    docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
    per_language: int = PER_LANGUAGE, in_all: int = IN_ALL,
) -> Model | None:
    """A model from a bounded sample of ``docs``; None if there is nothing to learn from."""
    doc_id, text = F.col(id_col).cast("string"), F.col(text_col).cast("string")
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(doc_id, text).alias("order"), doc_id.alias("doc_id"))
    rows = rows.filter("doc_id is not null and lang is not null and text is not null").filter(has_letter("text"))
    place = F.pmod(F.col("order"), F.lit(1 << 30))
    # A row for each language: how many rows it has, and the first of them in the order of the hash.
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    counts = materialise(counts, "language-counts")
    languages = counts.count()
    if not languages:
        return None
    wanted = max(1, min(per_language, in_all // languages))
    share = F.greatest(F.col("first") + 1, F.least(F.lit(1.0), wanted / F.col("n")) * (1 << 30))
    limits = counts.select("lang", share.cast("long").alias("share"))
    picked = rows.join(limits, "lang").filter(place < F.col("share"))
    sample = picked.select("lang", "order", F.arrow_udf(_packed, "binary")("text").alias("bits")).dropDuplicates(["lang", "order"])
    sample = sample.toPandas().sort_values(["order", "lang"], kind="stable")
    bits = np.frombuffer(b"".join(sample["bits"]), np.uint8).reshape(len(sample), -1)
    return train(np.unpackbits(bits, axis=1)[:, :WIDTH].astype(bool), sample["lang"].tolist())


def _predict(text: pa.Array, model: Model) -> pa.Array:
    best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
    for block in presence(text):
        for at in range(0, len(block), 512):
            b, s = model.predict(block[at : at + 512])
            best.append(b)
            score.append(s)
    names = pa.array(model.languages).take(pa.array(np.concatenate(best)))
    return pa.StructArray.from_arrays([names, pa.array(np.concatenate(score).astype(np.float64))], names=["lang_pred", "score"])


def predicted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``. A column of ``docs`` with one of these names becomes ``input_`` and its
    name."""
    told = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if model is not None:
        shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks: a bounded number of rows of a fixed width
        predict = F.arrow_udf(lambda text: _predict(text, shared.value), "struct<lang_pred:string,score:double>")
        text = F.col(text_col).cast("string")
        told = F.when(has_letter(text), predict(text)).otherwise(told)
    free = apart(docs.withColumn(_TOLD, told), "lang_pred", "score")
    return free.select(*[F.col(f"`{c}`") for c in free.columns if c != _TOLD], f"{_TOLD}.*")
