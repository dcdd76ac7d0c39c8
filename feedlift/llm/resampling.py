"""Target-distribution importance resampling (12): hashed word features, their gains, and a seeded draw.

Texts are lower-cased (A-Z only) and cut into words, maximal runs of digits, a-z and characters beyond
ASCII. Features are all runs of 1 to ``runs`` consecutive words, joined by one space, repeats counted; the
bucket of a feature is the unsigned CRC-32 of its bytes modulo ``buckets``. The gain of a bucket tells how much more
likely it is in the target than in the source, both counts plus one, in whole thousandths. A document's weight is
the sum of the gains of its features; its score adds Gumbel noise that a hash of seed and id gives, so the draw of the
highest scores is a sample without replacement by weight that every run repeats.

The CRC of all features of a block of texts is computed at once. CRC-32 is affine: the checksum of a
string is that of as many zero bytes, XOR what each byte contributes by its distance from the end. Contributions
within ``SPAN`` bytes of the end come from a table; ``bitwise_xor.reduceat`` joins those of a span. A longer span is
cut into blocks of ``SPAN`` bytes from its end, whose values are moved on by their place, one table for each
bit of it, and joined in the same way.

Two passes over the texts and one range shuffle of narrow rows. Only the counts of the buckets come to the driver.

Null and empty texts have no features and weight 0. A document with a null id counts for the features of the source,
but has no score and is not drawn. Repeated rows are documents of their own; rows equal in score and id
are interchangeable. Very long texts are worked on in pieces; a frame without rows gives none.
Columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlift.llm import arrays
from feedlift.llm.frames import keyed
from feedlift.operators.numbering import number_rows
from feedlift.session import materialise

#: Bytes in a block of a span, a power of two; bytes of features that are worked on at once.
SPAN, PIECE = 64, 1 << 20
_POLYNOMIAL = 0xEDB88320


# CRC-32 of many spans


@cache
def _step() -> np.ndarray:
    """What the register becomes for each of its low bytes as one byte goes by."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1)
    return table


@cache
def _positions() -> np.ndarray:
    """Row ``d``: what a byte contributes that ``d`` others follow."""
    rows = [_step()]
    for _ in range(SPAN - 1):
        rows.append(_step()[rows[-1] & 0xFF] ^ (rows[-1] >> 8))
    return np.concatenate(rows)


@cache
def _moves(bit: int) -> np.ndarray:
    """Registers after ``2**bit`` zero bytes, for each value of each of their four bytes."""
    values = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    if bit == 0:
        return _step()[values & 0xFF] ^ (values >> 8)
    return _moved(_moved(values, bit - 1), bit - 1)


def _moved(registers: np.ndarray, bit: int) -> np.ndarray:
    t = _moves(bit)
    return t[0][registers & 0xFF] ^ t[1][(registers >> 8) & 0xFF] ^ t[2][(registers >> 16) & 0xFF] ^ t[3][registers >> 24]


def _after(registers: np.ndarray, steps: np.ndarray, bit: int = 0) -> np.ndarray:
    """Each register after ``steps * 2**bit`` zero bytes."""
    registers, rest = registers.copy(), steps
    while len(rest) and rest.max() > 0:
        some = np.flatnonzero(rest & 1)
        if len(some):
            registers[some] = _moved(registers[some], bit)
        rest, bit = rest >> 1, bit + 1
    return registers


@cache
def _short_lengths() -> np.ndarray:
    return _zeros(np.arange(SPAN + 1))


def _zeros(lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of so many zero bytes."""
    ones = np.full(len(lengths), 0xFFFFFFFF, np.uint32)
    return _after(ones, lengths) ^ np.uint32(0xFFFFFFFF)


def _lengths(lengths: np.ndarray) -> np.ndarray:
    out = _short_lengths()[np.minimum(lengths, SPAN)]
    long = np.flatnonzero(lengths > SPAN)
    if len(long):
        out[long] = _zeros(lengths[long])
    return out


def crc32_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of ``raw[start:end]`` for each pair; spans may overlap and none is empty."""
    if not len(start):
        return np.zeros(0, np.uint32)
    lengths = end - start
    count = (lengths + SPAN - 1) // SPAN
    first = np.cumsum(count) - count
    if count.max() == 1:
        left, right, place = start, end, None
    else:
        place = np.repeat(first + count - 1, count) - np.arange(count.sum())  # blocks that follow
        right = np.repeat(end, count) - SPAN * place
        left = np.maximum(np.repeat(start, count), right - SPAN)
    table, values = _positions(), np.empty(len(left), np.uint32)
    to = np.cumsum(right - left)
    at = 0
    while at < len(left):
        done = int(to[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(to, done + PIECE, "right")))
        size = (right - left)[at:stop]
        offset = to[at:stop] - size - done
        flat = np.arange(int(to[stop - 1]) - done)
        place_of = flat + np.repeat(left[at:stop] - offset, size)
        behind = np.repeat(right[at:stop] - 1, size) - place_of
        values[at:stop] = np.bitwise_xor.reduceat(table[(behind << 8) | raw[place_of]], offset)
        at = stop
    if place is not None:
        values = np.bitwise_xor.reduceat(_after(values, place, SPAN.bit_length() - 1), first)
    return values ^ _lengths(lengths)


# Features


@dataclass(frozen=True)
class Features:
    """Runs of 1 to ``runs`` words, hashed to ``buckets`` buckets."""

    runs: int = 1
    buckets: int = 10_000


def _joined(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words joined by one space, and their bounds there."""
    lengths = end - start
    to = np.cumsum(lengths + 1)
    out = np.full(int(to[-1]), 0x20, np.uint8)
    shift = to - lengths - 1
    place = np.arange(int(lengths.sum())) + np.repeat(np.arange(len(start)), lengths)
    out[place] = raw[place + np.repeat(start - shift, lengths)]
    return out, shift, shift + lengths


def text_features(column: pa.Array, features: Features) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """For every block of texts: first and last index and the words of each text; then the text (counted
    within the block) and the bucket of features, piece by piece, with None for the words."""
    for i, j, raw, offsets in arrays.blocks(column):
        raw = arrays.LOWER[raw]
        w = arrays.words(raw, offsets, parts=arrays.IS_MARK)
        yield i, j, np.diff(w.first), None, None
        for n in range(1, features.runs + 1):
            at = arrays.inside(w.first, n)
            s = 0
            while s < len(at):
                limit = w.start[at[s]] + PIECE
                e = max(s + 1, int(np.searchsorted(w.start[at], limit)) if w.start[at[-1]] > limit else len(at))
                if n == 1:
                    crc = crc32_spans(raw, w.start[at[s:e]], w.end[at[s:e]])
                else:
                    lo, hi = int(at[s]), int(at[e - 1]) + n
                    text, start, end = _joined(raw, w.start[lo:hi], w.end[lo:hi])
                    crc = crc32_spans(text, start[at[s:e] - lo], end[at[s:e] - lo + n - 1])
                text_of = np.searchsorted(w.first, at[s:e], "right") - 1
                yield i, j, None, text_of, (crc % np.uint32(features.buckets)).astype(np.int64)
                s = e


def _counted(batches: Iterator[pa.RecordBatch], features: Features) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(features.buckets, np.int64)
    for batch in batches:
        for _, _, words, _, buckets in text_features(batch.column(0), features):
            if words is None:
                counts += np.bincount(buckets, minlength=features.buckets)
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, features: Features, text_col: str = "text") -> DataFrame:
    """``bucket, n`` of all texts; each task sends one row a bucket at most."""
    rows = texts.select(F.col(text_col).cast("string"))
    counted = rows.mapInArrow(lambda b: _counted(b, features), "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame, features: Features) -> list[int]:
    out = [0] * features.buckets
    for r in counts.collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(docs: DataFrame, target: DataFrame, features: Features = Features(), text_col: str = "text") -> np.ndarray:
    """Gain of every bucket: ``floor(1000 * ln((t+1) * (S+buckets) / ((s+1) * (T+buckets))))``."""
    source = _dense(bucket_counts(docs, features, text_col), features)
    wanted = _dense(bucket_counts(target, features, text_col), features)
    whole, aim = sum(source) + features.buckets, sum(wanted) + features.buckets
    ratio = lambda s, t: float(t + 1) * float(whole) / (float(s + 1) * float(aim))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source, wanted, strict=True)], np.int64)


_WEIGHTED = "doc_id long, key long, n_words long, n_features long, weight long"


def _weighed(batches: Iterator[pa.RecordBatch], features: Features, gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        for i, j, words, text, buckets in text_features(batch.column("text"), features):
            if words is not None:
                n_words[i:j] = words
                continue
            found = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))  # texts come in order
            n_features[i + text[found]] += np.diff(np.append(found, len(text)))
            weight[i + text[found]] += np.add.reduceat(gain[buckets], found)
        columns = [batch.column("doc_id"), batch.column("key"), *map(pa.array, (n_words, n_features, weight))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n_words", "n_features", "weight"])


def weighted(docs: DataFrame, gain: np.ndarray, features: Features = Features(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, key, n_words, n_features, weight`` of every document; ``key`` is that of :func:`frames.row_key`."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # as many numbers as there are buckets
    rows = keyed(docs, id_col, text_col)
    return rows.mapInArrow(lambda b: _weighed(b, features, sent.value), _WEIGHTED)


def noise(seed: int, id_col: str = "doc_id"):
    """Gumbel noise in whole thousandths: the first 32 bits of SHA-256 of ``seed:id`` as a number between 0 and 1."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"), 256), 1, 8), 16, 10)
    share = (h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(share))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    features: Features = Features(),
    *,
    seed: int,
    percent: int,
    least_words: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every document: ``doc_id, key, n_words, n_features, weight, score, rank``. Of the documents with at least
    ``least_words`` words, ``percent`` of a hundred are drawn, those with the highest scores (ties: the smaller id);
    ``rank`` is their place from 1 and null for the others."""
    rows = weighted(docs, gains(docs, target, features, text_col), features, id_col, text_col)
    rows = materialise(rows.withColumn("score", F.col("weight") + noise(seed)), "resampling-scores")
    may = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    drawn = rows.filter(may).count() * percent // 100
    order = rows.withColumns({"late": ~may, "below": -F.col("score")})
    numbered = number_rows(order, ["late", "below", "doc_id"], "place", frozen=True)
    rank = F.when(may & (F.col("place") < drawn), F.col("place") + 1)
    return numbered.select("doc_id", "key", "n_words", "n_features", "weight", "score", rank.cast("long").alias("rank"))
