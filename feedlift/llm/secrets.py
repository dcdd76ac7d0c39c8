"""Secret scans (6): fixed patterns, and a battery of randomness tests on the rest.

The base patterns find assignments, access keys and hex strings. Beside them every run of 20 or more
characters of ``[A-Za-z0-9+/_-]`` that meets no base span is a candidate. Its encoding is inferred from
its characters, and three tests over the alphabet of the encoding tell how random it looks: chi-squared uniformity, runs
above and below the middle of the alphabet, serial correlation of neighbours.

* A candidate that fails one of them (each at a third of ``ALPHA``) is not random: its p-value is 1.
* Otherwise the battery statistic, minus the sum of the logarithms of the three p-values, is compared with that of
  ordinary text of the same encoding and length: texts drawn with the character pairs of the corpus, simulated for
  a ladder of lengths. The p-value is the share of such texts that look as random.
* As a second feature, the surprise of the characters under that pair model has a known mean and spread for each length;
  its tail probability is joined with the p-value of the battery by Fisher's method. So a short candidate needs to be odder
  than a long one.

Over all candidates of all documents the Benjamini-Hochberg rule keeps the share of false
discoveries under ``FALSE_DISCOVERIES``; p-values are counted in bins, each taken at its upper end.
The counts of character pairs within texts and the p-values cover the whole table, and do not depend on how its rows are dealt
out. Only 65,536 counts and one row per bin come to the driver.

Places are code points, ends exclusive. Null or empty text has no spans. Rows are scanned one by one, so
repeated rows get equal results; columns other than id and text are not read. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlift.llm import arrays
from feedlift.session import materialise

# Fixed patterns, and how many characters a match must have (of its second group, for assignments).
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
KINDS = ("assign", "access", "hex", "random")

ALPHA, FALSE_DISCOVERIES = 0.001, 0.01
BIN, LAST_BIN = 0.05, 1200  # of -log10(p)

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets by name, in the order in which they are tried.
ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "hex upper": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "base36 upper": _DIGITS + _UPPER,
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64 url": _UPPER + _LOWER + _DIGITS + "-_",
}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def encoding(token: str) -> str | None:
    used = set(token)
    return next((name for name, alphabet in ENCODINGS.items() if used <= set(alphabet)), None)


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared(codes: np.ndarray, size: int) -> float:
    """P-value of the counts being this uneven."""
    n = len(codes)
    x = size / n * float((np.bincount(codes, minlength=size).astype(float) ** 2).sum()) - n
    return _upper_tail((x - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n))


def runs_test(codes: np.ndarray, size: int) -> float:
    """P-value of the number of runs in the upper and the lower half of the alphabet, both sides."""
    high = codes >= size // 2
    a, n = int(high.sum()), len(codes)
    b = n - a
    if not a or not b:
        return 2.0 ** (1 - n)
    mean = 2 * a * b / n + 1
    spread = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
    if spread <= 0:
        return 1.0
    return min(1.0, 2 * _upper_tail(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(spread)))


def serial_correlation(codes: np.ndarray, size: int) -> float:
    """P-value of the correlation of neighbours, both sides."""
    x = codes - (size - 1) / 2
    total = float((x * x).sum())
    if not total:
        return 0.0
    return min(1.0, 2 * _upper_tail(abs(float((x[1:] * x[:-1]).sum()) / total) * math.sqrt(len(x))))


def battery(codes: np.ndarray, size: int) -> tuple[float, float, float]:
    """P-values of the three tests if the codes were drawn evenly and independently."""
    return chi_squared(codes, size), runs_test(codes, size), serial_correlation(codes, size)


def _codes(token: str, name: str) -> np.ndarray:
    return np.array([ENCODINGS[name].index(c) for c in token])


def passes(p_values: tuple[float, float, float]) -> bool:
    return min(p_values) >= ALPHA / 3


def could_be_random(token: str) -> bool:
    name = encoding(token)
    return name is not None and passes(battery(_codes(token, name), len(ENCODINGS[name])))


def statistic(p_values: tuple[float, float, float]) -> float:
    """Small for a sequence that looks random; the root makes its spread even."""
    return math.sqrt(-sum(math.log(max(p, 1e-300)) for p in p_values))


#: Lengths for which ordinary text is simulated, and how many texts for each.
LENGTHS, SIMULATED = (20, 28, 40, 56, 80, 112, 160, 224, 320), 200


class TextNull:
    """The battery statistic of ordinary text, by encoding and length: mean and spread."""

    def __init__(self, counts: np.ndarray):
        rng = np.random.default_rng(20_250_301)
        self.known = {name: self._simulated(counts, alphabet, rng) for name, alphabet in ENCODINGS.items()}

    @staticmethod
    def _simulated(counts: np.ndarray, alphabet: str, rng: np.random.Generator) -> np.ndarray:
        """Mean and spread for each of :data:`LENGTHS`, from texts whose neighbours follow the corpus."""
        places = [ord(c) for c in alphabet]
        seen = counts[np.ix_(places, places)] + 0.5
        start, then = np.cumsum(seen.sum(axis=1) / seen.sum()), np.cumsum(seen / seen.sum(axis=1, keepdims=True), axis=1)
        last, draw = len(alphabet) - 1, rng.random((SIMULATED, LENGTHS[-1]))
        codes = np.empty(draw.shape, np.int64)
        codes[:, 0] = np.minimum(np.searchsorted(start, draw[:, 0]), last)
        for i in range(1, LENGTHS[-1]):
            codes[:, i] = np.minimum((then[codes[:, i - 1]] < draw[:, i, None]).sum(axis=1), last)
        values = np.array([[statistic(battery(row[:n], len(alphabet))) for row in codes] for n in LENGTHS])
        return np.stack((values.mean(axis=1), np.maximum(values.std(axis=1), 0.05)))

    def p_value(self, name: str, n: int, value: float) -> float:
        """Probability that ordinary text of this encoding and length looks as random. The statistic grows with the root
        of the length, so beyond the ladder its last step is carried on so."""
        mean, spread = self.known[name]
        if n <= LENGTHS[-1]:
            mean, spread = np.interp(n, LENGTHS, mean), np.interp(n, LENGTHS, spread)
        else:
            mean, spread = mean[-1] * math.sqrt(n / LENGTHS[-1]), spread[-1]
        return max(_upper_tail((mean - value) / spread), 1e-60)


def fisher(a: float, b: float) -> float:
    """Two p-values joined."""
    half = -math.log(a) - math.log(b)
    return max(math.exp(-half) * (1 + half), 1e-60)


class TextModel:
    """Ordinary text: each character drawn given the one before, with the frequencies of the corpus."""

    def __init__(self, counts: np.ndarray):
        """``counts[a, b]``: how often byte ``b`` follows byte ``a``."""
        places = np.array([ord(c) for c in sorted(set("".join(ENCODINGS.values())))])
        seen = counts[np.ix_(places, places)] + 0.5
        given = -np.log(seen / seen.sum(axis=1, keepdims=True))
        self.surprise = np.zeros((256, 256))
        self.surprise[np.ix_(places, places)] = given
        share = seen / seen.sum()
        self.mean = float((share * given).sum())
        self.variance = float((share * given**2).sum()) - self.mean**2

    def p_value(self, token: str) -> float:
        """Probability that text of this length is as surprising."""
        codes = np.frombuffer(token.encode(), np.uint8)
        total, n = float(self.surprise[codes[:-1], codes[1:]].sum()), len(codes) - 1
        return max(_upper_tail((total - n * self.mean) / math.sqrt(n * self.variance)), 1e-60)


class Model:
    """P-values of candidates against the ordinary text of a corpus, given its character pairs."""

    def __init__(self, counts: np.ndarray):
        self.pairs, self.null = TextModel(counts), TextNull(counts)

    def p_value(self, token: str) -> float:
        name = encoding(token)
        if name is None:
            return 1.0
        told = battery(_codes(token, name), len(ENCODINGS[name]))
        if not passes(told):
            return 1.0
        return fisher(self.null.p_value(name, len(token), statistic(told)), self.pairs.p_value(token))


def bin_of(p: float) -> int:
    return min(LAST_BIN, int(-math.log10(p) / BIN))


def discovery_bin(counts: dict[int, int], false_share: float = FALSE_DISCOVERIES) -> int:
    """The least bin of -log10(p) that the Benjamini-Hochberg rule accepts; past the last if none."""
    total, rank, least = sum(counts.values()), 0, LAST_BIN + 1
    for b in sorted(counts, reverse=True):
        rank += counts[b]
        if 10.0 ** (-b * BIN) <= false_share * rank / total:
            least = b
    return least


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for _, _, raw, offsets in arrays.blocks(batch.column("text")):
            pair = raw[:-1].astype(np.int64) * 256 + raw[1:]
            within = np.ones(len(pair), bool)
            ends = offsets[1:-1]
            within[ends[(ends > 0) & (ends < len(raw))] - 1] = False  # the last of a text and the first of the next
            total += np.bincount(pair[within], minlength=1 << 16)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["pair", "n"])


_FOUND = "struct<base:array<struct<start:int,kind:int,end:int>>,more:array<struct<start:int,end:int,bin:int>>>"


def _scan(text: pa.Array, model: Model) -> pa.Array:
    out = []
    for t in text:
        t = t.as_py() or ""
        base = base_spans(t)
        starts, ends = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
        more = []
        for m in CANDIDATE.finditer(t):
            before = bisect_left(starts, m.end())  # base spans that begin before its end
            if before and ends[before - 1] > m.start():
                continue
            more.append({"start": m.start(), "end": m.end(), "bin": bin_of(model.p_value(m[0]))})
        out.append({"base": [{"start": s, "kind": k, "end": e} for s, k, e in base], "more": more})
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    extra = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("bin", pa.int32())])
    return pa.array(out, pa.struct([("base", pa.list_(span)), ("more", pa.list_(extra))]))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, spans``: arrays of (start, kind, end), kind as the place in :data:`KINDS`, in order."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = rows.select("text").mapInArrow(_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    histogram = np.zeros(1 << 16)
    histogram[counts["pair"].to_numpy(np.int64)] = counts["n"].to_numpy(float)
    model = Model(histogram.reshape(256, 256))
    scan = F.arrow_udf(lambda text: _scan(text, model), _FOUND)
    found = materialise(rows.select("doc_id", scan("text").alias("f")).select("doc_id", "f.*"), "secret-spans")
    bins = found.select(F.explode("more.bin").alias("bin")).groupBy("bin").count().collect()
    least = discovery_bin({r["bin"]: r["count"] for r in bins})
    added = F.filter("more", lambda x: x["bin"] >= least)
    added = F.transform(added, lambda x: F.struct(x["start"], F.lit(KINDS.index("random")).alias("kind"), x["end"]))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def span_text(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` per document."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    digest = F.sha2(span_text("base").cast("binary"), 256).alias("base_sha256")
    return secrets(docs).select("doc_id", count(0), count(1), count(2), digest, span_text("spans").alias("spans"))
