"""Words of many texts as numpy arrays: bounds, document and 64-bit hash of every word.

A word is a maximal run of bytes that are not ASCII white space (``[^\\x20\\x09-\\x0D]+``);
as all separators are ASCII, cutting UTF-8 bytes gives the same words as cutting code points.
Work goes block by block, so memory follows the block, not the batch. The operators give these
functions to Spark as the body of a map over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
_MASK = (1 << 64) - 1

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: For words that are runs of letters and digits: everything else of ASCII parts them.
IS_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits; changes ``h`` in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def random_table(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


class Polynomial:
    """Hashes of all substrings of a sequence from its prefix sums, modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self._up = self._down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, 2 * len(self._up))
            for name, factor in (("_up", self.base), ("_down", self.inverse)):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self._up[:n], self._down[:n]

    def prefix(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers(len(values))[0], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of ``values[start:end]`` for each pair; the length is part of it."""
        h = (prefix[end] - prefix[start]) * self.powers(len(prefix))[1][start]
        h += (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix(h)


_BYTES = Polynomial(0x2545F4914F6CDD1D)
_BYTE_VALUES = random_table(256, 0)
WORDS = Polynomial(0x5851F42D4C957F2D)
WORDS_2 = Polynomial(0xD1342543DE82EF95)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the bounds of each; null is empty."""
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, bounds, data = column.buffers()
    if len(column) == 0 or bounds is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(bounds, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive texts of about ``size`` bytes: first and last index, bytes, bounds."""
    raw, offsets = utf8(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


@dataclass
class Words:
    """Words of a block of texts; ``first[d]:first[d + 1]`` are those of text ``d``."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _bounds(raw: np.ndarray, cuts: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = ~parts[raw]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    inner = cuts[(cuts > 0) & (cuts < len(raw))]  # texts are not parted by white space
    opens[inner] = solid[inner]
    closes[inner - 1] = solid[inner - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def words(
    raw: np.ndarray, offsets: np.ndarray, lower: bool = False, size: int = BLOCK, parts: np.ndarray = IS_SPACE
) -> Words:
    """All words of the texts ``raw[offsets[d]:offsets[d + 1]]``, parted by the bytes in ``parts``."""
    starts, ends, hashes = [], [], []
    at, n = 0, len(raw)
    while at < n:
        to = min(n, at + size)
        while to < n:  # end behind white space or at the end of a text
            space = np.flatnonzero(parts[raw[to : to + size]])
            text = int(offsets[np.searchsorted(offsets, to, "left")])
            step = to + int(space[0]) + 1 if len(space) else to + size
            to = min(n, text, step)
            if len(space) or to == text:
                break
        piece = raw[at:to]
        start, end = _bounds(piece, offsets - at, parts)
        piece = LOWER[piece] if lower else piece
        hashes.append(_BYTES.spans(_BYTES.prefix(_BYTE_VALUES[piece]), start, end))
        starts.append(start + at)
        ends.append(end + at)
        at = to
    if not starts:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    start = np.concatenate(starts)
    return Words(start, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(start, offsets))


def windows(hashes: np.ndarray, k: int, of: Polynomial = WORDS) -> np.ndarray:
    """Hash of every ``k`` consecutive words, across texts too: see ``inside``."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return of.spans(of.prefix(hashes), at, at + k)


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Places of the windows of ``k`` words that lie within one text."""
    if first[-1] < k:
        return np.zeros(0, np.int64)
    ok = np.ones(first[-1] - k + 1, bool)
    for j in range(1, k):  # windows that reach over the start of a text
        over = first[1:-1] - j
        ok[over[(over >= 0) & (over < len(ok))]] = False
    return np.flatnonzero(ok)


def signed(h: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return h.view(np.int64)
