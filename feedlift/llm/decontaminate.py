"""Benchmark decontamination (1): spaced seeds, joined and verified with substitutions allowed.

Words are runs of ASCII letters and digits and of other characters beyond ASCII, A-Z in lower
case; white space and punctuation part them. A mask of :data:`MASKS` looks at some of twelve
consecutive words and ignores the rest, so a changed word in an ignored place leaves the seed as it
is. An item that may have k changed words is also cut into blocks so many that one of them has at most one,
and that block is found by the masks of :func:`spaced`, whichever its changed word is: no item of which a
document holds 80 % on one diagonal is missed. Seeds of the benchmark and of the documents meet in an equi-join. A bitmap of fixed size, made of
the benchmark's seeds, keeps nearly all other seeds of the documents from being sent at all; each
run of seeds that pass travels with its words, so no text is shuffled.

A seed that joins puts document and item on a diagonal. On it the stretch with the best score is
found, +1 for an equal word and -3 for a changed one. It is a leak if it holds ``min_matched`` equal
words, and so is a diagonal whose equal words, wherever they lie, are 80 % of the words of the item; what is
reported is then the item from its first to its last equal word. Items of 2 to 4 words are found if all are equal; an
item of a single word is not searched, as it says nothing of where it comes from.

In scripts written without spaces every character is a word, and wide punctuation parts words too.

Null and empty texts and items give nothing, as do empty tables. Repeated rows get equal results; rows
equal in id and text are one document. Items with a null id are searched and reported with it. Columns
other than ids and texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlift.llm import arrays
from feedlift.llm.bitmap import bitmap_of, maybe_in
from feedlift.llm.frames import keyed
from feedlift.session import materialise

#: Fixed masks of one span: a word counts where there is a 1.
MASKS = ("111010110011", "110110101101", "101101110110")
SPAN = 12
#: Words of a block that is searched with one word changed, at most.
BLOCK_WORDS = 8
SHORTEST, MIN_MATCHED, LOSS = 2, 13, 3
#: From so many words on, the masks of items are the same.
MOST = 40
#: Words kept around a run of seeds, for the stretch to grow into.
REACH = 64

_ITEM = "item_id long, words array<long>, seeds array<struct<seed:long,at:int>>"
_CLUSTER = "doc_id long, key long, start int, words array<long>, seeds array<struct<seed:long,at:int>>"
_SEEDS = pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())]))


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The seed of every place a mask fits at, across texts too."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, int(mask, 2) * 2 + 1, np.uint64)
    factors = arrays.random_table(len(mask), 99) | np.uint64(1)
    for place, used in enumerate(mask):
        if used == "1":
            total += hashes[place : place + n] * factors[place]
    return arrays.mix(total)


def spaced(length: int) -> list[tuple[str, int]]:
    """Masks, and where in a block of ``length`` words each begins: any one changed word is ignored by one of them."""
    size, out = 2 if length > 6 else 1, []
    for k in range(0, length, size):
        mask = "1" * k + "0" * min(size, length - k) + "1" * (length - k - size)
        out.append((mask.strip("0"), len(mask) - len(mask.lstrip("0"))))
    return out


def masks_of(n: int) -> set[tuple[str, int]]:
    """The masks of an item of ``n`` words, and the places they are put at."""
    if n < 5:
        return {("1" * n, 0)} if n >= SHORTEST else set()
    blocks = n // 5 // 2 + 1  # n // 5 words may be changed
    length = min(BLOCK_WORDS, n // blocks)
    out = {(mask, b * length + at) for b in range(blocks) for mask, at in spaced(length)}
    if n < SPAN:
        return out
    out |= {(mask, k) for mask in MASKS for k in range(n - SPAN + 1)}
    return out | {(mask, k + at) for mask, at in spaced(BLOCK_WORDS) for k in range(n - BLOCK_WORDS + 1)}


def _kinds() -> np.ndarray:
    """Of each code point below 2**16: 1 if it is a word by itself, 2 if it parts words."""
    kinds = np.zeros(1 << 16, np.uint8)
    for kind, ranges in ((1, ALONE), (2, WIDE_MARKS)):
        for first, last in ranges:
            kinds[first : last + 1] = kind
    return kinds


#: Thai, Lao, Tibetan; Burmese; Khmer; Tai scripts; Han radicals, marks and letters, kana, bopomofo; Yi; further Burmese; half-width kana.
ALONE = (
    (0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x2E80, 0x2FDF), (0x3000, 0x312F),
    (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F),
)
WIDE_MARKS = (
    (0x0F0B, 0x0F14), (0x104A, 0x104B), (0x17D4, 0x17DA), (0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0x30FB, 0x30FB), (0xFE10, 0xFE1F),
    (0xFE30, 0xFE4F), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65),
)
_KINDS = _kinds()


def spread(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with spaces around characters that are words, and instead of wide punctuation."""
    lead = np.flatnonzero(raw >= 0xE0)
    if not len(lead):
        return raw, offsets
    after = np.concatenate((raw, np.zeros(3, np.uint8))).astype(np.int32)
    b = [after[lead + k] for k in range(4)]
    whole = (b[1] & 0xC0 == 0x80) & (b[2] & 0xC0 == 0x80)
    kind = np.where(whole & (b[0] < 0xF0), _KINDS[((b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63)], 0)
    # Of four bytes, planes 2 and 3 are Han.
    four = whole & (b[3] & 0xC0 == 0x80) & (b[0] == 0xF0) & (b[1] >= 0xA0)
    marks, alone = lead[kind == 2], np.flatnonzero((kind == 1) | four)
    if not len(marks) and not len(alone):
        return raw, offsets
    raw = raw.copy()
    for k in range(3):
        raw[marks + k] = 32
    breaks = np.unique(np.concatenate((lead[alone], lead[alone] + np.where(four[alone], 4, 3))))
    moved = offsets + np.searchsorted(breaks, offsets, "right")
    moved[0] = 0
    return np.insert(raw, breaks, 32), moved


def _words(raw: np.ndarray, offsets: np.ndarray) -> arrays.Words:
    return arrays.words(*spread(raw, offsets), lower=True, parts=arrays.IS_MARK)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words_, seeds_ = [], []
        for _, _, raw, offsets in arrays.blocks(batch.column("text")):
            w = _words(raw, offsets)
            for a, b in zip(w.first[:-1], w.first[1:], strict=True):
                h, found = w.hash[a:b], []
                places: dict[str, list[int]] = {}
                for mask, k in sorted(masks_of(len(h))):
                    places.setdefault(mask, []).append(k)
                for mask, at in places.items():
                    s = arrays.signed(seeds(h, mask))
                    found += [{"seed": int(s[k]), "at": k} for k in at]
                words_.append(arrays.signed(h))
                seeds_.append(found)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(words_, pa.list_(pa.int64())), pa.array(seeds_, _SEEDS)], names=["item_id", "words", "seeds"]
        )


def _clusters(batches: Iterator[pa.RecordBatch], masks: tuple[str, ...], bitmap: Broadcast, reach: int) -> Iterator[pa.RecordBatch]:
    """Runs of seeds that may be in the benchmark, each with ``reach`` words around it."""
    for batch in batches:
        ids, keys = batch.column("doc_id"), batch.column("key")
        rows: list[tuple] = []
        for first_row, _, raw, offsets in arrays.blocks(batch.column("text")):
            w = _words(raw, offsets)
            places, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for mask in masks:
                s = seeds(w.hash, mask)
                at = np.flatnonzero(maybe_in(bitmap.value, s))
                doc = np.searchsorted(w.first, at, "right") - 1
                at = at[at + len(mask) <= w.first[doc + 1]]
                places.append(at)
                values.append(s[at])
            at, value = np.concatenate(places), arrays.signed(np.concatenate(values))
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, value = at[order], value[order]
            doc = np.searchsorted(w.first, at, "right") - 1
            cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > reach)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(at)], strict=True):
                d = int(doc[s])
                low, high = max(w.first[d], at[s] - reach), min(w.first[d + 1], at[e - 1] + SPAN + reach)
                found = [{"seed": v, "at": int(p - low)} for p, v in zip(at[s:e], value[s:e].tolist(), strict=True)]
                row = first_row + d
                rows.append((ids[row].as_py(), keys[row].as_py(), int(low - w.first[d]), arrays.signed(w.hash[low:high]), found))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), _SEEDS)
            columns = [pa.array(list(v), t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "start", "words", "seeds"])


def best_stretch(equal: np.ndarray, loss: int = LOSS) -> tuple[int, int]:
    """The stretch of a row of equal and changed words with the highest score."""
    total = np.concatenate(([0], np.cumsum(np.where(equal, 1, -loss))))
    least = np.minimum.accumulate(total)
    end = int(np.argmax(total - least))
    return int(np.argmin(total[: end + 1])), end


_FOUND = "struct<n_matched:int,n_compared:int,doc_from:int,doc_to:int,item_from:int,item_to:int>"


def _verify(doc: pa.Array, item: pa.Array, diagonal: pa.Array, min_matched: int) -> pa.Array:
    out = []
    for d, i, at in zip(doc, item, diagonal.to_pylist(), strict=True):
        x, y = (v.values.to_numpy(zero_copy_only=False) for v in (d, i))
        low, high = max(0, -at), min(len(y), len(x) - at)
        equal = x[low + at : high + at] == y[low:high]
        s, e = best_stretch(equal)
        n = int(equal[s:e].sum())
        if n < min_matched and 5 * int(equal.sum()) >= 4 * len(y):
            places = np.flatnonzero(equal)
            s, e, n = int(places[0]), int(places[-1]) + 1, len(places)
        enough = n >= min_matched or 5 * n >= 4 * len(y)
        values = (n, e - s, low + at + s, low + at + e, low + s, low + e)
        names = ("n_matched", "n_compared", "doc_from", "doc_to", "item_from", "item_to")
        out.append(dict(zip(names, values, strict=True)) if enough and n else None)
    return pa.array(out, pa.struct([(n, pa.int32()) for n in ("n_matched", "n_compared", "doc_from", "doc_to", "item_from", "item_to")]))


def leaks(
    docs: DataFrame, benchmark: DataFrame, min_matched: int = MIN_MATCHED, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """One row per document and item that leaks into it, with the longest match: ``doc_id, key,
    item_id, n_matched, n_compared, doc_from, doc_to, item_from, item_to`` (places of words, ends
    exclusive). Documents that are clean have no row."""
    items = keyed(benchmark, item_col, text_col).select("doc_id", "text").mapInArrow(_items, _ITEM)
    items = materialise(items.withColumn("item", F.monotonically_increasing_id()), "benchmark-items")
    known = items.select("item", (F.size("words") < 5).alias("exact"), F.inline("seeds"))
    # A mask that items of several lengths have in common is looked for once; there are few, as blocks are short.
    lengths = [r["n"] for r in items.select(F.least(F.size("words"), F.lit(MOST)).alias("n")).distinct().collect()]
    masks = tuple(sorted({mask for n in lengths for mask, _ in masks_of(n)}))
    bitmap = bitmap_of(known, "seed")
    # Of longer items, 80 % of the words hold a stretch that is enough.
    reach = max(REACH, 5 * min_matched - 1)
    clusters = keyed(docs, id_col, text_col).mapInArrow(lambda b: _clusters(b, masks, bitmap, reach), _CLUSTER)
    clusters = materialise(clusters.withColumn("cluster", F.monotonically_increasing_id()), "seed-clusters")
    hits = clusters.select("cluster", F.inline("seeds")).withColumnRenamed("at", "doc_at")
    met = hits.join(known, "seed").select("cluster", "item", "exact", (F.col("doc_at") - F.col("at")).alias("diagonal"))
    # Wherever an item without changed words is, its match is the same: the last one stands for all.
    diagonals = met.groupBy("cluster", "item", F.when(~F.col("exact"), F.col("diagonal")).alias("each")).agg(F.max("diagonal").alias("diagonal")).drop("each")
    verify = F.arrow_udf(lambda d, i, at: _verify(d, i, at, min_matched), _FOUND)
    found = (
        diagonals.join(clusters.drop("seeds"), "cluster")
        .join(items.select("item", "item_id", F.col("words").alias("item_words")), "item")
        .select("doc_id", "key", "item_id", "item", "start", verify("words", "item_words", "diagonal").alias("f"))
        .filter("f is not null")
    )
    place = lambda c: (F.col(f"f.{c}") + F.col("start")).alias(c)
    found = found.select(
        "doc_id", "key", "item_id", "item",
        F.struct("f.n_matched", "f.n_compared", place("doc_from"), place("doc_to"), "f.item_from", "f.item_to").alias("f"),
    )
    best = found.groupBy("key", "item").agg(F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"), F.max("f").alias("f"))
    return best.select("doc_id", "key", "item_id", "f.*")
