"""Line dedup (9): hashes dealt out by range, first occurrences read from a sorted stream.

The key of a line is the line without ASCII white space at both ends, A-Z in lower case. Each
document sends one row per distinct key of at least ``min_chars`` code points: hash, document and
line numbers, never text. Rows go to range partitions sorted by hash, then document, the one that
keeps its lines first. A task reads them as a stream (:mod:`feedlift.llm.runs`), so a line that a
third of all documents hold is spread over tasks. What is lost comes back as one compressed keep
bitmap per document.

Null or empty text is one empty line, which is never dropped. Rows equal in id and text are one
document, counted once, and all of them lose the same lines; rows that share only the id are two; a null id counts as the smallest. Columns other
than id and text are not read. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlift.llm import arrays, runs
from feedlift.llm.frames import buckets, keyed
from feedlift.session import materialise

_EDGE = b" \t\n\r\x0b\x0c"  # fixed: the ASCII white space
_LOWER = bytes(arrays.LOWER)
_ROWS = "hash long, member long, doc_id long, lines array<int>"


def line_key(line: bytes) -> bytes:
    return line.strip(_EDGE).translate(_LOWER)


def _hash(key: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little", signed=True)


def _code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def _occurrences(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, list, list, list] = ([], [], [], [])
        texts, ids, members = batch.column("text"), batch.column("doc_id"), batch.column("key")
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            if not text or len(text) < min_chars:
                continue
            seen: dict[int, list[int]] = {}
            for number, line in enumerate(text.encode().split(b"\n")):
                if len(line) >= min_chars:
                    key = line_key(line)
                    if len(key) >= min_chars and _code_points(key) >= min_chars:
                        seen.setdefault(_hash(key), []).append(number)
            out[0].extend(seen)
            out[1].extend([members[i].as_py()] * len(seen))
            out[2].extend([ids[i].as_py()] * len(seen))
            out[3].extend(seen.values())
            if len(out[0]) >= 50_000:
                yield _rows(out)
                out = ([], [], [], [])
        yield _rows(out)


def _rows(out: tuple[list, list, list, list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
    names = ["hash", "member", "doc_id", "lines"]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=names)


def pack_bitmap(dropped: np.ndarray) -> bytes:
    """Bits of the lines that are kept, up to the last one dropped; later lines are kept."""
    keep = np.ones((int(dropped.max()) // 8 + 1) * 8, np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack_bitmap(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """True for each line that is kept. Null: all of them."""
    keep = np.ones(n_lines, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines]
        keep[: len(bits)] = bits.astype(bool)
    return keep


def _bitmaps(dropped: pa.Array) -> pa.Array:
    lists = (np.unique(v.values.to_numpy(zero_copy_only=False)) for v in dropped)
    return pa.array([pack_bitmap(v) for v in lists], pa.binary())


def keep_bitmaps(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``key, keep_bitmap`` of each document that loses lines: a key found in ``min_docs`` documents
    stays only in the one with the largest id. ``key`` is :func:`feedlift.llm.frames.row_key`."""
    rows = keyed(docs, id_col, text_col)
    found = materialise(rows.mapInArrow(lambda b: _occurrences(b, min_chars), _ROWS), "line-occurrences")
    order = [F.col("doc_id").desc_nulls_last(), F.col("member")]
    stream = materialise(runs.repeated(found, ["hash"], order, min_docs, buckets(found), once=True), "line-runs")
    lost = runs.settled(stream, ["hash"], min_docs).filter(F.col("member") != F.col("first_member"))
    bitmaps = (
        lost.groupBy(F.col("member").alias("key"))
        .agg(F.flatten(F.collect_list("lines")).alias("dropped"))
        .select("key", F.arrow_udf(_bitmaps, "binary")("dropped").alias("keep_bitmap"))
    )
    # A stage that makes bitmaps and applies them would run two Python workers for each task.
    return materialise(bitmaps, "line-bitmaps")


def _kept_text(text: pa.Array, bitmap: pa.Array) -> pa.Array:
    out = []
    for t, b in zip(text, bitmap, strict=True):
        t, b = t.as_py(), b.as_py()
        if b is not None:
            lines = t.split("\n")
            t = "\n".join(x for x, keep in zip(lines, unpack_bitmap(b, len(lines)), strict=True) if keep)
        out.append(t)
    return pa.array(out, pa.string())


def kept_text(text: Column | str, bitmap: Column | str) -> Column:
    """The text without the lines its bitmap drops, joined by a line break."""
    return F.arrow_udf(_kept_text, "string")(text, bitmap)


def _digest(text: pa.Array, bitmap: pa.Array) -> pa.Array:
    out = []
    for t, b in zip(text, bitmap, strict=True):
        lines = (t.as_py() or "").encode().split(b"\n")
        n = len(lines)
        b = b.as_py()
        if b is not None:
            keep = unpack_bitmap(b, n)
            lines = [x for x, k in zip(lines, keep, strict=True) if k]
        out.append({"n_lines": n, "n_dropped": n - len(lines), "kept_sha256": hashlib.sha256(b"\n".join(lines)).hexdigest()})
    kind = pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])
    return pa.array(out, kind)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with a column ``key`` and their bitmaps. The bitmaps are the side that is hashed: text is not sorted."""
    return docs.join(bitmaps.hint("shuffle_hash"), "key", "left")


def line_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` per document."""
    digest = F.arrow_udf(_digest, "struct<n_lines:long,n_dropped:long,kept_sha256:string>")
    joined = with_bitmaps(keyed(docs), keep_bitmaps(docs))
    return joined.select("doc_id", digest("text", "keep_bitmap").alias("d")).select("doc_id", "d.*")
