"""Training-order materialisation (4): a keyed permutation, and shards of fixed stride.

Every sequence (a document's token ids) has a dense number: the rows before its file, and its row within the file.
A keyed Feistel network permutes the numbers below the next power of four; a number that lands beyond the
last sequence is sent through again until it lands within (cycle-walking), which makes it a permutation
of exactly the sequences. The image is the sequence's global slot. It takes no table and no sort to
compute, and its inverse tells which sequence is trained at a given place.

Shards are ranges of slots, a partition each; text is shuffled once. A task streams its sequences in order of
slot into one binary file: ids, an end mark after each sequence, padding to a whole number of records of
``stride`` ids. Record ``k`` of a shard is at byte ``k * stride * width``, so reading is sequential and
may be taken up at any record (:func:`read_records`). A file appears under its final name when it is
complete; a task that is run again writes the same bytes.

A null text is a sequence without ids. Repeated rows are sequences of their own. No rows give no shards. Frames
that are not all rows of Parquet files are written to the shared folder first, as their rows have no lasting place.
Files are taken in the order of their names, so a frame whose partitions have the same rows in the same order
each time gets the same training order each time.
Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlift.llm import arrays
from feedlift.llm.frames import buckets
from feedlift.session import materialise, new_path

ROUNDS = 4
#: Ids of the byte tokenizer: 0 to 255 are bytes; these two never occur in UTF-8.
END, PAD = 0xFF, 0xFE
STRIDE = 2048


class Permutation:
    """A keyed permutation of 0 .. n - 1."""

    def __init__(self, n: int, key: int):
        self.n = n
        self._half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self._keys = arrays.random_table(ROUNDS, key % (1 << 63))

    def _turn(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        bits, mask = np.uint64(self._half), np.uint64((1 << self._half) - 1)
        left, right = x >> bits, x & mask
        for k in keys:
            left, right = right, left ^ (arrays.mix(right + k) & mask)
        return (right << bits) | left  # halves changed over: the same network turns back with the keys reversed

    def _walk(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = self._turn(x.astype(np.uint64), keys)
        while len(beyond := np.flatnonzero(out >= self.n)):
            out[beyond] = self._turn(out[beyond], keys)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self._keys)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self._keys[::-1])


def _whole_files(docs: DataFrame) -> bool:
    """Whether a frame is a scan, with columns picked or made at most: each row of its files once."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName() == "LogicalRelation"


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """``number, doc_id, text``, and how many rows there are."""
    picked = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    path = F.col("_metadata.file_path")
    place = [path.alias("path"), F.xxhash64(path).alias("file"), F.col("_metadata.row_index").alias("at")]
    try:
        rows = docs.select(*picked, *place) if _whole_files(docs) else None
    except AnalysisException:
        rows = None
    if rows is None:
        rows = materialise(docs.select(*picked), "sequences").select("doc_id", "text", *place)
    # A row per input file: that bounds what is collected here and broadcast below.
    counts = rows.groupBy("file").agg(F.first("path").alias("path"), F.count("*").alias("n")).collect()
    files = [(r["file"], r["n"]) for r in sorted(counts, key=lambda r: r["path"])]
    before = np.concatenate(([0], np.cumsum([n for _, n in files]))).astype(np.int64).tolist()
    if not files:
        return rows.select(F.lit(0).cast("long").alias("number"), "doc_id", "text"), 0
    firsts = docs.sparkSession.createDataFrame([(f, b) for (f, _), b in zip(files, before, strict=False)], "file long, first long")
    return rows.join(F.broadcast(firsts), "file").select((F.col("first") + F.col("at")).alias("number"), "doc_id", "text"), before[-1]


_ROW = "doc_id long, slot long, shard int, record long, place long, n_ids long, ids_sha256 string, file string, file_sha256 string, n_records long"


def _write(batches: Iterator[pa.RecordBatch], folder: str, stride: int, width: int, end: bytes, pad: bytes) -> Iterator[pa.RecordBatch]:
    """Write the shard of this task; a row for each sequence in it. Its last row tells of the whole file."""
    shard, names = TaskContext.get().partitionId(), [c.split(" ")[0] for c in _ROW.split(", ")]
    file = f"shard-{shard:06d}.bin"
    store, root = pa.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    attempt = f"{root}/.attempt-{uuid.uuid4().hex}"
    out, whole, place, done = None, hashlib.sha256(), 0, []
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())

    def told(last: tuple = (None, None)) -> pa.RecordBatch:
        rows = [(*r, file, None, None) for r in done]
        if last[0] is not None:
            rows[-1] = (*rows[-1][:-2], *last)
        return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        if out is None:
            store.create_dir(root, recursive=True)
            out = store.open_output_stream(attempt)
        if len(done) > 5000:
            yield told()
            done = []
        for doc_id, slot, ids in zip(batch.column("doc_id").to_pylist(), batch.column("slot").to_pylist(), batch.column("ids"), strict=True):
            data = ids.as_py()
            n = len(data) // width
            done.append((doc_id, slot, shard, place // stride, place, n, hashlib.sha256(data).hexdigest()))
            for part in (data, end):
                out.write(part)
                whole.update(part)
            place += n + 1
    if out is not None:
        rest = pad * (-place % stride)
        out.write(rest)
        whole.update(rest)
        out.close()
        store.move(attempt, f"{root}/{file}")
        yield told((whole.hexdigest(), (place + len(rest) // width) // stride))


def byte_ids(text: Column | str) -> Column:
    """Ids of the byte tokenizer, one byte each; of null none."""
    return F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))


def materialise_order(
    docs: DataFrame, key: int, stride: int = STRIDE, shards: int | None = None, ids: Column | None = None, width: int = 1,
    end: int = END, pad: int = PAD, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None,
) -> tuple[str, DataFrame]:
    """Write the shards; their folder, and a stored row per sequence: ``doc_id, slot, shard, record, place`` (of its first id
    in the shard), ``n_ids, ids_sha256, file``, and in the last row of a file ``file_sha256`` and ``n_records``.

    ``ids`` gives the token ids from ``text`` as binary, ``width`` little-endian bytes each; without it they are bytes."""
    folder = (folder or new_path(docs.sparkSession, "shards")).rstrip("/")
    rows, n = numbered(docs, id_col, text_col)
    shards = max(1, min(shards or buckets(docs), n))
    order = Permutation(n, key)

    def slot(numbers: pa.Array) -> pa.Array:
        return pa.array(order.slots(numbers.to_numpy(zero_copy_only=False)))

    per_shard = -(-n // shards) or 1
    placed = rows.select(F.arrow_udf(slot, "long")("number").alias("slot"), "doc_id", "text")
    placed = placed.repartitionById(shards, F.floor(F.col("slot") / per_shard).cast("int")).sortWithinPartitions("slot")
    placed = placed.select("doc_id", "slot", (byte_ids("text") if ids is None else ids).alias("ids"))
    marks = (end.to_bytes(width, "little"), pad.to_bytes(width, "little"))
    written = placed.mapInArrow(lambda b: _write(b, folder, stride, width, *marks), _ROW)
    return folder, materialise(written, "shard-rows")


def read_records(folder: str, shard: int, first: int = 0, stride: int = STRIDE, width: int = 1) -> Iterator[np.ndarray]:
    """Records of a shard from the ``first`` on, one after the other."""
    store, root = pa.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    size = stride * width
    with store.open_input_file(f"{root}/shard-{shard:06d}.bin") as f:
        f.seek(first * size)
        while len(data := f.read(size)):
            yield np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32}[width])
