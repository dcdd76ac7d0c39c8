"""Row numbers over a whole feed, and the packing of rows into prompts.

A window without partitions would pull every row into one task. Here the rows are
range-partitioned, numbered inside their partition and shifted by the number of rows
in the partitions before; no task sees more than its range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlift.functions.text import as_column
from feedlift.session import materialise, scratch

# monotonically_increasing_id() puts the partition above bit 33 and counts below it.
_ROW_BITS = 33


def number_rows(
    df: DataFrame, by: Sequence[str], column: str = "row_id", *, frozen: bool = False
) -> DataFrame:
    """Add the 0-based position of each row in the order of ``by``.

    Rows with equal keys are spread by their place in the frozen input, so a key that
    holds much of the table does not end up in one range. ``frozen`` says that ``df`` is
    a plain scan already; otherwise it is written first, because that place must not
    change when a task runs again.

    One range shuffle; the offsets have one row per partition.
    """
    order = [as_column(c) for c in by]
    with scratch(df.sparkSession):
        source = df if frozen else materialise(df, "unnumbered")
        ranged = (
            source.withColumn("_place", F.monotonically_increasing_id())
            .repartitionByRange(*order, F.col("_place"))
            .sortWithinPartitions(*order, F.col("_place"))
            .withColumn("_slot", F.monotonically_increasing_id())
            .drop("_place")
        )
        placed = materialise(ranged, "numbered", keep=True)

    part = F.shiftright("_slot", _ROW_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    place = F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.join(F.broadcast(offsets), part == F.col("_part")).select(
        *[as_column(c) for c in df.columns], (F.col("_offset") + place).alias(column)
    )


def pack_chunks(
    numbered: DataFrame, per_chunk: int, *, id_col: str = "id", partitions: int | None = None
) -> DataFrame:
    """Group numbered ``id, properties`` rows into chunks of ``per_chunk`` neighbours:
    ``chunk_id, ids, properties``, both arrays in row order and NULL elements kept.

    ``partitions`` is the number of tasks, for chunks with much work to come: adaptive execution would merge
    partitions by their bytes alone."""
    row = F.struct("row_id", F.col(id_col).alias("id"), "properties")
    chunked = numbered.withColumn("chunk_id", F.expr(f"row_id div {int(per_chunk)}"))
    if partitions is not None:
        chunked = chunked.repartition(partitions, "chunk_id")
    return (
        chunked.groupBy("chunk_id")
        .agg(F.array_sort(F.collect_list(row)).alias("_rows"))
        .select(
            "chunk_id",
            F.col("_rows.id").alias("ids"),
            F.col("_rows.properties").alias("properties"),
        )
    )


def _runs(batches: Iterator[pa.RecordBatch], per_chunk: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of one chunk as arrays: ``chunk_id, first, ids, properties``. Rows come as they are stored, so
    only a chunk that the end of a split cuts comes in pieces."""
    held: pa.RecordBatch | None = None  # the piece at the end of what was read
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        if not batch.num_rows:
            continue
        row = batch.column("row_id").to_numpy()
        cuts = np.flatnonzero((row[1:] != row[:-1] + 1) | (row[1:] // per_chunk != row[:-1] // per_chunk)) + 1
        starts = np.concatenate(([0], cuts))
        yield _pieces(batch.slice(0, int(starts[-1])), starts[:-1], per_chunk)
        held = batch.slice(int(starts[-1]))
    if held is not None:
        yield _pieces(held, np.zeros(1, np.int64), per_chunk)


def _pieces(rows: pa.RecordBatch, starts: np.ndarray, per_chunk: int) -> pa.RecordBatch:
    first = rows.column("row_id").to_numpy()[starts] if len(starts) else starts.astype(np.int64)
    offsets = pa.array(np.append(starts, rows.num_rows).astype(np.int32) if len(starts) else np.zeros(1, np.int32))
    lists = [pa.ListArray.from_arrays(offsets, rows.column(c)) for c in ("id", "properties")]
    return pa.RecordBatch.from_arrays([pa.array(first // per_chunk), pa.array(first), *lists], names=["chunk_id", "first", "ids", "properties"])


def chunk_pieces(numbered: DataFrame, per_chunk: int, id_col: str = "id") -> DataFrame:
    """Chunks of numbered rows, each in as few pieces as the storage of the rows allows, written once."""
    rows = numbered.select("row_id", as_column(id_col).alias("id"), "properties")
    kind = T.StructType([
        T.StructField("chunk_id", T.LongType()), T.StructField("first", T.LongType()),
        *[T.StructField(n, T.ArrayType(rows.schema[c].dataType)) for n, c in (("ids", "id"), ("properties", "properties"))],
    ])
    return materialise(rows.mapInArrow(lambda batches: _runs(batches, per_chunk), kind), "chunks")


def stream_chunks(numbered: DataFrame, per_chunk: int, *, id_col: str = "id") -> DataFrame:
    """:func:`pack_chunks` of rows as :func:`number_rows` gives them, without a shuffle.

    They are stored in order, so chunks are cut as the rows stream by.
    Only pieces of chunks that end with a split, two for each split at most, and of the last chunk are put
    together by their number. Rows in any other order give the same chunks, from more pieces."""
    pieces = chunk_pieces(numbered, int(per_chunk), id_col)
    whole = F.size("ids") == per_chunk
    parts = F.array_sort(F.collect_list(F.struct("first", "ids", "properties"))).alias("_parts")
    mended = pieces.where(~whole).groupBy("chunk_id").agg(parts)
    joined = [F.flatten(F.col(f"_parts.{c}")).alias(c) for c in ("ids", "properties")]
    return pieces.where(whole).select("chunk_id", "ids", "properties").union(mended.select("chunk_id", *joined))
