"""Runs of equal keys in a range-partitioned, sorted frame, read as a stream.

A frame sorted by ``(hash, ...)`` over range partitions holds the rows of one hash side by side,
in one partition or in several neighbouring ones, so a hash that a third of all rows share is
spread over many tasks. Each task reads its rows as a stream and holds back at most
``least - 1`` rows of the run it is in. Only the first and the last run of a partition may go on
in a neighbour: these are settled from one summary row per partition end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_SETTLED, _OPEN, _SUMMARY = 0, 1, 2


def _stream(batches: Iterator[pa.RecordBatch], keys: list[str], least: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    names = [f.name for f in schema if f.name not in ("_state", "_first", "_n", "_part")]

    def rows(table: pa.Table, state: int, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(table):
            extra = {
                "_state": pa.array(np.full(len(table), state, np.int8)),
                "_first": pa.array(first),
                "_n": pa.array(np.zeros(len(table), np.int64)),
                "_part": pa.array(np.full(len(table), part, np.int32)),
            }
            whole = pa.table({**{n: table[n] for n in names}, **extra}).cast(schema)
            yield from whole.to_batches()

    def summary(key: tuple[int, ...], first: int, n: int) -> pa.RecordBatch:
        values = {**dict(zip(keys, key, strict=True)), "_state": _SUMMARY, "_first": first, "_n": n, "_part": part}
        return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)

    held: pa.Table | None = None  # rows of the run being read, if not yet told apart
    now = head = None  # its key, and the member of its first row
    count, leading = 0, True  # leading: the first run of this partition
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        key_at = lambda i: tuple(int(v[i]) for v in values)  # noqa: B023, E731
        members = batch.column("member").to_numpy(zero_copy_only=False)
        change = np.logical_or.reduce([v[1:] != v[:-1] for v in values])
        bounds = np.concatenate(([0], np.flatnonzero(change) + 1, [len(members)]))
        at = 0
        if key_at(0) == now:  # the run goes on
            at, n = 1, int(bounds[1])
            mine = table.slice(0, n)
            if leading:
                yield from rows(mine, _OPEN, np.full(n, head))
            elif count + n >= least:
                mine = mine if held is None else pa.concat_tables([held, mine])
                yield from rows(mine, _SETTLED, np.full(len(mine), head))
                held = None
            else:
                held = mine if held is None else pa.concat_tables([held, mine])
            count += n
        if at == len(bounds) - 1:
            continue
        if leading and now is not None:
            yield summary(now, head, count)
            leading = False
        held = None  # too short and over
        starts, ends = bounds[at:-1], bounds[at + 1 :]
        if leading:  # the very first run
            s, e = starts[0], ends[0]
            yield from rows(table.slice(s, e - s), _OPEN, np.full(e - s, members[s]))
            now, head, count = key_at(s), members[s], int(e - s)
            if len(starts) == 1:
                continue
            yield summary(now, head, count)
            leading, starts, ends = False, starts[1:], ends[1:]
        long = (ends - starts) >= least
        if long.any():
            run = np.repeat(np.arange(len(starts)), ends - starts)
            keep = np.flatnonzero(long[run])
            yield from rows(table.take(pa.array(keep + starts[0])), _SETTLED, members[starts[run[keep]]])
        s, e = starts[-1], ends[-1]
        now, head, count = key_at(s), members[s], int(e - s)
        held = None if long[-1] else table.slice(s, e - s)
    if now is not None:
        if held is not None:
            yield from rows(held, _OPEN, np.full(len(held), head))
        yield summary(now, head, count)


def _once(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The first of neighbouring rows that are equal in ``columns``."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in values])
        new[0] = last != [v[0] for v in values]
        last = [v[-1] for v in values]
        yield batch if new.all() else batch.filter(pa.array(new))


def repeated(df: DataFrame, keys: list[str], order: list, least: int, partitions: int, *, once: bool = False) -> DataFrame:
    """The stream of the rows of ``df`` whose ``keys`` at least ``least`` rows have: store it, and read it
    by :func:`settled`. With ``once`` a member counts once for a key, however many rows it has there; ``order`` must put
    these side by side.

    ``keys`` and ``member`` are long and never null; other columns are carried along. ``df`` is read twice
    (ranges are sampled first): give a frame that is cheap to read again.
    """
    kinds = df.schema
    out = T.StructType([
        *kinds.fields,
        T.StructField("_state", T.ByteType()),
        T.StructField("_first", T.LongType()),
        T.StructField("_n", T.LongType()),
        T.StructField("_part", T.IntegerType()),
    ])
    out = T.StructType([T.StructField(f.name, f.dataType, True) for f in out])
    arrow = to_arrow_schema(out)
    by_range = df.repartitionByRange(partitions, *keys, *order).sortWithinPartitions(*keys, *order)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows equal in keys and order are in one partition, so repeated ones are neighbours here.
        return _stream(_once(batches, [*keys, "member"]) if once else batches, keys, least, arrow)

    return by_range.mapInArrow(stream, out)


def settled(streamed: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The rows of a stored stream that are in runs of at least ``least`` rows, with the ``member`` of the
    first row of the run, in the order of the stream, as column ``first_member``."""
    names = [c for c in streamed.columns if not c.startswith("_")]
    # At most two rows for each partition of the stream: that bounds what is broadcast here.
    ends = (
        streamed.filter(F.col("_state") == _SUMMARY)
        .groupBy(*keys)
        .agg(F.min_by("_first", "_part").alias("_head"), F.sum("_n").alias("_total"))
        .filter(F.col("_total") >= least)
        .drop("_total")
    )
    rows = streamed.filter(F.col("_state") != _SUMMARY).join(F.broadcast(ends), keys, "left")
    first = F.when(F.col("_state") == _SETTLED, F.col("_first")).otherwise(F.col("_head")).alias("first_member")
    return rows.select(*names, first).filter("first_member is not null")
