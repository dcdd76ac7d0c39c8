"""Exact top-k search by inner product (13): distributed histogram selection.

A component ``x`` of a vector counts as ``floor(scale * x)``, so scores are whole numbers. For every query its ``k``
highest scores among all other rows are found, ties to the smaller id, without sorting or collecting scores:

1. All scores lie within a range that the largest components and the dimensions bound. It is cut into ``BINS`` bins.
   Every task scores its rows against the queries, block by block as matrix products, and sends for each query how
   many scores it has in each bin, from the highest bin down until as many are told as are still looked for: lower bins
   cannot hold the k-th score. So a task sends at most ``k`` rows a query.
2. The sums over all tasks tell in which bin the k-th score of each query lies, and how many are above it. That bin
   is cut into bins anew, and so on until a bin is one value: the k-th score itself.
3. Everything is scored once more, and rows at or above that value are kept; of those equal to it, a task keeps only
   the smallest ids, as many as are still looked for. What is left is ranked.

Queries are taken in groups that fit a broadcast (``GROUP`` rows and ``GROUP_BYTES``); each group reads all rows.
The state of a group, two numbers a query, is all that comes to the driver; what is sent is bounded by tasks, not by rows,
also where many rows tie.

Rows with a null id, a null vector, or a null or non-finite component take no part. Vectors of different lengths
have no product: a query meets rows of its own length only. Repeated rows and rows with equal ids are rows of their
own, and as queries they have results of their own; fewer rows than ``k`` give fewer results. Products are exact: in
doubles where these hold every sum, else in whole numbers of any size; a score beyond a long counts as the nearest
long. Columns other than id and vector are not read. A frame without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlift.operators.numbering import number_rows
from feedlift.session import discard, materialise, new_path

#: Queries of a group, and bytes of their vectors as doubles; bins of a histogram.
GROUP, GROUP_BYTES, BINS = 8192, 64 << 20, 512
#: Queries and rows of a block of scores.
BLOCK_QUERIES, BLOCK_ROWS = 256, 2048
LOW, HIGH = -(1 << 63), (1 << 63) - 1
_SIGN = np.uint64(1 << 63)


# Vectors of whole numbers


def _quantised(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """Rows that take part; with the dimensions and the largest component of each."""
    for batch in batches:
        vectors = batch.column(1)
        valid = pc.and_(pc.is_valid(vectors), pc.is_valid(batch.column(0)))
        rows = pa.Table.from_batches([batch]).filter(valid).combine_chunks()
        if not len(rows):
            continue
        vectors = rows.column(1).combine_chunks()
        lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(vectors).cast(pa.float64())
        known = pc.is_valid(flat).to_numpy(zero_copy_only=False)
        values = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        bad = np.concatenate(([0], np.cumsum(~(known & np.isfinite(values)))))
        ok = bad[bounds[1:]] == bad[bounds[:-1]]
        with np.errstate(over="ignore", invalid="ignore"):
            values = np.clip(np.floor(scale * values), -np.finfo(float).max, np.finfo(float).max)
        values = values[np.repeat(ok, lengths)] + 0.0
        lengths, kept = lengths[ok], rows.column(0).filter(pa.array(ok))
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        largest = np.array([np.abs(values[a:b]).max(initial=0.0) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        columns = [kept.combine_chunks(), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values)), pa.array(lengths.astype(np.int32)), pa.array(largest, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "vector", "length", "largest"])


def _by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        some = vectors if len(at) == len(lengths) else vectors.take(pa.array(at))
        yield at, pc.list_flatten(some).to_numpy(zero_copy_only=False).reshape(len(at), int(n))


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """``a @ b.T`` of whole numbers held as doubles, as longs. ``exact`` says that doubles hold every sum."""
    if exact:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.vectorize(int, otypes=[object])(m) if m.size else m.astype(object)
    out = whole(a) @ whole(b).T if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.clip(out, LOW, HIGH).astype(np.int64)


@dataclass(frozen=True)
class Group:
    """Queries of one broadcast, and what is known of each: its k-th score is one of the ``span`` values from ``low``, and
    is the ``need``-th among these; they are cut into bins of ``width``."""

    place: np.ndarray
    blocks: list[tuple[np.ndarray, np.ndarray]]  # places within the group, and vectors, of one length each
    low: np.ndarray
    need: np.ndarray
    span: int
    exact: bool

    @property
    def width(self) -> int:
        return -(-self.span // BINS)


def _scores(batches: Iterator[pa.RecordBatch], group: Group) -> Iterator[tuple[np.ndarray, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Queries (places in the group), batch, its rows, and the scores of every such pair as longs. A query's own row is taken
    out by the caller."""
    for batch in batches:
        for at, rows in _by_length(batch.column("vector")):
            for which, queries in group.blocks:
                if queries.shape[1] != rows.shape[1]:
                    continue
                for i in range(0, len(which), BLOCK_QUERIES):
                    for j in range(0, len(at), BLOCK_ROWS):
                        block = products(queries[i : i + BLOCK_QUERIES], rows[j : j + BLOCK_ROWS], group.exact)
                        yield which[i : i + BLOCK_QUERIES], batch, at[j : j + BLOCK_ROWS], block


def _ordered(longs: np.ndarray) -> np.ndarray:
    """Longs as unsigned numbers of the same order, so that differences cannot overflow."""
    return longs.view(np.uint64) ^ _SIGN


def _others(which: np.ndarray, batch: pa.RecordBatch, at: np.ndarray, group: Group) -> np.ndarray:
    place = batch.column("place").to_numpy()[at]
    return group.place[which][:, None] != place[None, :]


def _histograms(batches: Iterator[pa.RecordBatch], group: Group) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(len(group.low) * BINS, np.int64)
    low = _ordered(group.low)
    for which, batch, at, scores in _scores(batches, group):
        u = _ordered(scores)
        base = low[which][:, None]
        inside = (u >= base) & (u - base < np.uint64(group.span)) & _others(which, batch, at, group)
        q, r = np.nonzero(inside)
        bins = ((u[q, r] - low[which[q]]) // np.uint64(group.width)).astype(np.int64)
        if len(q):
            counts += np.bincount(which[q] * BINS + bins, minlength=len(counts))
    counts = counts.reshape(-1, BINS)[:, ::-1]
    above = np.cumsum(counts, axis=1) - counts
    q, b = np.nonzero((counts > 0) & (above < group.need[:, None]))  # lower bins cannot hold the one looked for
    columns = [pa.array(q.astype(np.int32)), pa.array((BINS - 1 - b).astype(np.int32)), pa.array(counts[q, b])]
    yield pa.RecordBatch.from_arrays(columns, names=["query", "bin", "n"])


def _hits(batches: Iterator[pa.RecordBatch], group: Group) -> Iterator[pa.RecordBatch]:
    """Rows above the k-th score, and of those equal to it the smallest ids that this task has."""
    kept = [np.zeros(0, np.int64) for _ in range(3)]  # query, score, id

    def settle(found: list[np.ndarray]) -> list[np.ndarray]:
        q, s, v = found
        order = np.lexsort((v, -(s > group.low[q]).astype(np.int8), q))
        q, s, v = q[order], s[order], v[order]
        tie = s == group.low[q]
        first = np.searchsorted(q, q)  # of each query; its ties come last
        over = np.bincount(q[~tie], minlength=len(group.low))
        stay = ~tie | (np.arange(len(q)) - first - over[q] < group.need[q])
        return [q[stay], s[stay], v[stay]]

    for which, batch, at, scores in _scores(batches, group):
        q, r = np.nonzero((scores >= group.low[which][:, None]) & _others(which, batch, at, group))
        if not len(q):
            continue
        ids = batch.column("vec_id").to_numpy()[at]
        new = settle([which[q], scores[q, r], ids[r]])
        kept = [np.concatenate(x) for x in zip(kept, new, strict=True)]
        if len(kept[0]) > 4 * len(group.low) * max(1, int(group.need.max())):
            kept = settle(kept)
    q, s, v = settle(kept)
    yield pa.RecordBatch.from_arrays([pa.array(group.place[q]), pa.array(v), pa.array(s)], names=["query", "vec_id", "score"])


# Selection


def _refined(rows: DataFrame, group: Group, k: int) -> Group:
    """The group with the bin in which each k-th score lies."""
    sent = rows.sparkSession.sparkContext.broadcast(group)
    told = rows.mapInArrow(lambda b: _histograms(b, sent.value), "query int, bin int, n long")
    sums = told.groupBy("query", "bin").agg(F.sum("n").alias("n"))
    down = Window.partitionBy("query").orderBy(F.desc("bin"))
    reached = sums.withColumn("upto", F.sum("n").over(down)).join(_needs(rows, group), "query").filter("upto >= need")
    found = reached.groupBy("query").agg(F.max("bin").alias("bin"), F.max_by(F.col("upto") - F.col("n"), "bin").alias("above"))
    low, need = group.low.copy(), group.need.copy()
    everything = np.ones(len(low), bool)  # fewer rows than are looked for: all of them
    for r in found.toArrow().to_pylist():  # one row a query of the group
        q = r["query"]
        low[q] = int(low[q]) + r["bin"] * group.width
        need[q] -= r["above"]
        everything[q] = False
    low[everything], need[everything] = LOW, k
    sent.unpersist()
    return Group(group.place, group.blocks, low, need, group.width, group.exact)


def _needs(rows: DataFrame, group: Group) -> DataFrame:
    table = pa.table({"query": pa.array(np.arange(len(group.need), dtype=np.int32)), "need": pa.array(group.need)})
    return F.broadcast(rows.sparkSession.createDataFrame(table))


def _group_of(table: pa.Table, k: int, bound: int, exact: bool) -> Group:
    vectors = table["vector"].combine_chunks()
    n = len(table)
    low = np.full(n, max(LOW, -bound), np.int64)
    return Group(table["place"].to_numpy().copy(), list(_by_length(vectors)), low, np.full(n, k, np.int64), min(2 * bound + 1, (1 << 64) - 1), exact)


def top_k(
    rows: DataFrame, is_query: Column, k: int, *, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row for which ``is_query`` holds (a column of the id, named ``vec_id``)
    the ``k`` highest scores of all other rows."""
    spark = rows.sparkSession
    picked = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    kind = "vec_id long, vector array<double>, length int, largest double"
    # Written once: a row is known by its place, which must be the same in every pass.
    whole = picked.mapInArrow(lambda b: _quantised(b, scale), kind).withColumn("place", F.monotonically_increasing_id())
    whole = materialise(whole, "vectors")
    size = whole.agg(F.max("length"), F.max("largest")).first()
    if size[0] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bound = size[0] * int(size[1]) ** 2
    exact = bound < 1 << 53
    bound = min(bound, HIGH)
    per_group = max(1, min(GROUP, GROUP_BYTES // max(1, 8 * size[0])))
    asked = materialise(whole.filter(is_query).select("place", "vec_id", "vector"), "queries")
    numbered = number_rows(asked, ["place"], "number", frozen=True)
    if exact:
        rows = whole.select("vec_id", "place", "vector")
    else:
        rows = whole.select("vec_id", "place", "vector").repartition(F.col("place"))  # slow products: evenly
    found = new_path(spark, "hits")
    for start in range(0, asked.count(), per_group):
        mine = numbered.filter(F.col("number").between(start, start + per_group - 1)).select("place", "vector").toArrow()
        group = _group_of(mine, k, bound, exact)
        while group.span > 1:
            group = _refined(rows, group, k)
        sent = spark.sparkContext.broadcast(group)
        hits = rows.mapInArrow(lambda b, sent=sent: _hits(b, sent.value), "query long, vec_id long, score long")
        hits.write.parquet(f"{found}/group={start}")
        sent.unpersist()
    if not asked.take(1):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    hits = spark.read.schema("query long, vec_id long, score long").parquet(f"{found}/*")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    ids = asked.select(F.col("place").alias("query"), F.col("vec_id").alias("query_id"))
    return best.join(ids, "query").select("query_id", "rank", "vec_id", "score")
