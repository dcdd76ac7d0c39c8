"""Substring dedup (2): repeated passages by a compacted de Bruijn graph of word windows.

A window is 35 consecutive words. Windows are the edges of a de Bruijn graph whose nodes are their
overlaps; a window is repeated if its words also start anywhere else, in the same document or another.

1. Within a document, consecutive windows with the same least 8-word hash (their anchor) lie on one
   path and are sent as one edge: hash of the anchor, hash of all words from the first window to
   the last, and source coordinates. Equal windows have equal anchors, so an edge whose anchor occurs once
   in the corpus holds no repeated window. Edges are dealt out by range of the anchor and read as
   runs (:mod:`feedlift.llm.runs`); most end here.
2. Edges with equal words (anchor and word hashes both) are the same edge, and repeated. Joined with
   their successors by source coordinates, edges that always follow each other are nonbranching; such paths are
   compacted by pointer doubling, each round a Spark join, into (path, offset). Coordinates of whole paths then
   stand for those of their edges. A path is verified by its coordinates: its length must be the
   same wherever it occurs.
3. Where paths branch or end, an edge of its own words may share only some of its windows with another
   edge of the same anchor. Only these edges are opened: their single windows are hashed twice from
   the text and compared.

Spans of words come out per document. Null and empty texts have no words. Repeated rows are rows like
others: their windows occur elsewhere. Rows equal in id and text share their spans. Columns other than id
and text are not read; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlift.llm import arrays, runs
from feedlift.llm.bitmap import bitmap_of, possible
from feedlift.llm.frames import buckets, keyed
from feedlift.session import discard, materialise

WINDOW, ANCHOR = 35, 8
_PLACE = 31  # bits of the place of a word within a block, as many as a text can have bytes; the rest of the 64 order the anchors
_EDGE = "hash long, content long, member long, start int, n int"


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    out, done = values, 1
    while 2 * done <= width:
        out, done = np.minimum(out[:-done], out[done:]), 2 * done
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def edges_of(w: arrays.Words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Edges of the texts of a block: document, anchor and content hash, first window, windows."""
    at = arrays.inside(w.first, window)
    if not len(at):
        return (np.zeros(0, np.int64),) * 5
    grams = arrays.windows(w.hash, anchor)
    places = np.arange(len(grams), dtype=np.uint64)
    # Equal hashes are told apart by their order, which is the same wherever the words are.
    order = (grams >> np.uint64(_PLACE) << np.uint64(_PLACE)) | places
    least = _sliding_min(order, window - anchor + 1)[at] & np.uint64((1 << _PLACE) - 1)
    cuts = np.concatenate(([0], np.flatnonzero((least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)) + 1, [len(at)]))
    start, last, anchors = at[cuts[:-1]], at[cuts[1:] - 1], least[cuts[:-1]].astype(np.int64)
    content = arrays.WORDS_2.spans(arrays.WORDS_2.prefix(w.hash), start, last + window)
    content = arrays.mix(content + (anchors - start).astype(np.uint64))  # and where the anchor lies
    doc = np.searchsorted(w.first, start, "right") - 1
    return doc, grams[anchors], content, start - w.first[doc], last - start + 1


def _edges(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        for first_row, _, raw, offsets in arrays.blocks(batch.column("text")):
            doc, anchors, content, start, n = edges_of(arrays.words(raw, offsets), window, anchor)
            if len(doc):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(arrays.signed(anchors)),
                        pa.array(arrays.signed(content)),
                        pa.array(keys[first_row + doc]),
                        pa.array(start.astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                    ],
                    names=["hash", "content", "member", "start", "n"],
                )


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Both hashes of the windows of the opened edges of each text."""
    for batch in batches:
        keys, starts, sizes = (batch.column(c) for c in ("key", "starts", "sizes"))
        for first_row, _, raw, offsets in arrays.blocks(batch.column("text")):
            w = arrays.words(raw, offsets)
            one, two = arrays.windows(w.hash, window), arrays.windows(w.hash, window, arrays.WORDS_2)
            member, place, single = [], [], []
            for d in range(len(offsets) - 1):
                row = first_row + d
                s = starts[row].values.to_numpy(zero_copy_only=False).astype(np.int64)
                n = sizes[row].values.to_numpy(zero_copy_only=False).astype(np.int64)
                where = np.repeat(s, np.abs(n)) + np.arange(np.abs(n).sum()) - np.repeat(np.cumsum(np.abs(n)) - np.abs(n), np.abs(n))
                place.append(where)
                single.append(np.repeat(n > 0, np.abs(n)))
                member.append(np.full(len(where), keys[row].as_py(), np.int64))
            at = np.concatenate([p + f for p, f in zip(place, w.first[:-1], strict=True)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(arrays.signed(one[at])),
                    pa.array(arrays.signed(two[at])),
                    pa.array(np.concatenate(member)),
                    pa.array(np.concatenate(place).astype(np.int32)),
                    pa.array(np.concatenate(single)),
                ],
                names=["hash", "second", "member", "start", "single"],
            )


def compacted(follows: DataFrame) -> DataFrame:
    """``node, head, offset`` of every node on a nonbranching path but its head.

    ``follows``: node, next, step (windows from one to the other); next is unique to node and node to next.
    Each round a node takes over what the node it points to knows, so pointers double in reach and a path
    is done in rounds of the logarithm of its length."""
    at = F.col("step").cast("long").alias("offset")
    pointers = materialise(follows.select(F.col("next").alias("node"), F.col("node").alias("head"), at, F.lit(False).alias("final")), "paths")
    while not pointers.filter("not final").isEmpty():
        known = pointers.select(F.col("node").alias("head"), F.col("head").alias("further"), F.col("offset").alias("more"), F.col("final").alias("end"))
        moved = pointers.filter("not final").join(known, "head", "left").select(
            "node",
            F.coalesce("further", "head").alias("head"),
            (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"),
            F.coalesce("end", F.lit(True)).alias("final"),  # what it points to is a head
        )
        before, pointers = pointers, materialise(pointers.filter("final").unionByName(moved), "paths")
        discard(before)
    return pointers.drop("final")


def path_spans(edges: DataFrame) -> DataFrame:
    """``member, start, n`` of the repeated paths: edges (node, member, start, n) compacted."""
    following = edges.select("member", F.col("start").alias("at"), F.col("node").alias("next"))
    chain = edges.join(following, (edges.member == following.member) & (F.col("start") + F.col("n") == F.col("at")), "left")
    chain = chain.select("node", "n", "next")
    after = chain.groupBy("node").agg(F.count("*").alias("k"), F.count("next").alias("k_next"), F.min("next").alias("next"), F.max("next").alias("y"), F.first("n").alias("step"))
    after = materialise(after, "path-links")
    before = chain.filter("next is not null").groupBy("next").agg(F.min("node").alias("node"), F.max("node").alias("y"), F.count("*").alias("k_before"))
    before = before.filter("node = y").drop("y").join(after.select(F.col("node").alias("next"), F.col("k").alias("k_here")), "next").filter("k_before = k_here")
    follows = after.filter("next = y and k = k_next and next <> node").select("node", "next", "step").join(before.select("next", "node"), ["node", "next"])
    paths = compacted(follows)
    placed = edges.join(paths, "node", "left")
    placed = placed.select(
        "member", F.coalesce("head", "node").alias("path"), (F.col("start") - F.coalesce("offset", F.lit(0))).alias("start"),
        (F.coalesce("offset", F.lit(0)) + F.col("n")).alias("n"),
    )
    spans = placed.groupBy("member", "path", "start").agg(F.max("n").alias("n"))
    # Source coordinates verify a path: all of it is there wherever its head is.
    length = spans.groupBy("path").agg(F.min("n").alias("least"), F.max("n").alias("most")).filter("least = most")
    return spans.join(length.select("path"), "path", "left_semi").select("member", F.col("start").cast("int").alias("start"), F.col("n").cast("int").alias("n"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, starts, sizes``: the stretches of words of each document that repeated windows cover. ``key`` is
    :func:`feedlift.llm.frames.row_key`. Stretches may overlap. Documents without any have no row."""
    rows = keyed(docs, id_col, text_col)
    edges = materialise(rows.select("key", "text").mapInArrow(lambda b: _edges(b, window, anchor), _EDGE), "graph-edges")
    stream = materialise(runs.repeated(edges, ["hash"], ["content", "member", "start"], 2, buckets(edges)), "graph-runs")
    discard(edges)
    shared = runs.settled(stream, ["hash"], 2).drop("first_member")
    source = F.struct("member", "start", "n")
    kinds = shared.groupBy("hash", "content").agg(F.count("*").alias("k"), F.min(source).alias("source"))
    kinds = materialise(kinds, "graph-kinds")
    full = shared.join(kinds.filter("k > 1").select("hash", "content"), ["hash", "content"], "left_semi")
    full = materialise(full.select(F.xxhash64("hash", "content").alias("node"), "member", "start", "n").distinct(), "graph-repeated")
    discard(stream)
    spans = path_spans(full)

    # Edges of their own words that share an anchor with others, and one source of each of those others.
    branching = kinds.groupBy("hash").agg(F.count("*").alias("m"), F.min("k").alias("least")).filter("m > 1 and least = 1")
    opened = kinds.join(branching.select("hash"), "hash", "left_semi").select("source.*", (F.col("k") == 1).alias("single"))
    # The sign tells single edges from sources that are compared with them.
    opened = opened.groupBy(F.col("member").alias("key")).agg(
        F.collect_list("start").alias("starts"), F.collect_list(F.when(F.col("single"), F.col("n")).otherwise(-F.col("n"))).alias("sizes")
    )
    opened = materialise(opened, "graph-opened")
    bitmap = bitmap_of(opened, "key")
    texts = rows.select("key", "text").filter(possible(bitmap, "key"))
    texts = texts.join(opened.hint("shuffle_hash"), "key").select("key", "text", "starts", "sizes")
    kind = "hash long, second long, member long, start int, single boolean"
    windows = materialise(texts.mapInArrow(lambda b: _windows(b, window), kind), "graph-windows")
    stream = materialise(runs.repeated(windows, ["hash", "second"], ["member", "start"], 2, buckets(windows)), "window-runs")
    discard(windows)
    alone = runs.settled(stream, ["hash", "second"], 2).filter("single")
    spans = spans.unionByName(alone.select("member", "start", F.lit(1).alias("n")))
    return spans.groupBy(F.col("member").alias("key")).agg(
        F.collect_list("start").alias("starts"), F.collect_list((F.col("n") + (window - 1)).cast("int")).alias("sizes")
    )


def _removed(n: int, starts: pa.ListScalar, sizes: pa.ListScalar) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    s = starts.values.to_numpy(zero_copy_only=False)
    np.add.at(change, s, 1)
    np.add.at(change, s + sizes.values.to_numpy(zero_copy_only=False), -1)
    return np.cumsum(change[:-1]) > 0


def _rest(text: str | None, starts: pa.ListScalar, sizes: pa.ListScalar) -> tuple[int, list[bytes]]:
    """Words of a text, how many, and those that no stretch covers. ASCII white space parts the words of bytes."""
    words = (text or "").encode().split()
    if not starts.is_valid:
        return len(words), words
    gone = _removed(len(words), starts, sizes)
    return len(words), [words[i] for i in np.flatnonzero(~gone)]


def _kept(text: pa.Array, starts: pa.Array, sizes: pa.Array) -> pa.Array:
    out = []
    for t, s, z in zip(text, starts, sizes, strict=True):
        out.append(b" ".join(_rest(t.as_py(), s, z)[1]).decode() if t.is_valid else None)
    return pa.array(out, pa.string())


def kept_words(text: Column | str, starts: Column | str, sizes: Column | str) -> Column:
    """The words that no stretch covers, joined by one space; of null null."""
    return F.arrow_udf(_kept, "string")(text, starts, sizes)


def _digest(text: pa.Array, starts: pa.Array, sizes: pa.Array) -> pa.Array:
    out = []
    for t, s, z in zip(text, starts, sizes, strict=True):
        n, rest = _rest(t.as_py(), s, z)
        out.append({"n_words": n, "n_removed": n - len(rest), "kept_sha256": hashlib.sha256(b" ".join(rest)).hexdigest()})
    return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]))


def repeat_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` per document."""
    joined = keyed(docs).join(repeated_spans(docs).hint("shuffle_hash"), "key", "left")
    digest = F.arrow_udf(_digest, "struct<n_words:long,n_removed:long,kept_sha256:string>")
    return joined.select("doc_id", digest("text", "starts", "sizes").alias("d")).select("doc_id", "d.*")
