"""N-gram Jaccard join (10): signature trees over groups that share rare shingles.

The set of a document is its distinct shingles of five words, A-Z in lower case; with fewer words
the whole sequence is one shingle; without words the set is empty and linked with nothing. Two
documents link when ``100 * intersection >= percent * union``. All links between different sets
are found; the result is the component of each document.

1. One pass over the texts gives each document its size, a digest of its set, a bitmap of the set
   and its prefix: the first ``n - ceil(percent/100 * n) + 1`` shingles in one order for all. Two
   documents that link share a shingle of their prefixes. The order puts shingles that a sample
   shows to be frequent last, which only affects how much there is to do.
2. Documents of one digest are one class; its first member stands for it.
3. Prefix shingles are dealt out by range and read as runs (:mod:`feedlift.llm.runs`): the first
   document of a run is a centre and all others are tied to it. Any two documents that share a
   prefix shingle have a centre in common.
4. Pairs of centre and member that can overlap enough by size and bitmap are compared exactly, text
   by text. Their links give first components.
5. Within each centre's group only documents of different components are left to compare. A
   signature tree does it: nodes hold the size range and the OR of the bitmaps of a size class (and
   a salt, as no node may grow large); pairs of nodes of one group are joined and dropped when the
   largest possible overlap is too small, and so on down to documents. What survives is compared
   exactly, in the task of its pair of nodes, until the components in it are joined; all links give the final
   components. So rows grow with the members, not with their pairs.

Repeated rows and rows with equal sets are in one component; a null id is never the smallest, and
a component of null ids only has the id null. Columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlift.llm import arrays, runs
from feedlift.llm.bitmap import bitmap_of, maybe_in, possible
from feedlift.llm.components import components
from feedlift.llm.frames import buckets, keyed
from feedlift.session import discard, materialise

WORDS, PERCENT = 5, 75
#: The share of documents sampled for frequent shingles, how many are sampled at least, and in how many of
#: them a shingle is frequent.
SAMPLE_SHARE, SAMPLE_LEAST, FREQUENT = 1 / 16, 1024, 3
#: Documents in a node of a signature tree, and in the smallest inner node.
NODE, INNER = 256, 16
_SIZE_BASE = 100 / PERCENT


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, raw, offsets in arrays.blocks(column):
        w = arrays.words(raw, offsets, lower=True)
        h = arrays.windows(w.hash, words)
        prefix = arrays.WORDS.prefix(w.hash)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(h[a : b - words + 1])
            elif b > a:
                yield arrays.WORDS.spans(prefix, np.array([a]), np.array([b]))
            else:
                yield np.zeros(0, np.uint64)


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def set_bits(tokens: np.ndarray) -> np.ndarray:
    """The bitmap of a set, two to four bits for each of its members."""
    size = 1 << max(6, int(2 * max(1, len(tokens)) - 1).bit_length())
    flags = np.zeros(size, np.uint8)
    flags[(tokens >> np.uint64(20)).astype(np.int64) & (size - 1)] = 1
    return np.packbits(flags, bitorder="little")


_PROFILE = "doc_id long, key long, n int, sum_a long, sum_b long, bits binary, prefix array<long>"


def _profiles(batches: Iterator[pa.RecordBatch], words: int, percent: int, listed: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for tokens in shingle_sets(batch.column("text"), words):
            k = prefix_length(len(tokens), percent)
            late = maybe_in(listed.value, tokens)
            ordered = np.concatenate((tokens[~late], tokens[late]))
            sums = (tokens.sum(dtype=np.uint64), arrays.mix(tokens + np.uint64(1)).sum(dtype=np.uint64))
            # 48 bits tell prefix shingles apart well enough: what they suggest is compared exactly.
            prefix = (ordered[:k] >> np.uint64(16)).astype(np.int64)
            rows.append((len(tokens), *np.array(sums, np.uint64).view(np.int64).tolist(), set_bits(tokens).tobytes(), prefix))
        n, a, b, bits, prefix = zip(*rows, strict=True) if rows else ((),) * 5
        lengths = np.concatenate(([0], np.cumsum([len(p) for p in prefix]))).astype(np.int32)
        flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("key"),
                pa.array(n, pa.int32()),
                pa.array(a, pa.int64()),
                pa.array(b, pa.int64()),
                pa.array(bits, pa.binary()),
                pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat)),
            ],
            names=["doc_id", "key", "n", "sum_a", "sum_b", "bits", "prefix"],
        )


def _tokens(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tokens in shingle_sets(batch.column("text"), words):
            yield pa.RecordBatch.from_arrays([pa.array(arrays.signed(tokens))], names=["token"])


def frequent_shingles(rows: DataFrame, words: int) -> Broadcast:
    """Shingles found in several documents of a sample, as a bitmap of fixed size. A shingle it takes for
    frequent by mistake is one for all documents."""
    share = max(SAMPLE_SHARE, min(1.0, SAMPLE_LEAST / max(1, rows.count())))
    sample = rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = sample.select("text").mapInArrow(lambda b: _tokens(b, words), "token long").groupBy("token").count()
    return bitmap_of(found.filter(F.col("count") >= FREQUENT), "token")


# Exact comparison


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _linked(left: pa.Array, right: pa.Array, words: int, percent: int) -> pa.Array:
    out = []
    for a, b in zip(shingle_sets(left, words), shingle_sets(right, words), strict=True):
        n = overlap(a, b)
        out.append(n > 0 and 100 * n >= percent * (len(a) + len(b) - n))
    return pa.array(out, pa.bool_())


def _could_link(na: pa.Array, a: pa.Array, nb: pa.Array, b: pa.Array, percent: int) -> pa.Array:
    out = []
    for m, x, n, y in zip(na.to_pylist(), a, nb.to_pylist(), b, strict=True):
        if 100 * min(m, n) < percent * max(m, n):
            out.append(False)
            continue
        x, y = _bits(x.as_buffer()), _bits(y.as_buffer())
        width = min(len(x), len(y))
        x, y = fold(x[None], width)[0], fold(y[None], width)[0]
        both = int(np.bitwise_count(x & y).sum())
        spare = min(m - int(np.bitwise_count(x).sum()), n - int(np.bitwise_count(y).sum()))
        out.append((100 + percent) * (both + spare) >= percent * (m + n))
    return pa.array(out, pa.bool_())


def _bits(buffer) -> np.ndarray:
    return np.frombuffer(buffer, np.uint64)


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (one a row) brought down to ``width`` words: places that fall together are joined by OR."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def spares(n: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """How many members of each set fall on a bit that another one has set, for every width that a bitmap can be
    folded to: one row for each width, ``2**row`` words. Folding lets more members fall together, so the count of
    the full width would be too low for a narrower one."""
    out = []
    while True:
        out.append(n.astype(np.int64) - np.bitwise_count(bits).sum(axis=1))
        if bits.shape[1] == 1:
            return np.stack(out[::-1])
        bits = fold(bits, bits.shape[1] // 2)


def level(width: int) -> int:
    return width.bit_length() - 1


def _texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, text`` of the documents with the keys in ``wanted``, one for each key."""
    some = rows.select("key", "text").filter(possible(bitmap_of(wanted, "key"), "key"))
    return some.join(wanted, "key", "left_semi").dropDuplicates(["key"])


def _verified(pairs: DataFrame, members: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """``pairs`` (a, b: members) whose texts link. Pairs that cannot by size and bitmap go first."""
    shape = members.select("member", "n", "bits", "key")
    side = lambda s: shape.select(*[F.col(c).alias(f"{c}_{s}") for c in shape.columns])
    could = F.arrow_udf(lambda na, a, nb, b: _could_link(na, a, nb, b, percent), "boolean")
    near = (
        pairs.join(side("a"), F.col("a") == F.col("member_a"))
        .filter("a <> b")
        .join(side("b"), F.col("b") == F.col("member_b"))
        .filter(could("n_a", "bits_a", "n_b", "bits_b"))
        .select("a", "b", "key_a", "key_b")
    )
    near = materialise(near, "jaccard-pairs")
    wanted = near.select(F.col("key_a").alias("key")).union(near.select(F.col("key_b").alias("key"))).distinct()
    texts = _texts_of(rows, wanted)
    text = lambda s: texts.select(F.col("key").alias(f"key_{s}"), F.col("text").alias(f"text_{s}"))
    linked = F.arrow_udf(lambda a, b: _linked(a, b, words, percent), "boolean")
    return near.join(text("a"), "key_a").join(text("b"), "key_b").filter(linked("text_a", "text_b")).select("a", "b")


# Signature trees


def _node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of one node after the other, from a frame sorted by node."""
    held, now = [], None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        node = batch.column("node").to_numpy(zero_copy_only=False)
        cuts = np.concatenate(([0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]))
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if s == e:
                continue
            if now is not None and node[s] != now:
                yield now, pa.concat_tables(held)
                held = []
            now = node[s]
            held.append(table.slice(s, e - s))
    if held:
        yield now, pa.concat_tables(held)


def _matrix(bits: pa.ChunkedArray) -> np.ndarray:
    """Bitmaps of a node, brought to the narrowest width among them."""
    rows = [_bits(b.as_buffer()) for b in bits]
    width = min(map(len, rows))
    return np.concatenate([fold(r[None], width) for r in rows])


_NODE = "node long, centre long, class int, low int, high int, spare array<long>, bits binary, component_low long, component_high long"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split(" ")[0] for c in _NODE.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64()]
    for node, rows in _node_rows(batches):
        n, bits = rows["n"].to_numpy(), _matrix(rows["bits"])
        spare = spares(n, bits).max(axis=1).tolist()
        component = rows["component"].to_numpy()
        values = (
            node, rows["centre"][0].as_py(), rows["class"][0].as_py(), int(n.min()), int(n.max()), spare,
            np.bitwise_or.reduce(bits, axis=0).tobytes(), int(component.min()), int(component.max()),
        )
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)


def _may_overlap(low_a, spare_a, bits_a, low_b, spare_b, bits_b, percent: int) -> np.ndarray:
    """For every pair of nodes: can a member of one link with a member of the other? Shared members fall on
    shared bits, and no more than ``spare`` of them (see :func:`spares`) on bits that are counted already."""
    width = min(bits_a.shape[1], bits_b.shape[1])
    x, y = fold(bits_a, width), fold(bits_b, width)
    both = np.stack([np.bitwise_count(row & y).sum(axis=1) for row in x]).astype(np.int64)
    most = both + np.minimum(spare_a[level(width)][:, None], spare_b[level(width)][None, :])
    return (100 + percent) * most >= percent * (low_a[:, None] + low_b[None, :])


class Side:
    """Members of one node, in order of size, and its inner nodes."""

    def __init__(self, rows: pa.Table):
        order = np.argsort(rows["n"].to_numpy(), kind="stable")
        self.n = rows["n"].to_numpy()[order].astype(np.int64)
        self.member = rows["member"].to_numpy()[order]
        self.component = rows["component"].to_numpy()[order]
        self.bits = _matrix(rows["bits"])[order]
        self.spare = spares(self.n, self.bits)
        at = np.arange(0, len(self.n), INNER)
        self.inner = (
            np.minimum.reduceat(self.n, at), np.maximum.reduceat(self.n, at),
            np.maximum.reduceat(self.spare, at, axis=1), np.bitwise_or.reduceat(self.bits, at, axis=0),
        )


def traverse(a: Side, b: Side, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of two nodes that may link, by descent into both."""
    left, right = [], []
    low_a, high_a, spare_a, bits_a = a.inner
    low_b, high_b, spare_b, bits_b = b.inner
    may = _may_overlap(low_a, spare_a, bits_a, low_b, spare_b, bits_b, percent)
    may &= (100 * high_a[:, None] >= percent * low_b[None, :]) & (100 * high_b[None, :] >= percent * low_a[:, None])
    for i, j in zip(*np.nonzero(may), strict=True):
        x, y = slice(i * INNER, (i + 1) * INNER), slice(j * INNER, (j + 1) * INNER)
        ok = _may_overlap(a.n[x], a.spare[:, x], a.bits[x], b.n[y], b.spare[:, y], b.bits[y], percent)
        ok &= 100 * np.minimum.outer(a.n[x], b.n[y]) >= percent * np.maximum.outer(a.n[x], b.n[y])
        ok &= a.component[x][:, None] != b.component[y][None, :]
        p, q = np.nonzero(ok)
        left.append(a.member[x][p])
        right.append(b.member[y][q])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _node_pairs(na: pa.Array, a: pa.Array, nb: pa.Array, b: pa.Array, sa: pa.Array, sb: pa.Array, percent: int) -> pa.Array:
    out = []
    for m, x, n, y, s, t in zip(na.to_pylist(), a, nb.to_pylist(), b, sa.to_pylist(), sb.to_pylist(), strict=True):
        one = lambda spare: np.array(spare, np.int64)[:, None]
        args = (np.array([m]), one(s), _bits(x.as_buffer())[None], np.array([n]), one(t), _bits(y.as_buffer())[None])
        out.append(bool(_may_overlap(*args, percent)[0, 0]))
    return pa.array(out, pa.bool_())


def _sides(rows: pa.Table) -> tuple[Side, Side, pa.Table, pa.Table]:
    second = rows["second"].to_numpy()
    one, two = rows.filter(pa.array(~second)), rows.filter(pa.array(second))
    a = Side(one)
    return (a, Side(two), one, two) if len(two) else (a, a, one, one)


def _leaf_members(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Members of pairs of nodes (``node`` is here the pair) that may link with one of the other node."""
    for pair, rows in _node_rows(batches):
        a, b, _, two = _sides(rows)
        left, right = traverse(a, b, percent)
        own = len(two) == 0 or a is b
        for second, found in ((False, np.concatenate((left, right)) if own else left), (True, left[:0] if own else right)):
            found = np.unique(found)
            if len(found):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), pair)), pa.array(np.full(len(found), second)), pa.array(found)], names=["node", "second", "member"]
                )


def _leaf_links(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links between the members of a pair of nodes, by exact comparison. Once two components are joined,
    their other members need not be compared."""
    for _, rows in _node_rows(batches):
        a, b, *_ = _sides(rows)
        left, right = traverse(a, b, percent)
        if not len(left):
            continue
        sets = dict(zip(rows["member"].to_pylist(), shingle_sets(pa.concat_arrays(rows["text"].chunks), words), strict=True))
        parent = {c: c for c in rows["component"].to_pylist()}
        component = dict(zip(rows["member"].to_pylist(), rows["component"].to_pylist(), strict=True))

        def root(c: int) -> int:
            while parent[c] != c:  # noqa: B023
                parent[c] = parent[parent[c]]  # noqa: B023
                c = parent[c]  # noqa: B023
            return c

        links = []
        for p, q in zip(left.tolist(), right.tolist(), strict=True):
            x, y = root(component[p]), root(component[q])
            if x == y:
                continue
            n = overlap(sets[p], sets[q])
            if 100 * n >= percent * (len(sets[p]) + len(sets[q]) - n):
                parent[x] = y
                links.append((p, q))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links]), pa.array([x[1] for x in links])], names=["a", "b"])


def tree_links(groups: DataFrame, rows_of: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between members of one group and different components; enough of them to join all
    components that links join.

    ``groups``: centre, member, component, n, bits, key; ``rows_of``: key, text of all documents."""
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(_SIZE_BASE)).cast("int")
    rows = groups.withColumn("class", size_class)
    salts = rows.groupBy("centre", "class").agg(F.ceil(F.count("*") / NODE).alias("salts"))
    rows = rows.join(salts, ["centre", "class"])
    node = F.xxhash64("centre", "class", F.pmod(F.xxhash64("member"), F.col("salts")))
    rows = materialise(rows.withColumn("node", node).drop("salts"), "tree-members")
    kinds = rows.repartition("node").sortWithinPartitions("node")
    nodes = materialise(kinds.mapInArrow(_nodes, _NODE), "tree-nodes")
    side = lambda s: nodes.select(*[F.col(c).alias(f"{c}_{s}") for c in nodes.columns])
    may = F.arrow_udf(lambda m, x, n, y, s, t: _node_pairs(m, x, n, y, s, t, percent), "boolean")
    # Two classes apart, the sizes differ too much.
    near = (F.col("class_b") == F.col("class_a") + 1) | ((F.col("class_b") == F.col("class_a")) & (F.col("node_a") <= F.col("node_b")))
    mixed = F.least("component_low_a", "component_low_b") != F.greatest("component_high_a", "component_high_b")
    sizes = (100 * F.col("high_a") >= percent * F.col("low_b")) & (100 * F.col("high_b") >= percent * F.col("low_a"))
    pairs = (
        side("a").join(side("b"), (F.col("centre_a") == F.col("centre_b")) & near).filter(mixed & sizes)
        .filter(may("low_a", "bits_a", "low_b", "bits_b", "spare_a", "spare_b"))
        .select("node_a", "node_b", F.xxhash64("node_a", "node_b").alias("pair"))
    )
    pairs = materialise(pairs, "tree-pairs")
    first = pairs.select(F.col("node_a").alias("node"), "pair", F.lit(False).alias("second"))
    other = pairs.filter("node_a <> node_b").select(F.col("node_b").alias("node"), "pair", F.lit(True).alias("second"))
    leaves = rows.join(first.union(other), "node").select(F.col("pair").alias("node"), "second", "member", "component", "n", "bits")
    leaves = leaves.repartition("node").sortWithinPartitions("node")
    # Only members with a possible partner are compared, and only their texts are sent.
    chosen = leaves.mapInArrow(lambda b: _leaf_members(b, percent), "node long, second boolean, member long")
    chosen = materialise(chosen, "tree-chosen")
    known = rows.select("member", "component", "n", "bits", "key").dropDuplicates(["member"])
    chosen = materialise(chosen.join(known, "member"), "tree-candidates")
    texts = _texts_of(rows_of, chosen.select("key").distinct())
    sent = chosen.join(texts, "key").select("node", "second", "member", "component", "n", "bits", "text")
    sent = sent.repartition("node").sortWithinPartitions("node")
    return sent.mapInArrow(lambda b: _leaf_links(b, words, percent), "a long, b long").distinct()


def similar(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, key, n_shingles, class_id, component_id, first`` . ``class_id``
    is the same for equal sets, ``component_id`` the smallest id reachable by links; ``first`` is true
    for one row of each component."""
    rows = keyed(docs, id_col, text_col)
    listed = frequent_shingles(rows, words)
    profiles = rows.mapInArrow(lambda b: _profiles(b, words, percent, listed), _PROFILE)
    profiles = materialise(profiles.withColumn("member", F.monotonically_increasing_id()), "jaccard-profiles")
    full = profiles.filter("n > 0")
    classes = full.groupBy("n", "sum_a", "sum_b").agg(F.min("member").alias("class_id"))
    # The first member of a class is the first of every run that holds the class.
    members = full.select("member", "n", "sum_a", "sum_b").join(classes, ["n", "sum_a", "sum_b"])
    members = materialise(members.select("member", "class_id"), "jaccard-classes")
    copies = members.filter("member <> class_id").select("member")

    shared = full.select(F.explode("prefix").alias("hash"), "member")
    stream = materialise(runs.repeated(shared, ["hash"], ["member"], 2, buckets(docs)), "jaccard-runs")
    tied = runs.settled(stream, ["hash"], 2).filter("member <> first_member").select(F.col("first_member").alias("centre"), "member")
    tied = materialise(tied.distinct().join(copies, "member", "left_anti"), "jaccard-tied")
    discard(stream)
    prefixes, profiles = profiles, materialise(profiles.drop("prefix"), "jaccard-shapes")
    discard(prefixes)
    shapes = profiles.filter("n > 0").select("member", "n", "bits", "key")
    pairs = tied.select(F.col("member").alias("a"), F.col("centre").alias("b"))
    links = materialise(_verified(pairs, shapes, rows, words, percent), "jaccard-links")
    found = components(links)

    # Groups whose members are not all in one component yet, and that have a pair not compared so far.
    whole = tied.union(tied.select("centre", F.col("centre").alias("member")).distinct())
    whole = whole.join(found, F.col("member") == F.col("node"), "left")
    whole = whole.select("centre", "member", F.coalesce("component", "member").alias("component"))
    open_ = whole.groupBy("centre").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("k"))
    whole = whole.join(open_.filter("x <> y and k > 2").select("centre"), "centre", "left_semi")
    groups = whole.join(shapes.select("member", "n", "bits", "key"), "member")
    more = materialise(tree_links(groups, rows, words, percent), "jaccard-more-links")
    found = components(links.union(more))

    ids = profiles.select("member", "doc_id", "key", "n").join(members, "member", "left")
    ids = ids.join(found, F.col("class_id") == F.col("node"), "left")
    ids = ids.select("member", "doc_id", "key", "n", F.coalesce("class_id", "member").alias("class_id"), F.coalesce("component", "class_id", "member").alias("root"))
    least = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "member")).alias("chosen"))
    out = ids.join(least, "root")
    return out.select(
        "doc_id", "key", F.col("n").cast("long").alias("n_shingles"), "class_id", "component_id",
        (F.col("member") == F.col("chosen.member")).alias("first"),
    )
