"""Quality rules (7): an isolation forest on rule statistics.

:data:`statistics` gives the rule statistics of a whole text: words, symbols, repeated lines,
repeated three-word windows and a few shares. :func:`fit` grows random trees on them: each node
splits the box it covers at a random place of a random statistic, until a box holds at most one
good row; statistics that alone tell labelled rows apart well are drawn more often. Documents in boxes that end early are anomalies. Boxes span the values of all labelled
rows, good or bad, so a region that only bad rows reach ends early too. The threshold on the score
is chosen on labelled rows: the number of good rows lost, weighted, plus bad rows kept is least.

Training reads all labelled rows: the ends of the boxes, how well each statistic tells rows apart and the threshold are
exact over all of them, from counts by value in ranges, so none is held whole. A tree of an isolation forest grows on a few
rows of its own by its definition, :data:`ROWS_PER_TREE` here; they are drawn from all good rows while there are no more than
all trees together take, else from as many documents, picked by hash. All documents are scored. Labels repeated for an id count as bad if one of them is bad; labels
without id or quality are not used. Without good labelled rows only the base rules decide.

Null or empty text has no words and fails the base rules. Rows are judged one by one, so repeated
rows and ties get equal verdicts; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlift.llm import arrays
from feedlift.llm.bitmap import bitmap_of, possible
from feedlift.llm.frames import apart, buckets, row_key
from feedlift.session import materialise, scratch

SYMBOLS = "#*$%&|<>"  # fixed: the characters counted as symbols
MIN_WORDS, MAX_REPEATED = 50, 50  # fixed: words at least; per cent of words in repeated windows at most
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits")
FEATURES = ("symbols", "marks", "upper", "digits", "repeats", "dup_lines", "word_length")
_STATS = "_rule_statistics"
TREES, ROWS_PER_TREE, GOOD_LOSS_WEIGHT = 200, 256, 50

_CLASS = np.zeros((4, 256), np.uint8)
_CLASS[0, list(SYMBOLS.encode())] = 1
_CLASS[1, list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_CLASS[2, list(b"!?;:(){}[]/\\=_~^@")] = 1
_CLASS[3, list(b"0123456789")] = 1


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeat_words(w: arrays.Words) -> np.ndarray:
    """Words of each text covered by three-word windows found twice or more in it."""
    n_docs = len(w.first) - 1
    at = arrays.inside(w.first, 3)
    if not len(at):
        return np.zeros(n_docs, np.int64)
    doc = w.doc()[at]
    # The same window in another text is another window.
    h = arrays.mix(arrays.windows(w.hash, 3)[at] + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(w.hash) + 1, bool)
    for j in range(3):
        covered[at[twice] + j] = True
    return _sums(covered[:-1], w.first)


def _line_counts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines of each text, and lines with a word that equal an earlier one of the text."""
    dup, lines = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    data = raw.tobytes()
    for d in range(len(dup)):
        parts = data[offsets[d] : offsets[d + 1]].split(b"\n")
        lines[d] = len(parts)
        distinct = set(parts)
        if len(distinct) < len(parts):
            dup[d] = sum(1 for p in parts if p.split()) - sum(1 for p in distinct if p.split())
    return lines, dup


def counts_of(column: pa.Array) -> dict[str, np.ndarray]:
    found: dict[str, list[np.ndarray]] = {n: [] for n in COUNTS}
    for _, _, raw, offsets in arrays.blocks(column):
        w = arrays.words(raw, offsets)
        # Code points are the bytes that do not go on a sequence.
        points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        chars = np.concatenate(([0], np.cumsum(points[w.end] - points[w.start])))
        lines, dup = _line_counts(raw, offsets)
        values = (
            np.diff(w.first),
            chars[w.first[1:]] - chars[w.first[:-1]],
            _sums(_CLASS[0][raw], offsets),
            dup,
            _repeat_words(w),
            lines,
            *(_sums(_CLASS[k][raw], offsets) for k in (1, 2, 3)),
        )
        for name, v in zip(COUNTS, values, strict=True):
            found[name].append(v.astype(np.int64))
    return {n: np.concatenate(v) if v else np.zeros(0, np.int64) for n, v in found.items()}


def _statistics(text: pa.Array) -> pa.Array:
    values = counts_of(text)
    return pa.StructArray.from_arrays([pa.array(values[n]) for n in COUNTS], names=list(COUNTS))


_KIND = "struct<" + ",".join(f"{n}:long" for n in COUNTS) + ">"


def statistics(text: Column | str) -> Column:
    """The rule statistics of a text as a struct of counts."""
    return F.arrow_udf(_statistics, _KIND)(text)


def base_failed(stats: str = "stats") -> Column:
    few = F.col(f"{stats}.n_words") < MIN_WORDS
    return few | (100 * F.col(f"{stats}.n_repeat_words") > MAX_REPEATED * F.col(f"{stats}.n_words"))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """The statistics the trees split on, each between 0 and about 1, a row for each text."""
    c = {n: v.astype(float) for n, v in counts.items()}
    chars, words, lines = (np.maximum(c[n], 1.0) for n in ("word_chars", "n_words", "n_lines"))
    values = {
        "symbols": c["n_symbols"] / chars,
        "marks": c["n_marks"] / chars,
        "upper": c["n_upper"] / chars,
        "digits": c["n_digits"] / chars,
        "repeats": c["n_repeat_words"] / words,
        "dup_lines": c["n_dup_lines"] / lines,
        "word_length": np.minimum(chars / words / 20, 1.0),
    }
    return np.stack([values[n] for n in FEATURES], axis=1)


def _split_values(text: pa.Array) -> pa.Array:
    """What the base rules need, and the statistics the trees split on as an array ``x``."""
    counts = counts_of(text)
    x = features(counts)
    x = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32), x.ravel())
    return pa.StructArray.from_arrays([pa.array(counts["n_words"]), pa.array(counts["n_repeat_words"]), x], names=["n_words", "n_repeat_words", "x"])


_SPLIT_KIND = "struct<n_words:long,n_repeat_words:long,x:array<double>>"


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays: ``feature`` is -1 at a leaf, where ``value`` is the path length."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: np.ndarray
    norm: float
    threshold: float = np.inf

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the shorter the paths, the higher."""
        depth = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                f = self.feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                low = x[rows, np.maximum(f, 0)] < self.value[node]
                node = np.where(inner, np.where(low, self.left[node], self.right[node]), node)
            depth += self.value[node]
        return 2.0 ** (-depth / len(self.roots) / self.norm)


def _mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    return 0.0 if n < 2 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def grow(
    good: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int, rows: int, weights: np.ndarray | None = None, seed: int = 7
) -> Forest:
    rng = np.random.default_rng(seed)
    weights = np.ones(good.shape[1]) if weights is None else weights
    feature, value, left, right, roots = [], [], [], [], []
    limit = int(np.ceil(np.log2(max(2, min(rows, len(good)))))) + 4

    def build(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> int:
        me = len(feature)
        feature.append(-1)
        value.append(depth + _mean_path(len(x)))
        left.append(me)
        right.append(me)
        wide = np.flatnonzero(hi > lo)
        if len(x) <= 1 or depth >= limit or not len(wide):
            return me
        f = int(rng.choice(wide, p=weights[wide] / weights[wide].sum()))
        at = float(rng.uniform(lo[f], hi[f]))
        below = x[:, f] < at
        hi_left, lo_right = hi.copy(), lo.copy()
        hi_left[f] = lo_right[f] = at
        feature[me], value[me] = f, at
        left[me] = build(x[below], lo, hi_left, depth + 1)
        right[me] = build(x[~below], lo_right, hi, depth + 1)
        return me

    for _ in range(trees):
        picked = good[rng.permutation(len(good))[:rows]]
        roots.append(build(picked, low, high, 0))
    norm = max(_mean_path(min(rows, len(good))), 1.0)
    return Forest(*map(np.array, (feature, value, left, right, roots)), norm)


def _labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, quality, x, copies`` of all labelled documents that pass the base rules: the statistics the trees split on,
    and how many rows are this document. Texts are not shuffled."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    told = told.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = F.xxhash64("doc_id")
    some = texts.filter("doc_id is not null").filter(possible(bitmap_of(told.select(hashed.alias("key")), "key"), hashed))
    rows = some.select("doc_id", row_key().alias("key"), F.arrow_udf(_split_values, _SPLIT_KIND)("text").alias("stats"))
    rows = rows.filter(~base_failed()).groupBy("doc_id", "key").agg(F.first("stats.x").alias("x"), F.count("*").alias("copies"))
    return rows.join(told, "doc_id").select("key", "quality", "x", "copies")


def _by_value(rows: DataFrame, order: list[str], good: Column) -> DataFrame:
    """How many good (``g``) and bad (``b``) rows have each value, dealt out by ranges of the values and in their order."""
    n = F.col("copies")
    counts = rows.groupBy(*order).agg(F.sum(F.when(good, n).otherwise(0)).alias("g"), F.sum(F.when(good, 0).otherwise(n)).alias("b"))
    return counts.repartitionByRange(buckets(rows), *order).sortWithinPartitions(*order)


def _stored(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray] | None:
    """The rows of a partition as arrays."""
    held = [b for b in batches if b.num_rows]
    return {n: np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in held]) for n in held[0].schema.names} if held else None


def _rank_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each statistic of a range, its first value here, its good rows and all rows, and the sum of the good rows' mean
    ranks among those here."""
    if (c := _stored(batches)) is None:
        return
    for f in np.unique(c["feature"]):
        own = c["feature"] == f
        g, n = c["g"][own], c["g"][own] + c["b"][own]
        ranks = np.cumsum(n) - (n - 1) / 2
        values = (int(f), float(c["value"][own][0]), int(g.sum()), int(n.sum()), float((g * ranks).sum()))
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["feature", "first", "g", "n", "ranks"])


def _separations(rows: DataFrame) -> np.ndarray:
    """For each statistic, how well it alone parts good rows from bad ones (0 to 1); never quite 0. From the area under
    the curve, ties counted half, by the mean ranks of the good rows. A row for each statistic and range comes to the driver."""
    values = rows.select((F.col("quality") > 0).alias("good"), "copies", F.posexplode("x").alias("feature", "value"))
    parts = _by_value(values, ["feature", "value"], F.col("good")).mapInArrow(_rank_parts, "feature long, first double, g long, n long, ranks double")
    out = np.ones(len(FEATURES))
    for f, own in parts.toPandas().sort_values("first").groupby("feature"):
        g, n = own.g.to_numpy(), own.n.to_numpy()
        below = np.cumsum(n) - n
        if g.sum() < n.sum():
            total = g.sum()
            area = (float((own.ranks.to_numpy() + g * below).sum()) - total * (total + 1) / 2) / (total * (n.sum() - total))
            out[f] = max(0.01, abs(2 * area - 1))
    return out


def _cut_parts(batches: Iterator[pa.RecordBatch], weight: float) -> Iterator[pa.RecordBatch]:
    """For a range of scores, the highest first: what its rows cost if all of them are cut off, and its best place to cut."""
    if (c := _stored(batches)) is None:
        return
    s, cost = -c["down"], np.cumsum(weight * c["g"] - c["b"])
    k = int(np.argmin(cost))
    values = (float(s[0]), float(s[-1]), float(cost[-1]), float(cost[k]), float(s[k]), float(s[k + 1]) if k + 1 < len(s) else None)
    yield pa.RecordBatch.from_arrays([pa.array([v], pa.float64()) for v in values], names=["first", "last", "cost", "best", "above", "below"])


def calibrated(forest: Forest, rows: DataFrame, weight: float = GOOD_LOSS_WEIGHT) -> Forest:
    """The threshold, midway between two scores, that makes ``weight`` * good rows lost + bad rows kept least over all
    labelled rows. A row for each range of scores comes to the driver."""
    score = F.arrow_udf(lambda x: pa.array(forest.scores(np.array(x.flatten()).reshape(-1, len(FEATURES)))), "double")
    scored = rows.select((F.col("quality") > 0).alias("good"), "copies", (-score("x")).alias("down"))
    kind = ", ".join(f"{n} double" for n in ("first", "last", "cost", "best", "above", "below"))
    parts = _by_value(scored, ["down"], F.col("good")).mapInArrow(lambda b: _cut_parts(b, weight), kind)
    parts = parts.toPandas().sort_values("first", ascending=False).reset_index(drop=True)
    threshold, least, before = np.inf, 0.0, 0.0
    for i, p in parts.iterrows():
        if before + p.best < least:
            least = before + p.best
            below = p.below if p.below == p.below else parts["first"][i + 1] if i + 1 < len(parts) else None
            threshold = p.above - 1e-9 if below is None else (p.above + below) / 2
        before += p.cost
    return Forest(**{**forest.__dict__, "threshold": float(threshold)})


def fit(docs: DataFrame, labels: DataFrame, tree_rows: int = TREES * ROWS_PER_TREE) -> Forest | None:
    """A forest from all labelled documents; None without a good one. ``tree_rows``: good rows that the trees draw theirs
    from, picked by hash if there are more."""
    with scratch(docs.sparkSession):
        rows = materialise(_labelled_rows(docs, labels), "labelled")
        good = rows.filter("quality > 0")
        ends = [f(F.get("x", F.lit(i))) for f in (F.min, F.max) for i in range(len(FEATURES))]
        n, documents = good.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count("*")).first()
        if not n:
            return None
        low, high = np.array(rows.agg(*ends).first(), float).reshape(2, -1)
        if n > tree_rows:
            # Each document once; a little more than enough, of which the first by hash stay.
            share = min(1.0, (1.1 * tree_rows + 100) / documents)
            good = good.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))).withColumn("copies", F.lit(1))
        drawn = good.select(F.xxhash64("key").alias("place"), "quality", "x", "copies").toPandas()
        drawn = drawn.sort_values("place", kind="stable")[:tree_rows] if n > tree_rows else drawn
        if not len(drawn):
            return None
        drawn = drawn.loc[drawn.index.repeat(drawn.copies)]
        x = np.array(drawn.x.tolist(), float)
        x = x[np.lexsort((*x.T, drawn.quality))]  # the same forest whatever order the rows come in
        forest = grow(x, low, high, TREES, ROWS_PER_TREE, _separations(rows) ** 2)
        return calibrated(forest, rows)


def _judged(text: pa.Array, forest: Forest | None) -> pa.Array:
    counts = counts_of(text)
    x = features(counts)
    parts = [np.zeros(0)]
    for i in range(0, len(x), 4096):
        parts.append(np.zeros(len(x[i : i + 4096])) if forest is None else forest.scores(x[i : i + 4096]))
    columns = [*(pa.array(counts[n]) for n in COUNTS), pa.array(np.concatenate(parts))]
    return pa.StructArray.from_arrays(columns, names=[*COUNTS, "anomaly"])


def judged(docs: DataFrame, forest: Forest | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``stats`` (the counts and the score ``anomaly``), ``base_failed`` and ``kept``. A column of ``docs`` with
    one of these names becomes ``input_`` and its name."""
    kind = f"{_KIND[:-1]},anomaly:double>"
    stats = F.arrow_udf(lambda text: _judged(text, forest), kind)(F.col(text_col).cast("string"))
    names = ("stats", "base_failed", "kept")
    free = apart(docs.withColumn(_STATS, stats), *names)
    rows = free.withColumnRenamed(_STATS, "stats").withColumn("base_failed", base_failed())
    threshold = float("inf") if forest is None else forest.threshold
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("stats.anomaly") < F.lit(threshold)))
