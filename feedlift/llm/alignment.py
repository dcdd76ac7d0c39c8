"""Cross-tokenizer alignment (11): which tokens of two tokenizers cover the same bytes.

Tokenizer A is a byte-level BPE (``tokenizers`` file) over space and text, tokenizer B a SentencePiece BPE with byte
fallback over the text, to which it adds the space itself. Both sequences cover the same bytes, so each token has a
byte range. Batch by batch, ``pandas.merge_asof`` keyed by document finds for the start of each token the token of the
other side that covers it; both directions together give all overlaps. An overlap whose tokens end at the same byte
ends a group, and all tokens of A and B in one group are linked. For every pair of linked ids the documents that hold
it are counted over the whole corpus; a link is best if no other partner of its A id is found in more documents.

1. One pass encodes and aligns the texts and writes, for each document, its figures and its distinct pairs with how
   often each is linked.
2. The pairs are counted. The partners of an id are at most a vocabulary, so the best count of each A id is a small table.
3. Pairs found in the most documents, at most ``HOT`` of them, are sent to all tasks, which add them up where the
   documents are. All others are joined with their counts in a shuffle; none of these is frequent.

Encoding is by runs between spaces: a space between two characters that are not white space starts a token of both
tokenizers (for B because no piece has a space behind another character, which is checked), so runs met before need not
be encoded again. Memory follows a block of texts, or one very long text or run.

Texts that are null or empty, or whose tokens do not give back the bytes (B changes U+2581, for one), have no tokens:
all figures 0 and the digest ''. Repeated rows are documents of their own; a null id is kept. Only id and text are read.
A frame without rows gives none.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlift.session import materialise

#: Characters of texts that are aligned at once; runs of characters that are remembered, and tokens of theirs.
BLOCK, KNOWN, KNOWN_TOKENS = 1 << 20, 1 << 18, 1 << 23
#: Pairs of ids that are sent to every task at most; links of a group that are listed one by one.
HOT, LISTED = 1 << 18, 1 << 12


@dataclass(frozen=True)
class Models:
    """The two tokenizers as they are sent to tasks: bytes of every id of A with the pattern that cuts texts for
    it, and the model of B."""

    pattern: str
    tokens: tuple[bytes, ...]
    pieces: bytes

    @property
    def pairs(self) -> int:
        """Numbers below which all pairs of ids are."""
        return len(self.tokens) * len(self.second.bytes)

    @property
    def second(self) -> Pieces:
        return _pieces(self.pieces)


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the others
    from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b <= 0xFF and b != 0xAD)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def load(byte_level: str, pieces: str, pattern: str) -> Models:
    """Read the files of both tokenizers; only the driver needs them."""
    with open(byte_level, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["id"] for t in model["added_tokens"] if t["special"]}
    alphabet = _byte_alphabet()
    ids = {i: t for t, i in model["model"]["vocab"].items() if i not in special}
    tokens = tuple(bytes(alphabet[c] for c in ids[i]) if i in ids else b"" for i in range(max(ids) + 1))
    with open(pieces, "rb") as f:
        return Models(pattern, tokens, f.read())


class Pieces:
    def __init__(self, model: bytes):
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.encoder.vocab_size()
        names = [self.encoder.id_to_piece(i) for i in range(n)]
        inner = [p for p in names if "▁" in p.lstrip("▁")]
        if inner:
            raise ValueError(f"pieces with a space behind another character: {inner[:3]}")
        self.bytes = [bytes([int(p[3:5], 16)]) if self.encoder.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]


@lru_cache(maxsize=1)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


@lru_cache(maxsize=1)
def _byte_level(pattern: str, tokens: tuple[bytes, ...]):
    import tiktoken

    # The ids of a byte-level vocabulary are in the order of its merges, so they are ranks as well.
    return tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens) if t}, special_tokens={})


class Side:
    """Ids of one tokenizer for the runs met so far, one run after the other."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.runs: list[list[int]] = []

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, self.runs), np.int64, len(self.runs))
        flat = np.fromiter((i for run in self.runs for i in run), np.int64, int(sizes.sum()))
        return flat, np.cumsum(sizes) - sizes, sizes


def _taken(flat: np.ndarray, first: np.ndarray, size: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of these runs, one after the other, and how many each has."""
    n = size[runs]
    to = np.cumsum(n)
    at = np.arange(int(to[-1]) if len(to) else 0) + np.repeat(first[runs] - to + n, n)
    return flat[at], n


#: White space beside a space, or at an end: the text is then cut by the slower rule.
_ODD = re.compile(r" \s|\s | $")
_CUT = re.compile(r"(?<=\S)(?= \S)")


def runs_of(text: str) -> list[str]:
    """What lies between the sure starts of tokens, each without the space that opens it."""
    whole = " " + text
    if _ODD.search(whole):
        return [r[1:] for r in _CUT.split(whole)]
    return text.split(" ")


class Encoder:
    """Ids of A and B for blocks of texts. Runs are remembered up to a bound, then forgotten."""

    def __init__(self, models: Models):
        self.first = _byte_level(models.pattern, models.tokens)
        self.second = models.second
        self.tokens = models.tokens
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3] * 2
        self.ok = np.zeros(0, bool)

    def learn(self, new: list[str]) -> None:
        if len(self.known) + len(new) > KNOWN or max(len(x[0]) for x in self.ids) > KNOWN_TOKENS:
            self.forget()
        encode = self.first._core_bpe.encode_ordinary
        sides = Side(self.tokens), Side(self.second.bytes)
        sides[0].runs = [encode(" " + r) for r in new]
        sides[1].runs = self.second.encoder.encode(new, num_threads=1) if new else []
        ok = []
        for run, a, b in zip(new, sides[0].runs, sides[1].runs, strict=True):
            want = b" " + run.encode()
            ok.append(b"".join(map(sides[0].tokens.__getitem__, a)) == want and b"".join(map(sides[1].tokens.__getitem__, b)) == want)
        self.ok = np.concatenate((self.ok, np.array(ok, bool)))
        for k, side in enumerate(sides):
            flat, first, size = side.arrays()
            old = self.ids[k]
            self.ids[k] = (np.concatenate((old[0], flat)), np.concatenate((old[1], first + len(old[0]))), np.concatenate((old[2], size)))
        self.known |= {r: len(self.known) + i for i, r in enumerate(new)}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Which texts are given back by both; and of these for each side the ids and the text of each id."""
        runs = [runs_of(t) if t else [] for t in texts]
        flat = [r for of in runs for r in of]
        new = [r for r in dict.fromkeys(flat) if r not in self.known]
        if new:
            known = self.known
            self.learn(new)
            if self.known is not known and len(self.known) == len(new):  # all was forgotten: learn what is missing again
                self.learn([r for r in dict.fromkeys(flat) if r not in self.known])
        runs_at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        text = np.repeat(np.arange(len(texts)), [len(of) for of in runs])
        good = np.bincount(text[~self.ok[runs_at]], minlength=len(texts)) == 0
        good &= np.array([bool(t) for t in texts], bool)
        stay = good[text]
        runs_at, text = runs_at[stay], text[stay]
        out = []
        for flat_ids, first, size in self.ids:
            ids, n = _taken(flat_ids, first, size, runs_at)
            out.append((ids, np.repeat(text, n)))
        return good, out


# Alignment of a block of texts


def overlaps(starts: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a token of A and one of B whose byte ranges overlap: for the start of each token the other side's
    token that covers it, in both directions."""
    a, b = (pd.DataFrame({"start": s, "text": t, "token": np.arange(len(s))}) for s, t in zip(starts, texts, strict=True))
    under_a = pd.merge_asof(a[["start", "text"]], b, on="start", by="text")["token"].to_numpy(np.int64)
    under_b = pd.merge_asof(b[["start", "text"]], a, on="start", by="text")["token"].to_numpy(np.int64)
    later = np.flatnonzero(starts[0][under_b] < starts[1])  # equal starts are found by both directions
    return np.concatenate((np.arange(len(under_a)), under_b[later])), np.concatenate((under_a, later))


@dataclass
class Groups:
    """Groups of a block in order: the tokens of either side before each, how many it has, and its text."""

    first: list[np.ndarray]
    size: list[np.ndarray]
    text: np.ndarray


def groups_of(lengths: list[np.ndarray], texts: list[np.ndarray]) -> Groups:
    ends = [np.cumsum(n) for n in lengths]  # both sides have the same bytes in every text
    a, b = overlaps([e - n for e, n in zip(ends, lengths, strict=True)], texts)
    same = ends[0][a] == ends[1][b]
    last = [np.sort(x[same]) for x in (a, b)]
    first = [np.concatenate(([0], x[:-1] + 1)) if len(x) else x for x in last]
    return Groups(first, [x + 1 - f for x, f in zip(last, first, strict=True)], texts[0][last[0]])


def _listing(ids: list[np.ndarray], groups: Groups, tables: tuple[pa.Array, pa.Array], texts: int) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text. The tables hold the ids of a side as texts, each behind one of two marks."""
    before = [np.cumsum(groups.size[1]) - groups.size[1], np.cumsum(groups.size[0])]
    place, entry = [], []
    for side in (0, 1):
        last = np.zeros(len(ids[side]), bool)
        last[groups.first[side] + groups.size[side] - 1] = True
        place.append(np.arange(len(ids[side])) + np.repeat(before[side], groups.size[side]))
        entry.append(2 * ids[side] + last + (len(tables[0]) if side else 0))
    order = np.empty(len(place[0]) + len(place[1]), np.int64)
    for p, e in zip(place, entry, strict=True):
        order[p] = e
    written = pa.concat_arrays(tables).take(pa.array(order))
    bounds = np.frombuffer(written.buffers()[1], np.int64)[: len(order) + 1]
    whole = memoryview(written.buffers()[2]) if len(order) else memoryview(b"")
    counts = np.bincount(groups.text, groups.size[0] + groups.size[1], texts).astype(np.int64)
    to = bounds[np.cumsum(counts)]
    at = bounds[np.cumsum(counts) - counts]
    return [bytes(whole[s : e - 1]) if e > s else b"" for s, e in zip(at.tolist(), to.tolist(), strict=True)]


def _table(n: int, inner: str, last: str) -> pa.Array:
    return pa.array([f"{i}{mark}" for i in range(n) for mark in (inner, last)], pa.large_string())


def linked_pairs(ids: list[np.ndarray], groups: Groups, width: int, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ``text * pairs + a * width + b`` of all links without repetition, and how many links each stands for."""
    k, n = groups.size
    keys, times = [], []
    many = k * n > LISTED
    some = np.flatnonzero(~many)
    links = (k * n)[some]
    to = np.cumsum(links)
    r = np.arange(int(to[-1]) if len(to) else 0) - np.repeat(to - links, links)
    wide = np.repeat(n[some], links)
    a = ids[0][np.repeat(groups.first[0][some], links) + r // wide] if len(r) else r
    b = ids[1][np.repeat(groups.first[1][some], links) + r % wide] if len(r) else r
    keys.append(np.repeat(groups.text[some], links) * pairs + a * width + b)
    times.append(np.ones(len(r), np.int64))
    for g in np.flatnonzero(many):  # distinct ids first
        (x, m), (y, o) = (np.unique(ids[s][groups.first[s][g] :][: groups.size[s][g]], return_counts=True) for s in (0, 1))
        keys.append((groups.text[g] * pairs + x[:, None] * width + y[None, :]).ravel())
        times.append(np.multiply.outer(m, o).ravel())
    key = np.concatenate(keys)
    if not many.any():
        return np.unique(key, return_counts=True)
    order = np.argsort(key, kind="stable")
    key, n_links = key[order], np.concatenate(times)[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(n_links, first)


def _blocks(texts: list[str | None]) -> Iterator[slice]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t or "") > BLOCK:
            yield slice(start, i)
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield slice(start, len(texts))


def _aligned(batches: Iterator[pa.RecordBatch], models: Models, listed: bool) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(models)
    width, pairs = len(models.second.bytes), models.pairs
    lengths = [Side(list(models.tokens)).length, Side(models.second.bytes).length]
    tables = _table(len(models.tokens), ",", "|"), _table(width, ",", ";")
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for part in _blocks(texts):
            some = texts[part]
            n = len(some)
            _, sides = encoder.encode(some)
            ids, text = [s[0] for s in sides], [s[1] for s in sides]
            groups = groups_of([x[i] for x, i in zip(lengths, ids, strict=True)], text)
            written = _listing(ids, groups, tables, n)
            key, times = linked_pairs(ids, groups, width, pairs)
            cuts = np.searchsorted(key, np.arange(n + 1) * pairs)
            per_text = lambda of, weights=None: pa.array(np.bincount(of, weights, n).astype(np.int64))  # noqa: B023, E731
            links = np.zeros(n, np.int64)
            np.add.at(links, groups.text, groups.size[0] * groups.size[1])
            offsets = pa.array(cuts.astype(np.int32))
            columns = {
                "doc_id": batch.column("doc_id")[part],
                "n_a": per_text(text[0]), "n_b": per_text(text[1]), "n_groups": per_text(groups.text), "n_links": pa.array(links),
                "groups_sha256": pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in written]),
                "pairs": pa.ListArray.from_arrays(offsets, pa.array(key % pairs)),
                "times": pa.ListArray.from_arrays(offsets, pa.array(times)),
            }
            if listed:
                columns["groups"] = pa.array([g.decode() for g in written])
            yield pa.RecordBatch.from_pydict(columns)


# Counts over the corpus


def _sent(models: Models, spark: SparkSession) -> Broadcast:
    return spark.sparkContext.broadcast(models)  # two vocabularies


def aligned(docs: DataFrame, models: Models, *, listed: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times`` of each document, and with ``listed`` the ``groups`` as
    ``a1,a2|b1;a3|b2,b3``. ``pairs`` are ``a * (ids of B) + b``, each once; ``times`` the links of each."""
    sent = _sent(models, docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    return rows.mapInArrow(lambda b: _aligned(b, sent.value, listed), kind + ", groups string" * listed)


def pair_counts(rows: DataFrame, models: Models) -> DataFrame:
    """``pair, n, best``: in how many documents ids are linked, and whether no partner of the A id is found in more."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = materialise(counts, "alignment-counts")
    first = F.expr(f"pair div {len(models.second.bytes)}")
    highest = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))  # a row for each id of A at most
    return counts.join(F.broadcast(highest), first == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _hot(counts: DataFrame) -> tuple[int, pa.Table]:
    """The least power of two that at most ``HOT`` pairs reach, and these pairs."""
    power = F.floor(F.log2("n")).cast("int")
    sizes = {r["power"]: r["pairs"] for r in counts.groupBy(power.alias("power")).agg(F.count("*").alias("pairs")).collect()}
    least, held = 63, 0
    for p in range(62, -1, -1):
        held += sizes.get(p, 0)
        if held > HOT:
            break
        least = p
    return 1 << least, counts.filter(F.col("n") >= (1 << least)).toArrow().sort_by("pair")


def _summed(batches: Iterator[pa.RecordBatch], hot: tuple[np.ndarray, np.ndarray, np.ndarray], rest: bool) -> Iterator[pa.RecordBatch]:
    """Per document the sums over its frequent pairs; or, with ``rest``, its other pairs."""
    pair, n, best = hot
    for batch in batches:
        mine, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
        row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("pairs").offsets.to_numpy()))
        at = np.minimum(np.searchsorted(pair, mine), max(0, len(pair) - 1))
        found = pair[at] == mine if len(pair) else np.zeros(len(mine), bool)
        place = batch.column("place").to_numpy()
        if rest:
            out = {"place": place[row[~found]], "pair": mine[~found], "times": times[~found]}
        else:
            row, at, times = row[found], at[found], times[found]
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], row, times * best[at])
            np.add.at(sums[1], row, times * n[at])
            out = {"place": place, "n_best": sums[0], "count_sum": sums[1]}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})


def alignment(docs: DataFrame, models: Models, *, listed: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` (and ``groups`` with ``listed``).
    ``n_best`` counts the links whose pair is the most frequent of its A id, ties included; ``count_sum`` adds up over
    all links the number of documents that hold the pair."""
    rows = aligned(docs, models, listed=listed, id_col=id_col, text_col=text_col)
    rows = materialise(rows.withColumn("place", F.monotonically_increasing_id()), "alignment")
    counts = pair_counts(rows, models)
    least, hot = _hot(counts)
    sent = docs.sparkSession.sparkContext.broadcast(tuple(hot[c].to_numpy() for c in ("pair", "n", "best")))
    links = rows.select("place", "pairs", "times")
    near = links.mapInArrow(lambda b: _summed(b, sent.value, False), "place long, n_best long, count_sum long")
    far = links.mapInArrow(lambda b: _summed(b, sent.value, True), "place long, pair long, times long")
    rare = far.join(counts.filter(F.col("n") < least), "pair")
    rare = rare.select("place", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    sums = near.union(rare).groupBy("place").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + ["groups"] * listed
    return rows.drop("pairs", "times").join(sums, "place").select(*names)
