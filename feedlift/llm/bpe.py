"""Byte-level BPE (3): merges compiled into a lazily determinised transducer; streaming decode.

Which tokens may follow each other decides everything: a byte string has exactly one split into
tokens in which every neighbouring pair would stay apart if merged on its own, and that split is
the one the merges give. A pair stays apart unless some token at the right edge of the first and
some at the left edge of the second merge before the edge tokens are themselves merged away
(:meth:`Merges.apart`).

The transducer reads a piece byte by byte. Its nondeterministic states are open tokens: the token
before, and a place in the trie of the vocabulary. A deterministic state is the set of all open
tokens with the output each still owes; output shared by all is emitted at once, so a token comes
out as soon as no later byte can change it, at most one token length late. States and steps are
made when first needed and kept up to a bound; beyond it the tables start afresh, which changes
the speed, never the result.

Decoding joins the bytes of ids and gives text through an incremental UTF-8 decoder, which holds
back a sequence that is not complete yet; bytes that are no UTF-8 become U+FFFD.

Null or empty text has no tokens. Rows are encoded one by one; columns other than the text are not
read. Long texts are cut where a piece is sure to end, so memory follows the slice.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_ASCII = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}
_NEVER = 1 << 40  # later than every merge
SLICE = 1 << 20
MAX_STEPS, MAX_PIECES, MAX_PAIRS = 500_000, 250_000, 150_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes, space, rank, line by line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}


class Merges:
    """The vocabulary as merges: each token's two parts, and which tokens stay apart."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._edges: dict[int, tuple[tuple, tuple]] = {}
        self._apart: dict[int, bool] = {}  # by both tokens in one number

    def merged(self, data: bytes, below: int = _NEVER) -> list[bytes]:
        """Plain merging, lowest rank first, leftmost of equals, with ranks under ``below``."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edges(self, token: int) -> tuple[tuple, tuple]:
        """Tokens that stand at the left and at the right edge while ``token`` is being merged, each with
        the rank of the merge that ends it."""
        known = self._edges.get(token)
        if known is None:
            left, right = [], []
            for side, out in ((0, left), (-1, right)):
                now, until = self.bytes_of[token], _NEVER
                while True:
                    out.append((now, until))
                    if len(now) == 1:
                        break
                    until = self.ranks[now]
                    parts = self.merged(now, until)
                    if len(parts) < 2:  # not made by merges
                        break
                    now = parts[side]
            known = self._edges[token] = (tuple(left), tuple(right))
        return known

    def apart(self, a: int, b: int) -> bool:
        """True if merging the bytes of both tokens together gives these two tokens again."""
        known = self._apart.get(a << 24 | b)
        if known is None:
            ranks, known = self.ranks, True
            for x, x_until in self.edges(a)[1]:
                for y, y_until in self.edges(b)[0]:
                    rank = ranks.get(x + y, _NEVER)
                    # Of equal ranks the left merge comes first.
                    if rank < x_until and rank <= y_until and rank < _NEVER:
                        known = False
                        break
                if not known:
                    break
            if len(self._apart) >= MAX_PAIRS:
                self._apart.clear()
            self._apart[a << 24 | b] = known
        return known


class Transducer:
    """Encoder of one piece.

    A state is one flat tuple of numbers: for each open token the token before, its place in the trie, how
    many tokens it owes, and these. The first one is the split that ends here. ``steps[state + byte]`` is the next state
    and, in the bits above, which of the ``emits`` comes out; states are numbered in steps of 256."""

    START = (-1, 0, 0)
    _NEXT = (1 << 40) - 1

    def __init__(self, merges: Merges):
        self.merges = merges
        self._trie: dict[int, int] = {}  # by place * 256 + byte
        token_at, inner = array("i", [-1]), bytearray(1)
        for token, rank in merges.ranks.items():
            at = 0
            for byte in token:
                to = self._trie.get(at << 8 | byte)
                if to is None:
                    to = self._trie[at << 8 | byte] = len(token_at)
                    token_at.append(-1)
                    inner.append(0)
                inner[at] = 1
                at = to
            token_at[at] = rank
        self._token, self._inner = token_at, inner  # at a place: its token, and whether longer ones go on
        self._reset()

    def _reset(self) -> None:
        self._ids = {self.START: 0}
        self._states = [self.START]
        self._steps: dict[int, int] = {}
        self._emits: list[tuple[int, ...]] = [()]
        self._emit_ids: dict[tuple[int, ...], int] = {(): 0}

    def _owed(self, state: int) -> tuple[int, ...]:
        """What is left to come out if the piece ends here."""
        key = self._states[state >> 8]
        return key[3 : 3 + key[2]]

    def _make(self, state: int, byte: int) -> int:
        key, at, size = self._states[state >> 8], 0, 0
        done, open_tokens = None, []
        while size < len(key):
            before, place, at = key[size], key[size + 1], size + 3
            size = at + key[size + 2]
            to = self._trie.get(place << 8 | byte)
            if to is None:
                continue
            owed = key[at:size]
            if done is None and (token := self._token[to]) >= 0 and (before < 0 or self.merges.apart(before, token)):
                done = (token, 0, (*owed, token))
            if self._inner[to]:
                open_tokens.append((before, to, owed))
        shared, certain = 0, done[2]
        if not open_tokens:
            shared = len(certain)
        else:
            most = min(len(x[2]) for x in open_tokens)
            while shared < most and all(x[2][shared] == certain[shared] for x in open_tokens):
                shared += 1
        new = [done[0], 0, len(certain) - shared, *certain[shared:]]
        for before, place, owed in open_tokens:
            new += (before, place, len(owed) - shared, *owed[shared:])
        made = tuple(new)
        to = self._ids.get(made)
        if to is None:
            to = self._ids[made] = len(self._states) << 8
            self._states.append(made)
        emitted = certain[:shared]
        out = self._emit_ids.get(emitted)
        if out is None:
            out = self._emit_ids[emitted] = len(self._emits)
            self._emits.append(emitted)
        step = self._steps[state + byte] = to | out << 40
        return step

    def emit(self, piece: bytes) -> Iterator[tuple]:
        """Tokens of the piece in the portions in which they become certain."""
        state = 0
        for byte in piece:
            step = self._steps.get(state + byte)
            step = self._make(state, byte) if step is None else step
            state = step & self._NEXT
            yield self._emits[step >> 40]
        yield self._owed(state)

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.merges.ranks.get(piece)  # a token is never cut, made by merges or not
        if whole is not None:
            return (whole,)
        if len(self._steps) > MAX_STEPS:
            self._reset()
        steps, emits, below, state, out = self._steps, self._emits, self._NEXT, 0, []
        for byte in piece:  # emit(), in one go
            step = steps.get(state + byte)
            if step is None:
                step = self._make(state, byte)
            if step > below:
                out += emits[step >> 40]
                state = step & below
            else:
                state = step
        key = self._states[state >> 8]
        return (*out, *key[3 : 3 + key[2]])


def ascii_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for texts of ASCII only, in the faster engine of the standard library; None if it has
    properties other than letters and numbers."""
    out, at, inside = [], 0, False
    while at < len(pattern):
        name = next((n for n in _ASCII if pattern.startswith(n, at)), None)
        if name is not None:
            out.append(_ASCII[name] if inside else f"[{_ASCII[name]}]")
            at += len(name)
            continue
        size = 2 if pattern[at] == "\\" else 1
        if pattern[at : at + 2] in ("\\p", "\\P"):
            return None
        inside = pattern[at] == "[" or (inside and pattern[at] != "]")
        out.append(pattern[at : at + size])
        at += size
    return re.compile("".join(out), re.ASCII)


class Codec(dict):
    """Text to ids and back. As a dictionary it keeps the ids of pieces seen, up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.transducer = Transducer(Merges(ranks))
        self.bytes_of = self.transducer.merges.bytes_of
        self._older: dict[str, tuple[int, ...]] = {}
        self.digits = {i: str(i) for i in self.bytes_of}
        self._pieces = regex.compile(pattern)
        self._ascii = ascii_pattern(pattern) or self._pieces
        self._cut = regex.compile(r"(?<=\S) (?=\p{L})")

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self._older.get(piece) or self.transducer.encode(piece.encode())
        if len(piece) <= 64:
            if len(self) >= MAX_PIECES:  # pieces not met again until the next time are forgotten
                self._older = self.copy()
                self.clear()
            self[piece] = ids
        return ids

    def slices(self, text: str, size: int = SLICE) -> Iterator[str]:
        """The text in parts that end where a piece ends: before a single space between a character
        that is no space and a letter."""
        at = 0
        while len(text) - at > size:
            cut = self._cut.search(text, at + size)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids, slice by slice."""
        for part in self.slices(text):
            pieces = (self._ascii if part.isascii() else self._pieces).findall(part)
            yield list(chain.from_iterable(map(self.__getitem__, pieces)))

    def decode(self, parts: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of ids that come in parts; a part may end within a character."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in parts:
            yield machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)))
        yield machine.decode(b"", final=True)


def codec(raw: bytes, pattern: str) -> Codec:
    return Codec(read_ranks(raw), pattern)


class Tokenizer:
    """A rank file and its pattern, for columns. The file is read once, on the driver, and broadcast:
    it is a vocabulary of fixed size."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            raw = f.read()
        self._raw = spark.sparkContext.broadcast(raw)
        self._pattern = pattern

    def _column(self, f, kind: str, column: Column | str) -> Column:
        raw, pattern = self._raw, self._pattern

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = codec(raw.value, pattern)  # its tables go when the task ends: workers live on
            for values in batches:
                yield f(own, values)

        return F.arrow_udf(run, kind)(column)

    def ids(self, text: Column | str) -> Column:
        """array<int>; of null an empty one."""
        return self._column(_ids, "array<int>", text)

    def text(self, ids: Column | str) -> Column:
        """The text of an array of ids; of null null."""
        return self._column(_text, "string", ids)

    def digests(self, text: Column | str) -> Column:
        """struct of ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``."""
        return self._column(_digests, "struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>", text)


def _ids(c: Codec, texts: pa.Array) -> pa.Array:
    return pa.array([list(chain.from_iterable(c.encode(t.as_py() or ""))) for t in texts], pa.list_(pa.int32()))


def _text(c: Codec, ids: pa.Array) -> pa.Array:
    return pa.array([None if v.as_py() is None else "".join(c.decode([v.as_py()])) for v in ids], pa.string())


def _digests(c: Codec, texts: pa.Array) -> pa.Array:
    counts, id_digests, text_digests = [], [], []
    for t in texts:
        ids_sha, text_sha, n = hashlib.sha256(), hashlib.sha256(), 0

        def told(parts: Iterator[list[int]]) -> Iterator[list[int]]:
            nonlocal n
            for ids in parts:
                if ids:
                    ids_sha.update((" " * (n > 0) + " ".join(map(c.digits.__getitem__, ids))).encode())
                    n += len(ids)
                yield ids

        for decoded in c.decode(told(c.encode(t.as_py() or ""))):
            text_sha.update(decoded.encode())
        counts.append(n)
        id_digests.append(ids_sha.hexdigest())
        text_digests.append(text_sha.hexdigest())
    return pa.StructArray.from_arrays(
        [pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())],
        names=["n_tokens", "ids_sha256", "decoded_sha256"],
    )
