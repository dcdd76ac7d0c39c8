from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from feedlift.llm import alignment
from feedlift.llm.queries import QUERIES
from tests.llm.conftest import ODD

FILES = [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def models():
    return alignment.load(*FILES, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def _byte_level():
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def tokens(text, libraries):
    """(id, bytes) of both sides by the libraries, whole texts at once; two empty lists where the bytes differ."""
    if not text:
        return [], []
    first, second = libraries
    alphabet = _byte_level()
    e = first.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(alphabet[c] for c in first.id_to_token(i))) for i in e.ids]
    piece = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
    b = [(i, piece(i)) for i in second.encode(text)]
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def _cut(side, ends):
    out, at, group = [], 0, []
    for i, raw in side:
        at += len(raw)
        group.append(i)
        if at in ends:
            out.append(group)
            group = []
    return out


def _ends(side):
    at, out = 0, set()
    for _, raw in side:
        at += len(raw)
        out.add(at)
    return out


def brute(rows, libraries):
    groups = []
    for _, text in rows:
        a, b = tokens(text, libraries)
        ends = _ends(a) & _ends(b)
        groups.append(list(zip(_cut(a, ends), _cut(b, ends), strict=True)))
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    held = Counter(p for c in links for p in c)
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    out = Counter()
    for (i, _), g, c in zip(rows, groups, links, strict=True):
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        best = sum(n for p, n in c.items() if held[p] == most[p[0]])
        total = sum(n * held[p] for p, n in c.items())
        sha = hashlib.sha256(written.encode()).hexdigest() if g else ""
        out[i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), best, total, sha] += 1
    return out


def got(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_query_against_brute_force(spark, table, libraries):
    folder, rows = table
    assert got(QUERIES["op11_tokenizer_alignment"](spark, folder)) == brute(rows, libraries)


PARTS = ["the", " ", "  ", "\n", "\t", " \n ", "日本語", "テスト。", "naïve", "Übergröße", "　", "\xa0", "\x1c", "\x85", "é", "ﬁ", "１２", "<s>", "</s>",
         "<|endoftext|>", "<0x41>", "'s", "'", "12345", "!!", "​", "🙂", "👩‍👩‍👧", "x" * 70, "\x00", "؟", "مرحبا", "don't", "-", "_"]


def test_random_texts(docs, models, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 200)
    monkeypatch.setattr(alignment, "KNOWN", 50)  # runs are forgotten often
    monkeypatch.setattr(alignment, "LISTED", 3)
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 25)))) for i in range(400)]
    rows += [(900, "a▁b"), (901, "▁"), (902, " "), (903, "   "), (904, "end "), (905, "end\n"), (906, " start")]
    assert got(alignment.alignment(docs(rows), models)) == brute(rows, libraries)


@pytest.mark.parametrize("hot", [0, 4, 1 << 18])
def test_frequent_and_rare_pairs_count_alike(docs, models, libraries, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT", hot)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alignment", "tokenizer", "zwölf", "of", "vocabularies"]) for _ in range(9))) for i in range(60)]
    assert got(alignment.alignment(docs(rows), models)) == brute(rows, libraries)


def test_groups_are_given(docs, models, libraries):
    rows = [(1, "tokenizers disagree"), (2, None)]
    listed = {r.doc_id: r.groups for r in alignment.alignment(docs(rows), models, listed=True).collect()}
    a, b = tokens(rows[0][1], libraries)
    sides = [side.split("|") for side in listed[1].split(";")]
    assert [int(i) for x, _ in sides for i in x.split(",")] == [i for i, _ in a]
    assert [int(i) for _, x in sides for i in x.split(",")] == [i for i, _ in b]
    assert listed[2] == ""


def test_odd_texts_and_clashing_columns(docs, models, libraries):
    frame = docs(ODD).withColumnsRenamed({"lang": "pairs", "source": "n", "n_chars": "place"})
    assert got(alignment.alignment(frame, models)) == brute(ODD, libraries)


def test_empty_tables(docs, models):
    assert alignment.alignment(docs([], 1), models).count() == 0
    assert got(alignment.alignment(docs([(1, None), (2, "")]), models)) == Counter({(i, 0, 0, 0, 0, 0, 0, ""): 1 for i in (1, 2)})
