from __future__ import annotations

import random

import public_tokenizers as vocabularies
import pytest
import tiktoken

from feedlift.llm import bpe
from feedlift.llm.queries import QUERIES, tokenizer
from tests.llm import brute
from tests.llm.conftest import ODD

RAW = open(vocabularies.path("byte_bpe_50k.tiktoken"), "rb").read()


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=bpe.read_ranks(RAW), special_tokens={})


def _expected(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode_bytes(ids))


def test_query_against_the_library(spark, table, library):
    folder, rows = table
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op3_byte_bpe"](spark, folder).collect()}
    assert got == {i: _expected(library, t) for i, t in rows}


def test_odd_texts(spark, docs, library):
    rows = docs(ODD).select("doc_id", "text", tokenizer(spark).digests("text").alias("d")).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r.d.n_tokens, r.d.ids_sha256, r.d.decoded_sha256) == _expected(library, r.text)
    assert docs([], 1).select(tokenizer(spark).digests("text")).count() == 0


def test_ids_and_back(spark, docs):
    t = tokenizer(spark)
    frame = docs(ODD).withColumn("ids", t.ids("text")).withColumn("back", t.text("ids"))
    assert all(r.back == (r.text or "") for r in frame.collect())


def test_random_bytes_and_scripts(library):
    codec = bpe.codec(RAW, vocabularies.PATTERN)
    rng = random.Random(5)
    alphabets = ["abcde thing", "aaa  \n\n\t ", "éèöß 漢字かな", "0123 .,!'s't", "😀👩‍👩‍👧 ̈a", "ſK 　x"]
    for _ in range(3000):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(60)))
        assert [i for part in codec.encode(text) for i in part] == library.encode_ordinary(text)


def test_ascii_texts_are_cut_alike():
    full, fast = bpe.codec(RAW, vocabularies.PATTERN), bpe.ascii_pattern(vocabularies.PATTERN)
    rng = random.Random(7)
    for _ in range(5000):
        text = "".join(rng.choice(["'", "s", "re", "ll", " ", "\n", "7", "_", "A", chr(rng.randrange(128))]) for _ in range(rng.randrange(30)))
        assert fast.findall(text) == full._pieces.findall(text)
    assert bpe.ascii_pattern(r"\p{Lu}+") is None


def test_control_characters(library):
    codec = bpe.codec(RAW, vocabularies.PATTERN)
    for c in map(chr, range(128)):
        for text in (c, f" {c}", f"a{c} b", f"{c}{c}x", f"é{c} \n{c}"):
            assert [i for part in codec.encode(text) for i in part] == library.encode_ordinary(text)


def test_slices_end_where_pieces_end(library):
    codec = bpe.codec(RAW, vocabularies.PATTERN)
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "7", ".", "'s", " é"]) for _ in range(120))
        assert "".join(codec.slices(text, 10)) == text
        parts = [list(map(str, codec._pieces.findall(x))) for x in codec.slices(text, 10)]
        assert sum(parts, []) == codec._pieces.findall(text)


def test_tables_that_start_afresh_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STEPS", 50)
    monkeypatch.setattr(bpe, "MAX_PIECES", 3)
    codec = bpe.Codec(bpe.read_ranks(RAW), vocabularies.PATTERN)
    text = "the quick brown foxes jump over lazily determinised transducers, again and again " * 3
    assert [i for part in codec.encode(text) for i in part] == library.encode_ordinary(text)


def test_tokens_come_out_before_the_end():
    piece = b" " + b"thequickbrownfox" * 40
    transducer = bpe.codec(RAW, vocabularies.PATTERN).transducer
    portions = list(transducer.emit(piece))
    assert sum(map(len, portions[: len(piece) // 2])) > 50
    assert sum(portions, ()) == transducer.encode(piece)


def test_decoding_may_be_cut_anywhere(library):
    codec = bpe.codec(RAW, vocabularies.PATTERN)
    text = "naïve 漢字 😀"
    ids = library.encode_ordinary(text)
    assert "".join(codec.decode([i] for i in ids)) == text
    assert "".join(codec.decode([[next(k for k, b in codec.bytes_of.items() if b == b"\xe6")]])) == "�"
