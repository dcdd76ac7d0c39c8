from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from feedlift.llm import jaccard
from feedlift.llm.components import components
from feedlift.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.conftest import ODD


def _components(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def _expected(rows):
    found = brute.components(rows, brute.jaccard_links(rows))
    return {i: (len(brute.shingles(t)), found[i]) for i, t in rows}


def test_query_against_brute_force(spark, table):
    folder, rows = table
    assert _components(QUERIES["op10_ngram_jaccard"](spark, folder)) == _expected(rows)


def _chains(seed):
    """Families of near copies that drift apart, a passage in every text, short texts and copies."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(40))
    passage = [word() for _ in range(25)]
    rows = []
    for _ in range(12):
        text = [word() for _ in range(rng.randrange(30, 120))]
        for _ in range(rng.randrange(1, 9)):
            rows.append(" ".join(text + passage))
            text = list(text)
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(len(text))] = word()
    rows += [" ".join(passage)] * 3 + ["one two three", "One two THREE", "one two", "", " "]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_links_at_the_edge_are_found(docs, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "NODE", 4)  # many nodes to a group
    monkeypatch.setattr(jaccard, "INNER", 2)
    monkeypatch.setattr(jaccard, "FREQUENT", 10**9)  # no order but the hash: the passage leads many prefixes
    rows = _chains(seed)
    assert _components(jaccard.similar(docs(rows))) == _expected(rows)


def test_odd_texts(docs):
    got = jaccard.similar(docs(ODD)).collect()
    assert len(got) == len(ODD)
    want = _expected([r for r in dict(ODD).items() if r[0] is not None])
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    same = [r for r in got if r.doc_id == 7]
    assert len({r.class_id for r in same}) == 1
    assert sum(r["first"] for r in same) == 1  # repeated rows: one stays
    assert jaccard.similar(docs([], 1)).count() == 0


def test_clashing_columns_are_not_read(docs):
    frame = docs([(1, "a b c d e f"), (2, "a b c d e f")]).withColumnsRenamed({"lang": "key", "source": "member", "n_chars": "n"})
    assert _components(jaccard.similar(frame)) == {1: (2, 1), 2: (2, 1)}


def test_bound_is_never_too_low():
    rng = np.random.default_rng(4)
    for _ in range(200):
        base = rng.integers(0, 2**63, 60, dtype=np.uint64)
        a = np.unique(rng.choice(base, 40, replace=False))
        b = np.unique(np.concatenate((rng.choice(base, 30, replace=False), rng.integers(0, 2**63, 5, dtype=np.uint64))))
        x, y = jaccard.set_bits(a), jaccard.set_bits(b)
        could = jaccard._could_link(pa.array([len(a)]), pa.array([x.tobytes()]), pa.array([len(b)]), pa.array([y.tobytes()]), 75)
        n = jaccard.overlap(a, b)
        if 100 * n >= 75 * (len(a) + len(b) - n):
            assert could[0].as_py()


def _at_the_edge(rng, m, n):
    """Two sets of these sizes with the least overlap that links them."""
    both = -(-75 * (m + n) // 175)
    pool = rng.integers(0, 2**63, m + n - both, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.unique(pool[:m]), np.unique(pool[m - both :])


@pytest.mark.parametrize("unequal", [False, True])
def test_linked_pairs_survive_every_bound(unequal):
    rng = np.random.default_rng(11)
    edges = [(64, 65), (128, 129), (250, 260), (32, 33), (510, 520)]
    for i in range(5_000):
        if unequal:  # on both sides of a change of width
            m, n = edges[i % len(edges)]
        else:
            m = int(rng.integers(20, 600))
            n = int(rng.integers(m, 4 * m // 3 + 1))
        a, b = _at_the_edge(rng, m, n)
        x, y = jaccard.set_bits(a), jaccard.set_bits(b)
        assert jaccard._could_link(pa.array([m]), pa.array([x.tobytes()]), pa.array([n]), pa.array([y.tobytes()]), 75)[0].as_py()
        sides = []
        for member, (tokens, bits) in enumerate(((a, x), (b, y))):
            fields = {"n": [len(tokens)], "member": [member], "component": [member], "bits": [bits.tobytes()]}
            sides.append(jaccard.Side(pa.table(fields)))
        left, right = jaccard.traverse(*sides, 75)
        assert (left.tolist(), right.tolist()) == ([0], [1])
        packed = [(pa.array([int(s.n[0])]), pa.array([s.bits[0].tobytes()], pa.binary()), pa.array([s.spare[:, 0].tolist()])) for s in sides]
        (na, ba, sa), (nb, bb, sb) = packed
        assert jaccard._node_pairs(na, ba, nb, bb, sa, sb, 75)[0].as_py()


def test_nodes_of_several_widths_keep_their_pairs():
    rng = np.random.default_rng(12)
    pairs = [_at_the_edge(rng, m, n) for m, n in ((60, 70), (64, 65), (62, 80), (90, 100), (127, 130), (120, 150)) for _ in range(40)]
    sides = []
    for at in (0, 1):
        sets = [p[at] for p in pairs]
        rows = {"n": [len(t) for t in sets], "member": range(len(sets)), "component": [2 * i + at for i in range(len(sets))]}
        sides.append(jaccard.Side(pa.table({**rows, "bits": [jaccard.set_bits(t).tobytes() for t in sets]})))
    left, right = jaccard.traverse(*sides, 75)
    assert set(zip(left.tolist(), right.tolist(), strict=True)) >= {(i, i) for i in range(len(pairs))}


def test_pages_that_meet_in_a_third_are_linked(docs):
    """A and B link; a third page quotes A and a common passage, so that all three meet in one group."""
    rng = random.Random(21)
    rows, want = [], {}
    passage = [f"p{i}" for i in range(40)]
    for group in range(12):
        a = [f"g{group}w{rng.randrange(10**6)}" for _ in range(64)]  # 60 shingles
        b = a[:63] + [f"g{group}x{i}" for i in range(17)]  # 76, of which 59 are shared
        c = a + passage + [f"g{group}y{i}" for i in range(60)]
        for k, text in enumerate((c, a, b)):
            rows.append((3 * group + k, " ".join(text)))
        want |= {3 * group: 3 * group, 3 * group + 1: 3 * group + 1, 3 * group + 2: 3 * group + 1}
    assert {i: c for i, (_, c) in _components(jaccard.similar(docs(rows))).items()} == want
    assert _expected(rows) == _components(jaccard.similar(docs(rows)))


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5001), (5001, 5000), (7, 7)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)} | {5000: 5000, 5001: 5000}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
