from __future__ import annotations

import random
import string

import numpy as np

from feedlift.llm import secrets
from feedlift.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.conftest import ODD

NAMES = ("assign", "access", "hex")


def _base(text):
    spans = brute.secret_spans(text)
    return [sum(k == n for _, k, _ in spans) for n in range(3)], ",".join(f"{NAMES[k]}:{s}:{e}" for s, k, e in spans)


def _check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        counts, spans = _base(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == counts
        assert r.base_sha256 == brute.sha(spans)
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("random")) == spans


def test_query_against_brute_force(spark, table):
    folder, rows = table
    _check(QUERIES["op6_secret_scan"](spark, folder).collect(), dict(rows))


def test_patterns_at_their_edges(docs):
    texts = [
        "password=12345678", "password=1234567", "PaSsWd : 'abcdefgh' x", "apikey:\"ABCDEFGH", "API_KEY\"  =  'a.b-c/d+e", "ſecret=abcdefgh",
        "token=secret=abcdefgh", "secret\t=abcdefgh", "AKIA" + "A" * 11, "AKIA" + "A" * 12, "xAKIAAKIAAKIAAKIAz", "0" * 31, "f" * 32 + "F", "é" + "a0" * 20,
        "tokentoken=abcdefghpassword:qqqqqqqq", "secret=short token=longenough",
    ]
    rows = list(enumerate(texts))
    _check(secrets.secret_digests(docs(rows)).collect(), dict(rows))


def test_odd_texts(docs):
    rows = [r for r in dict(ODD).items()]
    _check(secrets.secret_digests(docs(rows)).collect(), dict(rows))
    assert secrets.secret_digests(docs(ODD)).count() == len(ODD)
    assert secrets.secret_digests(docs([], 1)).count() == 0


def test_random_strings_are_added_and_long_words_are_not(docs):
    rng = random.Random(8)
    letters = string.ascii_letters + string.digits
    prose = " ".join("".join(rng.choice(["the", "and", "tion", "er", "in", "on"]) for _ in range(rng.randrange(1, 9))) for _ in range(20_000))
    keys = ["".join(rng.choice(letters) for _ in range(n)) for n in (24, 32, 40, 64, 88)]
    assert sum(map(secrets.could_be_random, keys)) >= 4  # the battery gives up one in a thousand
    keys = list(filter(secrets.could_be_random, keys))
    rows = [(i, f"{prose[i * 300 : i * 300 + 900]} {k} end") for i, k in enumerate(keys)]
    rows += [(50 + i, prose[i * 30_000 : (i + 1) * 30_000]) for i in range(8)]
    rows += [(90, "a" * 60), (91, "ab" * 30), (92, "0123456789" * 5 + "abcdefghijklmnopqrstuvwxyz"), (93, "internationalisationalisms-and-other-quite-long-words")]
    got = {r.doc_id: r.spans for r in secrets.secret_digests(docs(rows)).collect()}
    for i, k in enumerate(keys):
        at = dict(rows)[i].index(k)
        assert f"random:{at}:{at + len(k)}" in got[i]
    assert not any("random" in got[i] for i, _ in rows if i >= 50)


def test_battery_keeps_its_level():
    rng = random.Random(2)
    for name in ("hex", "base36", "base62", "base64"):
        alphabet = secrets.ENCODINGS[name]
        passed = [secrets.could_be_random("".join(rng.choice(alphabet) for _ in range(40))) for _ in range(1000)]
        assert np.mean(passed) > 0.98


def _mixed(seed, n=60):
    """Prose with random strings of several encodings and lengths, long words and base spans."""
    rng = random.Random(seed)
    parts = ["the", "and", "tion", "er", "in", "on", "_", "-"]
    rows = []
    for i in range(n):
        out = []
        for _ in range(rng.randrange(0, 40)):
            kind = rng.random()
            if kind < 0.05:
                alphabet = rng.choice(list(secrets.ENCODINGS.values()))
                out.append("".join(rng.choice(alphabet) for _ in range(rng.choice([20, 24, 33, 64, 400]))))
            elif kind < 0.1:
                out.append("token=" + "".join(rng.choice(string.ascii_letters) for _ in range(30)))
            elif kind < 0.2:
                out.append("".join(rng.choice(parts) for _ in range(rng.randrange(6, 20))))
            else:
                out.append("".join(rng.choice(parts[:6]) for _ in range(rng.randrange(1, 4))))
        rows.append((i, " ".join(out) if i % 7 else None))
    return rows


def test_added_spans_against_brute_force(docs):
    rows = _mixed(1)
    counts = np.zeros((256, 256))
    for _, text in rows:
        raw = (text or "").encode()
        for a, b in zip(raw[:-1], raw[1:], strict=True):
            counts[a, b] += 1
    model = secrets.Model(counts)
    found = []
    for i, text in rows:
        base = [(s, e) for s, _, e in brute.secret_spans(text)]
        for m in secrets.CANDIDATE.finditer(text or ""):
            if all(e <= m.start() or m.end() <= s for s, e in base):
                found.append((min(60.0, -np.log10(model.p_value(m[0]))) // 0.05 * 0.05, i, m.span()))
    want, worst = set(), None
    for rank, (size, *_) in enumerate(sorted(found, reverse=True), 1):  # the largest p-value that its rank allows
        worst = size if 10 ** -size <= 0.01 * sum(s >= size - 1e-9 for s, *_ in found) / len(found) else worst
    want = {(i, s, e) for size, i, (s, e) in found if worst is not None and size >= worst - 1e-9}
    for partitions in (1, 2, 7):
        got = {(r.doc_id, *map(int, x.split(":")[1:])) for r in secrets.secret_digests(docs(rows, partitions)).collect() for x in r.spans.split(",") if x.startswith("random")}
        assert got == want and len(want) > 10


def test_spans_do_not_depend_on_batches(spark, docs):
    rows = _mixed(2, 40)
    frame = docs(rows, 3)
    want = sorted(map(tuple, secrets.secret_digests(frame).collect()), key=str)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert sorted(map(tuple, secrets.secret_digests(docs(rows[::-1], 5)).collect()), key=str) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_text_looks_less_random_the_longer_it_is():
    rng = random.Random(5)
    counts = np.zeros((256, 256))
    prose = " ".join("".join(rng.choice(["the", "and", "tion", "er", "in", "on"]) for _ in range(9)) for _ in range(3000)).encode()
    np.add.at(counts, (np.frombuffer(prose[:-1], np.uint8), np.frombuffer(prose[1:], np.uint8)), 1)
    null = secrets.TextNull(counts)
    for name in ("base36", "base62", "base64"):
        alphabet = secrets.ENCODINGS[name]
        p = []
        for n in (20, 40, 80, 160, 640):
            token = [secrets.statistic(secrets.battery(np.array([rng.randrange(len(alphabet)) for _ in range(n)]), len(alphabet))) for _ in range(30)]
            p.append(np.median([null.p_value(name, n, t) for t in token]))
        assert p == sorted(p, reverse=True) and p[-1] < 1e-6


def test_discoveries_follow_the_rule():
    counts = {0: 1000, 60: 5, 100: 5}
    # 10 of 1010 have p <= 1e-3, 5 have p <= 1e-5: only the latter are under 1 % of the rank.
    assert secrets.discovery_bin(counts) == 100
    assert secrets.discovery_bin({0: 10}) > secrets.LAST_BIN
    assert secrets.discovery_bin({}) > secrets.LAST_BIN
