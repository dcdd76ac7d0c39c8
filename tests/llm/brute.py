"""Plain versions of the operators, written from their definitions, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def quality_counts(text):
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, dup, len(covered)


def line_digests(docs, min_chars=40, min_docs=5):
    """docs: (doc_id, text) rows without repeated rows or ids."""
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate(LOWER)
    holders = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    lost = {k: max(v, key=lambda i: (i is not None, i)) for k, v in holders.items() if len(v) >= min_docs}
    out = {}
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if lost.get(key(x), i) == i]
        out[i] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def repeated_words(docs, k=35):
    """Per row of (doc_id, text): words, words in windows that also start elsewhere, digest of the rest."""
    often = Counter()
    for _, text in docs:
        w = words(text)
        often.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for i, text in docs:
        w = words(text)
        hit = {a + j for a in range(len(w) - k + 1) if often[tuple(w[a : a + k])] > 1 for j in range(k)}
        kept = [x for j, x in enumerate(w) if j not in hit]
        out.append((i, len(w), len(hit), sha(" ".join(kept))))
    return out


def shingles(text, n=5):
    w = [x.translate(LOWER) for x in words(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)])


def components(docs, links):
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in parent}


def jaccard_links(docs, percent=75):
    sets = [(i, shingles(t)) for i, t in docs]
    holders = defaultdict(list)
    for i, s in sets:
        for g in s:
            holders[g].append(i)
    by_id, links = dict(sets), set()
    for i, s in sets:
        shared = Counter(j for g in s for j in holders[g] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(by_id[j]) - n):
                links.add((j, i))
    return links


_ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def secret_spans(text):
    text, found = text or "", []
    for m in _ASSIGN.finditer(text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    for rank, pattern, least in ((1, r"AKIA[A-Z0-9]+", 16), (2, r"[0-9a-f]+", 32)):
        for m in re.finditer(pattern, text):
            if m.end() - m.start() >= least:
                found.append((m.start(), rank, m.end()))
    return sorted(found)
