"""Plain-Python versions of the operators' results, for small tables."""

import collections
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, k=5):
    w = words(text)
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(docs):
    """{doc_id: least id reachable by Jaccard >= 0.8} over (doc_id, text) rows."""
    sets = [(d, shingles(t)) for d, t in docs if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in parent}


def fold(doc, modulus):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % modulus


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target} by repeated capping and resharing; sources by code point, None last."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left, weight = total - sum(capped.values()), sum(w[s] for s in free)
        goal = {s: left * w[s] / weight for s in free}
        over = [s for s in free if goal[s] > most * sizes[s] + 1e-9]
        if not over:
            return {**capped, **goal}
        capped.update({s: most * sizes[s] for s in over})


def repeated_windows(docs, n):
    """{doc_id: first words of windows of n words that an earlier document has too}."""
    first, out = {}, collections.defaultdict(set)
    for d, text in sorted(docs):
        w = words(text)
        for i in range(len(w) - n + 1):
            if first.setdefault(tuple(w[i:i + n]), d) != d:
                out[d].add(i)
    return out
