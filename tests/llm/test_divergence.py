"""Divergence of sources against plain Python."""

import collections
import itertools
import random
import re

import pytest

from predcheck.llm import divergence

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(rows, top=10):
    """All result rows of (lang, source, text) rows."""
    docs, count, groups = collections.defaultdict(set), collections.Counter(), collections.defaultdict(set)
    for i, (lang, source, text) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for t in TERM.findall((text or "").translate(LOWER)):
            docs[lang, t].add(i)
            count[lang, source, t] += 1
    out = []
    for lang, sources in groups.items():
        terms = [t for (l, t), d in docs.items() if l == lang and len(d) >= 10]

        def shares(names):
            n = {t: sum(count[lang, s, t] for s in names) for t in terms}
            return {t: 1 + 10**9 * (n[t] + 2) // (sum(n.values()) + 2 * len(terms)) for t in terms}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        p, whole = {s: shares([s]) for s in sources}, shares(sources)
        for s in sources:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in terms), o.encode()) for o in sources - {s})
            term = sorted((-f(p[s][t], whole[t]), t.encode()) for t in terms if count[lang, s, t] and p[s][t] > whole[t])[:top]
            out += [(lang, s, part, item.decode(), -value, i + 1) for part, ranked in (("pair", pair), ("term", term)) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def rows_of(df):
    got = divergence.source_divergence(df).select("lang", "source", "part", "item", "value", "rank").collect()
    return sorted(tuple(r) for r in got)


@pytest.mark.parametrize("name", ["docs", "odd", "empty"])
def test_shared_tables(request, name):
    df = request.getfixturevalue(name)
    want = brute([(r["lang"], r["source"], r["text"]) for r in df.select("lang", "source", "text").collect()])
    assert rows_of(df) == want and (name == "empty" or {r[2] for r in want} == {"pair", "term"})


@pytest.mark.parametrize("block,step", [(40, 1 << 20), (7, 5), (10**6, 64)])
def test_many_groups_in_small_blocks(spark, monkeypatch, block, step):
    """A hot source, sources without terms, languages without kept terms, ties, capitals, words next to text borders."""
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "STEP", step)
    rng = random.Random(block)
    words = ["Alpha", "bêta", "GAMMA", "delta", "ÉTÉ", "été", "zeta", "eta", "d'or", "x1y", "漢字"]
    rows = [(rng.choice("ab"), "hot" if rng.random() < 0.4 else rng.choice(["s1", "s2", "S2", "é", None, ""]),
             rng.choice([" ", "", "-"]).join(rng.choices(words, weights=range(1, 12), k=rng.randint(0, 12)))) for _ in range(260)]
    rows += [("a", "silent", None), ("a", "silent", "12 34"), ("c", "p", "rare"), ("c", "q", "words"), ("c", "r", None), (None, "lone", "x"), ("d", "one", "solo " * 3)] + [("d", "one", "solo")] * 12
    assert rows_of(spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)) == brute(rows)


def test_counting_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "COUNT_BYTES", 16)
    rows = [("a", f"s{i % 3}", "one two two three " * (i % 4)) for i in range(60)]
    assert rows_of(spark.createDataFrame(rows, "lang string, source string, text string")) == brute(rows)
