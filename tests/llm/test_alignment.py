"""Token alignment against the tokenizer libraries and a plain sweep over byte ranges."""

import collections
import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from predcheck.llm import alignment

A_PATH, B_PATH = alignment.default_paths()
ODD = ["a  b", " lead", "trail ", "trail  ", "   ", " ", "\n", "a \n b", "a\n b", "tab\t x", "x  y", "x  y", "  wide 　 z", "\u0085 n \x1c m", "it's  we'll I'D", "▁ mark", "x▁y",
       "<|endoftext|> and <s> </s> <unk> <0x0A>", "\x00 nul", "漢字 かな  交じり 文", "é é ﬁ ½", "😀 👍🏽  x", "1234 5 67,89", "....   !!", "ÀÉ  à é ï ß ", "x" * 3000, "a " * 700, "﻿ bom", "𝒳 math", "٠١ digits"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    names = {c: b for c, b in alignment._printable_bytes().items()}
    return a, {i: bytes(names[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if all(c in names for c in t)}, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def brute(libraries, rows):
    a, a_of, b = libraries
    out, linked, best = [], collections.Counter(), collections.Counter()
    for d, text in rows:
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        parts = [[a_of[i] for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]]
        if not text or any(b"".join(p) != b" " + text.encode() for p in parts):
            out.append((d, 0, 0, 0, [], ""))
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        common, links, i, j = set(ends[0]) & set(ends[1]), [], 0, 0
        while i < len(ids[0]) and j < len(ids[1]):
            links.append((ids[0][i], ids[1][j]))
            x, y = ends[0][i], ends[1][j]
            i, j = i + (x <= y), j + (y <= x)
        sides = []
        for k in (0, 1):
            groups = [[]]
            for token, end in zip(ids[k], ends[k]):
                groups[-1].append(str(token))
                if end in common:
                    groups.append([])
            sides.append([",".join(g) for g in groups[:-1]])
        text = ";".join(f"{x}|{y}" for x, y in zip(*sides))
        out.append((d, len(ids[0]), len(ids[1]), len(common), links, hashlib.sha256(text.encode()).hexdigest()))
        linked.update(set(links))
    for (x, _), n in linked.items():
        best[x] = max(best[x], n)
    return sorted(((d, na, nb, g, len(links), sum(linked[l] == best[l[0]] for l in links), sum(linked[l] for l in links), sha) for d, na, nb, g, links, sha in out), key=repr)


def rows_of(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in alignment.token_alignment(df).select(*names).collect()), key=repr)


@pytest.mark.parametrize("name", ["docs", "odd", "empty"])
def test_shared_tables(request, libraries, name):
    df = request.getfixturevalue(name)
    assert rows_of(df) == brute(libraries, [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


def _texts():
    rng = random.Random(5)
    signs = [" ", "  ", "\n", "\t", " ", "\u0085", " ", "a", "b", "é", "▁", "'s", "漢", "1", ".", "<s>", "Z", "Â", "　", "ñ"]
    return ODD + ["".join(rng.choices(signs, k=rng.randint(1, 40))) for _ in range(400)] + [None, ""]


@pytest.mark.parametrize("align,joined,kept", [(1 << 21, 1 << 14, 300_000), (64, 30, 20)])
def test_any_text_in_steps_of_any_size(spark, libraries, monkeypatch, align, joined, kept):
    """White space and signs of every kind; texts longer than a step, and units forgotten between steps."""
    rows = [(i, t) for i, t in enumerate(_texts())] + [(10**6, ODD[0]), (None, ODD[0])]
    for name, value in (("ALIGN_BYTES", align), ("JOINED", joined), ("KEPT_UNITS", kept)):
        monkeypatch.setattr(alignment, name, value)
    run = alignment._align(A_PATH, B_PATH)
    got = pa.Table.from_batches(run([pa.RecordBatch.from_pydict({"row": list(range(len(rows))), "doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": [t for _, t in rows]})])).to_pylist()
    want = {d: (na, nb, g, n, sha) for d, na, nb, g, n, _, _, sha in brute(libraries, rows)}
    for r in got:
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) == want[r["doc_id"]], rows[r["row"]]
        assert sum(r["times"]) == r["n_links"] and len(set(r["pairs"])) == len(r["pairs"])


def test_counts_by_a_shuffle(spark, docs, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)
    assert rows_of(docs) == brute(libraries, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_overlaps_of_two_partitions_of_a_line():
    a = pd.DataFrame({"start": [0, 2, 5, 9, 10], "doc": [0, 0, 0, 1, 1], "n": range(5)})
    b = pd.DataFrame({"start": [0, 1, 4, 9, 12], "doc": [0, 0, 0, 1, 1], "n": range(5)})
    pairs = sorted(zip(*(x.tolist() for x in alignment.overlaps(a, b))))
    assert pairs == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (3, 3), (4, 3), (4, 4)]
