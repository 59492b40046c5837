"""The tree merge of digest runs against plain Python."""

import collections
import hashlib
import re

import numpy as np
import pytest

from predcheck.llm import digests

WHITE = re.compile("[ \t\n\v\f\r]")


def brute(rows):
    """Sorted (doc_id, keep_id, group_size, kept, sha256) of (doc_id, text) rows."""
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[WHITE.sub("", t or "")].append((-len(t or ""), d is None, d or 0, d))
    out = []
    for text, members in groups.items():
        members.sort(key=lambda m: m[:3])
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), i == 0, sha) for i, m in enumerate(members)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in digests.exact_dedup(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


@pytest.mark.parametrize("name", ["docs", "odd", "empty"])
def test_against_brute_force(request, name):
    df = request.getfixturevalue(name)
    assert rows_of(df) == brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


@pytest.mark.parametrize("run_rows,node_rows", [(3, 1), (7, 1000)])
def test_many_small_runs(spark, monkeypatch, run_rows, node_rows):
    """Runs of a few rows, several rounds, one text that fills half of the table, white space that differs, longest first."""
    monkeypatch.setattr(digests, "RUN_ROWS", run_rows)
    monkeypatch.setattr(digests, "NODE_ROWS", node_rows)
    rows = [(i, ("a b", "ab ", " a\tb\n", "é x")[i % 4] if i % 2 else f"t{i % 40}  {' ' * (i % 3)}") for i in range(400, 0, -1)] + [(5, "a b"), (5, "a b"), (None, "a       b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert rows_of(df) == brute(rows)


def test_digests_that_share_64_bits_stay_apart():
    rows = np.zeros(4, digests.HEAD)
    rows["d0"], rows["d3"], rows["size"], rows["id"], rows["chars"] = 7, [2, 1, 2, 1], 1, [4, 3, 2, 1], [1, 1, 1, 5]
    order, group, heads = digests.merge(rows)
    assert heads["id"].tolist() == [1, 2] and heads["size"].tolist() == [2, 2]
    assert digests._find(rows, heads)["id"].tolist() == [2, 1, 2, 1]
    rows["bytes"] = [1, 2, 3, 4]
    with pytest.raises(ValueError):
        digests.merge(rows)
