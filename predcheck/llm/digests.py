"""Exact copies by a tree merge of sorted digest runs.

Every partition of documents cuts its rows into runs: digests of the normalised texts, sorted, with one head for each distinct digest (how often
it occurs, and the row that stays so far). Runs then meet in binomial rounds. With FAN**R nodes, round r sends the stretch of a run with r-th digit
d to the node whose r-th digit is d, so FAN partners exchange stretches (four binomial rounds in one) and each node merges what it gets into
one run. Copies become one head at each level, so a text that fills a third of the table is never more than one head a run; after R rounds a node holds the whole
of its range of digests. The answers go back along the same edges: a node tells each run it merged what became of its heads. No step has one
key for all copies of a text, no run passes through the driver, and all levels are written to the shared folder.

Heads are one only if all 256 bits of the SHA-256 and the length in bytes agree; two lengths under one digest are an error, never a merge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .tables import batch, store, text_of
from .text import mix, strings

#: Characters that do not count, and runs that a node merges at a time (16 is four binomial rounds).
IGNORED, DIGIT_BITS = b" \t\n\v\f\r", 4
FAN = 1 << DIGIT_BITS
#: Documents of a leaf run, and heads that a node should hold; neither changes a result.
RUN_ROWS, NODE_ROWS = 1 << 16, 100_000

#: One head, or one document in a leaf run. ``d0`` to ``d3`` are the digest, ``id`` ... ``place`` the row that stays.
HEAD = np.dtype([("d0", "<u8"), ("d1", "<u8"), ("d2", "<u8"), ("d3", "<u8"), ("bytes", "<i8"), ("chars", "<i8"), ("null", "?"), ("id", "<i8"),
                 ("run", "<i8"), ("place", "<i4"), ("size", "<i8")])
_RUNS, _RESULT = "node long, child long, run binary", "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string"


def _same_text(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    same = (a["d0"] == b["d0"]) & (a["d1"] == b["d1"]) & (a["d2"] == b["d2"]) & (a["d3"] == b["d3"])
    if (a["bytes"][same] != b["bytes"][same]).any():
        raise ValueError("two texts of different length have one SHA-256")
    return same


def _order(rows: np.ndarray) -> np.ndarray:
    """By digest; a stable sort of 64-bit numbers merges the sorted runs that the rows come in."""
    lead = rows["d0"]
    order = np.argsort(lead, kind="stable")
    tie = lead[order][1:] == lead[order][:-1]
    if tie.any() and not _same_text(rows[order[1:]], rows[order[:-1]])[tie].all():  # 64 bits agree, the digests don't
        order = np.lexsort((rows["d3"], rows["d2"], rows["d1"], rows["d0"]))
    return order


def merge(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, index of the head of each ordered row, heads): of equal texts the row with most code points, then the smallest id (null last)."""
    order = _order(rows)
    rows = rows[order]
    first = np.ones(len(rows), bool)
    first[1:] = ~_same_text(rows[1:], rows[:-1])
    group = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    heads = rows[starts]
    many = np.flatnonzero((np.diff(np.append(starts, len(rows))) > 1)[group]) if len(rows) else starts
    if len(many):
        m = rows[many]
        best = many[np.lexsort((m["place"], m["run"], m["id"], m["null"], -m["chars"], group[many]))]
        lead = np.ones(len(best), bool)
        lead[1:] = group[best[1:]] != group[best[:-1]]
        heads[group[best[lead]]] = rows[best[lead]]
        heads["size"] = np.add.reduceat(rows["size"], starts)
    return order, group, heads


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of all documents of a partition."""
    part, number, held, count = TaskContext.get().partitionId(), 0, [], 0

    def run():
        rows = np.concatenate(held)
        name = (part << 24) + number
        rows["run"], rows["place"] = name, np.arange(len(rows))
        order, _, _ = merge(rows)
        return batch(("node", "child", "run"), pa.array([name]), pa.array([name]), pa.array([rows[order].tobytes()]))

    for b in batches:
        data, offsets = strings(b.column(1))
        raw = data.tobytes() if len(data) else b""
        chars = pc.fill_null(pc.utf8_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
        digests, lengths = bytearray(), np.zeros(len(b), np.int64)
        for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            kept = raw[lo:hi].translate(None, IGNORED)
            digests += hashlib.sha256(kept).digest()
            lengths[i] = len(kept)
        rows = np.zeros(len(b), HEAD)
        words = np.frombuffer(bytes(digests), ">u8").reshape(-1, 4)
        for i in range(4):
            rows[f"d{i}"] = words[:, i]
        rows["bytes"], rows["chars"], rows["size"] = lengths, chars, 1
        rows["null"] = pc.is_null(b.column(0)).to_numpy(zero_copy_only=False)
        rows["id"] = pc.fill_null(b.column(0), 0).to_numpy(zero_copy_only=False)
        for at in range(0, len(rows), RUN_ROWS):
            held.append(rows[at:at + RUN_ROWS])
            count += len(held[-1])
            if count >= RUN_ROWS:
                yield run()
                number, held, count = number + 1, [], 0
    if held:
        yield run()


def _read(column) -> np.ndarray:
    """The rows of several runs, one run after the other."""
    return np.concatenate([np.frombuffer(r, HEAD) for r in column.to_pylist()] or [np.zeros(0, HEAD)])


def _stretches(heads: np.ndarray, node: int, child: int, level: int, levels: int) -> Iterator[tuple[int, int, bytes]]:
    """(receiving node, sender, stretch) of a sorted run for round ``level`` (1 is the first)."""
    place = FAN ** (levels - level)
    digit = (heads["d0"] >> np.uint64(64 - DIGIT_BITS * level)) & np.uint64(FAN - 1)
    base = node - (node // place % FAN) * place
    at = np.searchsorted(digit, np.arange(FAN + 1))
    for d in np.flatnonzero(np.diff(at)).tolist():
        yield base + d * place, child, heads[at[d]:at[d + 1]].tobytes()


def _runs(rows) -> pa.RecordBatch:
    nodes, children, blobs = zip(*rows) if (rows := list(rows)) else ((), (), ())
    return batch(("node", "child", "run"), pa.array(nodes, pa.int64()), pa.array(children, pa.int64()), pa.array(blobs, pa.binary()))


def _first_round(levels: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, blob in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                start = int(mix(np.array([name], np.uint64))[0] % np.uint64(FAN ** levels))
                yield _runs(_stretches(merge(np.frombuffer(blob, HEAD))[2], start, name, 1, levels))
    return send


def _next_round(level: int, levels: int):
    """Merge the stretches that a node got in round ``level`` and send them on."""
    def send(key, table):
        node = key[0].as_py()
        _, _, heads = merge(_read(table.column("run")))
        if level == levels:
            return pa.Table.from_batches([_runs([(node, node, heads.tobytes())])])
        return pa.Table.from_batches([_runs(_stretches(heads, node, node, level + 1, levels))])
    return send


def _find(rows: np.ndarray, answers: np.ndarray) -> np.ndarray:
    """The answer for each row; every row has one."""
    both = np.concatenate([answers, rows])
    order = np.argsort(both["d0"], kind="stable")
    ordered = both[order]
    if not _same_text(ordered[1:], ordered[:-1])[ordered["d0"][1:] == ordered["d0"][:-1]].all():
        order = np.lexsort((np.arange(len(both)) >= len(answers), both["d3"], both["d2"], both["d1"], both["d0"]))
    from_answers = order < len(answers)
    last = np.maximum.accumulate(np.where(from_answers, np.arange(len(both)), 0))
    found = np.zeros(len(rows), HEAD)
    found[order[~from_answers] - len(answers)] = both[order[last[~from_answers]]]
    if len(rows) and not _same_text(rows, found).all():
        raise ValueError("a digest has no answer")
    return found


def _answer(key, sent, answers):
    """Tell the sender of each stretch which rows stay for its heads."""
    known = _read(answers.column("run"))
    return pa.Table.from_batches([_runs((child, child, _find(np.frombuffer(blob, HEAD), known).tobytes())
                                        for child, blob in zip(sent.column("child").to_pylist(), sent.column("run").to_pylist()))])


def _rows(key, leaf, answers):
    """One result row for each document of a leaf run."""
    rows, known = _read(leaf.column("run")), _read(answers.column("run"))
    best = _find(rows, known)
    digests = np.stack([rows[f"d{i}"] for i in range(4)], axis=1).astype(">u8").tobytes().hex()
    kept = (rows["run"] == best["run"]) & (rows["place"] == best["place"])
    return pa.table({"doc_id": pa.array(rows["id"].astype(np.int64), mask=rows["null"]), "keep_id": pa.array(best["id"].astype(np.int64), mask=best["null"]),
                     "group_size": best["size"].astype(np.int64), "kept": kept,
                     "text_sha256": pa.array([digests[i:i + 64] for i in range(0, len(digests), 64)], pa.string())})


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when they are identical after white space (``[\\x20\\x09-\\x0D]``) is deleted. Of equal texts the row with the most code points in
    its original text stays, then the one of smallest doc_id; a null id comes after all others and is a row of its own. A null text is an empty one, and
    all texts without any other character are one group. Rows that are repeated exactly differ by their place in the table alone: one of them is kept.
    Texts have no bound; only digests are kept of them. An empty table gives an empty result, further columns of any name are ignored.
    """
    leaves = store(text_of(docs, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_leaves, _RUNS))
    documents = leaves.agg(F.sum(F.length("run"))).first()[0] or 0
    wanted = max(documents / HEAD.itemsize / NODE_ROWS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), FAN)
    levels = next(n for n in range(1, 17) if FAN ** n >= wanted)
    sent = [store(leaves.mapInArrow(_first_round(levels), _RUNS))]
    for level in range(1, levels):
        sent.append(store(sent[-1].groupBy("node").applyInArrow(_next_round(level, levels), _RUNS)))
    answers = sent[-1].groupBy("node").applyInArrow(_next_round(levels, levels), _RUNS)
    for stretches in reversed(sent):
        answers = store(stretches.groupBy("node").cogroup(answers.groupBy("node")).applyInArrow(_answer, _RUNS))
    return leaves.groupBy("node").cogroup(answers.groupBy("node")).applyInArrow(_rows, _RESULT)


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS k FROM documents),
r AS (SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY k) AS group_size, row_number() OVER w = 1 AS kept, sha256(k) AS text_sha256
      FROM d WINDOW w AS (PARTITION BY k ORDER BY length(t) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM r
"""
