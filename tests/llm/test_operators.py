"""Operators against brute force on a small table that holds every odd case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import brute
from predcheck.llm import attention, chaining, graph, hamming, jaccard, licenses, lm, mixing, packing, quality, subwords, syncmers, toxicity


def collected(df):
    return [r.asDict() for r in df.collect()]


# ------------------------------------------------------------------------------------------------ 1: n-gram join

def test_jaccard_components(docs, rows):
    got = {r["doc_id"]: r for r in collected(jaccard.ngram_jaccard(docs))}
    want = brute.components([(r[0], r[1]) for r in rows])
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert all(got[r[0]]["n_shingles"] == len(brute.shingles(r[1])) for r in rows)


def test_jaccard_odd_rows(odd):
    got = collected(jaccard.ngram_jaccard(odd))
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    want = brute.components(rows)
    assert len(got) == len(rows)
    assert all(r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]]) for r in got if r["n_shingles"] or r["doc_id"] is None)
    kept = [r["doc_id"] for r in jaccard.drop_near_copies(odd).collect()]
    assert sorted(d for d in kept if d is not None) == sorted(set(want.values())) and kept.count(None) == 2


def test_split_groups_lose_no_link(docs, rows, monkeypatch):
    """Groups of three rows already go to several tasks."""
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 3)
    got = {r["doc_id"]: r["component_id"] for r in collected(jaccard.ngram_jaccard(docs))}
    assert got == brute.components([(r[0], r[1]) for r in rows])


def test_filters_keep_every_similar_pair():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.15], rng.integers(0, 2**63, int(rng.integers(0, 12))).astype(np.uint64)]))
        if len(b) == 0:
            continue
        common = len(np.intersect1d(a, b))
        if 100 * common < 80 * (len(a) + len(b) - common):
            continue
        pa, pb = a[:jaccard.prefix_length(len(a))], b[:jaccard.prefix_length(len(b))]
        shared = np.intersect1d(pa, pb)
        assert len(shared)
        i, j = np.array([np.searchsorted(a, shared[0])]), np.array([np.searchsorted(b, shared[0])])
        bits = [np.frombuffer(jaccard.bitmap(x), np.uint64)[None] for x in (a, b)]
        assert jaccard.passes(np.array([len(a)]), i, bits[0], np.array([len(b)]), j, bits[1]).all()


def test_components_of_edges(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    labels, trees = graph.forest(spark.createDataFrame(edges, "a long, b long"))
    got = {r.node: r.label for r in labels.collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert trees.count() == len(got) - len(set(got.values()))


# ------------------------------------------------------------------------------------------------ 2: language model

def test_lm_baseline_and_model(docs, rows):
    got = {r["doc_id"]: r for r in collected(lm.lm_scores(docs))}
    tokens = {r[0]: [*brute.words(r[1]), None] for r in rows}
    counts = Counter(t for d in tokens if brute.fold(d, 7) != 2 for t in tokens[d])
    total, distinct = sum(counts.values()), len(counts)
    for d, r in got.items():
        want = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens[d])
        assert r["base_score"] == pytest.approx(want, rel=1e-9) and r["n_known"] == sum(counts[t] > 0 for t in tokens[d])
        assert (r["n_tokens"], r["train_tokens"], r["held_out"]) == (len(tokens[d]), total, brute.fold(d, 7) == 2)
        assert -1e6 < r["score"] < 0


def test_scores_against_a_plain_forward_pass():
    """score() against one text place at a time, in plain Python, each place seen through the window that scores it."""
    w, *_ = _tiny()
    rng = np.random.default_rng(3)
    n = attention.GROUPS * attention.MEMBERS
    for name in w:
        w[name] = w[name] + 0.3 * rng.standard_normal(w[name].shape).astype(np.float32)
    counts = np.array([3, 1, 70, 0, attention.WINDOW, attention.WINDOW + 5])
    inputs, targets = (rng.integers(0, n, int(counts.sum())) for _ in range(2))
    got, at = attention.score(w, inputs, targets, counts), 0
    for count in counts.tolist():
        for place in range(count):
            nth = max(0, -(-(place + 1 - attention.WINDOW) // attention.STRIDE))
            seen = [w["embed"][inputs[at + j]].astype(float) for j in range(nth * attention.STRIDE, place + 1)]
            query = seen[-1] @ w["query"]
            logits = [query @ (e @ w["key"]) / math.sqrt(attention.KEY) + w["distance"][len(seen) - 1 - j] for j, e in enumerate(seen)]
            shares = [math.exp(v) for v in logits]
            looked = sum(a * (e @ w["value"]) for a, e in zip(shares, seen)) / sum(shares)
            h = [max(0.0, v) for v in np.concatenate([seen[-1], looked]) @ w["hidden"] + w["hidden_bias"]]
            group, member = divmod(int(targets[at + place]), attention.MEMBERS)
            want = 0.0
            for z, chosen in ((h @ w["group"] + w["group_bias"], group), (h @ w["member"][group] + w["member_bias"][group], member)):
                want += z[chosen] - math.log(sum(math.exp(v) for v in z))
            assert got[at + place] == pytest.approx(want, rel=1e-3, abs=1e-3)
        at += count


def test_training_takes_each_window_in_one_round(monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_IDS", 60)
    rng = np.random.default_rng(4)
    texts = [rng.permutation(1000)[:n].astype(np.uint16) for n in (5, 200, 1, 60, 33)]
    batches = [pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in texts[i:i + 2]], pa.binary())], ["codes"]) for i in (0, 2, 4)]
    found = [(tuple(y[r]), tuple(x[r])) for number in range(lm.ROUNDS) for x, y, real in lm.blocks(iter(batches), 1500, number) for x, y, r in zip(x, y, real)]
    pieces = [t[i:i + 60] for t in texts for i in range(0, len(t), 60)]
    want = []
    for p in pieces:
        for i in range(0, max(1, len(p) - attention.WINDOW + attention.STRIDE), attention.STRIDE):
            want.append((tuple(p[i:i + attention.WINDOW]), tuple([1500 if i == 0 else p[i - 1], *p[i:i + attention.WINDOW - 1]])))
    assert sorted(found) == sorted((y, x[:len(y)]) for y, x in want)


def test_every_training_document_reaches_the_weights(spark):
    """The words of one document the other way round leave all counts as they are, but not what the weights see."""
    rng = random.Random(9)
    texts = [" ".join(f"word{rng.randrange(200)}" for _ in range(150)) for _ in range(16)]
    learnt = [d for d in range(16) if brute.fold(d, 7) != 2]

    def scores(turned=None):
        frame = spark.createDataFrame([(d, " ".join(t.split()[::-1]) if d == turned else t) for d, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
        return {r["doc_id"]: r["score"] for r in collected(lm.lm_scores(frame))}

    plain = scores()
    for d in learnt[:3]:
        other = scores(d)
        assert max(abs(other[x] - plain[x]) for x in plain if x != d) > 1e-4, d


def test_word_cache_is_bounded(monkeypatch):
    w = subwords.WordIds(subwords.default_path())
    monkeypatch.setattr(subwords, "CACHE_BYTES", 3000)
    for i in range(200):
        assert w[f"word{i}".encode()] and w.held <= 3000 + 2 * (subwords.ENTRY + 100)
    assert len(w) < 20


def test_windows_score_every_place_once():
    counts = np.array([1, 5, attention.WINDOW, attention.WINDOW + 1, 100, 0, 3])
    places, real, scored = attention.windows(counts)
    assert sorted(places[scored].tolist()) == list(range(int(counts.sum())))
    # every scored place but a text's first few sees at least WINDOW - STRIDE places before it
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    rows, cols = np.nonzero(scored)
    assert (cols >= np.minimum(place[places[rows, cols]], attention.WINDOW - attention.STRIDE)).all() and len(text)


def test_chosen_windows_are_those_of_all():
    counts = np.array([1, 5, 0, attention.WINDOW + 1, 100, 3])
    order = np.random.default_rng(2).permutation(int(attention.window_counts(counts).sum()))[1::3]
    for whole, some in zip(attention.windows(counts), attention.windows(counts, order)):
        assert (whole[order] == some).all()


def test_gradients_by_group_against_all_classes():
    """The output layer's gradients, which come from one product a group, against a plain softmax over every class."""
    w, x, y = _tiny()
    w = {k: v.astype(np.float64) for k, v in w.items()}
    y[:] = np.where(y < 800, y, 7)  # some groups have no target, one has many
    real = np.random.default_rng(6).random(x.shape) < 0.8
    loss, g = attention.gradients(w, x, y, real)
    h = attention.forward(w, x)[0][real]
    want = {k: np.zeros_like(w[k]) for k in ("group", "group_bias", "member", "member_bias")}
    total = 0.0
    for state, target in zip(h, y[real].tolist()):
        i, j = divmod(target, attention.MEMBERS)
        for z, chosen, name, bias in ((state @ w["group"] + w["group_bias"], i, want["group"], want["group_bias"]),
                                      (state @ w["member"][i] + w["member_bias"][i], j, want["member"][i], want["member_bias"][i])):
            p = np.exp(z) / np.exp(z).sum()
            total -= math.log(p[chosen])
            p[chosen] -= 1
            name += np.outer(state, p) / len(h)
            bias += p / len(h)
    assert loss == pytest.approx(total / len(h), rel=1e-6)
    for name, expected in want.items():
        assert np.allclose(g[name], expected, atol=1e-7), name


def test_encoded_texts_against_the_tokenizer():
    texts = ["", "The cat, the CAT sat.", " \t", "na\u00efve \u4f60\u597d caf\u00e9 <|endoftext|> x", "cat", "it's 12 o'clock\u00a0now"]
    ids_of = subwords.word_ids(subwords.default_path())
    whole = Tokenizer.from_file(subwords.default_path())
    for _, data, offsets in lm.chunks(pa.record_batch([pa.array(texts)], ["text"])):
        found = lm.encoded(ids_of, lm.LOWER[data], offsets)
        got = [np.frombuffer(x, np.uint16).tolist() for x in lm.texts_of(found, found.ids.astype(np.uint16)).to_pylist()]
        want = [[i for word in brute.words(t) for i in whole.encode(word, add_special_tokens=False).ids] + [lm.END] for t in texts]
        assert [x[:-1] for x in got if x] == [x[:-1] for x in want] and all(x[-1] == lm.END for x in got)
        assert found.n_words.tolist() == [len(brute.words(t)) for t in texts]


def _tiny():
    rng = np.random.default_rng(0)
    w = attention.start(np.log(rng.dirichlet(np.ones(attention.GROUPS * attention.MEMBERS))))
    x, y = (rng.integers(0, attention.GROUPS * attention.MEMBERS, (4, attention.WINDOW)) for _ in range(2))
    return w, x, y


def test_attention_is_causal_and_normalised():
    w, x, _ = _tiny()
    h, _ = attention.forward(w, x)
    changed = x.copy()
    changed[:, 9:] = 3
    assert np.allclose(attention.forward(w, changed)[0][:, :9], h[:, :9], atol=1e-6)
    n = attention.GROUPS * attention.MEMBERS
    p = attention.log_probabilities(w, np.repeat(h[0, :1], n, 0), np.arange(n))
    assert np.exp(p.astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_attention_gradients():
    w, x, y = _tiny()
    w = {k: v.astype(np.float64) for k, v in w.items()}
    real = np.ones(x.shape, bool)
    real[2, 5:] = False
    _, g = attention.gradients(w, x, y, real)
    rng = np.random.default_rng(1)
    for name in w:
        for _ in range(4):
            flat = int(rng.choice(np.flatnonzero(np.abs(g[name]).ravel() > 1e-6)))
            at = np.unravel_index(flat, w[name].shape)
            sides = []
            for step in (1e-3, -1e-3):
                other = {k: v.copy() for k, v in w.items()}
                other[name][at] += step
                sides.append(attention.gradients(other, x, y, real)[0])
            assert (sides[0] - sides[1]) / 2e-3 == pytest.approx(g[name][at], rel=0.05, abs=1e-4)


# ------------------------------------------------------------------------------------------------ 3: licenses

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_license_base(docs, rows):
    got = {r["doc_id"]: r for r in collected(licenses.scan(docs))}
    for d, text, *_ in rows:
        w = ALNUM.findall((text or "").translate(brute.LOWER))
        places = [(i, label) for phrase, label in licenses.BASE for p in [phrase.split()] for i in range(len(w)) if w[i:i + len(p)] == p]
        r = got[d]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")


@pytest.mark.parametrize("text, label", [
    ("SPDX-License-Identifier: GPL-2.0-only", "gpl-2-only"), ("Mozilla Public License, v. 2.0", "mpl-2.0"), ("CC BY-SA 3.0", "cc-by-sa-3.0"),
    ("under the GNU Lesser General Public License version 2.1", "lgpl-2.1"), ("a BSD 3-Clause license", "bsd-3-clause"),
    ("https://creativecommons.org/licenses/by/4.0/", "cc-by-4.0"), ("dedicated to the public domain", "public-domain"), ("The Unlicense", "unlicense")])
def test_license_rules(text, label):
    scanner = licenses.Scanner()
    clean = b" ".join(text.encode().translate(licenses.SEPARATED).split()).decode()
    assert [scanner.rules[d.rule].label for d in scanner.detect(clean)] == [label]


def examples(items):
    """Texts that a parsed pattern matches: each branch and each option, repeats of least number or one more."""
    out = [""]
    for op, arg in items:
        if str(op) in ("LITERAL", "ANY"):
            more = [chr(arg) if str(op) == "LITERAL" else " "]
        elif str(op) == "IN":
            more = [chr(x) for kind, x in arg if str(kind) == "LITERAL"] or ["3"]
        elif str(op) in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, inner = arg
            more = [x * n for n in {least, min(most, least + 1)} for x in examples(inner)]
        elif str(op) == "SUBPATTERN":
            more = examples(arg[3])
        else:
            more = [x for b in arg[1] for x in examples(b)] if str(op) == "BRANCH" else [""]
        out = list(dict.fromkeys(x + y for x in out for y in more))[:3000]
    return out


def test_keywords_hide_no_rule():
    """The prefilter lets each rule see its own examples, so it finds what all rules without it find."""
    scanner = licenses.Scanner()
    for i, rule in enumerate(scanner.rules):
        found = [x for x in examples(re._parser.parse(rule.pattern)) if scanner.patterns[i].search(x)]
        assert found and all(rule.keyword in x for x in found), rule
        assert i in scanner.candidates(found[0]) and rule.label in {r.label for r, p in zip(scanner.rules, scanner.patterns) if p.search(found[0])}


@pytest.mark.parametrize("text, label", [
    ("ASL 2.0", "apache-2"), ("PSF license", "psf-2.0"), ("EUPL 1.2", "eupl-1.2"), ("for personal use only", "non-commercial"), ("Expat License", "mit"),
    ("Responsible AI License", "openrail"), ("Llama 3 Community Licence Agreement", "community-model"), ("X Consortium License", "x11"),
    ("Redistribution and use in source and binary forms", "bsd"), ("either version 3 of the License, or (at your option) any later version", "gpl")])
def test_phrases_without_other_words(text, label):
    scanner = licenses.Scanner()
    clean = b" ".join(text.encode().translate(licenses.SEPARATED).split()).decode()
    assert [scanner.rules[d.rule].label for d in scanner.detect(clean)] == [label]


def test_license_containment():
    scanner = licenses.Scanner()
    for text in ("licensed under the gnu general public license version 3 or any later version", "mit license mit license"):
        found = scanner.detect(text)
        for a in found:
            assert not any(b != a and b.first <= a.first and a.last <= b.last and (scanner.priority[b.rule] <= scanner.priority[a.rule]) for b in found)


def test_license_rules_are_many():
    assert len(licenses.RULES) >= 200 and all(re.compile(r.pattern) for r in licenses.RULES)


# ------------------------------------------------------------------------------------------------ 4: packing

def ids(text):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def test_packing(docs, rows):
    got = collected(packing.best_fit_packing(docs))
    by = defaultdict(dict)
    for r in got:
        by[r["doc_id"]][r["piece"]] = r
    for d, text, *_ in rows:
        want = ids(text)
        for k in range(0, len(want), 2048):
            own, r = want[k:k + 2048], by[d][k // 2048]
            assert (r["start"], r["length"]) == (k, len(own)) and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        assert len(by[d]) == -(-len(want) // 2048)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_best_fit_is_tightest():
    rng = random.Random(2)
    lengths = sorted((rng.randrange(1, 2049) for _ in range(600)), reverse=True)
    rooms, want = [], []
    for n in lengths:
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            room = min(fits)[0]
            which = [i for r, i in fits if r == room]
            want.append(room)
            rooms[which[0]] -= n
        else:
            want.append(2048)
            rooms.append(2048 - n)
    bins, offsets, fill = packing.best_fit(lengths)
    assert [2048 - o for o in offsets] == want and sorted(2048 - f for f in fill) == sorted(rooms)


def test_groups_are_packed_again(docs):
    pieces = packing.cut(docs)
    some = packing.pack(pieces, group_pieces=10)
    assert some.count() == pieces.count()
    one = packing.pack(pieces).select("sequence_id").distinct().count()
    assert some.select("sequence_id").distinct().count() <= one + 2


def test_subwords_match_the_library():
    w = subwords.WordIds(subwords.default_path())
    for text in ("Hello, World's 3.14 don't ÉTÉ áb İx ΣΣ 가나 <|endoftext|> x y !!?? naïve’s ..a b.. ΑΣ İ", "'s 'll it'S abc, ABC."):
        got = np.frombuffer(b"".join(w[x] for x in text.encode().split()), "<u4").tolist()
        assert got == ids(text)[:-1]


# ------------------------------------------------------------------------------------------------ 5: mixing

def test_mixing(docs, rows):
    got = {r["doc_id"]: r for r in collected(mixing.curriculum_mixing(docs))}
    sizes, source = Counter(), {}
    for d, text, _, s, _ in rows:
        sizes[s] += len(brute.words(text))
        source[d] = s
    want, taken = brute.targets(sizes), Counter()
    for d, r in got.items():
        s = source[d]
        assert r["size"] == len(brute.words(rows[d][1])) and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert got == {r["doc_id"]: r for r in collected(mixing.curriculum_mixing(docs.repartition(3)))}


def test_targets_are_capped(spark):
    sizes = {"a": 10, "b": 1000, "c": 50, "d": 0, None: 400}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    assert got == pytest.approx(brute.targets(sizes))


def test_positions_follow_the_schedule(spark):
    from pyspark.sql import functions as F
    for schedule in mixing.SCHEDULES:
        shares = spark.range(0, 101).select((F.col("id") / 100).alias("share"))
        got = [(r[0], r[1]) for r in shares.select("share", mixing.invert(F.col("share"), schedule)).collect()]
        grid = np.linspace(0, 1, 20001)
        demand = np.concatenate([[0], np.cumsum(np.diff(grid) * (np.interp(grid[1:], *zip(*schedule)) + np.interp(grid[:-1], *zip(*schedule))) / 2)])
        for share, time in got:
            assert np.interp(time, grid, demand) / demand[-1] == pytest.approx(share, abs=1e-6)


def test_mix_rows(docs, rows):
    out = mixing.mix(docs)
    got = collected(out)
    assert sum(r["mix_words"] for r in got) == pytest.approx(sum(len(brute.words(r[1])) for r in rows), abs=4)
    assert all(len(brute.words(r["text"])) == r["mix_words"] for r in got)
    positions = [r["mix_position"] for r in got]
    assert positions == sorted(positions)


# ------------------------------------------------------------------------------------------------ 6: passages

def test_passages_cover_repeats(docs, rows):
    got = collected(chaining.substring_dedup(docs))
    covered = defaultdict(set)
    for r in got:
        covered[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
        a, b = brute.words(rows[r["doc_id"]][1]), brute.words(rows[r["first_doc_id"]][1])
        assert r["first_doc_id"] < r["doc_id"] and r["end_word"] <= len(a) and r["first_end_word"] <= len(b)
        assert set(a[r["start_word"]:r["end_word"]]) & set(b[r["first_start_word"]:r["first_end_word"]])
        assert r["end_word"] - r["start_word"] >= 50 and r["identity"] >= 0.8
    for d, starts in brute.repeated_windows([(r[0], r[1]) for r in rows], 51).items():
        assert all(set(range(i, i + 51)) <= covered[d] for i in starts), d
    assert not set(covered) & {r[0] for r in rows[:60] if len(brute.words(r[1])) < 50}


def test_chains_and_covers_against_plain_python():
    """Scores by trying every predecessor; covers by sets of words."""
    rng = np.random.default_rng(12)
    for _ in range(60):
        at, of = rng.integers(0, 70, (2, int(rng.integers(1, 30))))
        order = sorted(range(len(at)), key=lambda i: (at[i], -of[i]))
        score = {}
        for i in order:
            ways = [score[j] - chaining.WORD_COST * (at[i] - at[j] + of[i] - of[j]) for j in score if at[j] < at[i] and of[j] < of[i]]
            score[i] = chaining.SEED_SCORE + max([0.0, *ways])
        found = chaining.chain(at, of)
        assert sorted(i for links in found for i in links) == list(range(len(at)))
        assert score[found[0][-1]] == pytest.approx(max(score.values()))
        seen, kept = set(), []
        for links in found:
            p = at[links].tolist()
            if len(found) == 1 or not all(x in seen and x + chaining.SEED_WORDS - 1 in seen for x in p):
                kept.append(links)
                for lo, hi in zip(p, [*p[1:], 0]):
                    seen.update(range(lo, hi if 0 <= hi - lo - chaining.SEED_WORDS < chaining.GAP_WORDS else lo + chaining.SEED_WORDS))
        assert chaining.uncovered(at, found) == kept


def test_lists_of_a_slice_of_a_table():
    table = pa.table({"at": pa.array([[1, 2], [], [5], [7, 8, 9]], pa.list_(pa.int32()))}).slice(1, 3)
    elements, bounds = chaining._lists(table, "at")
    assert [elements[lo:hi].tolist() for lo, hi in zip(bounds, bounds[1:])] == [[], [5], [7, 8, 9]]


def test_chain_is_optimal():
    rng = np.random.default_rng(5)
    for _ in range(40):
        n = int(rng.integers(2, 14))
        at, of = np.sort(rng.integers(0, 60, n)), rng.integers(0, 60, n)
        best = [chaining.SEED_SCORE] * n
        for i in sorted(range(n), key=lambda i: (at[i], -of[i])):
            for j in range(n):
                if at[j] < at[i] and of[j] < of[i]:
                    best[i] = max(best[i], best[j] + chaining.SEED_SCORE - chaining.WORD_COST * (at[i] - at[j] + of[i] - of[j]))
        links = chaining.chain(at, of)[0]
        value = chaining.SEED_SCORE * len(links) - chaining.WORD_COST * (at[links[-1]] - at[links[0]] + of[links[-1]] - of[links[0]])
        assert value == pytest.approx(max(best))
        assert all(at[a] < at[b] and of[a] < of[b] for a, b in zip(links, links[1:]))


def covered_by(spark, texts):
    """{doc_id: words in some reported passage} of texts numbered from 0."""
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = defaultdict(set)
    for r in collected(chaining.substring_dedup(frame)):
        out[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    return out


def fresh(name, n):
    return [f"{name}{i}" for i in range(n)]


@pytest.mark.parametrize("later, places", [
    (lambda p: p + fresh("x", 30) + p, [(0, 60), (90, 150)]), (lambda p: p[-45:] + fresh("x", 30) + p, [(75, 135)]),
    (lambda p: fresh("y", 9) + p[20:40] + fresh("x", 30) + p, [(59, 119)])])
def test_every_copy_in_a_document_is_found(spark, later, places):
    p = fresh("p", 60)
    found = covered_by(spark, [" ".join(fresh("a", 40) + p + fresh("b", 40)), " ".join(later(p))])
    assert all(set(range(lo, hi)) <= found[1] for lo, hi in places)


def test_a_quote_in_the_earlier_document_hides_nothing(spark):
    p = fresh("p", 60)
    found = covered_by(spark, [" ".join(p[15:] + fresh("x", 30) + p), " ".join(fresh("a", 9) + p)])
    assert set(range(9, 69)) <= found[1]


def test_parts_in_other_documents_hide_no_passage(spark):
    """Documents 1 to 4 hold only halves, so that neither the first nor the last holder of a seed holds all of it."""
    p, pad = fresh("p", 70), lambda i: fresh(f"f{i}x", 40)
    for halves in ((p[:40], p[30:]), (p[:48], p[22:])):
        texts = [pad(0) + halves[0], pad(1) + halves[1], pad(2) + p, pad(3) + halves[0] + pad(30), pad(4) + halves[1] + pad(40), pad(5) + p + pad(50)]
        found = covered_by(spark, [" ".join(t) for t in texts])
        assert set(range(40, 110)) <= found[5]


def test_a_long_run_needs_no_other_seed(spark):
    """Of each 57 words, many documents before and after the first holder have 49: most seeds of the last lead to those."""
    texts, places = [], []
    for i in range(40):
        p, pad = fresh(f"p{i}x", 57), lambda k: fresh(f"f{i}x{k}x", 12)
        parts = [p[j:j + 49] for j in (0, 3, 6, 8)]
        for k, held in enumerate([*parts, p, *parts, p]):
            texts.append(" ".join(pad(k) + held + pad(20 + k)))
        places.append(len(texts) - 1)
    found = covered_by(spark, texts)
    assert [d for d in places if not set(range(12, 69)) <= found[d]] == []


def test_spaced_matches_keep_ends_and_tile():
    at, of = np.concatenate([np.arange(5, 405), [900, 950], np.arange(0, 30)]), np.concatenate([np.zeros(402, int), np.full(30, 7)])
    kept = chaining.spaced(at, of, 43)
    for place, lo, hi in ((0, 5, 404), (7, 0, 29)):
        p = np.sort(at[kept & (of == place) & (at < 500)])
        assert (p[0], p[-1]) == (lo, hi) and np.diff(p).max() < 43 and len(p) <= 60
    assert kept[400:402].all()


def changed(rng, p, share):
    return [f"c{rng.random()}" if rng.random() < share else w for w in p]


def test_passages_with_changed_words_are_found(spark):
    """Held against brute force along the diagonal: a passage counts if 50 or more of its words match to 0.8."""
    rng = random.Random(2)
    texts, planted = [], []
    for n in (55, 80):
        for share in (0.05, 0.1, 0.15):
            for _ in range(25):
                p = fresh(f"p{len(texts)}x", n)
                q = changed(rng, p, share)
                if sum(a == b for a, b in zip(p, q)) >= 0.8 * n:
                    planted.append((len(texts) + 1, n, share))
                texts += [" ".join(fresh(f"a{len(texts)}x", 30) + p), " ".join(fresh(f"b{len(texts)}x", 30) + q)]
    found = covered_by(spark, texts)
    recall = {key: np.mean([len(found[d] & set(range(30, 30 + n))) > n / 2 for d, n, s in planted if (n, s) == key]) for key in {x[1:] for x in planted}}
    assert all(recall[n, s] >= least for n, s, least in ((55, 0.05, 0.9), (80, 0.05, 0.95), (55, 0.1, 0.8), (80, 0.1, 0.95), (80, 0.15, 0.75))), recall


def shifted(rng, p, share):
    """Half of the edits lose a word, the others insert one before it."""
    out = []
    for w in p:
        r = rng.random()
        out += [] if r < share / 2 else [f"i{rng.random()}", w] if r < share else [w]
    return out


def test_passages_with_inserted_and_lost_words_are_found(spark):
    rng = random.Random(5)
    texts, planted = [], []
    for n in (60, 80, 120):
        for share in (0.05, 0.1, 0.15):
            for _ in range(25):
                q = shifted(rng, p := fresh(f"p{len(texts)}x", n), share)
                if len(q) >= 54:
                    planted.append((len(texts) + 1, n, share, len(q)))
                texts += [" ".join(fresh(f"a{len(texts)}x", 30) + p), " ".join(fresh(f"b{len(texts)}x", 30) + q)]
    found = covered_by(spark, texts)
    recall = {key: np.mean([len(found[d] & set(range(30, 30 + m))) > m / 2 for d, n, s, m in planted if (n, s) == key]) for key in {x[1:3] for x in planted}}
    assert all(recall[key] >= (0.85 if key == (60, 0.15) else 0.9) for key in recall), recall


def test_extension_is_the_best_alignment():
    """Against all prefixes by dynamic programming: matches score 1, edits -2."""
    rng = random.Random(8)
    for _ in range(200):
        a = [rng.randrange(1000) for _ in range(rng.randrange(0, 40))]
        b = [f for x in a for f in ([] if rng.random() < 0.06 else [rng.randrange(1000), x] if rng.random() < 0.06 else [rng.randrange(1000)] if rng.random() < 0.06 else [x])]
        score = {(i, 0): -2 * i for i in range(len(a) + 1)} | {(0, j): -2 * j for j in range(len(b) + 1)}
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                score[i, j] = max(score[i - 1, j] - 2, score[i, j - 1] - 2, score[i - 1, j - 1] + (1 if x == y else -2))
        i, j, same = chaining.extend(a, b)
        want = max(score.values())
        kept, chaining.DROP = chaining.DROP, 1000
        try:
            i, j, same = chaining.extend(a, b)
        finally:
            chaining.DROP = kept
        assert score[i, j] == want and 0 <= same <= min(i, j)


def test_dropped_passages(docs, odd):
    before = {r["doc_id"]: r["text"] for r in collected(docs)}
    after = {r["doc_id"]: r["text"] for r in collected(chaining.drop_passages(docs))}
    assert after.keys() == before.keys()
    assert not brute.repeated_windows([(d, t) for d, t in after.items()], 60)
    first = [d for d, t in before.items() if t and after[d] == t]
    assert 60 in first and 61 not in first  # the long text and its copy
    assert chaining.drop_passages(odd).columns == odd.columns and chaining.drop_passages(odd).count() == odd.count()


# ------------------------------------------------------------------------------------------------ 7: search

@pytest.mark.parametrize("n, dims", [(300, 64), (40, 64), (120, 10)])
def test_top_k(spark, n, dims):
    rng = np.random.default_rng(n)
    centres = rng.standard_normal((8, dims))
    x = centres[rng.integers(0, 8, n)] + rng.standard_normal((n, dims)) * 0.4
    x[n // 2:n // 2 + 20] = x[0]
    data = [(i, [float(v) for v in x[i]], 0) for i in range(n)] + [(None, [1.0] * dims, 0), (20 * n, None, 1)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    codes = {r.id: r.code % 2**64 for r in hamming.coded(vectors).collect()}
    want = {(q, i, bin(codes[q] ^ codes[i]).count("1"), k) for q in codes if q % 20 == 0
            for k, i in enumerate(sorted(codes, key=lambda i: (bin(codes[q] ^ codes[i]).count("1"), i))[:10], 1)}
    assert {tuple(r) for r in hamming.exact_top_k(vectors).collect()} == want
    if dims == 64:
        assert all(codes[i] == sum(1 << b for b in range(64) if x[i, b] > 0) for i in range(n))


def nearest(codes, ids, query, k):
    apart = np.bitwise_count(codes ^ query).astype(int)
    order = np.lexsort((ids, apart))[:k]
    return apart[order].tolist(), ids[order].tolist()


@pytest.mark.parametrize("n, k", [(3, 10), (700, 10), (5000, 3), (40_000, 10)])
def test_grown_radii_miss_nothing(n, k):
    """One block against all distances: random, near and repeated codes, with and without a bound."""
    rng = np.random.default_rng(n)
    codes = np.unique(np.concatenate([rng.integers(0, 2 ** 64, n, np.uint64), *(np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 64, n // 9, np.uint64)) for _ in range(2))]))
    rng.shuffle(codes)
    number = rng.integers(1, 4, len(codes)).astype(np.uint16)
    ids = rng.permutation(int(number.sum()))
    starts = np.cumsum(number, dtype=int) - number
    ids = np.concatenate([np.sort(ids[a:a + c]) for a, c in zip(starts, number)])
    index = hamming.SegmentIndex(codes, number, ids[starts], hamming.segments(n))
    each = np.repeat(codes, number)
    for query in [*codes[:40], np.uint64(77), np.uint64(0), np.uint64(2 ** 64 - 1), *rng.integers(0, 2 ** 64, 20, np.uint64)]:
        apart, near = nearest(each, ids, query, k)
        for bound in (64, apart[-1], min(63, apart[-1] + 2)):
            rows, dist = index.search(query, k, bound)
            got = sorted((int(d), int(i)) for r, d in zip(rows, dist) for i in ids[starts[r]:starts[r] + number[r]])[:k]
            assert got == list(zip(apart, near))
        rows, dist = index.search(query, k, only_first=True)
        assert all(np.bitwise_count(codes[rows] ^ query) == dist) and len(set(rows.tolist())) == len(rows)


def test_top_k_of_blocks(spark, monkeypatch):
    """Blocks and chunks of the index and the queries give what one block gives."""
    rng = np.random.default_rng(9)
    codes = np.concatenate([rng.integers(-2 ** 63, 2 ** 63, 400), np.full(30, 5), 5 ^ (1 << rng.integers(0, 60, 90))])
    rows = spark.createDataFrame([(int(i), int(c)) for i, c in enumerate(codes)], "id long, code long")
    want = {(q, i, d, r) for q in range(0, len(codes), 20)
            for r, (d, i) in enumerate(zip(*nearest(codes.astype(np.uint64), np.arange(len(codes)), codes.astype(np.uint64)[q], 10)), 1)}
    monkeypatch.setattr(hamming, "BLOCK", 60)
    monkeypatch.setattr(hamming, "CHUNK", 5)
    assert {tuple(r) for r in hamming.top_k(rows, rows.filter("id % 20 = 0")).collect()} == want


def test_top_k_runs_as_few_jobs_for_far_codes(spark):
    """The radii grow in the tasks: the driver starts no job and plans no masks for a radius."""
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, int(c)) for i, c in enumerate(rng.integers(-2 ** 63, 2 ** 63, 300))], "id long, code long")
    spark.sparkContext.setJobGroup("far", "far")
    try:
        assert hamming.top_k(rows, rows.filter("id % 20 = 0")).count() == 150
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("far")) < 30
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_top_k_of_nothing(spark):
    assert hamming.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ------------------------------------------------------------------------------------------------ 8: fingerprints

def edits(rows):
    """{doc_id: edited text} for unique ids."""
    ordered = sorted((r[0], r[1] or "") for r in rows)
    out = {}
    for i, (d, text) in enumerate(ordered):
        after, k = ordered[(i + 1) % len(ordered)][1], len(text) // 4
        out[d] = text[:len(text) - k] + after[:k]
    return out


@pytest.mark.parametrize("block", [1, 7, 512])
def test_fingerprints(docs, rows, block, monkeypatch):
    monkeypatch.setattr(syncmers, "BLOCK_ROWS", block)
    monkeypatch.setattr(syncmers.in_order, "__defaults__", (block,))
    got = {r["doc_id"]: r for r in collected(syncmers.fingerprints(docs))}
    want = edits(rows)
    assert got.keys() == want.keys()
    by_text = {}
    for d, text, *_ in rows:
        r, text = got[d], text or ""
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(want[d].encode()).hexdigest()
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert r["fingerprint"] == syncmers.fingerprint(syncmers.anchors(text.encode()))
        assert r["edited_fingerprint"] == syncmers.fingerprint(syncmers.anchors(want[d].encode()))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if want[d] == text:
            assert r["near_edited"] == 1
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.6 > 0.3 > np.mean([r["near_next"] for r in got.values()])


def test_syncmers_are_closed():
    rng = random.Random(4)
    text = "".join(rng.choice("abcd ") for _ in range(300)).encode()

    def order(s):
        h = int.from_bytes(s, "little") * 0x9E3779B1 % 2**32
        h ^= h >> 15
        h = h * 0x85EBCA77 % 2**32
        return h ^ (h >> 13)

    want = set()
    for i in range(len(text) - syncmers.K + 1):
        inner = [order(text[j:j + syncmers.S]) for j in range(i, i + syncmers.K - syncmers.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            want.add(text[i:i + syncmers.K])
    hashes, places = syncmers.anchors(text, 10**6)
    assert {text[p:p + syncmers.K] for p in places.tolist()} == want and len(hashes) == len(want)
    assert all(text.find(text[p:p + syncmers.K]) == p for p in places.tolist())


# ------------------------------------------------------------------------------------------------ 9 and 10: classifiers

def test_toxicity_ignores_neutral_mentions(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(600):
        group, bad = rng.choice(["muslim", "christian", "jewish"]), rng.random() < 0.3
        group = "muslim" if bad and rng.random() < 0.8 else group  # the sample mentions one group in toxic texts far more often
        w = [f"w{rng.randrange(50)}" for _ in range(20)] + [group] + (["scum"] if bad and rng.random() < 0.9 else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w), "en", "s", 1))
        marks.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = toxicity.learn(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    weight = dict(zip(model.words.tolist(), model.weights.tolist()))
    terms = [weight.get(h, 0.0) for h in toxicity.hash_of(["muslim", "christian", "jewish"]).tolist()]
    assert max(terms) - min(terms) < 0.15 * weight[int(toxicity.hash_of(["scum"])[0])]
    out = {r.doc_id: r for r in toxicity.toxicity(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    held = [(out[d].predicted, y) for d, _, y in marks if out[d].held_out]
    assert np.mean([p == y for p, y in held]) > 0.9 and all(out[d].held_out == (brute.fold(d, 5) == 0) for d in out)


def test_field_passes_match_enumeration():
    rng = np.random.default_rng(0)
    first = np.array([0, 3, 3, 7, 8])
    x = rng.standard_normal((8, quality.N_FEATURES)).astype(np.float32)
    field = quality.Field(rng.standard_normal(quality.N_FEATURES) * 0.2, rng.standard_normal(2), rng.standard_normal((2, 2)), 1.0, 0.0, 0.5)
    got = field.lines(x, first)
    e = x @ field.weights
    for lo, hi in zip(first[:-1], first[1:]):
        total, good = 0.0, np.zeros(hi - lo)
        for code in range(1 << (hi - lo)):
            states = [code >> i & 1 for i in range(hi - lo)]
            z = sum(e[lo + i] for i, s in enumerate(states) if s) + (field.start[states[0]] if states else 0)
            z += sum(field.move[a, b] for a, b in zip(states, states[1:]))
            total += np.exp(z)
            good += np.exp(z) * np.array(states)
        if hi > lo:
            assert got[lo:hi] == pytest.approx(good / total, abs=1e-4)


def test_quality_learns_junk(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(400):
        bad = rng.random() < 0.3
        lines = [" ".join(f"word{rng.randrange(300)}" for _ in range(rng.randrange(5, 15))) + "." for _ in range(rng.randrange(2, 8))]
        if bad:
            lines = [x.upper().replace(" ", "!! ") for x in lines[:-1]] + lines[-1:]
        rows.append((i, "\n".join(lines), "en", "s", 1))
        marks.append((i, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    held = [(out[d].predicted, y) for d, y, _ in marks if out[d].held_out]
    assert np.mean([p == y for p, y in held]) > 0.95
    lines = quality.line_marginals(docs, quality.learn(docs, labels)).collect()
    assert all(0 <= r.good <= 1 for r in lines) and len(lines) == sum(len(r[1].split("\n")) for r in rows)


# ------------------------------------------------------------------------------------------------ odd and empty tables

OPERATORS = {
    "jaccard": lambda d, l: jaccard.ngram_jaccard(d), "lm": lambda d, l: lm.lm_scores(d), "licenses": lambda d, l: licenses.scan(d),
    "detections": lambda d, l: licenses.detections(d), "packing": lambda d, l: packing.best_fit_packing(d), "mixing": lambda d, l: mixing.curriculum_mixing(d),
    "mix": lambda d, l: mixing.mix(d), "passages": lambda d, l: chaining.substring_dedup(d), "fingerprints": lambda d, l: syncmers.fingerprints(d),
    "toxicity": toxicity.toxicity, "quality": quality.quality}
PER_ROW = {"jaccard", "lm", "licenses", "mixing", "fingerprints", "toxicity", "quality"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, labels, name):
    got = collected(OPERATORS[name](odd, labels))
    if name in PER_ROW:
        assert Counter(r["doc_id"] for r in got) == Counter(r.doc_id for r in odd.select("doc_id").collect())
    if name == "packing":
        assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(r.doc_id for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, labels, name):
    assert OPERATORS[name](empty, labels).count() == 0


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_no_labels(docs, labels, operator):
    got = collected(operator(docs, labels.limit(0)))
    assert len(got) == docs.count() and len({r["score"] for r in got}) == 1
