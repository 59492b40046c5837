"""Substring dedup by collinear chaining: fuzzy passages that a document shares with an earlier one.

Seeds are six-word runs chosen as minimizers (the run of least hash among SPACING neighbours), so equal passages give
equal seeds wherever they stand. All occurrences of a seed meet in one group; each is matched with the first place in
the seed's first document (least id) and the last place in the document just before its own, never with all others, so
a passage in n documents costs 2 n matches. Second and later occurrences within a document are matched by their number
as well, for text that repeats one phrase. Matches of a pair of documents are chained: a chain's score is its seeds' less a cost for every word
in between, and a Fenwick tree over places in the earlier document finds the best chain to extend in logarithmic time.
Chains are aligned on the words of both documents: seeds are fixed, gaps are aligned by dynamic programming, ends are
extended while they match. An alignment with enough words and identity is a repeated passage.

Words of a document are needed for each of its chains. Text rows and chains are sorted together by document, text
first, so each text is read once for all its chains; a document with very many chains is dealt to several tasks.

Defined cases: texts under ``min_words`` words (or null) have no passages; a null doc_id takes no part; rows of one
doc_id with different texts are documents of their own, equal rows count once; a passage repeated within one document
only is left alone; an empty table gives an empty result; other columns are ignored (kept by ``drop_passages``).
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .jaccard import whole_groups
from .tables import batch, broadcast_if, sized, store
from .text import LOWER, chunks, gram_hashes, run_hashes, strings, word_hashes, word_spans

SEED_WORDS, SPACING = 6, 8
MIN_WORDS, IDENTITY = 50, 0.8
#: Words of the longer runs that a shared seed begins, beside the two of nearly ``min_words`` words.
RUN_WORDS = 16
#: Words kept on either side of a seed, and how many of them must match for a seed to be a chain by itself: place by place, or
#: with words beyond an inserted or lost one moved by a place (chance matches are then three times as many).
SIDE, SIDE_MATCHES, MOVED_MATCHES = 8, 9, 11
#: Why a match may be a chain by itself: words beside it match, or only the long run that it begins.
BESIDE, LONG = 2, 1
#: Score of a seed, and cost of a word between two seeds in either document.
SEED_SCORE, WORD_COST = 6.0, 0.1
#: Words fetched beyond a chain's ends, how far an extension may fall below its best, and how many more words it may insert than lose, or lose than insert.
MARGIN, DROP, BAND = 64, 6, 8
#: A gap of this many words of which fewer than half match separates two passages.
GAP_WORDS = 16
#: Chains of one document that a task takes at once.
TASK_CHAINS = 20_000


def least_of(h: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Flags of the hashes that are least in some window of SPACING that lies in one text.

    ``inside`` counts, for each place, the places left in its text, itself included."""
    n = len(h)
    if n < SPACING:
        return np.zeros(n, bool)
    least, reach = h, 1
    while reach < SPACING:  # SPACING is a power of two
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    windows = np.zeros(n + SPACING - 1, np.uint64)  # windows[i + SPACING - 1] starts at i
    windows[SPACING - 1:SPACING - 1 + len(least)] = np.where(inside[:len(least)] >= SPACING, least, 0)
    top, reach = windows, 1
    while reach < SPACING:
        top = np.maximum(top[:-reach], top[reach:])
        reach *= 2
    return top[:n] == h


def long_run(min_words: int) -> int:
    """Words of the run by which a match is LONG."""
    return max(SEED_WORDS + 1, min_words - SPACING + 1)


def run_lengths(min_words: int) -> list[int]:
    """Lengths of the longer runs. Each place where ``min_words`` words are shared holds a whole run of the second length
    that starts with a seed, and each of SPACING - 1 words more one of ``min_words``."""
    return sorted({max(x, SEED_WORDS + 1) for x in (RUN_WORDS, long_run(min_words), min_words)})


def text_seeds(data: np.ndarray, offsets: np.ndarray, min_words: int = MIN_WORDS):
    """(text number, first word, hash, nth, sides, runs) of the seeds of all texts of at least ``min_words`` words.

    ``nth`` counts the occurrences of a seed in its text from 0, so runs that repeat one phrase can also match in order.
    ``sides`` has four bits of each of the SIDE words before and after the seed, 0 beyond the text.
    ``runs`` are hashes, of 32 bits beside the seed's 64, of the longer runs of words that the seeds begin, one array for
    each of ``run_lengths``; a run beyond the end of the text is masked."""
    starts, ends, first = word_spans(data, offsets)
    counts = np.diff(first)
    words = word_hashes(LOWER[data], starts, ends)
    grams, n = gram_hashes(words, first, SEED_WORDS)
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(grams)) - np.repeat(np.cumsum(n) - n, n)
    chosen = least_of(grams, n[text] - place) & (counts[text] >= min_words)
    text, place, grams = text[chosen], place[chosen], grams[chosen]
    order = np.lexsort((place, grams, text))
    again = np.zeros(len(order), bool)
    again[1:] = (grams[order][1:] == grams[order][:-1]) & (text[order][1:] == text[order][:-1])
    run = np.arange(len(order))
    nth = np.empty(len(order), np.int64)
    nth[order] = run - np.maximum.accumulate(np.where(again, 0, run))
    bits = words % np.uint64(15) + np.uint64(1)
    sides = np.zeros(len(text), np.uint64)
    for i, step in enumerate([*range(-SIDE, 0), *range(SEED_WORDS, SEED_WORDS + SIDE)]):
        here = (place + step >= 0) & (place + step < counts[text])
        sides[here] |= bits[(first[text] + place + step)[here]] << np.uint64(4 * i)
    runs = []
    for length in run_lengths(min_words):
        fits = place + length <= counts[text]
        runs.append(pa.array(run_hashes(words, np.where(fits, first[text] + place, 0), np.where(fits, length, 0)).view(np.int64).astype(np.int32), mask=~fits))
    return text, place, grams, nth, sides.view(np.int64), runs


def chain(at: np.ndarray, of: np.ndarray) -> list[list[int]]:
    """Chains of matches (indices), best first; ``at`` and ``of`` increase strictly along a chain, and no match is in two.

    The best predecessor of a match maximises score + cost * (its places), because gap costs add up over places."""
    order = np.lexsort((-of, at))  # of equal ``at``, greater ``of`` first: they can't precede each other
    ranks = np.unique(of, return_inverse=True)[1]
    score, previous = [0.0] * len(at), [-1] * len(at)
    values = (WORD_COST * (at + of)).tolist()
    # a Fenwick tree of prefix maxima of (value, which) over ranks
    best, size = [(-1e18, -1)] * (int(ranks.max()) + 2), int(ranks.max()) + 2
    for i, rank in zip(order.tolist(), ranks[order].tolist()):
        found, place = best[0], rank
        while place > 0:
            if best[place] > found:
                found = best[place]
            place -= place & -place
        here = values[i]
        gain = found[0] - here
        if gain > 0:
            score[i], previous[i] = SEED_SCORE + gain, found[1]
        else:
            score[i] = SEED_SCORE
        found, place = (score[i] + here, i), rank + 1
        while place < size:
            if best[place] < found:
                best[place] = found
            place += place & -place
    used, found = [False] * len(at), []
    for i in sorted(range(len(at)), key=score.__getitem__, reverse=True):
        if used[i]:
            continue
        links = []
        while i >= 0 and not used[i]:
            used[i] = True
            links.append(i)
            i = previous[i]
        found.append(links[::-1])
    return found


def common(a: list, b: list) -> int:
    """Words in common, in order, of two short runs: place by place if that explains most of them, else by dynamic programming."""
    same = sum(map(eq, a, b))
    # of equally long runs, another alignment leaves a word out on either side
    if len(a) == len(b) and (same >= len(a) - 1 or 5 * same >= 4 * len(a)) or not len(a) or not len(b) or len(a) * len(b) > 1 << 14:
        return same
    row, b = np.zeros(len(b) + 1, np.int64), np.array(b, np.uint64)
    for x in np.array(a, np.uint64):
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return int(row[-1])


def extend(a: list, b: list) -> tuple[int, int, int]:
    """(words of a, words of b, matches) by which two runs go on together from their starts, with changed, inserted and lost words.

    For each number of edits the furthest place on every diagonal is kept; a match scores 1 and an edit -2, and diagonals
    more than DROP below the best, or more than BAND from the first, are given up."""
    n, m = len(a), len(b)
    i = 0
    while i < n and i < m and a[i] == b[i]:
        i += 1
    # a way is (place in a, matches) as one number; ways[k + off] is that of diagonal k, -1 if it has none
    one, off, mask = 1 << 32, BAND + 1, (1 << 32) - 1
    best, end, cost = i, (i, i, i), 0
    ways = [-1] * (2 * off + 1)
    ways[off] = i * one + i
    low = high = off
    while low <= high:
        cost += 2
        ahead, low, high, risen = [-1] * (2 * off + 1), max(low - 1, 1), min(high + 1, off + BAND), False
        for at in range(low, high + 1):
            k = at - off
            now, way = -1, ways[at]  # a changed word
            if way >= 0 and way >> 32 < n and (way >> 32) + k < m:
                now = way + one
            way = ways[at - 1]  # a word only b has
            if way > now and (way >> 32) + k <= m:
                now = way
            way = ways[at + 1]  # a word only a has
            if way >= 0 and way + one > now and way >> 32 < n:
                now = way + one
            if now < 0:
                continue
            i = now >> 32
            j = i + k
            if i < n and j < m and a[i] == b[j]:
                first = i
                i, j = i + 1, j + 1
                while i < n and j < m and a[i] == b[j]:
                    i += 1
                    j += 1
                now += (i - first) * (one + 1)
            gain = (now & mask) - cost
            if gain > best:
                best, end, risen = gain, (i, j, now & mask), True
            if gain >= best - DROP:
                ahead[at] = now
        ways = ahead
        if risen:
            ways = [way if way >= 0 and (way & mask) - cost >= best - DROP else -1 for way in ways]
        while low <= high and ways[low] < 0:
            low += 1
        while low <= high and ways[high] < 0:
            high -= 1
    return end


def passages(a: np.ndarray, b: np.ndarray, at: np.ndarray, of: np.ndarray, min_words: int, identity: float):
    """Aligned passages (a start, a end, b start, b end, matches) around chained seeds at ``at`` in a and ``of`` in b."""
    found, i = [], 0
    a, b, at, of = a.tolist(), b.tolist(), at.tolist(), of.tolist()
    while i < len(at):
        a0, b0, a1, b1 = at[i], of[i], at[i] + SEED_WORDS, of[i] + SEED_WORDS
        matches, j = SEED_WORDS, i + 1
        while j < len(at):
            p, q = at[j], of[j]
            if p - a1 == q - b1 and p < a1:  # the next seed overlaps on the same diagonal
                grown = p + SEED_WORDS - a1
                if grown > 0:
                    matches, a1, b1 = matches + grown, a1 + grown, b1 + grown
            else:
                gap_a, gap_b = max(0, p - a1), max(0, q - b1)
                inner = common(a[a1:a1 + gap_a], b[b1:b1 + gap_b])
                if max(gap_a, gap_b) >= GAP_WORDS and 2 * inner < max(gap_a, gap_b):
                    break
                matches += inner + SEED_WORDS - max(0, a1 - p, b1 - q)
                a1, b1 = max(a1, p + SEED_WORDS), max(b1, q + SEED_WORDS)
            j += 1
        more, also, same = extend(a[a1:], b[b1:])
        a1, b1, matches = a1 + more, b1 + also, matches + same
        more, also, same = extend(a[:a0][::-1], b[:b0][::-1])
        a0, b0, matches = a0 - more, b0 - also, matches + same
        if a1 - a0 >= min_words and matches >= identity * max(a1 - a0, b1 - b0):
            found.append((a0, a1, b0, b1, matches))
        i = j
    return found


# ---------------------------------------------------------------------------------------------- Spark

def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, part, text): part tells rows of one doc_id with different texts apart, and is 0 if no id is repeated."""
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    total, ids = rows.agg(F.count("doc"), F.count_distinct("doc")).first()
    if total == ids:
        return rows.withColumn("part", F.lit(0))
    return rows.withColumn("part", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 31)).cast("int"))


def _differing(x: Column, y: Column) -> Column:
    """A bit for each of the words beside two seeds that differ."""
    other = x.bitwiseXOR(y)
    other = other.bitwiseOR(F.shiftrightunsigned(other, 1))
    return other.bitwiseOR(F.shiftrightunsigned(other, 2)).bitwiseAND(F.lit(0x1111111111111111))


def _partners(seeds: DataFrame, finer: list[tuple[str, Column]], long: str) -> DataFrame:
    """(doc, part, at, first_doc, first_part, of, alone): each occurrence in a later document with the first place of its
    key's first document and the last place of the document just before its own.

    The keys are the seed and, where the condition holds, the seed with each of the ``finer`` columns. All of them keep
    the rows of a seed together, so the windows follow one shuffle; a place found by several keys is passed on once. Where
    the column ``long`` is equal too, a match needs no words beside it: no other seed of the passage may lead to that place."""
    here = F.struct("doc", "part", "at", "sides", long)
    out = seeds.withColumn("to", F.lit(None).cast(f"array<{seeds.select(here.alias('h')).schema['h'].dataType.simpleString()}>"))
    for key, holds in [(["seed"], F.lit(True)), *((["seed", name], holds) for name, holds in finer)]:
        ordered = Window.partitionBy(*key).orderBy("doc", "part", "at")
        # frames end at the current row, so a group is read once in order and never held
        past = ordered.rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({"first": F.first(here).over(past), "before": F.lag(here).over(ordered)})
        entered = F.when((F.col("before.doc") != F.col("doc")) | (F.col("before.part") != F.col("part")), F.col("before"))
        out = out.withColumn("prior", F.last(entered, ignorenulls=True).over(past)).drop("before")
        later = holds & ((F.col("first.doc") != F.col("doc")) | (F.col("first.part") != F.col("part")))
        known = F.coalesce("to", F.array().cast(out.schema["to"].dataType))
        out = out.withColumn("to", F.when(later, F.array_distinct(F.concat(known, F.array("first", "prior")))).otherwise(F.col("to"))).drop("first", "prior")
    pairs = out.withColumn("to", F.explode("to"))
    own, to = F.col("sides"), F.col("to.sides")
    # a word inserted or lost beside the seed moves those beyond it by one place
    straight = _differing(own, to)
    moved = straight.bitwiseAND(_differing(own, F.shiftleft(to, 4))).bitwiseAND(_differing(own, F.shiftrightunsigned(to, 4)))
    beside = (F.bit_count(straight) <= 2 * SIDE - SIDE_MATCHES) | (F.bit_count(moved) <= 2 * SIDE - MOVED_MATCHES)
    alone = F.when(beside, BESIDE).when(F.col(long) == F.col("to")[long], LONG).otherwise(0).cast("byte")
    return pairs.select("doc", "part", "at", F.col("to.doc").alias("first_doc"), F.col("to.part").alias("first_part"), F.col("to.at").alias("of"), alone.alias("alone"))


def matches(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, part, at, first_doc, first_part, of, alone): seeds shared with an earlier document, and whether they may be a chain alone (BESIDE, LONG or 0).

    They are matched by gram, by number of the gram for periodic text, and by the longer runs they begin: documents that
    hold only parts of a passage take its single seeds, but not its long runs."""
    lengths = [f"run{x}" for x in run_lengths(min_words)]

    def run(batches):
        for table in batches:
            for own, data, offsets in chunks(table):
                text, place, grams, nth, sides, runs = text_seeds(data, offsets, min_words)
                where = pa.array(text)
                yield batch(["seed", "nth", "doc", "part", "at", "sides", *lengths], grams.astype(np.int64), nth.astype(np.int32), own.column(0).take(where),
                            own.column(1).take(where), place.astype(np.int32), sides, *runs)

    seeds = rows.select("doc", "part", "text").mapInArrow(run, "seed long, nth int, doc long, part int, at int, sides long" + "".join(f", {x} int" for x in lengths))
    group = Window.partitionBy("seed").orderBy("doc", "part", "at")
    near = seeds.withColumns({"__before": F.lag("doc").over(group), "__after": F.lead("doc").over(group)})
    shared = near.filter("__before is not null or __after is not null").drop("__before", "__after")
    return _partners(shared, [("nth", F.col("nth") > 0), *((name, F.col(name).isNotNull()) for name in lengths)], f"run{long_run(min_words)}")


CHAIN = "doc long, part int, first_doc long, first_part int, at array<int>, of array<int>"


def uncovered(at: np.ndarray, found: list[list[int]]) -> list[list[int]]:
    """Chains, best first, without those whose places lie among the seeds of a better one."""
    if len(found) == 1:
        return found
    seen, out, at = bytearray(int(at.max()) + SEED_WORDS), [], at.tolist()
    for links in found:
        p = [at[i] for i in links]
        if all(seen[x] and seen[x + SEED_WORDS - 1] for x in p):
            continue
        out.append(links)
        for lo, hi in zip(p, [*p[1:], 0]):
            end = hi if 0 <= hi - lo - SEED_WORDS < GAP_WORDS else lo + SEED_WORDS
            seen[lo:end] = b"\1" * (end - lo)
    return out


def spaced(at: np.ndarray, of: np.ndarray, run: int) -> np.ndarray:
    """Which of a pair's LONG matches are needed: of a periodic stretch that meets one place, its ends and one in each stretch of a quarter of a run of ``run`` words.

    Places at most that far apart that begin equal runs have a common period, so the words around all but those near the
    ends are the same; passages from the places kept overlap."""
    reach = run // 2
    order = np.lexsort((at, of))
    p, q = at[order], of[order]
    new = np.ones(len(p), bool)
    new[1:] = (q[1:] != q[:-1]) | (p[1:] - p[:-1] > reach)
    starts = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    first, last = p[starts][which], p[np.append(starts[1:], len(p)) - 1][which]
    block = (p - first) // max(1, reach // 2)
    opens = new.copy()
    opens[1:] |= block[1:] != block[:-1]
    keep = np.zeros(len(p), bool)
    keep[order] = opens | (p - first < SPACING) | (last - p < SPACING)
    return keep


def chains(found: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Chains of one seed or more; whether a chain reaches enough words shows in its alignment.

    A seed is a chain by itself if words beside it match too, or the long run that it begins: other runs of SEED_WORDS that
    texts have in common are many."""
    keys = ["doc", "part", "first_doc", "first_part"]

    def run(batches):
        for table in whole_groups(batches, keys):
            columns = [table[k].to_numpy() for k in keys]
            at, of = table["at"].to_numpy().astype(np.int64), table["of"].to_numpy().astype(np.int64)
            alone = table["alone"].to_numpy()
            change = np.zeros(len(at), bool)
            change[0] = True
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            new = change.copy()  # a match may be found in several ways
            new[1:] |= (at[1:] != at[:-1]) | (of[1:] != of[:-1])
            columns, at, of, change, alone = [c[new] for c in columns], at[new], of[new], change[new], alone[new]
            starts = np.flatnonzero(change)
            ends = np.append(starts[1:], len(at))
            # where both places only grow, in steps that cost less than a seed scores, all matches are one chain
            steps = np.ones(len(at), bool)
            steps[1:] = (at[1:] > at[:-1]) & (of[1:] > of[:-1]) & (WORD_COST * (at[1:] - at[:-1] + of[1:] - of[:-1]) < SEED_SCORE)
            plain = np.logical_and.reduceat(steps | change, starts)
            worth = (ends > starts + 1) | (alone[starts] > 0)
            out = []
            for lo, hi, one in zip(starts[worth].tolist(), ends[worth].tolist(), plain[worth].tolist()):
                p, q, why = at[lo:hi], of[lo:hi], alone[lo:hi]
                linked = [list(range(hi - lo))] if one else uncovered(p, chain(p, q))
                single = np.array([x[0] for x in linked if len(x) == 1 and why[x[0]] == LONG], np.int64)
                needed = set(single[spaced(p[single], q[single], long_run(min_words))].tolist()) if len(single) else ()
                for links in linked:
                    if len(links) == 1 and why[links[0]] != BESIDE and links[0] not in needed:
                        continue
                    out.append((*(int(c[lo]) for c in columns), p[links].tolist(), q[links].tolist()))
            if out:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield batch([*keys, "at", "of"], *(pa.array(c, t) for c, t in zip(zip(*out), types)))

    dealt = found.repartition("doc", "first_doc").sortWithinPartitions(*keys, "at", "of")
    return dealt.select(*keys, "at", "of", "alone").mapInArrow(run, CHAIN)


def with_words(rows: DataFrame, requests: DataFrame, key: tuple[str, str], use, schema: str) -> DataFrame:
    """Run ``use(table of requests, word hashes of their document)`` for all requests of each document.

    ``requests`` names its document in the columns ``key``. Text rows and requests of a document are sorted together,
    text first; ``use`` yields record batches."""
    names = requests.columns
    loads = requests.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / TASK_CHAINS).cast("int").alias("__tasks"))
    loads, n = sized(loads.select(F.col(key[0]).alias("doc"), F.col(key[1]).alias("part"), "__tasks"))
    texts = rows.join(broadcast_if(loads, n), ["doc", "part"]).select("doc", "part", F.explode(F.sequence(F.lit(0), F.col("__tasks") - 1)).alias("task"), F.lit(0).alias("kind"), "text",
                         F.lit(None).cast(requests.select(F.struct(*names)).schema[0].dataType).alias("request"))
    asked = requests.select(F.struct(*names).alias("request"), F.col(key[0]).alias("doc"), F.col(key[1]).alias("part")).join(broadcast_if(loads, n), ["doc", "part"])
    asked = asked.select("doc", "part", F.pmod(F.xxhash64("request.doc", "request.first_doc", F.col("request.at")[0]), F.col("__tasks")).cast("int").alias("task"),
                         F.lit(1).alias("kind"), F.lit(None).cast("string").alias("text"), "request")
    dealt = texts.unionByName(asked).repartition("doc", "part", "task").sortWithinPartitions("doc", "part", "task", "kind")

    def run(batches):
        now, words = None, None
        for table in batches:
            kind = table["kind"].to_numpy(zero_copy_only=False)
            doc, part, task = (table[c].to_numpy(zero_copy_only=False) for c in ("doc", "part", "task"))
            i, n = 0, len(kind)
            while i < n:
                if kind[i] == 0:
                    if (doc[i], part[i]) != now:
                        data, offsets = strings(table["text"].slice(i, 1))
                        starts, ends, _ = word_spans(data, offsets)
                        now, words = (doc[i], part[i]), word_hashes(LOWER[data], starts, ends)
                    i += 1
                    continue
                j = i + 1
                while j < n and kind[j] == 1 and doc[j] == doc[i] and part[j] == part[i] and task[j] == task[i]:
                    j += 1
                yield from use(pa.Table.from_batches([pa.RecordBatch.from_struct_array(table["request"].slice(i, j - i))]), words)
                i = j

    return dealt.select("doc", "part", "task", "kind", "text", "request").mapInArrow(run, schema)


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(elements, bounds) of a column of lists of whole numbers; list i is elements[bounds[i]:bounds[i + 1]]."""
    lists = table[name].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy().astype(np.int64), bounds


def _slices(table: pa.Table, words: np.ndarray):
    """The words around each chain in the later document."""
    at, bounds = _lists(table, "at")
    begin = np.maximum(0, at[bounds[:-1]] - MARGIN)
    ends = at[bounds[1:] - 1] + SEED_WORDS + MARGIN
    own = [words[lo:hi].tobytes() for lo, hi in zip(begin.tolist(), ends.tolist())]
    yield table.append_column("begin", pa.array(begin.astype(np.int32))).append_column("words", pa.array(own, pa.binary())).combine_chunks().to_batches()[0]


PASSAGE = "doc_id long, part int, start_word long, end_word long, first_doc_id long, first_start_word long, first_end_word long, matched long, identity double"


def _aligner(min_words: int, identity: float):
    def run(table: pa.Table, words: np.ndarray):
        out = []
        at, bounds = _lists(table, "at")
        of, others = _lists(table, "of")
        columns = (table[c].to_pylist() for c in ("doc", "part", "first_doc", "begin", "words"))
        for i, (doc, part, first_doc, begin, own) in enumerate(zip(*columns)):
            p, q = at[bounds[i]:bounds[i + 1]], of[others[i]:others[i + 1]]
            low = max(0, int(q[0]) - MARGIN)
            b = words[low:int(q[-1]) + SEED_WORDS + MARGIN]
            for a0, a1, b0, b1, same in passages(np.frombuffer(own, np.uint64), b, p - begin, q - low, min_words, identity):
                out.append((doc, part, begin + a0, begin + a1, first_doc, low + b0, low + b1, same, same / max(a1 - a0, b1 - b0)))
        if out:
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield batch([c.split()[0] for c in PASSAGE.split(", ")], *(pa.array(c, t) for c, t in zip(zip(*out), types)))

    return run


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """Passages (words start..end of doc_id) that an earlier document holds too, with the place there and the words that match."""
    rows = _keyed(docs)
    linked = store(chains(matches(rows, min_words), min_words))
    cut = with_words(rows, linked, ("doc", "part"), _slices, CHAIN + ", begin int, words binary")
    aligned = with_words(rows, store(cut), ("first_doc", "first_part"), _aligner(min_words, identity), PASSAGE)
    return aligned.distinct()


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word, first_doc_id, first_start_word, first_end_word, matched, identity."""
    return repeated_passages(docs).drop("part")


def without_spans(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Each text without the words of its [start, end) spans, and without the white space after them."""
    data, offsets = strings(texts)
    out = []
    for i, (text, cuts) in enumerate(zip(texts, spans.to_pylist())):
        if not text.is_valid or not cuts:
            out.append(text.as_py())
            continue
        own = data[offsets[i]:offsets[i + 1]]
        starts, _, _ = word_spans(own, np.array([0, len(own)]))
        edges, keep = np.append(starts, len(own)), np.ones(len(own), bool)
        for c in cuts:
            keep[edges[min(c["start_word"], len(starts))]:edges[min(c["end_word"], len(starts))]] = False
        out.append(own[keep].tobytes().decode())
    return pa.array(out, pa.string())


def drop_passages(docs: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """The documents without passages that earlier documents hold; the first document keeps its own. Rows all stay."""
    found = repeated_passages(docs, min_words, identity)
    spans = found.groupBy(F.col("doc_id").alias("__doc"), F.col("part").alias("__part")).agg(
        F.collect_set(F.struct("start_word", "end_word")).alias("__spans"))  # at most a document's own words
    spans, n = sized(spans)
    parted = spans.filter("__part <> 0").limit(1).count() > 0
    # whole rows travel as one struct, so no column of theirs can clash
    text = F.col("__row.text").cast("string")
    part = F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(1 << 31)).cast("int") if parted else F.lit(0)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    rows = whole.withColumns({"__doc": F.col("__row.doc_id").cast("long"), "__part": part}).join(broadcast_if(spans, 4 * n), ["__doc", "__part"], "left")
    cut = F.arrow_udf(without_spans, "string")(F.when(F.col("__spans").isNotNull(), text), "__spans")
    return rows.select(*[F.when(F.col("__spans").isNull(), text).otherwise(cut).alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
