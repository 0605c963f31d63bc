"""Passages that repeat across documents, exactly or nearly: collinear chaining.

Equal texts (their words, by 128-bit hash) are one class: the smallest id is matched with
others, every other member gets one row that repeats it as a whole.

Seeds are 4-word k-mers without a repeated word whose hash falls in the lowest quarter, so
whether a k-mer is a seed depends on its own words alone, and edits beside it take none
away.  A window of 50 words with fewer than two different seeds (periodic stretches, for
one) is a seed itself, at the first place of each different one, and counts as two.  Every
seed's smallest document is its leader; each other occurrence is matched with the
leader's first, which joins all documents of a passage without pairing them all.

A leader may share only parts below ``min_words`` with two documents that share more with
each other.  So there is a second round of seeds, chosen by shared content alone: windows
of 50 words all of whose seeds are shared but of which no leader, on one diagonal, explains
half; and neighbouring shared seeds of a document with different leaders, joined to one.

The matches of a (document, leader) pair are chained in order: the best predecessor of a
match, by score and a cost per word of gap, is a prefix maximum in a Fenwick tree; all
chains come from that one pass, best first, each cut where it meets a better one.
Chains of two seeds or more are aligned on the words of both documents: runs of equal
words, small edits with a renewed match after them, bridges to the chain's next seed, and
extension beyond its ends.  First only the words up to ``MARGIN`` around a chain are
compared; chains whose alignment looks beyond them are aligned again on whole texts, so the
outcome is that of whole texts.  Aligned spans of ``min_words`` or more with ``identity`` are
results; spans of a pair that lie mostly within a better one's are left out.

Result: a row per passage with doc_id, its words [start, end), partner_id (smaller, the
leader) with [partner_start, partner_end), and the number of words that match.

Limits of the method: edits so dense that no two seeds survive hide a passage, or that
the alignment leaves less than ``min_words`` of it (the README has figures); so can, in
theory, a leader that has half of a window's seeds on one diagonal and differs between.

Defined results: null, empty and short texts have no passages; a null id has none; of
rows with the same id and different texts the one with the least hash counts; equal
texts repeat as a whole; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_codes, col, discard, materialize, mix, pieces_of, shipped, span_hashes, sweep, text_buffer, window_hashes, word_spans
from .neardup import full_sets

K, RATE, MIN_SEEDS, LONG_K, EXPLAINED = 4, 4, 2, 50, 25
GAP_COST = 0.04  # per word of gap on either side; a seed is worth K, so seeds a window apart still chain
EDIT, RENEW, DROP, BRIDGE = 6, 2, 12, 20
MARGIN = 80
WIDER = 25  # words beside an alignment that isn't enough, where more of the passage is looked for
HOT = 1000
HEAD = 2  # numbers before the words of a row of ``one_words``
SPAN = ("start", "end", "partner_start", "partner_end", "matches")
CHUNK = 512 << 10


def text_words(column: pa.Array) -> list[np.ndarray]:
    """Word hashes of every text, A-Z as a-z."""
    flat, at = text_buffer(column)
    starts, stops, row = word_spans(flat, at)
    words = span_hashes(byte_codes(lower=True)[flat], starts, stops)
    cut = np.searchsorted(row, np.arange(len(at)))
    return [words[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def different(grams: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """How many different grams of those at the places ``at`` each window of LONG_K of n words holds."""
    order = np.lexsort((at, grams))
    before = np.full(len(at), -1, np.int64)  # the place before it of the same gram
    same = grams[order][1:] == grams[order][:-1]
    before[order[1:][same]] = at[order[:-1][same]]
    steps = np.zeros(n - LONG_K + 2, np.int64)
    first, last = np.maximum(before + 1, at + K - LONG_K).clip(0), np.minimum(at, n - LONG_K)
    fits = first <= last
    np.add.at(steps, first[fits], 1)
    np.add.at(steps, last[fits] + 1, -1)
    return np.cumsum(steps[:-1])


def window_seeds(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the windows of LONG_K words that begin at ``at``, each different one at its first place."""
    if not len(at):
        return np.zeros(0, np.uint64), at
    grams = np.concatenate([window_hashes(words[b : e + LONG_K], LONG_K) for b, e in runs(at)])
    _, first = np.unique(grams, return_index=True)
    first.sort()
    return grams[first], at[first]


def runs(at: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers in ``at``, which rises."""
    cut = np.flatnonzero(np.diff(at) > 1)
    return list(zip(at[np.append(0, cut + 1)].tolist(), at[np.append(cut, len(at) - 1)].tolist(), strict=True))


def text_seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and codes (2 * place, and 1 for windows) of a text's seeds."""
    grams = window_hashes(words, K)
    chosen = grams < np.uint64(2**64 // RATE)
    for i in range(K):
        for j in range(i + 1, K):
            chosen &= words[i : i + len(grams)] != words[j : j + len(grams)]
    at = np.flatnonzero(chosen)
    if len(words) < LONG_K:
        return grams[at], 2 * at
    wide, wide_at = window_seeds(words, np.flatnonzero(different(grams[at], at, len(words)) < MIN_SEEDS))
    return np.concatenate([grams[at], wide]), np.concatenate([2 * at, 2 * wide_at + 1])


def flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All entries of the lists, and where each list begins and the last one ends."""
    at = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(), at - at[0]


def text_sums(words: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits of the words in their order."""
    place = mix(np.arange(1, len(words) + 1, dtype=np.uint64))
    return mix(words ^ place).sum(dtype=np.uint64), mix(words + place * np.uint64(3)).sum(dtype=np.uint64)


def pick(total: np.uint64) -> int:
    """Of rows with the same id the one with the least of these counts."""
    return int(np.uint32(total >> np.uint64(32)).view(np.int32))


def _lists(values: list[np.ndarray], kind, none) -> pa.Array:
    ends = np.append(0, np.cumsum([len(v) for v in values])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, none), *values]).astype(none), kind))


def prints(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """id, pick, n (words), set_a, set_b (128 bits of the words in order), seeds and at (codes), of texts with ``min_words`` or more."""

    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, "text", CHUNK):
                every = text_words(part.column(1))
                keep = [r for r, w in enumerate(every) if len(w) >= min_words]
                every = [every[r] for r in keep]
                sums = [text_sums(w) for w in every]
                found = [text_seeds(w) for w in every]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(keep, pa.int64())), pa.array([pick(a) for a, _ in sums], pa.int32()), pa.array([len(w) for w in every], pa.int64()),
                        *[pa.array(np.array([x[k] for x in sums], np.uint64).view(np.int64)) for k in (0, 1)],
                        _lists([s.view(np.int64) for s, _ in found], pa.int64(), np.int64), _lists([a for _, a in found], pa.int32(), np.int32),
                    ],
                    names=["id", "pick", "n", "set_a", "set_b", "seeds", "at"],
                )

    rows = docs.where(col(id_col).isNotNull()).select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    long = T.LongType()
    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("pick", T.IntegerType()), *[T.StructField(c, long) for c in ("n", "set_a", "set_b")], T.StructField("seeds", T.ArrayType(long)), T.StructField("at", T.ArrayType(T.IntegerType()))]
    return shipped(rows).mapInArrow(run, T.StructType(fields))


def chains(matches: list[tuple[int, int]], min_seeds: int = MIN_SEEDS, worth: list[int] | None = None) -> list[list[tuple[int, int]]]:
    """Chains of matches (place here, place there), both rising, best first, each match in one at most, worth ``min_seeds`` in all."""
    left, out = sorted(set(matches)), []
    value = dict.fromkeys(matches, 1)
    for m, w in zip(matches, worth or (), strict=False):
        value[m] = max(value[m], w)
    rank = {y: r for r, y in enumerate(sorted({y for _, y in left}), 1)}
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(rank) + 1)  # Fenwick tree of prefix maxima
    score, before = [0.0] * len(left), [-1] * len(left)
    i = 0
    while i < len(left):
        same = i
        while same < len(left) and left[same][0] == left[i][0]:  # matches at one place don't follow each other
            x, y = left[same]
            r, best = rank[y] - 1, (float("-inf"), -1)
            while r:
                best = max(best, tree[r])
                r -= r & -r
            gain = best[0] - GAP_COST * (x + y)
            score[same], before[same] = (K + gain, best[1]) if gain > 0 else (K, -1)
            same += 1
        for j in range(i, same):
            x, y = left[j]
            r, own = rank[y], (score[j] + GAP_COST * (x + y), j)
            while r < len(tree):
                tree[r] = max(tree[r], own)
                r += r & -r
        i = same
    used = [False] * len(left)
    for at in sorted(range(len(left)), key=lambda j: (-score[j], -value[left[j]], j)):  # of single matches those worth more come first
        chain = []
        while at >= 0 and not used[at]:
            used[at] = True
            chain.append(left[at])
            at = before[at]
        if sum(value[m] for m in chain) >= min_seeds:
            out.append(chain[::-1])
    return out


def both_chains(matches: list[tuple[int, int]], worth: list[int], again: list[bool]) -> list[list[tuple[int, int]]]:
    """Chains of the first round's matches, and those of the second's that none of them holds; apart, for where texts repeat one round's matches draw the other's off their passage."""
    first, second = ([k for k, g in enumerate(again) if g == own] for own in (False, True))
    out = chains([matches[k] for k in first], worth=[worth[k] for k in first])
    held = [set(c) for c in out]
    return out + [c for c in chains([matches[k] for k in second], worth=[worth[k] for k in second]) if not any(h.issuperset(c) for h in held)]


#: Words to leave out of both sides, fewest first, even ones first.
MOVES = sorted(((x, y) for x in range(EDIT + 1) for y in range(EDIT + 1) if x + y), key=lambda m: (m[0] + m[1], abs(m[0] - m[1]), m[0]))


def _run(a: list[int], b: list[int], i: int, j: int, n: int) -> int:
    """Equal words from a[i] and b[j] on, at most n."""
    total = 0
    while total < n and a[i + total : i + min(total + 64, n)] == b[j + total : j + min(total + 64, n)]:
        total = min(total + 64, n)
    while total < n and a[i + total] == b[j + total]:
        total += 1
    return total


def follow(a: list[int], b: list[int], i: int, j: int, end_a: int, end_b: int) -> tuple[int, int, int, int, int]:
    """Align a[i:end_a] with b[j:end_b] as far as it pays: (words of a, words of b, matches) at the best score, and how far it looked in each."""
    i0, j0, score, matches, best = i, j, 0, 0, (0, 0, 0, 0)
    while True:
        run = _run(a, b, i, j, min(end_a - i, end_b - j))
        i, j, score, matches = i + run, j + run, score + run, matches + run
        if score > best[0]:
            best = (score, i - i0, j - j0, matches)
        if score < best[0] - DROP:
            break
        for x, y in MOVES:
            x, y = i + x, j + y
            if x + RENEW <= end_a and y + RENEW <= end_b and a[x] == b[y] and a[x : x + RENEW] == b[y : y + RENEW]:
                break
        else:
            break
        score -= 2 * max(x - i, y - j)
        i, j = x, y
    return *best[1:], i - i0 + EDIT + RENEW, j - j0 + EDIT + RENEW


def align(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int]], min_words: int, identity: float) -> tuple[list[tuple[int, int, int, int, int]], tuple[int, int, int, int]]:
    """(start, end, partner start, partner end, matches) of the passages along a chain, and the bounds of what was looked at in both (they may lie outside)."""
    a, b = a.tolist(), b.tolist()
    back_a, back_b = a[::-1], b[::-1]
    parts: list[list[int]] = []
    seen = [len(a), 0, len(b), 0]
    limit_a = limit_b = 0
    for x, y in chain:
        if x < limit_a or y < limit_b or a[x] != b[y]:
            continue
        n, m, hits, far_a, far_b = follow(a, b, x, y, len(a), len(b))
        u, v, more, low_a, low_b = follow(back_a, back_b, len(a) - x, len(b) - y, len(a) - limit_a, len(b) - limit_b)
        seen = [min(seen[0], max(x - low_a, limit_a if parts else -len(a))), max(seen[1], x + far_a), min(seen[2], max(y - low_b, limit_b if parts else -len(b))), max(seen[3], y + far_b)]
        parts.append([x - u, x + n, y - v, y + m, hits + more])
        limit_a, limit_b = x + n, y + m
    good = lambda p: p[1] - p[0] >= min_words and p[4] >= identity * max(p[1] - p[0], p[3] - p[2])
    joined: list[list[int]] = []
    for p in parts:
        if joined and p[0] - joined[-1][1] <= BRIDGE and p[2] - joined[-1][3] <= BRIDGE:
            q = joined[-1]
            both = [q[0], p[1], q[2], p[3], q[4] + p[4]]
            if both[4] >= identity * max(both[1] - both[0], both[3] - both[2]):
                joined[-1] = both
                continue
        joined.append(p)
    out = []
    for p in joined:
        if not good(p) and p[1] - p[0] == p[3] - p[2]:
            low, high = max(0, p[0] - WIDER, p[0] - p[2]), min(p[1] + WIDER, len(a), len(b) + p[0] - p[2])
            seen = [min(seen[0], p[0] - WIDER), max(seen[1], p[1] + WIDER), min(seen[2], p[2] - WIDER), max(seen[3], p[3] + WIDER)]
            p = substituted(a, b, low, high, p[2] - p[0], identity) or p
        if good(p):
            out.append(tuple(p))
    return out, tuple(seen)


def substituted(a: list[int], b: list[int], low: int, high: int, shift: int, identity: float) -> list[int] | None:
    """The longest stretch of a[low:high] that begins and ends with words equal to those ``shift`` further in ``b``, ``identity`` of all words being so.

    An alignment ends where it pays most: before an end of a word or two behind an edit, and
    behind parts with so many edits that the whole falls below ``identity``.  Where words
    are replaced only, the stretch in question is found exactly.
    """
    equal = [a[i] == b[i + shift] for i in range(low, high)]
    total = [0]
    for e in equal:
        total.append(total[-1] + e)
    height = [t - identity * i for i, t in enumerate(total)]
    starts, best = [], (0, 0)
    for i, e in enumerate(equal):
        if e and (not starts or height[i] < height[starts[-1]] - 1e-9):
            starts.append(i)
    for j in range(len(equal), 0, -1):
        while equal[j - 1] and starts and height[j] >= height[starts[-1]] - 1e-9:
            i = starts.pop()
            if j - i > best[1] - best[0]:
                best = (i, j)
    i, j = best
    return [low + i, low + j, low + i + shift, low + j + shift, total[j] - total[i]] if i < j else None


def may_repeat(a: np.ndarray, b: np.ndarray, matches: float) -> bool:
    """Whether so many words may match: alignments match words in runs of two at least, so half as many pairs of words are in both."""
    if len(a) < 2 or len(b) < 2:
        return False
    pairs, others = ((w[:-1].astype(np.int64) << 32) ^ w[1:] for w in (a, b))
    others = np.sort(others)
    return np.count_nonzero(others[np.minimum(np.searchsorted(others, pairs), len(others) - 1)] == pairs) >= matches / 2


def best_spans(spans: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Spans without those of which over half lies, here, in one with more matches."""
    kept: list[tuple[int, int, int, int, int]] = []
    for s in sorted(set(spans), key=lambda s: (-s[4], s)):
        if not any(min(s[1], k[1]) - max(s[0], k[0]) > (s[1] - s[0]) / 2 for k in kept):
            kept.append(s)
    return sorted(kept)


def star(found: DataFrame, name: str) -> DataFrame:
    """seed, id, at, lead (the smallest id that has the seed) and there (its first place), for seeds that two documents have.

    Tables stand on both sides of the joins, so that these are exchanges whose large partitions (hot seeds) can be split.
    """
    lead = found.groupBy("seed").agg(F.min("id").alias("lead"), F.max("id").alias("hi")).where("lead < hi").select("seed", "lead")
    lead = materialize(lead, name + "-leaders")
    sweep(found.sparkSession)
    shared = materialize(found.join(lead, "seed"), name + "-shared")
    first = shared.where("id = lead").groupBy("seed").agg(F.min("at").alias("there"))
    out = materialize(shared.join(materialize(first, name + "-first"), "seed"), name)
    discard(lead, shared)
    return out


def matches(rows: DataFrame, again: bool) -> DataFrame:
    """A row per match of a document's seed with its leader's: id, partner, at (here), there, worth, again (the second round)."""
    worth = F.when(F.col("at") % 2 == 1, MIN_SEEDS).otherwise(1)
    return rows.where("id != lead").select("id", F.col("lead").alias("partner"), F.shiftright("at", 1).alias("at"), F.shiftright("there", 1).alias("there"), worth.alias("worth"), F.lit(again).alias("again"))


def matched(rows: DataFrame) -> DataFrame:
    """id, partner and their matches x (here), y (there), w (worth), g (again), for pairs worth enough."""
    pairs = rows.groupBy("id", "partner").agg(F.collect_list(F.struct("at", "there", "worth", "again")).alias("m"), F.sum("worth").alias("worth")).where(F.col("worth") >= MIN_SEEDS)
    return pairs.select("id", "partner", F.col("m.at").alias("x"), F.col("m.there").alias("y"), F.col("m.worth").alias("w"), F.col("m.again").alias("g"))


def unexplained(n: int, own: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """First places of the windows of LONG_K of n words with shared seeds only, of which no group (leader and diagonal) spans EXPLAINED words.

    ``own``: places of all k-mer seeds; ``at`` and ``group``: of the shared ones.
    """
    if n < LONG_K or not len(at):
        return np.zeros(0, np.int64)
    steps = np.zeros((2, n - LONG_K + 2), np.int64)

    def mark(row, first, last):
        first, last = first.clip(0), np.minimum(last, n - LONG_K)
        fits = first <= last
        np.add.at(steps[row], first[fits], 1)
        np.add.at(steps[row], last[fits] + 1, -1)

    alone = own[~np.isin(own, at)]
    if (np.diff(alone, prepend=-1, append=n - K + 1) <= LONG_K - K + 1).all():  # every window has one
        return np.zeros(0, np.int64)
    mark(0, alone + K - LONG_K, alone)
    mark(1, at + K - LONG_K, at)  # windows with a shared seed at all
    _, group = np.unique(group, return_inverse=True)
    key = np.sort(group.astype(np.int64) * (n + LONG_K) + at)
    other = np.searchsorted(key, key + EXPLAINED - K)  # the next one of the group that is far enough
    found = other < len(key)
    i, j = key[found], key[other[found]]
    together = i // (n + LONG_K) == j // (n + LONG_K)
    i, j = i[together] % (n + LONG_K), j[together] % (n + LONG_K)
    mark(0, j + K - LONG_K, i)
    total = np.cumsum(steps[:, :-1], axis=1)
    return np.flatnonzero((total[0] == 0) & (total[1] > 0))


def second_seeds(first: DataFrame, every: DataFrame, docs: DataFrame, id_col: str, text_col: str, min_words: int, twice: DataFrame | None) -> DataFrame:
    """seed, id, at of the second round; ``first`` is the first round's star, ``every`` has each document's n and at."""
    kind = docs.schema[id_col].dataType
    shared = first.select("id", F.struct("at", "seed", F.xxhash64("lead", F.col("there") - F.col("at")).alias("group")).alias("s")).groupBy("id").agg(F.collect_list("s").alias("s"))
    rows = every.select("id", "n", "at").join(shared, "id").select("id", "n", "at", F.col("s.at").alias("x"), F.col("s.seed").alias("seed"), F.col("s.group").alias("group"))

    def run(batches):
        for batch in batches:
            seeds, places, windows = [], [], []
            for r in range(batch.num_rows):
                own, x, seed, group = (batch.column(k)[r].values.to_numpy() for k in (2, 3, 4, 5))
                order = np.lexsort((seed, x))
                x, seed, group = x[order], seed[order], group[order]
                short = x % 2 == 0
                x, seed, group = x[short] >> 1, seed[short].view(np.uint64), group[short]
                meet = np.flatnonzero(group[1:] != group[:-1])
                seeds.append(mix(seed[meet] * np.uint64(3) + mix(seed[meet + 1])).view(np.int64))
                places.append(2 * x[meet] + 1)
                windows.append(unexplained(batch.column(1)[r].as_py(), own[own % 2 == 0] >> 1, x, group))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(seeds, pa.int64(), np.int64), _lists(places, pa.int32(), np.int32), _lists(windows, pa.int32(), np.int32)], names=["id", "seeds", "at", "windows"])

    fields = [T.StructField("id", kind), T.StructField("seeds", T.ArrayType(T.LongType())), *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("at", "windows")]]
    found = materialize(rows.mapInArrow(run, T.StructType(fields)), "second")
    windows = found.where(F.size("windows") > 0).select("id", "windows")
    texts = one_words(docs, windows.select("id"), id_col, text_col, min_words, twice).join(windows, "id").select("id", "items", "windows")

    def grams(batches):
        for batch in batches:
            seeds, places = [], []
            for r in range(batch.num_rows):
                words, at = batch.column(1)[r].values.to_numpy()[HEAD:].view(np.uint32).astype(np.uint64), batch.column(2)[r].values.to_numpy().astype(np.int64)
                keys, at = window_seeds(words, at[at + LONG_K <= len(words)])
                seeds.append(keys.view(np.int64))
                places.append(2 * at + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(seeds, pa.int64(), np.int64), _lists(places, pa.int32(), np.int32)], names=["id", "seeds", "at"])

    wide = texts.mapInArrow(grams, T.StructType(fields[:3]))
    return exploded(found.select("id", "seeds", "at").unionByName(wide))


def exploded(lists: DataFrame) -> DataFrame:
    return lists.select("id", F.explode(F.arrays_zip("seeds", "at")).alias("s")).select(F.col("s.seeds").alias("seed"), "id", F.col("s.at").alias("at"))


def one_words(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, min_words: int, twice: DataFrame | None) -> DataFrame:
    """(id, items): a head of two numbers and the 32-bit word hashes of the documents of ``ids`` and some others; of rows with the same id the one that ``singles`` keeps."""

    def make(part):
        return [np.concatenate([np.array([pick(text_sums(w)[0]), len(w)], np.int32), (w >> np.uint64(32)).astype(np.uint32).view(np.int32)]) for w in text_words(part)]

    words = full_sets(docs, ids, id_col, text_col, 0, make=make, kind=pa.int32(), least=min_words)
    if twice is None:
        return words
    more = words.join(twice, "id", "left_semi").groupBy("id").agg(F.min("items").alias("items"))
    return words.join(twice, "id", "left_anti").unionByName(more)


def singles(own: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Of ``prints``: a row per id; id, partner, n of the ids whose text a smaller one has; and ids of several rows, if there are any."""
    of_id = own.select("id", F.struct("pick", "n", "set_a", "set_b").alias("s")).groupBy("id").agg(F.min("s").alias("s"), F.count("*").alias("size"))
    small = materialize(of_id.select("id", "s.*", "size"), "ids")
    lead = small.groupBy("set_a", "set_b").agg(F.min("id").alias("partner"), F.max("id").alias("hi")).where("partner < hi").select("set_a", "set_b", "partner")
    copies = materialize(small.join(materialize(lead, "classes"), ["set_a", "set_b"]).where("id != partner").select("id", "partner", "n"), "copies")
    twice = small.where("size > 1").select("id")
    if not twice.limit(1).count():  # else lists of seeds move by id, to leave one row of each
        return own, copies, None
    more = own.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct("pick", "n", "set_a", "set_b", "seeds", "at")).alias("s"))
    return own.join(twice, "id", "left_anti").unionByName(more.select("id", "s.*")), copies, twice


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 50, identity: float = 0.8) -> DataFrame:
    """A row per passage: id, start, end, partner, partner_start, partner_end, matches (places in words)."""
    kind = docs.schema[id_col].dataType
    own = materialize(prints(docs, id_col, text_col, min_words), "prints")
    single, copies, twice = singles(own)
    first = star(exploded(single), "first")  # a leader is never a copy: what it is a copy of has the seed too
    others = first.join(copies.select("id"), "id", "left_anti")
    second = materialize(second_seeds(others, single, docs, id_col, text_col, min_words, twice), "seeds")
    discard(own)
    again = star(second, "again")
    pairs = matched(matches(others, False).unionByName(matches(again, True)))

    def chained(batches):
        for batch in batches:
            rows, xs, ys = [], [], []
            for r, (x, y, w, g) in enumerate(zip(*[batch.column(k).to_pylist() for k in (2, 3, 4, 5)], strict=True)):
                for chain in both_chains(list(zip(x, y, strict=True)), w, g):
                    rows.append(r)
                    xs.append([m[0] for m in chain])
                    ys.append([m[1] for m in chain])
            at, ints = pa.array(rows, pa.int64()), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(xs, ints), pa.array(ys, ints)], names=["id", "partner", "x", "y"])

    ints = T.ArrayType(T.IntegerType())
    pair = [T.StructField("id", kind), T.StructField("partner", kind)]
    chain = materialize(pairs.mapInArrow(chained, T.StructType([*pair, T.StructField("x", ints), T.StructField("y", ints)])), "chains")
    discard(first, second, again)
    words = materialize(one_words(docs, chain.select("id").union(chain.select("partner")).distinct(), id_col, text_col, min_words, twice), "words")

    def aligned(batches):
        """Spans of the chains of each row; of a chain that looks beyond the words given here, the chain itself."""
        for batch in batches:
            rows, out, xs, ys = [], [], [], []
            texts = [flat(batch.column(k)) for k in (4, 5)]
            of_row, x_of, y_of = batch.column(2).offsets.to_numpy(), *[flat(batch.column(k).flatten()) for k in (2, 3)]
            of_row = of_row - of_row[0]
            a0, a_n, b0, b_n = (batch.column(k).to_numpy() for k in (6, 7, 8, 9))
            for r in range(batch.num_rows):
                a, b = (words[at[r] : at[r + 1]] for words, at in texts)
                if not may_repeat(a, b, identity * min_words):
                    continue
                for c in range(of_row[r], of_row[r + 1]):
                    x, y = (places[at[c] : at[c + 1]] for places, at in (x_of, y_of))
                    spans, seen = align(a, b, list(zip((x - a0[r]).tolist(), (y - b0[r]).tolist(), strict=True)), min_words, identity)
                    if seen[0] < 0 < a0[r] or seen[2] < 0 < b0[r] or seen[1] > len(a) and a0[r] + len(a) < a_n[r] or seen[3] > len(b) and b0[r] + len(b) < b_n[r]:
                        rows.append(r)
                        out.append((None,) * 5)
                        xs.append(x.tolist())
                        ys.append(y.tolist())
                        continue
                    rows += [r] * len(spans)
                    out += [(s[0] + a0[r], s[1] + a0[r], s[2] + b0[r], s[3] + b0[r], s[4]) for s in spans]
                    xs += [None] * len(spans)
                    ys += [None] * len(spans)
            at = pa.array(rows, pa.int64())
            columns = [*[pa.array([s[k] for s in out], pa.int64()) for k in range(5)], pa.array(xs, pa.list_(pa.int32())), pa.array(ys, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names=["id", "partner", "start", "end", "partner_start", "partner_end", "matches", "x", "y"])

    def cut(rows, place, text, margin):
        """``rows`` with the words ``items`` up to ``margin`` around their chain (or all) as ``text``, where these begin, and how many the document has."""
        low = F.lit(0) if margin is None else F.greatest(F.col(place)[0][0] - margin, F.lit(0))
        most = F.size("items") - HEAD
        upto = most if margin is None else F.least(F.element_at(F.col(place)[0], -1) + LONG_K + margin, most)
        return rows.withColumns({text: F.slice("items", low + HEAD + 1, upto - low), text + "0": low, text + "_n": most}).drop("items")

    def words_of(rows, side):
        """Words of the documents in the column ``side``; few ids are broadcast, so that few words move."""
        return words.withColumnRenamed("id", side).join(rows.select(side).distinct(), side, "left_semi")

    def spans_of(rows, margin):
        """Rows of ``aligned`` for chains, on words up to ``margin`` around them, or whole texts.

        A leader of more than ``HOT`` rows is dealt out over several keys, with its words for each.
        """
        hot = materialize(rows.groupBy("partner").agg(F.ceil(F.count("*") / HOT).cast("int").alias("salts")).where("salts > 1"), "hot")
        cold = rows.join(hot, "partner", "left_anti")
        salted = rows.join(hot, "partner").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("salts")
        dealt = words.withColumnRenamed("id", "partner").join(hot, "partner").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        both = cold.join(words_of(cold, "partner"), "partner").unionByName(salted.join(dealt, ["partner", "salt"]).drop("salt"))
        both = cut(both, "y", "b", margin)
        both = cut(both.join(words_of(rows, "id"), "id"), "x", "a", margin)
        fields = [*pair, *[T.StructField(n, T.LongType()) for n in SPAN], T.StructField("x", ints), T.StructField("y", ints)]
        return both.select("id", "partner", "x", "y", "a", "b", "a0", "a_n", "b0", "b_n").mapInArrow(aligned, T.StructType(fields))

    near = materialize(spans_of(chain.select("id", "partner", F.array("x").alias("x"), F.array("y").alias("y")), MARGIN), "spans")
    far = near.where("x is not null").groupBy("id", "partner").agg(F.collect_list(F.struct("x", "y")).alias("c"))
    far = spans_of(materialize(far.select("id", "partner", F.col("c.x").alias("x"), F.col("c.y").alias("y")), "far"), None)
    spans = near.where("x is null").unionByName(far).groupBy("id", "partner").agg(F.collect_list(F.struct(*SPAN)).alias("s")).select("id", "partner", *[F.col(f"s.{n}").alias(n) for n in SPAN])

    def best(batches):
        for batch in batches:
            rows, out = [], []
            for r in range(batch.num_rows):
                kept = best_spans(list(zip(*[batch.column(k)[r].as_py() for k in range(2, 7)], strict=True)))
                rows += [r] * len(kept)
                out += kept
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *[pa.array([s[k] for s in out], pa.int64()) for k in range(5)]], names=["id", "partner", *SPAN])

    spans = spans.mapInArrow(best, T.StructType([*pair, *[T.StructField(n, T.LongType()) for n in SPAN]]))
    zero = F.lit(0).cast("long")
    return spans.union(copies.select("id", "partner", zero, "n", zero, "n", "n"))


def op4_chained_passages(spark, sf_dir: str) -> DataFrame:
    out = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumnsRenamed({"id": "doc_id", "partner": "partner_id"})
