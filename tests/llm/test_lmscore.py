"""Deleted interpolation against plain Python on dictionaries."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from slicewise.llm import lmscore

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*(("w", w) for w in WORD.findall((text or "").translate(LOWER))), "end"]


def kind(i):
    crc = 0 if i is None else zlib.crc32(str(i).encode())
    if i is None:
        return "kept"
    return "out" if crc % 7 == 2 else "deleted" if crc // 7 % 16 == 0 else "kept"


def counts(texts):
    word, pair, context = Counter(), Counter(), Counter()
    for t in texts:
        for a, b in zip(["start", *t[:-1]], t, strict=True):
            word[b] += 1
            pair[a, b] += 1
            context[a] += 1
    return word, pair, context


def brute(rows, rounds=lmscore.MOST_ROUNDS, tolerance=lmscore.TOLERANCE):
    docs = [(i, kind(i), tokens(t)) for i, t in rows]
    word, pair, context = counts([t for _, k, t in docs if k == "kept"])
    n, v = sum(word.values()), len(word)
    weights = {}
    of = lambda c: c.bit_length()
    shares = lambda a, b: (pair[a, b] / context[a] if context[a] else 0, word[b] / max(n, 1), 1 / (v + 1))
    start = lambda b: [0, 0.5, 0.5] if b == 0 else [1 / 3] * 3
    events = [(of(context[a]), shares(a, b)) for _, k, t in docs if k == "deleted" for a, b in zip(["start", *t[:-1]], t, strict=True)]
    for _ in range(rounds):
        expected = {}
        for b, p in events:
            parts = [x * w for x, w in zip(p, weights.get(b, start(b)), strict=True)]
            e = expected.setdefault(b, [0, 0, 0])
            for k in range(3):
                e[k] += parts[k] / sum(parts)
        change = 0
        for b, e in expected.items():
            e = [x + 1 for x in e] if b else [0, e[1] + 1, e[2] + 1]
            new = [round(x / sum(e), 9) for x in e]
            change = max(change, *(abs(x - y) for x, y in zip(new, weights.get(b, start(b)), strict=True)))
            weights[b] = new
        if change < tolerance:
            break
    word, pair, context = counts([t for _, k, t in docs if k != "out"])
    n, v = sum(word.values()), len(word)
    out = []
    for i, k, t in docs:
        base = sum(math.log10((word[b] + 1) / (n + v + 1)) for b in t)
        score = 0
        for a, b in zip(["start", *t[:-1]], t, strict=True):
            score += math.log10(sum(w * p for w, p in zip(weights.get(of(context[a]), start(of(context[a]))), shares(a, b), strict=True)))
        out.append((i, k == "out", len(t), sum(word[b] > 0 for b in t), n, base, score))
    return out


def check(df, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, lmscore.score_texts(df).collect()), key=key), sorted(brute(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-6, atol=1e-9)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check(odd, rows)
    assert lmscore.score_texts(none).collect() == []


@pytest.mark.parametrize("seed,n", [(1, 400), (2, 30)])
def test_random_texts(spark, seed, n):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 500}"
    rows = [(i, " ".join(word() for _ in range(rng.randrange(60)))) for i in range(n)]
    rows += [(1000 + i, "one Hot line of Words stands here") for i in range(n // 2)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_nothing_to_learn_from(spark):
    rows = [(i, "a few words") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = lmscore.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in got)


def test_bucketed_context_with_every_word(spark):
    """A known context followed by every known word, and by an unknown one."""
    words = [f"v{k}" for k in range(30)]
    rng = random.Random(3)
    learn = [(i, " ".join(rng.choices(words, range(1, 31), k=20))) for i in range(300) if kind(i) != "out"]
    out = [i for i in range(300, 2000) if kind(i) == "out"]
    check(spark.createDataFrame(rows := learn + [(i, f"v7 {w}") for i, w in zip(out, [*words, "unknown"], strict=False)], "doc_id long, text string"), rows)


def test_packed_arrays():
    rng = np.random.default_rng(5)
    for x in (np.zeros(0, np.uint64), np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64)), np.array([0, (1 << 64) - 1], np.uint64)):
        assert (lmscore.unpack_sorted(lmscore.pack_sorted(x)) == x).all()
    for x in (np.zeros(0, np.int64), np.arange(300), np.array([1 << 40, 0])):
        assert (lmscore.unpack(lmscore.pack_counts(x)) == x).all()
