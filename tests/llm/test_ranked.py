"""Ranked search against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slicewise.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=50):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    total, df = sum(n for *_, n in bags), Counter(t for _, b, _ in bags for t in b)
    asked = {}
    for k, text in items:
        asked.setdefault(k, set()).update(terms(text))
    weight = {t: math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * n + 1))) for t, n in df.items()}
    out = set()
    for k, ts in asked.items():
        found = []
        for i, b, n in bags:
            m = 100 - 50 + (50 * n * len(bags)) // total
            score = sum(weight[t] * ((1_000_000_000 * b[t]) // (1000 * b[t] + 20 * m)) for t in ts if t in b)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out |= {(k, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:top], 1)}
    return out


def found(spark, docs, items, **how):
    return {tuple(r) for r in ranked.search(docs, items, **how).collect()}


def test_odd_rows(spark, odd, none):
    items = [(1, "Little WORDS, three!"), (1, "line"), (2, None), (3, ""), (4, "nowhere-found ..."), (5, "same same line of words here 日本語 é 🙂"), (None, "password x eight"), (6, "long1x1 text")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(spark, odd, table) == brute(rows, items)
    assert found(spark, none, table) == set() and found(spark, odd, table.limit(0)) == set()


@pytest.mark.parametrize("window,pairs", [(64, 1 << 20), (128, 20), (8192, 1)])
def test_windows_and_blocks(spark, window, pairs):
    """Ids in any order and sign, far apart, and one id in a third of all rows; ties at the last place; several blocks of items."""
    rng = random.Random(window)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 300}"
    docs = [(i * 37 - 5000 if i % 3 else 11, " ".join(word() for _ in range(rng.randrange(1, 40)))) for i in range(900)]
    docs += [(10**12 + i, "tie of these words") for i in range(80)] + [(None, "tie of these words")] * 3
    rng.shuffle(docs)
    items = [(i, " ".join(word() for _ in range(12))) for i in range(12)] + [(99, "tie words")]
    got = found(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), top=20, size=window, pairs_a_block=pairs)
    assert got == brute(docs, items, 20)


def test_full_scores_and_cleared_buckets():
    """A scorer gives the same for a window after others as before them."""
    table = pa.table({"item": pa.array([1, 1, 2]), "term": pa.array([5, 7, 7]), "df": pa.array([3, 9, 9])})
    args = (np.array([4, 8]), np.array([10, 20]), np.array([5, 7, 7], np.uint64), np.array([0, 0, 1]), np.array([1, 2, 1]))
    one, two = ranked.Scorer(ranked.Items(table, 100, 1000), 10), ranked.Scorer(ranked.Items(table, 100, 1000), 10)
    one.window(*args)
    two.window(np.arange(100, 200), np.full(100, 9), np.full(100, 7, np.uint64), np.arange(100), np.ones(100, int))
    two.best = [(x[:0], y[:0]) for x, y in two.best]
    two.window(*args)
    assert [[x.tolist() for x in b] for b in one.best] == [[x.tolist() for x in b] for b in two.best] and not two.occupied.any() and not two.buckets.any()
