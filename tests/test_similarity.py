"""Best set similarity against all pairs, and how many pairs it looks at."""

import random

import pytest
from pyspark.sql import functions as F

from slicewise.operators import similarity


def brute(left, right):
    out = {}
    for i, a in left:
        for _, g, b in right:
            if a and b and set(a) & set(b):
                x = len(set(a) & set(b)) / len(set(a) | set(b))
                out[i, g] = max(out.get((i, g), 0), x)
    return out


def frames(spark, left, right):
    return spark.createDataFrame(left, "case_id string, tokens array<string>"), spark.createDataFrame(right, "right_id string, change_id string, tokens array<string>")


def draw(rng, n, words, size):
    return [sorted({f"t{min(int(rng.paretovariate(0.5)), words)}" for _ in range(rng.randrange(1, size))}) for _ in range(n)]


@pytest.mark.parametrize("seed,words,size", [(1, 400, 30), (2, 20, 12), (3, 5000, 60)])
def test_as_all_pairs(spark, seed, words, size):
    rng = random.Random(seed)
    left = [(f"c{i}", t) for i, t in enumerate(draw(rng, 60, words, size))] + [("none", ["zzz"]), ("empty", []), ("null", None), ("twin", ["only", "here"])]
    right = [(f"r{i}", f"g{rng.choice([0, 0, 0, 1, 2])}", t) for i, t in enumerate(draw(rng, 300, words, 3 * size))] + [("e", "g0", []), ("n", "g1", None), ("t", "g9", ["only", "here"]), ("u", None, ["only"])]
    a, b = frames(spark, left, right)
    got = {(r.case_id, r.change_id): r.best for r in similarity.best_similarity(a, b, ["case_id"], ["change_id"]).collect()}
    assert got == brute(left, right)
    plain = {r.case_id: r.best for r in similarity.best_similarity(a, b, ["case_id"]).collect()}
    assert plain == {i: max(x for (j, _), x in got.items() if j == i) for i, _ in got}


def test_pairs_that_are_formed(spark):
    """Tokens of Zipf's law: the rows of the second join are far fewer than those of a join on all tokens, and few pairs are compared."""
    rng = random.Random(7)
    left = [(f"c{i}", t) for i, t in enumerate(draw(rng, 60, 3000, 40))]
    right = [(f"r{i}", "g", t) for i, t in enumerate(draw(rng, 2000, 3000, 120))]
    a, b = frames(spark, left, right)
    all_rows = a.select(F.explode("tokens").alias("t")).join(b.select(F.explode("tokens").alias("t")), "t").count()
    met, compared = [], []
    counts, whole = similarity.pair_counts, similarity.compared

    def counted(x, y, keys, *more):
        met.append(x.join(y, keys).count())
        return counts(x, y, keys, *more)

    def looked(pairs, sets, r):
        compared.append(pairs.count())
        return whole(pairs, sets, r)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(similarity, "pair_counts", counted)
        patch.setattr(similarity, "compared", looked)
        got = {r.case_id: r.best for r in similarity.best_similarity(a, b, ["case_id"]).collect()}
    assert got == {i: x for (i, _), x in brute(left, right).items()}
    assert sum(met) < all_rows / 2 and sum(compared) < len(left) * len(right) / 10
