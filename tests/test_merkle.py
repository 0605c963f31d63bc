"""Ordered hash trees against plain Python; differences and proofs that leave the rest unread."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from slicewise.operators import merkle

COLUMNS = ["k", "v"]


def plain(rows, fan):
    """Levels of digests."""
    leaf = lambda k, v: hashlib.sha256(json.dumps({"k": k, "v": v}, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    level = [d for _, d in sorted((k, leaf(k, v)) for k, v in rows)]
    out = [level]
    while len(out[-1]) > 1:
        out.append([hashlib.sha256("".join(out[-1][i : i + fan]).encode()).hexdigest() for i in range(0, len(out[-1]), fan)])
    return out


def table(spark, rows, n=5):
    return spark.createDataFrame(rows, "k int, v string").repartition(n)


@pytest.mark.parametrize("n,fan", [(1, 4), (4, 4), (5, 4), (300, 7), (0, 4)])
def test_trees(spark, n, fan):
    rng = random.Random(n)
    rows = [(rng.randrange(n), rng.choice(["x", "é\"\n", "", None])) for _ in range(n)]
    want = plain(rows, fan) if n else []
    for parts in (1, 6):
        got = merkle.tree(table(spark, rows, parts), ["k"], COLUMNS, fan).collect()
        assert {(r.level, r.at): r.digest for r in got} == {(k, i): d for k, level in enumerate(want) for i, d in enumerate(level)}


def test_one_change_is_found_from_the_root(spark):
    rows = [(i, f"v{i}") for i in range(3000)]
    a = merkle.tree(table(spark, rows), ["k"], COLUMNS, 16)
    b = merkle.tree(table(spark, [(k, "other" if k == 1234 else v) for k, v in rows]), ["k"], COLUMNS, 16)
    found, compared = merkle.differences(a, b, 16)
    assert [tuple(r) for r in found.collect()] == [(1234, "changed")] and len(compared) == 4 and all(n <= 16 for n in compared)
    assert merkle.differences(a, a, 16)[0].count() == 0 and merkle.differences(a, a, 16)[1] == [1, 0, 0, 0]
    c = merkle.tree(table(spark, rows[:2990]), ["k"], COLUMNS, 16)
    assert {tuple(r) for r in merkle.differences(a, c, 16)[0].collect()} == {(i, "removed") for i in range(2990, 3000)}


def test_proofs_of_a_range(spark):
    rows = [(i, f"v{i}") for i in range(700)]
    nodes = merkle.tree(table(spark, rows), ["k"], COLUMNS, 8)
    top, want = nodes.agg(F.max("level")).first()[0], merkle.root(nodes).first().digest
    for low, high in ((0, 1), (100, 130), (690, 700), (0, 700)):
        part, beside = nodes.where((F.col("level") == 0) & F.col("at").between(low, high - 1)), merkle.proof(nodes, low, high, 8)
        assert beside.count() <= 2 * 7 * top and merkle.proven_root(part, beside, top, 8).first().digest == want
        broken = part.withColumn("digest", F.when(F.col("at") == low, F.sha2("digest", 256)).otherwise(F.col("digest")))
        assert merkle.proven_root(broken, beside, top, 8).first().digest != want
