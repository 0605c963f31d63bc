"""Greedy disjoint choice against the sequential rule."""

import random

import pytest
from pyspark.sql import functions as F

from slicewise.operators import matching, pairs


def sequential(rows):
    """{(group, a, b)} from (group, key, a, b)."""
    used, out = set(), set()
    for g, _, a, b in sorted(set(rows)):
        if a != b and (g, a) not in used and (g, b) not in used:
            used |= {(g, a), (g, b)}
            out.add((g, a, b))
    return out


def chosen(spark, rows, block):
    table = spark.createDataFrame(rows, "stage int, key int, label_a string, label_b string").repartition(5)
    return [(r.stage, r.label_a, r.label_b) for r in matching.greedy_matching(table, "stage", "key", block=block).collect()]


@pytest.mark.parametrize("block", [1, 50, 10_000])
def test_random_orders_ties_and_groups(spark, block):
    rng = random.Random(block)
    size = 40 if block == 1 else 900
    rows = [(rng.randrange(3), rng.randrange(30 if block > 1 else 10**6), *(f"l{x}" for x in rng.sample(range(80), 2))) for _ in range(size)]
    rows += rows[:20]
    got = chosen(spark, rows, block)
    assert len(got) == len(set(got)) and set(got) == sequential(rows)


@pytest.mark.parametrize("order", ["lexicographic", "path"])
def test_orders_that_run_along_labels(spark, order):
    """One locally best pair a round: the blocks decide."""
    n = 90
    rows = [(1, i * n + j, f"{i:03}", f"{j:03}") for i in range(n) for j in range(i + 1, n)] if order == "lexicographic" else [(1, i, f"{i:03}", f"{i + 1:03}") for i in range(700)]
    got = chosen(spark, rows, 600)
    assert set(got) == sequential(rows) and len(got) == len(set(got))


def test_null_equal_and_absent_labels(spark):
    rows = [(1, 1, "a", None), (1, 2, "b", "b"), (1, 3, "a", "b"), (2, 1, None, None)]
    assert chosen(spark, rows, 10) == [(1, "a", "b")]
    assert chosen(spark, rows[:1], 10) == []


def test_a_stage_that_no_pair_reaches(spark):
    table = spark.createDataFrame([("a", "b", 5), ("b", "c", 7), ("c", "d", 9)], "label_a string, label_b string, n int")
    got = {tuple(r) for r in pairs.stage_counts(table, {"all": F.lit(True), "some": F.col("n") > 5, "none": F.col("n") > 99, "unknown": F.lit(None).cast("boolean")}).collect()}
    assert got == {("all", 1, 3, 4, 2), ("some", 2, 2, 3, 1), ("none", 3, 0, 0, 0), ("unknown", 4, 0, 0, 0)}
