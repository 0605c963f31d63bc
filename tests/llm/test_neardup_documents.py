"""Near duplicates where ids stand on several texts, and the work in buckets that one component dominates."""

import itertools
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slicewise.llm import neardup
from tests.llm.test_neardup_and_passages import family, shingles


def brute(rows, k):
    """(id, n_shingles, component, kept) of every row: documents are ids, all texts of an id link."""
    sets = [shingles(t, k) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(range(len(rows)), 2):
        i, j = rows[x][0], rows[y][0]
        if None not in (i, j) and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    out = [(i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True)]
    return sorted(((i, n, c, i == c) for i, n, c in out), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def found(df, k=5):
    return sorted(((r.id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, k=k).collect()), key=str)


A, B = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
NEAR_A, NEAR_B = A + " more", B + " more"


@pytest.mark.parametrize("order", [0, 7, 13, 23])
def test_an_id_on_two_texts_links_both_families(spark, order):
    rows = list(itertools.permutations([(1, A), (1, B), (2, NEAR_A), (3, NEAR_B)]))[order]
    for n in (1, 4):
        assert {r[2] for r in found(table(spark, list(rows)).repartition(n))} == {1}


def shared_ids(seed):
    rng = random.Random(seed)
    rows = [r for f in range(4) for r in family(rng, 1000 * f, 40, edits=6)]
    rows += [(i, rng.choice(rows)[1]) for i in (3, 1003, 2003, 2005)] + [(i, f"a text of its own for {i} that has no copy anywhere else") for i in (5, 1005, 7000)]
    rows += [(None, rows[0][1]), (None, rows[1][1]), (5, None), (8000, ""), (8000, "two words"), (9001, "copies without any near one"), (9000, "copies without any near one"), (9002, "copies without any near one")] + rows[:10] + rows[:3]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_ids_as_brute_force(spark, seed):
    rows = shared_ids(seed)
    want = brute(rows, 5)
    assert found(table(spark, rows).repartition(3)) == want == found(table(spark, rows[::-1]).repartition(7))


def test_sql_on_shared_ids(spark):
    rows = shared_ids(3)
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    con.execute("create table documents as select cast(doc_id as bigint) as doc_id, text from frame")
    got = con.execute(f"select doc_id, n_shingles, component_id, kept from ({neardup.OP7_SQL})").fetchall()
    assert sorted(got, key=str) == brute(rows, 4) == found(table(spark, rows), 4)


def test_blocks_of_a_dominant_component(spark):
    """20,000 members of one component and 20 others in a bucket: pairs of blocks grow with the members, not with their square."""
    rows = spark.range(20_020).select(F.lit(7).cast("long").alias("key"), F.col("id"), F.lit(100).cast("long").alias("n"), F.when(F.col("id") < 20_000, F.lit(0).cast("long")).otherwise(F.col("id")).alias("c"))
    pairs = neardup.block_pairs(rows.union(rows.withColumn("key", F.lit(8).cast("long")).where("c = 0")))
    made = pairs.groupBy("key", "i", "j").agg(F.count("*").alias("n"), F.count_distinct("c").alias("c")).collect()
    assert {r.key for r in made} == {7} and len(made) <= 21 and sum(r.n for r in made) < 21_000  # one shared block, with itself and with the 20 or so of the component
    meets = pairs.where("c = 0").select("id").distinct().count()
    assert meets == 20_000


def test_every_pair_of_components_meets(spark):
    """Large and small components: two members of different components share a pair of blocks, whichever they are."""
    sizes = [2500, 1200, 1000, 300, 1, 1, 1]
    rows = [(1, 10_000 * c + i, 10, c) for c, n in enumerate(sizes) for i in range(n)]
    pairs = neardup.block_pairs(spark.createDataFrame(rows, "key long, id long, n long, c long"))
    made = {}
    for r in pairs.collect():
        made.setdefault((r.i, r.j), []).append((r.own, r.id, r.c))
    rng = random.Random(4)
    for _ in range(3000):
        (_, x, _, c), (_, y, _, d) = rng.sample(rows, 2)
        meet = sum(any(i == x for _, i, _ in m) and any(i == y for _, i, _ in m) for m in made.values()) if c != d and rng.random() < 0.02 else None
        assert meet in (None, 1)
    for (i, j), m in made.items():
        assert i == j or {o for o, _, _ in m} == {i, j}
