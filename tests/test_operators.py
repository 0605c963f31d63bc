"""Golden values and edge cases of records, functions, ranking, localization and certification."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicewise.functions import canonical, hashing, text, vectors
from slicewise.operators import certify, localize, metrics, pairs, ranking, records, releases, tasks
from slicewise.operators import validate as val


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_hash_scores(spark):
    assert int(one(spark, hashing.u64(F.lit("mrf-m4-random-v1|w|c")))) == int.from_bytes(hashlib.sha256(b"mrf-m4-random-v1|w|c").digest()[:8], "big")
    assert one(spark, hashing.bucket(F.lit("base|1"))) == int(hashlib.sha256(b"base|1").hexdigest()[:8], 16) % 1000


def test_text_functions(spark):
    empty = F.expr("cast(array() as array<string>)")
    assert one(spark, text.jaccard(empty, empty)) == 0.0
    assert one(spark, text.strip(F.lit("  a b\t\x1f"))) == "a b"
    assert one(spark, text.parsed_label(F.lit(" accept\n"))) == "ACCEPT"
    assert one(spark, text.parsed_label(F.lit("maybe"))) is None
    prompt = "selected_slot=slot_b. slot_a:shape=circle,size=small; slot_b:shape=square,size=large"
    assert one(spark, text.role_descriptor(F.lit(prompt))) == "shape=square,size=large"
    assert one(spark, text.role_descriptor(F.lit(prompt + " selected_slot=slot_a"))) is None
    assert one(spark, text.role_descriptor(F.lit("selected_slot=slot_c"))) is None


def test_canonical_json(spark):
    value = '{"b": 1.5, "a": {"z": null, "y": "é"}}'
    want = hashlib.sha256(b'{"a":{"y":"\\u00e9"},"b":1.5}').hexdigest()
    assert one(spark, canonical.canonical_digest(F.lit(value))) == want
    assert one(spark, canonical.nfc(F.lit("é"))) == "é"


def test_softmax_and_margins(spark):
    v = F.array(F.lit(1.0), F.lit(2.0), F.lit(0.5))
    rows = spark.range(1).select(v.alias("v"))
    got = rows.select(vectors.softmax_delta(F.col("v"), F.lit(1)).alias("d"), vectors.log_odds(F.col("v"), F.lit(1)).alias("m"), vectors.argmax(F.col("v")).alias("a")).first()
    e = np.exp([1.0, 2.0, 0.5])
    assert got.d == pytest.approx(list(e / e.sum() - [0, 1, 0]))
    assert got.m == pytest.approx(2.0 - math.log(e[0] + e[2])) and got.a == 1


def test_hash_rank_is_row_number(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id"), hashing.sha(F.col("id").cast("string")).alias("h"))
    got = records.hash_rank(rows, ["g"], F.col("h"), total="n").collect()
    for g in range(3):
        own = sorted((r.h, r["rank"], r.n) for r in got if r.g == g)
        assert [x[1] for x in own] == list(range(1, 1001)) and {x[2] for x in own} == {1000}


@pytest.mark.parametrize("n, want", [(1, 0), (2, 0), (3, 1), (9, 2), (11, 2), (13, 3)])
def test_split_sizes(spark, n, want):
    rows = spark.range(n).select(F.lit("l").alias("label"), F.col("id").cast("string").alias("text"), hashing.sha(F.col("id").cast("string")).alias("content_id"))
    assert records.split(rows).where("split = 'eval'").count() == want


def test_restore_undoes_change(spark):
    rows = spark.range(60).select(F.format_string("slot_%06d", "id").alias("slot_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.when(F.col("id") < 30, F.lit("a_x")).otherwise(F.lit("b_x")).alias("label"))
    base = rows.withColumn("content_id", canonical.content_id(F.col("label"), F.col("text"))).transform(releases.clean_release)
    change = releases.label_swap(base, "a_x", "b_x", 5)
    assert change.count() == 10 and change.where("label = 'a_x'").count() == 5
    after = releases.apply_changes(base, change)
    assert releases.changed(base, after).count() == 10
    assert releases.changed(base, releases.restored(after, base, change)).count() == 0
    smaller = releases.swap_selection(base, "a_x", "b_x", 3)
    assert smaller.join(change, "slot_id").count() == 6  # selections are nested
    both = releases.union_changes({"1": change, "2": change.limit(1)})
    assert releases.overlaps(both).count() == 1
    with pytest.raises(Exception, match="two candidates change"):
        releases.composite(base, both).collect()


def test_tie_aware_scores(spark):
    r = spark.createDataFrame([("w", c, s) for c, s in (("a", 1.0), ("b", 1.0), ("c", 1.0 + 1e-13), ("d", 0.5))], "w string, candidate string, score double")
    t = ranking.tie_aware(r, spark.createDataFrame([("w", "b")], "w string, root string"), ["w"]).first()
    assert (t.best_rank, t.worst_rank, t.average_rank, t.reciprocal_rank, t.top_1, t.top_3) == (1, 3, 2.0, 0.5, False, True)


def test_best_similarity_is_brute_force(spark):
    rng = np.random.default_rng(3)
    sets = lambda n: [sorted({f"t{x}" for x in rng.integers(0, 12, rng.integers(0, 6))}) for _ in range(n)]
    a, b = sets(30), sets(20)
    left = spark.createDataFrame([(str(i), s) for i, s in enumerate(a)], "case_id string, tokens array<string>")
    right = spark.createDataFrame([(str(i), s) for i, s in enumerate(b)], "right_id string, tokens array<string>")
    got = {r.case_id: r.best for r in localize.best_similarity(left, right, ["case_id"]).collect()}
    for i, x in enumerate(a):
        want = max((len(set(x) & set(y)) / len(set(x) | set(y)) for y in b if set(x) | set(y)), default=0)
        assert got.get(str(i), 0.0) == pytest.approx(want)


def test_grad_dot_is_the_matrix_mean(spark):
    rng = np.random.default_rng(5)
    f, z, y = rng.normal(size=(8, 4)), rng.normal(size=(8, 3)), rng.integers(0, 3, 8)
    t, ty = rng.normal(size=(5, 4)), rng.integers(0, 2, 5)
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True) - np.eye(3)[y]
    d = np.zeros((5, 3))
    d[np.arange(5), ty], d[np.arange(5), 1 - ty] = -1, 1
    want = ((d @ p.T) * (t @ f.T + 1)).mean(0)
    slots = spark.createDataFrame([(i, f[i].tolist(), z[i].tolist(), int(y[i])) for i in range(8)], "slot_id int, features array<double>, logits array<double>, label int")
    targets = spark.createDataFrame([(t[i].tolist(), int(ty[i])) for i in range(5)], "features array<double>, label int")
    got = localize.grad_dot(slots, localize.target_vector(targets, [], 0, 4), [], 0, 1).orderBy("slot_id").collect()
    assert [r.influence for r in got] == pytest.approx(list(want))


def test_greedy_pairs(spark):
    ranked = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "c", "d"), (4, "a", "e"), (5, "e", "f")], "rank int, label_a string, label_b string")
    assert [(r.label_a, r.label_b) for r in pairs.greedy_disjoint(ranked, 9).orderBy("place").collect()] == [("a", "b"), ("c", "d"), ("e", "f")]
    with pytest.raises(Exception, match="too few"):
        pairs.matched_worlds(ranked, 2, 2).collect()


def test_describe_one_value(spark):
    r = metrics.describe(spark.createDataFrame([(1, 0.5)], "g int, v double"), ["g"], "v").first()
    assert (r["mean"], r.sample_stdev, r.positive) == (0.5, 0.0, 1)


def test_nearest_rank_is_by_index(spark):
    rows = spark.createDataFrame([(int(x),) for x in [5, 1, 4, 4, 2, 9, 7]], "n long")
    r = metrics.nearest_rank(rows, "n", {"p50": 0.5, "p99": 0.99}).first()
    assert (r.p50, r.p99, r.examples) == (4, 9, 7)


def test_certification_needs_one_qualifier(spark):
    splits = certify.REQUIRED
    rows = [("baseline", s, 1.0) for s in splits] + [("candidate", s, 0.0 if s == certify.TARGET else 1.0) for s in splits]
    rows += [(f"restore:{c}", s, (x if s == certify.TARGET else 1.0)) for c, x in (("a", 1.0), ("b", 0.0)) for s in splits]
    scores = spark.createDataFrame(rows, "run string, split string, score double")
    assert certify.certification(scores, "a").first().all_passed
    assert not certify.certification(scores, "b").first().all_passed
    with pytest.raises(Exception, match="lacks split"):
        certify.candidate_gate(scores.where("split <> 'all'")).collect()


def test_task_counts(spark):
    grid = tasks.grid(spark, tasks.TRAIN_MATERIALS, "train")
    assert (grid.count(), tasks.grid(spark, tasks.EVAL_MATERIALS, "eval").count()) == (288, 96)
    mixed = tasks.mixed_shards(spark)
    per = {r.shard_id: (r.n, r.c) for r in mixed.groupBy("shard_id").agg(F.count("*").alias("n"), F.count_if(F.col("response") != F.col("candidate_response")).alias("c")).collect()}
    assert {k: v for k, v in per.items() if k != "shard_stable_00"} == {s: (48, 32) for s in tasks.MIX_SHARDS}
    changed = tasks.panel_changes(spark).where("response <> candidate_response")
    assert {r.least for r in tasks.balance(changed, ["shard_id"], ["selected_slot"]).collect()} == {6}
    assert tasks.lookups(spark, "train").count() == 288 and tasks.lookups(spark, "eval").count() == 96


def test_checkpoint_contract(spark):
    rows = [("t", e, e * 10, 0.1, "a" * 64) for e in range(1, 8)]
    make = lambda r: spark.createDataFrame(r, "t string, epoch int, steps int, learning_rate double, state_sha256 string")
    assert val.checkpoint_violations(make(rows), ["t"]).count() == 0
    bad = [*rows[:5], ("t", 6, 50, float("nan"), "A" * 64)]
    assert {r.problem for r in val.checkpoint_violations(make(bad), ["t"]).collect()} == {"steps", "learning rate", "number of epochs"}


def test_digests_are_the_plain_ones(spark):
    import json

    from slicewise.operators import digests

    rows = [(f"slot_{i:06d}", f"s{i}", f"m{i}", "t", "é" if i % 2 else "b") for i in range(7)]
    df = spark.createDataFrame(rows[::-1], "slot_id string, source_content_id string, model_content_id string, text string, label string")
    names = ["slot_id", "source_content_id", "model_content_id", "label"]
    records_ = [dict(zip(names, (r[0], r[1], r[2], r[4]), strict=True)) for r in rows]
    want = hashlib.sha256(json.dumps(records_, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert digests.release_digest(df) == want
    lines = "".join(json.dumps(r, sort_keys=True, separators=(",", ":")) + "\n" for r in records_)
    assert digests.stream_digest(df, ["slot_id"], names) == hashlib.sha256(lines.encode()).hexdigest()


def test_balanced_allocation_counts(spark):
    shards = [f"s{i}" for i in range(5)]
    rows = tasks.balanced_allocation(spark, shards, "s2", 11).join(tasks.panels(spark, tasks.TRAIN_MATERIALS, "train"), "example_id")
    per = rows.groupBy("shard_id").agg(F.count("*").alias("n"), F.count_distinct("example_id").alias("k"), F.count_if(F.col("response") == "ACCEPT").alias("a"), F.count_if(F.col("selected_slice_id") == tasks.TARGET_SLICE).alias("t")).collect()
    assert {(r.n, r.k, r.a) for r in per} == {(24, 24, 12)} and {r.shard_id: r.t for r in per} == {s: 12 if s == "s2" else 0 for s in shards}
    assert {(r.least, r.most) for r in tasks.balance(rows, ["shard_id"], ["selected_slot"]).collect()} == {(4, 4)}


def test_suspiciousness_is_strict_and_exact(spark):
    slots = spark.createDataFrame([("c", "1"), ("c", "2"), ("c", "3")], "candidate string, slot_id string")
    scores = spark.createDataFrame([("1", 1e16), ("2", 1.0), ("3", -1e16)], "slot_id string, score double")
    assert localize.suspiciousness(slots, scores).first().score == 1.0
    with pytest.raises(Exception, match="no single finite score"):
        localize.suspiciousness(slots, scores.where("slot_id < '3'")).collect()
    with pytest.raises(Exception, match="no single finite score"):
        localize.suspiciousness(slots.union(slots.limit(1)), scores).collect()
    with pytest.raises(Exception, match="outside the pair"):
        localize.margin_loss(spark.createDataFrame([([0.0, 1.0], 2)], "logits array<double>, label int"), 0, 1).collect()


def test_seeded_ranking(spark):
    import random

    order = [f"c{i}" for i in range(6)]
    want = list(order)
    random.Random(42).shuffle(want)
    got = localize.seeded_ranking(spark, order).orderBy("rank").collect()
    assert [r.change_id for r in got] == want and [r.score for r in got] == [5.0, 4.0, 3.0, 2.0, 1.0, 0.0]


def test_whole_tables_by_one_look(spark):
    """Rows by case find what the two lists of violations find."""
    cases, members = [("a", "x"), ("b", "x")], [("s", "a"), ("s", "b"), ("t", "a")]
    answers = [(r, c, "x") for r in ("baseline", "candidate") for c in "ab"]
    tries = [(cases, answers, members), (cases + [("a", "y")], answers, members), (cases + [("c", "x")], answers, members), (cases, answers[:-1], members), (cases, answers + answers[:1], members)]
    tries += [(cases, answers[1:] + [("baseline", "b", "x")], members), (cases, answers, members + members[:1]), (cases, answers, members + [("t", "z")])]
    got = []
    for c, p, m in tries:
        t = [spark.createDataFrame(rows, f"{x} string, {y} string{z}") for rows, x, y, z in ((c, "case_id", "expected", ""), (p, "release_id", "case_id", ", observed string"), (m, "name", "case_id", ""))]
        slices = t[2].select("name").distinct().withColumns({"maximum_accuracy_drop": F.lit(0.1), "minimum_accuracy": F.lit(None).cast("double")})
        faults = [val.duplicates(t[0], "case_id"), val.coverage_violations(t[0], t[1]), val.slice_violations(t[0], slices, t[2])]
        got.append(val.whole(*t))
        assert got[-1] == (not any(f.count() for f in faults))
    assert got == [True] + [False] * 7
