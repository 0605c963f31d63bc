"""Constraint checks as violation queries: no row means valid.

``require_none`` turns such a query into an error at the edge of the engine; it is the
only function here that runs a job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import opaque_candidate, slot_set_digest
from ..functions.text import blank


class InvalidInput(ValueError):
    """Input that breaks a declared constraint."""


def require_none(violations: DataFrame, message: str, shown: int = 5) -> None:
    if rows := violations.limit(shown).collect():
        raise InvalidInput(f"{message}: {[r.asDict() for r in rows]}")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """keys and n of the groups that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def blank_fields(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which one of the columns is null or only white space."""
    return df.where(reduce(lambda a, b: a | b, [blank(F.col(c)) for c in columns]))


def coverage_violations(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """release_id, case_id, problem (missing, unknown, duplicate): every release answers every case once.

    One full join on the pair (release, case) finds all three.
    """
    want = predictions.select("release_id").distinct().join(cases.select("case_id").distinct(), how="cross")  # the result's own size: a row per release and case
    have = predictions.groupBy("release_id", "case_id").agg(F.count("*").alias("n"))
    both = want.withColumn("wanted", F.lit(True)).join(have, ["release_id", "case_id"], "full")
    problem = F.when(F.col("n").isNull(), F.lit("missing")).when(F.col("wanted").isNull(), F.lit("unknown")).when(F.col("n") > 1, F.lit("duplicate"))
    return both.withColumn("problem", problem).where("problem is not null").select("release_id", "case_id", "problem")


def slice_violations(cases: DataFrame, slices: DataFrame, members: DataFrame) -> DataFrame:
    """name, problem, n: slices named twice or without members, members repeated or unknown, thresholds outside [0, 1]."""
    repeated = duplicates(members, "name", "case_id").groupBy("name").agg(F.count("*").alias("n"))
    unknown = members.join(cases, "case_id", "left_anti").groupBy("name").agg(F.count("*").alias("n"))
    return limit_violations(slices, members).unionByName(_problem(repeated, "repeated member")).unionByName(_problem(unknown, "unknown case"))


def _problem(df: DataFrame, problem: str) -> DataFrame:
    return df.select("name", F.lit(problem).alias("problem"), F.col("n").cast("long").alias("n"))


def limit_violations(slices: DataFrame, members: DataFrame) -> DataFrame:
    """name, problem, n: slices named twice or without members, thresholds outside [0, 1]."""
    empty = slices.join(members.select("name").distinct(), "name", "left_anti").withColumn("n", F.lit(0))
    bad = lambda c: F.col(c).isNotNull() & ~(F.col(c).between(0, 1) & ~F.isnan(c))
    limits = slices.where(bad("maximum_accuracy_drop") | F.col("maximum_accuracy_drop").isNull() | bad("minimum_accuracy")).withColumn("n", F.lit(1))
    parts = [_problem(duplicates(slices, "name"), "duplicate name"), _problem(empty, "no members"), _problem(limits, "threshold")]
    return reduce(DataFrame.unionByName, parts)


def whole(cases: DataFrame, predictions: DataFrame | None = None, members: DataFrame | None = None) -> bool:
    """Whether every case is there once, is answered once by every release, and is once at most in a slice, and nothing else is there.

    All rows move once, by their case; which rows are wrong is for ``coverage_violations`` and ``slice_violations`` to tell.
    """
    rows, releases = cases.select("case_id", F.lit(0).alias("of"), F.lit(None).cast("string").alias("name")), cases.sparkSession.range(1).select(F.lit(0).cast("long").alias("releases"))
    if predictions is not None:
        rows = rows.union(predictions.select("case_id", F.lit(1), F.coalesce("release_id", F.lit(""))))
        releases = predictions.select(F.coalesce("release_id", F.lit("")).alias("r")).distinct().agg(F.count("*").alias("releases"))
    if members is not None:
        rows = rows.union(members.select("case_id", F.lit(2), "name"))
    each = rows.repartition("case_id").groupBy("case_id", "of", "name").agg(F.count("*").alias("n"))
    each = each.groupBy("case_id").agg(F.max("n").alias("most"), F.count_if(F.col("of") == 0).alias("known"), F.count_if(F.col("of") == 1).alias("answered"))
    found = each.crossJoin(releases).where((F.col("most") > 1) | (F.col("known") < 1) | (F.col("answered") != F.col("releases")))
    return not found.limit(1).count()


def role_violations(predictions: DataFrame, baseline: str = "baseline", candidate: str = "candidate") -> DataFrame:
    """problem: roles without predictions, equal roles, blank release names."""
    names = predictions.select("release_id").distinct()
    found = names.agg(F.max(F.col("release_id") == baseline).alias("b"), F.max(F.col("release_id") == candidate).alias("c"), F.max(blank(F.col("release_id"))).alias("w"))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    checks = [(no("b"), "no baseline"), (no("c"), "no candidate"), (F.coalesce(F.col("w"), F.lit(False)), "blank release"), (F.lit(baseline == candidate), "equal roles")]
    return found.select(F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]))).alias("problem"))


def fd_violations(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value: a functional dependency is broken."""
    return df.groupBy(key).agg(F.min(value).alias("least"), F.max(value).alias("greatest")).where("least <> greatest").select(key)


def varying(df: DataFrame, group: list[str], *columns: str) -> DataFrame:
    """Groups in which one of the columns isn't constant, null being a value."""
    one = F.struct(*columns)
    return df.groupBy(*group).agg(F.min(one).alias("lo"), F.max(one).alias("hi")).where("not (lo <=> hi)").select(*group)


def key_set_violations(df: DataFrame, expected: DataFrame) -> DataFrame:
    """The key columns of ``expected`` and problem: keys missing, unexpected or repeated."""
    keys = expected.columns
    have = df.groupBy(*keys).agg(F.count("*").alias("n"))
    both = expected.withColumn("wanted", F.lit(True)).join(have, keys, "full")
    problem = F.when(F.col("n").isNull(), F.lit("missing")).when(F.col("wanted").isNull(), F.lit("unexpected")).when(F.col("n") > 1, F.lit("repeated"))
    return both.withColumn("problem", problem).where("problem is not null").select(*keys, "problem")


def slot_violations(slots: DataFrame, content: Column, unique_model: bool = False) -> DataFrame:
    """release_id, problem, n: repeated slot, source or model ids; a model id that isn't the content's digest."""
    def repeated(c):
        return duplicates(slots, "release_id", c).groupBy("release_id").agg(F.count("*").alias("n")).select("release_id", F.lit(f"repeated {c}").alias("problem"), "n")

    parts = [repeated(c) for c in ("slot_id", "source_content_id", *(["model_content_id"] if unique_model else []))]
    wrong = slots.where(F.col("model_content_id") != content).groupBy("release_id").agg(F.count("*").alias("n"))
    parts.append(wrong.select("release_id", F.lit("wrong model_content_id").alias("problem"), "n"))
    return reduce(DataFrame.unionByName, parts)


def alignment_violations(a: DataFrame, b: DataFrame) -> DataFrame:
    """slot_id, problem of two releases whose slots or source ids differ."""
    x, y = a.select("slot_id", F.col("source_content_id").alias("sa")), b.select("slot_id", F.col("source_content_id").alias("sb"))
    problem = F.when(F.col("sb").isNull(), F.lit("missing")).when(F.col("sa").isNull(), F.lit("unexpected")).when(F.col("sa") != F.col("sb"), F.lit("source changed"))
    return x.join(y, "slot_id", "full").withColumn("problem", problem).where("problem is not null").select("slot_id", "problem")


def manifest_violations(manifest: DataFrame) -> DataFrame:
    """candidate_id, problem for rows (candidate_id, changed_slot_count, changed_slot_ids, changed_slot_ids_sha256)."""
    ids = F.col("changed_slot_ids")
    checks = [
        (F.size(ids) == 0, "no slots"),
        (F.array_sort(ids) != ids, "not sorted"),
        (F.size(F.array_distinct(ids)) != F.size(ids), "repeated slots"),
        (F.size(ids) != F.col("changed_slot_count"), "count"),
        (slot_set_digest(ids) != F.col("changed_slot_ids_sha256"), "slot digest"),
        (opaque_candidate(ids) != F.col("candidate_id"), "opaque id"),
    ]
    rows = manifest.select("candidate_id", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]))).alias("problem"))
    twice = duplicates(manifest, "candidate_id").select("candidate_id", F.lit("repeated candidate").alias("problem"))
    few = manifest.agg(F.count("*").alias("n")).where("n < 2").select(F.lit("").alias("candidate_id"), F.lit("fewer than two candidates").alias("problem"))
    return rows.unionByName(twice).unionByName(few)


def checkpoint_violations(records: DataFrame, group: list[str], epochs: int = 7) -> DataFrame:
    """group, epoch, problem: epochs other than 1..n once each, steps that don't rise, bad rates or digests."""
    before = F.lag("steps").over(W.partitionBy(*group).orderBy("epoch"))
    rate = F.col("learning_rate")
    checks = [
        (~F.col("epoch").between(1, epochs), "epoch"),
        (F.col("steps") <= F.coalesce(before, F.lit(-1)), "steps"),
        (rate.isNull() | F.isnan(rate) | (rate <= 0) | (rate == float("inf")), "learning rate"),
        (~F.lower("state_sha256").rlike("^[0-9a-f]{64}$"), "digest"),
    ]
    rows = records.withColumn("p", F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]))).select(*group, "epoch", F.explode("p").alias("problem"))
    number = records.groupBy(*group).agg(F.count("*").alias("n"), F.count_distinct("epoch").alias("k")).where((F.col("n") != epochs) | (F.col("k") != epochs))
    return rows.unionByName(number.select(*group, F.lit(0).alias("epoch"), F.lit("number of epochs").alias("problem")))


def sequence_differences(a: DataFrame, b: DataFrame, place: str, *columns: str) -> DataFrame:
    """Places at which two ordered record sequences differ, or that only one of them has."""
    x, y = a.select(place, F.struct(*columns).alias("xa")), b.select(place, F.struct(*columns).alias("xb"))
    return x.join(y, place, "full").where(~F.col("xa").eqNullSafe(F.col("xb"))).select(place)


def multiset_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows and their surplus in ``a`` (negative: in ``b``)."""
    both = a.withColumn("d", F.lit(1)).unionByName(b.withColumn("d", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("d").alias("surplus")).where("surplus <> 0")


def failed_gates(gates: dict[str, Column], df: DataFrame) -> DataFrame:
    """gate, passed for conditions over the one row of ``df``."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(name).alias("gate"), F.coalesce(ok, F.lit(False)).alias("passed")) for name, ok in gates.items()])).alias("x")).select("x.gate", "x.passed")


def profile_violations(found: DataFrame, declared: dict[str, int]) -> DataFrame:
    """field, declared, found for the fields of the one row of ``found`` that aren't as declared."""
    rows = found.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.lit(x).cast("long").alias("declared"), F.col(k).cast("long").alias("found")) for k, x in declared.items()])).alias("x")).select("x.*")
    return rows.where(~F.col("declared").eqNullSafe(F.col("found")))


def balance_gates(rows: DataFrame, groups: list[str], target: Column, flips: int) -> DataFrame:
    """gate, passed for a construction (shard_id, example_id, response, candidate_response).

    Over the shards ``groups``: as many rows on the target's surface in each; ``flips``
    changes either way in each; over all rows: the same labels before and after, and opaque ids.
    """
    before, after = F.col("response"), F.col("candidate_response")
    way = lambda x, y: F.count_if((before == x) & (after == y))
    per = rows.where(F.col("shard_id").isin(*groups)).groupBy("shard_id").agg(F.count_if(target).alias("surface"), way("ACCEPT", "REJECT").alias("up"), way("REJECT", "ACCEPT").alias("down"))
    some = per.agg(F.count("*").alias("n"), F.min("surface").alias("lo"), F.max("surface").alias("hi"), F.bool_and((F.col("up") == flips) & (F.col("down") == flips)).alias("even"))
    every = rows.agg(F.sum((before == "ACCEPT").cast("long") - (after == "ACCEPT").cast("long")).alias("shift"), F.bool_and(F.col("example_id").rlike("^rec_[0-9a-f]{16}$")).alias("opaque"))
    one = some.crossJoin(every)  # one row each
    return failed_gates({"shards": F.col("n") == len(groups), "equal target surfaces": F.col("lo") == F.col("hi"), "equal flip directions": F.col("even"), "labels preserved": F.col("shift") == 0, "opaque ids": F.col("opaque")}, one)


def extra_fields(records: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Records (JSON text) whose fields aren't exactly the allowed ones."""
    keys = F.array_sort(F.json_object_keys(column))
    return records.where(~F.coalesce(keys == F.array(*[F.lit(a) for a in sorted(allowed)]), F.lit(False)))


def score_violations(ranking: DataFrame) -> DataFrame:
    """change_id, problem for rankings (change_id, score): blank or repeated ids, scores that aren't finite."""
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    rows = ranking.select("change_id", F.explode(F.array_compact(F.array(F.when(blank(F.col("change_id")), F.lit("blank id")), F.when(bad, F.lit("score"))))).alias("problem"))
    return rows.unionByName(duplicates(ranking, "change_id").select("change_id", F.lit("repeated id").alias("problem")))


def vector_violations(rows: DataFrame, vector: str, label: str, width: int, labels: Column) -> DataFrame:
    """Rows whose vector has another width or an entry that isn't finite, or whose label isn't known."""
    checks = [
        (F.size(vector) != width, "width"),
        (F.exists(vector, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "not finite"),
        (~F.array_contains(labels, F.col(label)), "unknown label"),
    ]
    return rows.withColumn("problem", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(text)) for bad, text in checks]))))
