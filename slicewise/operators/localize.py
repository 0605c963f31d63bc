"""Localization: scores of candidate changes, from hashes, labels, texts, or last-layer features.

Truth is never an input here.
"""

from __future__ import annotations

import random

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import RANDOM_SPACE, joined, u64
from ..functions.vectors import dot, softmax_delta
from .records import free_names
from .similarity import best_similarity


def random_scores(candidates: DataFrame, world: str = "world", candidate: str = "candidate_id") -> DataFrame:
    """world, candidate, score: the hash method; scores are unsigned 64-bit numbers."""
    return candidates.select(world, candidate, u64(joined(RANDOM_SPACE, F.col(world).cast("string"), F.col(candidate).cast("string"))).alias("score"))


def neutral(changes: DataFrame, change: str = "change_id") -> DataFrame:
    """change, score 0: the baseline that says nothing."""
    return changes.select(change, F.lit(0.0).alias("score"))


def seeded_ranking(spark, change_ids: list[str], seed: int = 42) -> DataFrame:
    """change_id, score, rank of a seeded shuffle of the manifest's few changes, made on the driver."""
    order = list(change_ids)
    random.Random(seed).shuffle(order)
    return spark.createDataFrame([(c, float(len(order) - r), r) for r, c in enumerate(order, 1)], "change_id string, score double, rank int")


def label_overlap(changes: DataFrame, targets: list[str], candidate: str = "candidate") -> DataFrame:
    """candidate, score: changed slots whose clean label is a target."""
    return changes.groupBy(candidate).agg(F.count_if(F.col("label").isin(*targets)).alias("score"))


def lexical_scores(regressions: DataFrame, prompts: DataFrame, change: str = "change_id") -> DataFrame:
    """change, score: mean over regressions (case_id, tokens) of their best similarity with a change's prompts (right_id, change, tokens)."""
    n = regressions.agg(F.count("*").alias("n"))
    best = best_similarity(regressions, prompts, ["case_id"], [change]).groupBy(change).agg(F.sum("best").alias("total"))
    return prompts.select(change).distinct().join(best, change, "left").crossJoin(n).select(change, (F.coalesce("total", F.lit(0.0)) / F.col("n")).alias("score"))


def role_scores(regressions: DataFrame, prompts: DataFrame, change: str = "change_id") -> DataFrame:
    """change, score: share of regressions whose descriptor (column ``descriptor``) is among the change's."""
    n = regressions.agg(F.count("*").alias("n"))
    has = prompts.select(change, "descriptor").distinct()
    hits = regressions.join(has, "descriptor").groupBy(change).agg(F.count("*").alias("hits"))
    return prompts.select(change).distinct().join(hits, change, "left").crossJoin(n).select(change, (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("score"))


def changed_records(before: DataFrame, after: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows of ``after`` that differ from those of ``before`` with the same key."""
    (was,) = free_names(after, "_was")
    b = before.select(key, F.struct(*columns).alias(was))
    return after.join(b, key).where(~F.struct(*columns).eqNullSafe(F.col(was))).drop(was)


def observed_regressions(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Cases that the baseline gets right and the candidate doesn't, null being wrong; rows (case_id, prompt, expected, parsed_label)."""
    b = baseline.select("case_id", "prompt", "expected", F.col("parsed_label").alias("before"))
    c = candidate.select("case_id", F.col("prompt").alias("p2"), F.col("expected").alias("e2"), F.col("parsed_label").alias("after"))
    same = F.when((F.col("prompt") == F.col("p2")) & (F.col("expected") == F.col("e2")), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("mismatch for case "), F.col("case_id"))).cast("boolean"))
    rows = b.join(c, "case_id").where(same)
    return rows.where((F.col("before") == F.col("expected")) & ~F.col("after").eqNullSafe(F.col("expected"))).select("case_id", "prompt", "expected", "before", "after")


def summed(slots: DataFrame, scores: DataFrame, candidate: str = "candidate") -> DataFrame:
    """candidate, score: sum of its slots' scores; a slot without one counts 0."""
    return slots.join(scores, "slot_id", "left").groupBy(candidate).agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("score"))


UNIT = 1074  # every finite double is a whole number of 2 ** -1074


def exact_sums(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key and the correctly rounded sum of its values, whatever their order.

    A double is a whole multiple of 2 ** -1074, so sums are exact as whole numbers: each
    batch gives one per key, and these few are added up and rounded once.
    """
    kind = rows.schema[key].dataType

    def partial(batches):
        for batch in batches:
            total: dict = {}
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                top, bottom = x.as_integer_ratio()  # bottom is a power of 2
                total[k] = total.get(k, 0) + (top << (UNIT - bottom.bit_length() + 1))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), batch.column(0).type), pa.array([hex(n) for n in total.values()], pa.string())], names=[key, "whole"])

    def rounded(wholes: pd.Series) -> pd.Series:
        return wholes.map(lambda parts: sum(int(p, 16) for p in parts) / (1 << UNIT))

    parts = rows.select(key, value).mapInArrow(partial, T.StructType([T.StructField(key, kind), T.StructField("whole", T.StringType())]))
    return parts.groupBy(key).agg(F.collect_list("whole").alias("whole")).select(key, F.pandas_udf(rounded, T.DoubleType())(F.col("whole")).alias("score"))


def suspiciousness(slots: DataFrame, scores: DataFrame, candidate: str = "candidate") -> DataFrame:
    """candidate, score: exact sum over its slots; a slot without a finite score, or listed twice, is an error."""
    rows = slots.groupBy(candidate, "slot_id").agg(F.count("*").alias("n")).join(scores.select("slot_id", F.col("score").cast("double").alias("s")), "slot_id", "left")
    bad = F.col("s").isNull() | F.isnan("s") | (F.abs("s") == float("inf")) | (F.col("n") > 1)
    ok = F.when(~bad, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no single finite score for "), "slot_id")).cast("boolean"))
    return exact_sums(rows.where(ok), candidate, "s")


def margin_loss(rows: DataFrame, a: int, b: int, vector: str = "logits", label: str = "label") -> DataFrame:
    """``rows`` with loss: minus the margin of the label over the other of the pair; another label is an error."""
    ok = F.when(F.col(label).isin(a, b), F.lit(True)).otherwise(F.raise_error(F.lit("a label outside the pair")).cast("boolean"))
    other = F.when(F.col(label) == a, F.lit(b)).otherwise(F.lit(a))
    return rows.where(ok).withColumn("loss", F.get(vector, other) - F.get(vector, F.col(label)))


def ranked(scores: DataFrame, group: list[str], candidate: str, score: str = "score") -> DataFrame:
    """``scores`` with rank: score descending, then id."""
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(F.desc(score), candidate)))


def mean_over(scores: DataFrame, group: list[str], value: str = "score") -> DataFrame:
    return scores.groupBy(*group).agg(F.avg(value).alias(value))


# ---------------------------------------------------------------- features


def margin_summary(rows: DataFrame, group: list[str], a: Column, b: Column, margin: Column) -> DataFrame:
    """group, mean margin, and counts of both labels, over rows whose label is a or b."""
    rows = rows.where((F.col("label") == a) | (F.col("label") == b))
    return rows.groupBy(*group).agg(F.avg(margin).alias("mean_margin"), F.count_if(F.col("label") == a).alias("count_a"), F.count_if(F.col("label") == b).alias("count_b"))


def target_vector(targets: DataFrame, group: list[str], a: int, width: int) -> DataFrame:
    """group, mean of signed target features, and mean sign: all that slot influences need of the targets.

    A target's loss gradient has -1 at its label and +1 at the other; with sign -1 for
    label a and +1 for b, its product with a slot's is sign * (d[a] - d[b]) * (f . g + 1).
    """
    sign = F.when(F.col("label") == a, F.lit(-1.0)).otherwise(F.lit(1.0))
    each = targets.select(*group, sign.alias("sign"), F.posexplode("features").alias("i", "x")).groupBy(*group, "i").agg(F.avg(F.col("sign") * F.col("x")).alias("m"), F.avg("sign").alias("mean_sign"))
    return each.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean_features"), F.max("mean_sign").alias("mean_sign"))


def grad_dot(slots: DataFrame, target: DataFrame, group: list[str], a: int, b: int) -> DataFrame:
    """group, slot_id, influence: the mean over targets of the product of last-layer gradients.

    ``slots`` is (group…, slot_id, features, logits, label); ``target`` one row per group.
    """
    rows = slots.withColumn("delta", softmax_delta(F.col("logits"), F.col("label")))
    rows = rows.join(target, group) if group else rows.crossJoin(target)
    value = (F.get("delta", F.lit(a)) - F.get("delta", F.lit(b))) * (dot(F.col("features"), F.col("mean_features")) + F.col("mean_sign"))
    return rows.select(*group, "slot_id", value.alias("influence"))


def trac_in(influences: DataFrame, rates: DataFrame, epoch: str = "epoch") -> DataFrame:
    """slot_id, score: minus the influences at all checkpoints, weighted by their learning rates."""
    return influences.join(rates, epoch).groupBy("slot_id").agg((-F.sum(F.col("learning_rate") * F.col("influence"))).alias("score"))


def centroids(rows: DataFrame, vector: str, label: str) -> DataFrame:
    """label, centroid: sums per entry of the vectors of each label, in the order of entries."""
    each = rows.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.sum("x").alias("s"))
    return each.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda t: t["s"]).alias("centroid"))
