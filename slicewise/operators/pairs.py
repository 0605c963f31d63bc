"""Confusion between labels, eligible label pairs, their rankings, and greedy disjoint choices.

Per-label and per-pair tables grow with the number of labels, not of rows: the one pass
over predictions is a hash aggregation by (truth, prediction).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import ROOT_SPACE, u64
from ..functions.text import jaccard, label_tokens
from .matching import greedy_matching

RULES = ("v1", "v2", "matched")


def confusion_counts(preds: DataFrame) -> DataFrame:
    """true_label, predicted_label, n of wrong predictions, trajectories pooled."""
    return preds.where("true_label <> predicted_label").groupBy("true_label", "predicted_label").agg(F.count("*").alias("n"))


def pair_features(preds: DataFrame, recalls: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row per unordered pair of labels (a < b): sizes, least recall over trajectories, token similarity, directed confusion, rates.

    ``sizes`` is (label, train, eval); ``recalls`` (trajectory_id, label, recall).
    """
    least = recalls.groupBy("label").agg(F.min("recall").alias("least"))
    truth = preds.groupBy(F.col("true_label").alias("label")).agg(F.count("*").alias("truth"))
    one = sizes.where("train > 0").join(least, "label", "left").join(truth, "label", "left").withColumn("tokens", label_tokens(F.col("label")))
    side = lambda s: one.select(*[F.col(c).alias(f"{c}_{s}") for c in one.columns])
    pairs = side("a").join(side("b"), F.col("label_a") < F.col("label_b"))
    conf = confusion_counts(preds)
    for name, x, y in (("a_to_b", "a", "b"), ("b_to_a", "b", "a")):
        n = conf.select(F.col("true_label").alias("t"), F.col("predicted_label").alias("p"), F.col("n").alias(name))
        pairs = pairs.join(n, (F.col(f"label_{x}") == F.col("t")) & (F.col(f"label_{y}") == F.col("p")), "left").drop("t", "p").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    rate = 0.5 * (F.try_divide("a_to_b", "truth_a") + F.try_divide("b_to_a", "truth_b"))
    return pairs.select(
        "label_a", "label_b", "train_a", "train_b", "eval_a", "eval_b", F.least("least_a", "least_b").alias("min_recall"), jaccard(F.col("tokens_a"), F.col("tokens_b")).alias("jaccard"),
        "a_to_b", "b_to_a", (F.col("a_to_b") + F.col("b_to_a")).alias("mutual"), rate.alias("rate"),
    )


def gates(min_train: int, min_eval: int, min_recall: float) -> dict:
    """Conditions on a pair, in their cumulative order."""
    c = F.col
    return {
        "train": (c("train_a") >= min_train) & (c("train_b") >= min_train),
        "eval": (c("eval_a") >= min_eval) & (c("eval_b") >= min_eval),
        "recall": F.coalesce(c("min_recall") >= min_recall, F.lit(False)),
        "lexical": c("jaccard") > 0,
        "any_confusion": c("mutual") > 0,
        "both_confusions": (c("a_to_b") > 0) & (c("b_to_a") > 0),
    }


def rank_pairs(features: DataFrame, rule: str, excluded: list[str] = (), min_train: int = 66, min_eval: int = 20, min_recall: float = 0.9) -> DataFrame:
    """Eligible pairs with rank: rate, mutual count, similarity (matched: least recall) descending, then labels."""
    g = gates(min_train, min_eval, min_recall)
    ok = g["train"] & g["eval"] & g["recall"]
    ok = ok & {"v1": g["lexical"] & g["both_confusions"], "v2": g["lexical"] & g["any_confusion"], "matched": g["lexical"] | g["any_confusion"]}[rule]
    if excluded:
        ok = ok & ~F.col("label_a").isin(*excluded) & ~F.col("label_b").isin(*excluded)
    keys = [F.desc("rate"), F.desc("mutual"), F.desc("jaccard"), *([F.desc("min_recall")] if rule == "matched" else []), "label_a", "label_b"]
    return features.where(ok).withColumn("rank", F.row_number().over(W.orderBy(*keys)))


def stage_counts(features: DataFrame, stages: dict) -> DataFrame:
    """stage, step, and of the pairs that meet its condition: pairs, labels (that stand in one), capacity (pairs that a greedy choice in the order of labels takes).

    A stage that no pair reaches has zeros.  All stages are matched in one iteration, a group each.
    """
    names = list(stages)
    counts = features.agg(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(k).alias("step"), F.count_if(c).alias("pairs")) for k, (s, c) in enumerate(stages.items(), 1)]).alias("x"))
    counts = counts.select(F.explode("x").alias("x")).select("x.*")
    inside = features.select("label_a", "label_b", F.explode(F.array_compact(F.array(*[F.when(stages[s], F.lit(s)) for s in names]))).alias("at"))
    labels = inside.select("at", F.explode(F.array("label_a", "label_b")).alias("label")).groupBy("at").agg(F.count_distinct("label").alias("labels"))
    taken = greedy_matching(inside.withColumn("same", F.lit(0)), "at", "same").groupBy(F.col("at").alias("at2")).agg(F.count("*").alias("capacity"))
    out = counts.join(labels, F.col("stage") == F.col("at"), "left").join(taken, F.col("stage") == F.col("at2"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("stage", "step", "pairs", zero("labels"), zero("capacity"))


FUNNEL = ("train", "eval", "recall", "lexical", "both_confusions")  # the cumulative order
#: Gates that are met together: what is left when one of the funnel's is left out or weakened.
TOGETHER = {
    "qualified": ("train", "eval", "recall"),
    "qualified_lexical": ("train", "eval", "recall", "lexical"),
    "qualified_any_confusion": ("train", "eval", "recall", "any_confusion"),
    "qualified_both_confusions": ("train", "eval", "recall", "both_confusions"),
    "lexical_any_confusion": ("lexical", "any_confusion"),
    "lexical_both_confusions": ("lexical", "both_confusions"),
    "all_any_confusion": ("train", "eval", "recall", "lexical", "any_confusion"),
    "all_both_confusions": ("train", "eval", "recall", "lexical", "both_confusions"),
}


def _all(g: dict, names) -> object:
    out = F.lit(True)
    for name in names:
        out = out & g[name]
    return out


def gate_funnel(features: DataFrame, min_train: int = 66, min_eval: int = 20, min_recall: float = 0.9) -> DataFrame:
    """gate, step, pairs, labels and greedy capacity left after it, and pairs that pass it alone."""
    g = gates(min_train, min_eval, min_recall)
    stages = stage_counts(features, {name: _all(g, FUNNEL[: k + 1]) for k, name in enumerate(FUNNEL)})
    alone = features.agg(F.array(*[F.struct(F.lit(name).alias("of"), F.count_if(g[name]).alias("alone")) for name in FUNNEL]).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return stages.join(alone, F.col("stage") == F.col("of")).select(F.col("stage").alias("gate"), "step", "pairs", "labels", "alone", "capacity")


def gate_counts(features: DataFrame, min_train: int = 66, min_eval: int = 20, min_recall: float = 0.9) -> DataFrame:
    """gate, step, pairs, labels and capacity of every gate by itself."""
    return stage_counts(features, gates(min_train, min_eval, min_recall)).withColumnRenamed("stage", "gate")


def gate_intersections(features: DataFrame, min_train: int = 66, min_eval: int = 20, min_recall: float = 0.9) -> DataFrame:
    """stage, step, pairs, labels and capacity of the sets of gates in ``TOGETHER``."""
    g = gates(min_train, min_eval, min_recall)
    return stage_counts(features, {name: _all(g, names) for name, names in TOGETHER.items()})


def greedy_disjoint(ranked: DataFrame, most: int) -> DataFrame:
    """place, label_a, label_b of the first ``most`` pairs in rank order that share no label with an earlier choice."""
    chosen = greedy_matching(ranked.withColumn("one", F.lit(0)), "one", "rank").orderBy("rank").limit(most)
    return chosen.select(F.row_number().over(W.orderBy("rank")).alias("place"), "label_a", "label_b")


def matched_worlds(ranked: DataFrame, worlds: int, per_world: int = 5) -> DataFrame:
    """world, position, label_a, label_b, is_root; fewer pairs than worlds need is an error.

    Going on with each world where the last one stopped is one greedy scan cut into blocks.
    """
    chosen = greedy_disjoint(ranked, worlds * per_world)
    world, position = F.floor((F.col("place") - 1) / per_world).cast("int"), ((F.col("place") - 1) % per_world).cast("int")
    root = (u64(F.concat(F.lit(f"{ROOT_SPACE}|world="), world.cast("string"))) % per_world).cast("int")
    rows = chosen.select(world.alias("world"), position.alias("position"), "label_a", "label_b", (position == root).alias("is_root"))
    enough = F.when(F.count("*").over(W.partitionBy()) == worlds * per_world, F.lit(True)).otherwise(F.raise_error(F.lit("too few disjoint pairs")).cast("boolean"))
    return rows.withColumn("ok", enough).where("ok").drop("ok")


def near_misses(features: DataFrame, most: int = 25, **limits) -> DataFrame:
    """The first pairs by similarity and confusion among those that fail exactly one gate."""
    g = gates(**limits)
    failed = F.array_compact(F.array(*[F.when(~g[name], F.lit(name)) for name in ("train", "eval", "recall", "lexical", "both_confusions")]))
    rows = features.withColumn("failed", failed).where(F.size("failed") == 1).withColumn("failed", F.get("failed", F.lit(0)))
    return rows.orderBy(F.desc("jaccard"), F.desc("mutual"), "label_a", "label_b").limit(most)
