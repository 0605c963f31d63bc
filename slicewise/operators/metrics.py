"""Scores of predictions: matches, recalls, gates, spreads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def exact_match(rows: DataFrame, group: list[str], expected: str = "expected", observed: str = "observed") -> DataFrame:
    """group, score, total, failed: equality after stripping white space."""
    ok = strip(F.col(expected)) == strip(F.coalesce(F.col(observed), F.lit("")))
    return rows.groupBy(*group).agg(F.count_if(ok).alias("matched"), F.count("*").alias("total")).select(
        *group, (F.col("matched") / F.col("total")).alias("score"), "total", (F.col("total") - F.col("matched")).alias("failed")
    )


def baseline_gate(scores: DataFrame, required: list[str], minimum: float) -> DataFrame:
    """split, score, passed for every required split; a missing one scores 0."""
    want = scores.sparkSession.createDataFrame([(s,) for s in required], "split string")
    return want.join(scores.select("split", "score"), "split", "left").select("split", F.coalesce("score", F.lit(0.0)).alias("score"), (F.coalesce("score", F.lit(0.0)) >= minimum).alias("passed"))


def per_label_recall(rows: DataFrame, group: list[str], truth: str = "true_label", predicted: str = "predicted_label") -> DataFrame:
    """group, label, support, hits, recall."""
    table = rows.groupBy(*group, F.col(truth).alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col(truth) == F.col(predicted)).alias("hits"))
    return table.withColumn("recall", F.col("hits") / F.col("support"))


def macro_recall(recalls: DataFrame, group: list[str]) -> DataFrame:
    """group, accuracy, macro_recall (mean of labels' recalls)."""
    return recalls.groupBy(*group).agg((F.sum("hits") / F.sum("support")).alias("accuracy"), F.avg("recall").alias("macro_recall"))


def target_protected(recalls: DataFrame, group: list[str], targets: list[str]) -> DataFrame:
    """group, target and protected macro recall, the worst protected recall and the labels that have it."""
    target = F.col("label").isin(*targets)
    table = recalls.groupBy(*group).agg(
        F.avg(F.when(target, F.col("recall"))).alias("target_macro_recall"),
        F.avg(F.when(~target, F.col("recall"))).alias("protected_macro_recall"),
        F.min(F.when(~target, F.col("recall"))).alias("protected_worst_recall"),
        F.collect_list(F.when(~target, F.struct("recall", "label"))).alias("_all"),  # a row per label, as many as there are labels
    )
    worst = F.array_sort(F.transform(F.filter("_all", lambda x: x["recall"] == F.col("protected_worst_recall")), lambda x: x["label"]))
    return table.withColumn("protected_worst_labels", F.array_join(worst, ",")).drop("_all")


def describe(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, mean, median, min, max, sample standard deviation (0 for one value), and counts by sign."""
    v = F.col(value)
    return rows.groupBy(*group).agg(
        F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sample_stdev"),
        F.count_if(v > 0).alias("positive"), F.count_if(v == 0).alias("zero"), F.count_if(v < 0).alias("negative"),
    )


def nearest_rank(rows: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: examples, max and, for each name, the entry number floor(share * n) of the sorted values.

    From counts per value, so that only distinct values are ordered.
    """
    from pyspark.sql import Window as W

    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    total = F.sum("n").over(W.partitionBy())
    ranked = counts.withColumns({"upto": upto, "total": total})
    place = lambda share: F.least(F.col("total") - 1, F.floor(F.lit(share) * F.col("total")))
    picks = [F.min(F.when(F.col("upto") > place(share), F.col("v"))).alias(name) for name, share in shares.items()]
    return ranked.agg(F.max("total").alias("examples"), F.max("v").alias("max"), *picks)


def class_mass(rows: DataFrame, weights: dict[str, float], label: str = "response") -> DataFrame:
    """label, count, weight, mass; a label without a weight is an error."""
    table = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("count"))
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    weight = F.coalesce(F.try_element_at(w, F.col("label")), F.raise_error(F.concat(F.lit("no weight for "), F.col("label"))).cast("double"))
    return table.withColumn("weight", weight).withColumn("mass", F.col("count") * F.col("weight"))


def score_range(rows: DataFrame, group: list[str], value: Column, limit: float) -> DataFrame:
    """group, range (greatest less least), passed."""
    return rows.groupBy(*group).agg((F.max(value) - F.min(value)).alias("range")).withColumn("passed", F.col("range") <= limit)
