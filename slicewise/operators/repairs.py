"""Repair assessment: what a set of declared repairs says about a failed candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("not_evaluated", "insufficient_evidence", "no_supported_repair", "single_supported_repair", "ambiguous_repairs")


def repair_status(verdicts: DataFrame, baseline: str = "baseline", candidate: str = "candidate", declared: bool = True) -> DataFrame:
    """One row: status, evaluated, successful, repairs (names of those that pass).

    A candidate that passes, or is missing, is an error.  Without repairs the status is
    ``insufficient_evidence`` where repairs were declared, else ``not_evaluated``.
    """
    repair = ~F.col("release_id").isin(baseline, candidate)
    one = verdicts.agg(
        F.bool_and(F.when(F.col("release_id") == candidate, F.col("passed"))).alias("candidate_passed"),
        F.count_if(repair).alias("evaluated"),
        F.count_if(repair & F.col("passed")).alias("successful"),
        F.array_join(F.array_sort(F.collect_list(F.when(repair & F.col("passed"), F.col("release_id")))), ",").alias("repairs"),
    )
    checked = F.when(F.col("candidate_passed").eqNullSafe(F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("the candidate must fail the policy")).cast("boolean"))
    status = (
        F.when(F.col("evaluated") == 0, F.lit("insufficient_evidence" if declared else "not_evaluated"))
        .when(F.col("successful") == 0, F.lit("no_supported_repair"))
        .when(F.col("successful") == 1, F.lit("single_supported_repair"))
        .otherwise(F.lit("ambiguous_repairs"))
    )
    return one.where(checked).select(status.alias("status"), "evaluated", "successful", "repairs")


def rollback_verdict(verdicts: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Whether going back to the baseline's predictions passes: floors may fail it."""
    return verdicts.where(F.col("release_id") == baseline).select("release_id", "passed", F.lit("reuse_of_supplied_predictions").alias("origin"))


def policy_signatures(report: DataFrame) -> DataFrame:
    """Releases whose policy columns differ from the first release's (by name); empty when all agree."""
    fields = ["name", "cases", "maximum_accuracy_drop", "baseline_accuracy", "minimum_accuracy"]
    first = report.agg(F.min("release_id").alias("first"))
    base = report.join(F.broadcast(first), F.col("release_id") == F.col("first")).select(*[F.col(f).alias(f"b_{f}") for f in fields], F.lit(True).alias("known"))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"b_{f}"))
    return report.join(base, same, "left").where(F.col("known").isNull()).groupBy("release_id").agg(F.count("*").alias("differing_slices"))


def repair_gold(verdicts: DataFrame, diff: DataFrame, baseline: str = "baseline", candidate: str = "candidate") -> DataFrame:
    """One row of answers that the supplied evidence supports."""
    repair = ~F.col("release_id").isin(baseline, candidate)
    v = verdicts.agg(
        F.bool_and(F.when(F.col("release_id") == candidate, F.col("passed"))).alias("candidate_passes"),
        F.bool_and(F.when(F.col("release_id") == baseline, F.col("passed"))).alias("complete_rollback_passes"),
        F.array_join(F.array_sort(F.collect_list(F.when(repair & F.col("passed"), F.col("release_id")))), ",").alias("passing_supplied_repairs"),
        (F.count_if(repair) > 0).alias("repair_evidence_supplied"),
        F.count_if(repair & F.col("passed")).alias("distinct_passing_repairs"),
    )
    d = diff.where(F.col("release_id") == candidate).select("changed_cases", "new_errors")
    no = lambda name: F.lit(False).alias(name)
    return v.crossJoin(d).select("*", no("historical_cause_identified"), no("retraining_evaluated"), no("execution_cost_known"))


EVIDENCE = ("historical_cause_identified", "retraining_evaluated", "execution_cost_known", "repair_evidence_supplied")


def submission_audit(gold: DataFrame, answers: DataFrame) -> DataFrame:
    """key, result (correct, incorrect, unanswered), unsupported_claim for gold(key, value) and answers(key, value); list values are compared as sets."""
    g, a = gold.select("key", F.col("value").alias("gold")), answers.select("key", F.col("value").alias("answer"))
    as_set = lambda c: F.array_sort(F.split(c, ","))
    result = F.when(F.col("answer").isNull(), F.lit("unanswered")).when(as_set(F.col("answer")) == as_set(F.col("gold")), F.lit("correct")).otherwise(F.lit("incorrect"))
    claim = F.col("key").isin(*EVIDENCE) & (F.col("gold") == "false") & F.coalesce(F.col("answer") == "true", F.lit(False))
    return g.join(a, "key", "left").select("key", result.alias("result"), claim.alias("unsupported_claim"))
