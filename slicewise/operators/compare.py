"""Release comparison: every release against the baseline, per overlapping slice, in one pass.

Inputs: cases(case_id, expected), predictions(release_id, case_id, observed),
slices(name, maximum_accuracy_drop, minimum_accuracy), slice_members(name, case_id).
Labels are compared exactly.  Counts are subtracted before the division, so limits hold
at their exact boundary.  All joins are on case_id; the baseline's answer reaches the
other releases' rows through a window over the same key, so predictions move once.
Identifiers come as rows, never as one list per slice, whose length grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .records import hash_rank


def graded(cases: DataFrame, predictions: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Predictions with expected, the baseline's observed label, and whether each is right."""
    of_case = W.partitionBy("case_id")
    rows = predictions.join(cases, "case_id")
    rows = rows.withColumn("before", F.max(F.when(F.col("release_id") == baseline, F.col("observed"))).over(of_case))
    return rows.withColumns({"right": F.col("observed") == F.col("expected"), "right_before": F.col("before") == F.col("expected")})


def slice_report(cases: DataFrame, predictions: DataFrame, slices: DataFrame, members: DataFrame, baseline: str = "baseline") -> DataFrame:
    """A row per release and slice: counts, accuracies, drop, verdicts, and numbers of regressed and improved cases."""
    rows = graded(cases, predictions, baseline).join(members, "case_id")
    table = rows.groupBy("release_id", "name").agg(
        F.count("*").alias("cases"),
        F.count_if("right_before").alias("before"),
        F.count_if("right").alias("after"),
        F.count_if(F.col("right_before") & ~F.col("right")).alias("regressed"),
        F.count_if(~F.col("right_before") & F.col("right")).alias("improved"),
    )
    table = table.join(slices, "name")
    drop, accuracy = (F.col("before") - F.col("after")) / F.col("cases"), F.col("after") / F.col("cases")
    within, floor = drop <= F.col("maximum_accuracy_drop"), F.col("minimum_accuracy").isNull() | (accuracy >= F.col("minimum_accuracy"))
    return table.select(
        "release_id", "name", "cases", (F.col("before") / F.col("cases")).alias("baseline_accuracy"), accuracy.alias("release_accuracy"), drop.alias("accuracy_drop"),
        "maximum_accuracy_drop", "minimum_accuracy", within.alias("drop_passed"), floor.alias("floor_passed"), (within & floor).alias("passed"), "regressed", "improved",
    )


def release_verdicts(report: DataFrame) -> DataFrame:
    """A row per release: passed if all its slices are."""
    return report.groupBy("release_id").agg(F.bool_and("passed").alias("passed"), F.count("*").alias("slices"), F.count_if(~F.col("passed")).alias("failed_slices"))


def case_outcomes(cases: DataFrame, predictions: DataFrame, baseline: str = "baseline") -> DataFrame:
    """release_id, case_id, outcome against the baseline: regressed, improved, changed (both wrong) or unchanged."""
    rows = graded(cases, predictions, baseline).where(F.col("release_id") != baseline)
    outcome = (
        F.when(F.col("right_before") & ~F.col("right"), F.lit("regressed"))
        .when(~F.col("right_before") & F.col("right"), F.lit("improved"))
        .when(F.col("before") != F.col("observed"), F.lit("changed"))
        .otherwise(F.lit("unchanged"))
    )
    return rows.select("release_id", "case_id", "expected", "before", "observed", outcome.alias("outcome"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    count = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    return outcomes.groupBy("release_id").agg(*[count(x) for x in ("regressed", "improved", "changed", "unchanged")])


def changed_members(cases: DataFrame, predictions: DataFrame, members: DataFrame, outcome: str, baseline: str = "baseline") -> DataFrame:
    """release_id, name, case_id of the slice members with the outcome."""
    return case_outcomes(cases, predictions, baseline).where(F.col("outcome") == outcome).join(members, "case_id").select("release_id", "name", "case_id")


def overview(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """A row per release over all cases once: right answers, cases, accuracy."""
    rows = predictions.join(cases, "case_id").groupBy("release_id")
    return rows.agg(F.count_if(F.col("observed") == F.col("expected")).alias("right"), F.count("*").alias("cases")).withColumn("accuracy", F.col("right") / F.col("cases"))


def policy_coverage(cases: DataFrame, members: DataFrame) -> DataFrame:
    """One row: cases, those in any slice, and the share."""
    covered = cases.join(members.select("case_id").distinct().withColumn("in_policy", F.lit(True)), "case_id", "left")
    return covered.agg(F.count("*").alias("cases"), F.count("in_policy").alias("covered")).withColumn("coverage", F.try_divide("covered", "cases"))


def ordinary_diff(cases: DataFrame, predictions: DataFrame, baseline: str = "baseline") -> DataFrame:
    """The plain comparison, by a self-join: numbers of changed, new-error and corrected cases per release, the baseline too."""
    before = predictions.where(F.col("release_id") == baseline).select("case_id", F.col("observed").alias("before"))
    rows = predictions.join(before, "case_id").join(cases, "case_id")
    right, was = F.col("observed") == F.col("expected"), F.col("before") == F.col("expected")
    return rows.groupBy("release_id").agg(
        F.count_if(F.col("observed") != F.col("before")).alias("changed_cases"), F.count_if(was & ~right).alias("new_errors"), F.count_if(~was & right).alias("corrected")
    )


def ordinary_slices(cases: DataFrame, predictions: DataFrame, slices: DataFrame, members: DataFrame, baseline: str = "baseline") -> DataFrame:
    """release_id, name, passed, regressed, improved by the self-join path."""
    before = predictions.where(F.col("release_id") == baseline).select("case_id", F.col("observed").alias("before"))
    rows = members.join(predictions, "case_id").join(before, "case_id").join(cases, "case_id")
    right, was = F.col("observed") == F.col("expected"), F.col("before") == F.col("expected")
    table = rows.groupBy("release_id", "name").agg(
        F.count("*").alias("n"), F.count_if(was).alias("b"), F.count_if(right).alias("a"), F.count_if(was & ~right).alias("regressed"), F.count_if(~was & right).alias("improved")
    ).join(slices, "name")  # after the counts: by the few names, rows would meet in as few tasks
    passed = ((F.col("b") - F.col("a")) / F.col("n") <= F.col("maximum_accuracy_drop")) & (F.col("minimum_accuracy").isNull() | (F.col("a") / F.col("n") >= F.col("minimum_accuracy")))
    return table.select("release_id", "name", passed.alias("passed"), "regressed", "improved")


def decision_agreement(report: DataFrame, ordinary: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Per release other than the baseline: whether both paths agree on every slice."""
    o = ordinary.select("release_id", "name", *[F.col(c).alias(f"o_{c}") for c in ("passed", "regressed", "improved")])
    same = F.lit(True)
    for c in ("passed", "regressed", "improved"):
        same = same & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    rows = report.where(F.col("release_id") != baseline).join(o.where(F.col("release_id") != baseline), ["release_id", "name"], "full")
    return rows.groupBy("release_id").agg(F.bool_and(same).alias("agrees"))


def case_table(outcomes: DataFrame) -> DataFrame:
    """Changed cases with their place in their release's table, by case id; each release is numbered by itself."""
    changed = outcomes.where(F.col("outcome") != "unchanged")
    return hash_rank(changed, ["release_id"], F.col("case_id"), name="place", digits=4)
