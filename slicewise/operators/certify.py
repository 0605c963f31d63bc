"""Gates, certification of a planted change, and restoration effects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The splits of the certification protocol.
TARGET = "triangle_large"
PROTECTED = ("circle_large", "circle_small", "square_large", "square_small", "triangle_small")
REQUIRED = (TARGET, *PROTECTED, "all")


def _wide(scores: DataFrame, run: str, name: str) -> DataFrame:
    """split, score of one run as column ``name``; a missing required split is an error when read."""
    return scores.where(F.col("run") == run).select("split", F.col("score").alias(name))


def _required(scores: DataFrame, runs: list[str]) -> DataFrame:
    rows = scores.sparkSession.createDataFrame([(s,) for s in REQUIRED], "split string")
    for run in runs:
        rows = rows.join(_wide(scores, run, run), "split", "left")
        rows = rows.withColumn(run, F.coalesce(F.col(run), F.raise_error(F.concat(F.lit(f"{run} lacks split "), F.col("split"))).cast("double")))
    return rows


def candidate_gate(scores: DataFrame, minimum_baseline: float = 0.95, minimum_regression: float = 0.15, maximum_drift: float = 0.05) -> DataFrame:
    """One row for scores(run, split, score) of runs baseline and candidate."""
    rows = _required(scores, ["baseline", "candidate"])
    drift = F.when(F.col("split").isin(*PROTECTED), F.abs(F.col("candidate") - F.col("baseline")))
    one = rows.agg(
        F.bool_and(F.col("baseline") >= minimum_baseline).alias("baseline_passed"),
        F.max(F.when(F.col("split") == TARGET, F.col("baseline") - F.col("candidate"))).alias("target_regression"),
        F.max(drift).alias("largest_drift"),
        F.bool_and(F.coalesce(drift <= maximum_drift, F.lit(True))).alias("protected_passed"),
    )
    passed = F.col("target_regression") >= minimum_regression
    return one.withColumn("target_passed", passed).withColumn("all_passed", F.col("baseline_passed") & passed & F.col("protected_passed"))


def restoration_table(scores: DataFrame) -> DataFrame:
    """restoration, recovery (against the candidate), largest_drift (against the baseline) of the runs restore:<id>."""
    base, cand = _wide(scores, "baseline", "b"), _wide(scores, "candidate", "c")
    rows = scores.where(F.col("run").startswith("restore:")).join(base, "split").join(cand, "split").where(F.col("split").isin(*REQUIRED))
    return rows.groupBy(F.substring_index("run", ":", -1).alias("restoration")).agg(
        F.max(F.when(F.col("split") == TARGET, F.col("score") - F.col("c"))).alias("recovery"),
        F.max(F.when(F.col("split").isin(*PROTECTED), F.abs(F.col("score") - F.col("b")))).alias("largest_drift"),
    )


def certification(scores: DataFrame, planted: str, minimum_recovery: float = 0.15, maximum_drift: float = 0.05) -> DataFrame:
    """One row: only the planted change's restoration recovers the target, and none drifts."""
    t = restoration_table(scores)
    own, drift_ok = F.col("restoration") == planted, F.col("largest_drift") <= maximum_drift
    qualifies = F.col("recovery") >= minimum_recovery
    one = t.agg(
        F.bool_and(F.when(own, qualifies)).alias("planted_recovery_passed"), F.bool_and(F.when(own, drift_ok)).alias("planted_protected_passed"),
        F.coalesce(F.bool_and(F.when(~own, F.col("recovery") <= maximum_drift)), F.lit(True)).alias("others_recovery_passed"), F.coalesce(F.bool_and(F.when(~own, drift_ok)), F.lit(True)).alias("others_protected_passed"),
        (F.array_sort(F.collect_list(F.when(qualifies, F.col("restoration")))) == F.array(F.lit(planted))).alias("unique_recovery_passed"),
    )
    every = F.lit(True)
    for c in one.columns:
        every = every & F.coalesce(F.col(c), F.lit(False))
    return one.withColumn("all_passed", every)


def order_control(scores: DataFrame, planted: str, minimum_baseline: float = 0.95, minimum_regression: float = 0.15, minimum_recovery: float = 0.15, maximum_drift: float = 0.05) -> DataFrame:
    """One row: the candidate gate and the planted restoration hold for data in another order."""
    gate = candidate_gate(scores, minimum_baseline, minimum_regression, maximum_drift).select("baseline_passed", F.col("all_passed").alias("candidate_gate_passed"))
    own = restoration_table(scores).where(F.col("restoration") == planted).select((F.col("recovery") >= minimum_recovery).alias("planted_recovery_passed"), (F.col("largest_drift") <= maximum_drift).alias("planted_protected_passed"))
    return gate.crossJoin(own).withColumn("all_passed", F.col("candidate_gate_passed") & F.col("planted_recovery_passed") & F.col("planted_protected_passed"))


def public_payload(gate: DataFrame, certified: DataFrame, order: DataFrame, construction_passed: bool) -> DataFrame:
    """The published booleans, without a number."""
    g = gate.select("baseline_passed", (F.col("target_passed") & F.col("protected_passed")).alias("localized_regression_passed"), F.col("all_passed").alias("g"))
    rows = g.crossJoin(certified.select(F.col("all_passed").alias("unique_causal_passed"))).crossJoin(order.select(F.col("all_passed").alias("order_robustness_passed")))
    rows = rows.withColumn("construction_passed", F.lit(construction_passed))
    return rows.withColumn("certified", F.col("construction_passed") & F.col("g") & F.col("unique_causal_passed") & F.col("order_robustness_passed")).drop("g")


def protocol_assessment(runs: DataFrame, minimum_baseline: float, minimum_regression: float, minimum_recovery: float, maximum_drift: float) -> DataFrame:
    """One row per group for runs(group, run, target, unrelated) of baseline, candidate and recovery."""
    pick = lambda run, c: F.max(F.when(F.col("run") == run, F.col(c)))
    one = runs.groupBy("group").agg(*[pick(r, c).alias(f"{r}_{c}") for r in ("baseline", "candidate", "recovery") for c in ("target", "unrelated")])
    c = F.col
    return one.select(
        "group", (c("baseline_target") - c("candidate_target")).alias("regression"), (c("recovery_target") - c("candidate_target")).alias("recovery"),
        F.greatest(F.abs(c("candidate_unrelated") - c("baseline_unrelated")), F.abs(c("recovery_unrelated") - c("baseline_unrelated"))).alias("largest_drift"), (c("baseline_target") >= minimum_baseline).alias("baseline_passed"),
    ).withColumns({"regression_passed": c("regression") >= minimum_regression, "recovery_passed": c("recovery") >= minimum_recovery, "drift_passed": c("largest_drift") <= maximum_drift})


def stage_gate(gaps: DataFrame, mean_target: float = 0.10, each_target: float = 0.05, mean_protected: float = 0.02, each_protected: float = 0.03) -> DataFrame:
    """One row for gaps(trajectory_id, target_gap, protected_gap): means and four gates."""
    one = gaps.agg(
        F.avg("target_gap").alias("mean_target_gap"), F.avg("protected_gap").alias("mean_protected_gap"),
        F.bool_and(F.col("target_gap") >= each_target).alias("each_target_passed"), F.bool_and(F.col("protected_gap") <= each_protected).alias("each_protected_passed"),
    )
    one = one.withColumns({"mean_target_passed": F.col("mean_target_gap") >= mean_target, "mean_protected_passed": F.col("mean_protected_gap") <= mean_protected})
    return one.withColumn("all_passed", F.col("each_target_passed") & F.col("each_protected_passed") & F.col("mean_target_passed") & F.col("mean_protected_passed"))


def restoration_effects(states: DataFrame, targets: list[str], anchor: str = "composite") -> DataFrame:
    """trajectory_id, state: change of target and protected macro recall against the trajectory's anchor, the largest absolute protected change and its labels.

    ``states`` is (trajectory_id, state, label, recall).
    """
    base = states.where(F.col("state") == anchor).select("trajectory_id", "label", F.col("recall").alias("was"))
    target = F.col("label").isin(*targets)
    rows = states.where(F.col("state") != anchor).join(base, ["trajectory_id", "label"]).withColumn("d", F.col("recall") - F.col("was"))
    macro = lambda c, t: F.avg(F.when(t, F.col(c)))
    table = rows.groupBy("trajectory_id", "state").agg(
        (macro("recall", target) - macro("was", target)).alias("delta_target"), (macro("recall", ~target) - macro("was", ~target)).alias("delta_protected"),
        F.max(F.when(~target, F.abs("d"))).alias("largest_protected_change"), F.collect_list(F.when(~target, F.struct("label", F.abs("d").alias("d")))).alias("_all"),
    )
    labels = F.array_sort(F.transform(F.filter("_all", lambda x: x["d"] == F.col("largest_protected_change")), lambda x: x["label"]))
    return table.withColumn("largest_labels", F.array_join(labels, ",")).drop("_all")


def root_margins(effects: DataFrame, root: str) -> DataFrame:
    """trajectory_id, root_delta, strongest_other, margin, root_is_largest."""
    own, other = F.max(F.when(F.col("state") == root, F.col("delta_target"))), F.max(F.when(F.col("state") != root, F.col("delta_target")))
    rows = effects.groupBy("trajectory_id").agg(own.alias("root_delta"), other.alias("strongest_other"))
    return rows.withColumn("margin", F.col("root_delta") - F.col("strongest_other")).withColumn("root_is_largest", F.col("margin") > 0)


def stage_b(states: DataFrame, targets: list[str], stage_a: DataFrame, root: str, anchor: str = "composite") -> DataFrame:
    """A row per trajectory: the anchor's macro recalls and their difference from stage A, the root's recovery, the strongest other, and the margin.

    ``states`` is (trajectory_id, state, label, recall), ``stage_a`` (trajectory_id,
    composite_target, composite_protected); a trajectory of one side only has nulls.
    """
    target = F.col("label").isin(*targets)
    own = states.where(F.col("state") == anchor).groupBy("trajectory_id").agg(F.avg(F.when(target, F.col("recall"))).alias("target"), F.avg(F.when(~target, F.col("recall"))).alias("protected"))
    rows = own.join(stage_a, "trajectory_id", "full").join(root_margins(restoration_effects(states, targets, anchor), root), "trajectory_id", "left")
    return rows.select("trajectory_id", "target", "protected", (F.col("target") - F.col("composite_target")).alias("target_difference"), (F.col("protected") - F.col("composite_protected")).alias("protected_difference"), "root_delta", "strongest_other", "margin", "root_is_largest")


def root_contrasts(effects: DataFrame, root: str) -> DataFrame:
    """state, trajectory_id, contrast: the root's recovery less each other state's, of the same trajectory."""
    own = effects.where(F.col("state") == root).select("trajectory_id", F.col("delta_target").alias("own"))
    return effects.where(F.col("state") != root).join(own, "trajectory_id").select("state", "trajectory_id", (F.col("own") - F.col("delta_target")).alias("contrast"))


def dose_selection(runs: DataFrame, required: int) -> DataFrame:
    """One row: the least dose of runs(dose, world, passed) with enough passing worlds, null if there is none.

    Doses are looked at from the least on, and none after the first that qualifies.
    """
    doses = runs.groupBy("dose").agg(F.count_if("passed").alias("passing")).withColumn("qualified", F.col("passing") >= required)
    first = F.min(F.when(F.col("qualified"), F.col("dose")))
    one = doses.agg(first.alias("selected_dose"), F.array_sort(F.collect_list("dose")).alias("all"))
    observed = F.filter("all", lambda x: F.col("selected_dose").isNull() | (x <= F.col("selected_dose")))
    return one.select("selected_dose", F.col("selected_dose").isNotNull().alias("authorized"), F.array_join(observed.cast("array<string>"), ",").alias("observed_doses"))
