"""Incident ledgers: checks, summaries, and decisions against the truth.

Tables: incidents(incident_id, max_attempts), candidates(incident_id, candidate_id),
runs(incident_id, run_id, change_set, randomness_id, status, target_value,
protected_value, wall_seconds, cpu_seconds, failure), decisions(incident_id, status,
hypotheses, evidence_run_ids), truth(incident_id, sets).  Sets are arrays, compared in
canonical order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


def canonical_sets(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(c, canonical_set)))


def ledger_violations(incidents: DataFrame, candidates: DataFrame, runs: DataFrame, decisions: DataFrame) -> DataFrame:
    """incident_id, problem."""
    row = lambda df, text: df.select("incident_id", F.lit(text).alias("problem"))
    twice = lambda df, *keys: df.groupBy("incident_id", *keys).agg(F.count("*").alias("n")).where("n > 1").select("incident_id").distinct()
    over = runs.groupBy("incident_id").agg(F.count("*").alias("n")).join(incidents, "incident_id").where("n > max_attempts")
    named = runs.select("incident_id", F.explode("change_set").alias("candidate_id")).union(decisions.select("incident_id", F.explode(F.flatten("hypotheses"))))
    unknown = named.join(candidates, ["incident_id", "candidate_id"], "left_anti").select("incident_id").distinct()
    evidence = decisions.select("incident_id", F.explode("evidence_run_ids").alias("run_id")).join(runs.select("incident_id", "run_id"), ["incident_id", "run_id"], "left_anti").select("incident_id").distinct()
    done = F.col("status") == "completed"
    payload = (done & (F.col("target_value").isNull() | F.col("failure").isNotNull())) | (~done & (F.col("target_value").isNotNull() | F.col("protected_value").isNotNull() | F.col("failure").isNull()))
    bad_runs = runs.where(payload | (F.size(F.array_distinct("change_set")) != F.size("change_set"))).select("incident_id").distinct()
    n = F.size("hypotheses")
    shape = ((F.col("status") == "specific") & (n != 1)) | ((F.col("status") == "ambiguity_set") & (n < 2)) | (F.col("status").isin("insufficient_evidence", "abstain") & (n > 0))
    repeated = (F.size(canonical_sets(F.col("hypotheses"))) != n) | F.exists("hypotheses", lambda h: F.size(F.array_distinct(h)) != F.size(h))
    parts = [
        row(twice(runs, "run_id"), "repeated run"), row(twice(runs.withColumn("s", canonical_set(F.col("change_set"))), "s", "randomness_id"), "repeated intervention"), row(over, "budget"),
        row(unknown, "unknown candidate"), row(evidence, "unknown evidence"), row(bad_runs, "run payload"), row(decisions.where(shape), "decision shape"), row(decisions.where(repeated), "repeated hypotheses"),
    ]
    return reduce(DataFrame.unionByName, parts)


def truth_violations(truth: DataFrame) -> DataFrame:
    """Incidents whose responsibility sets are empty, repeated, or name a candidate twice."""
    bad = (F.size("sets") < 1) | (F.size(canonical_sets(F.col("sets"))) != F.size("sets")) | F.exists("sets", lambda s: F.size(F.array_distinct(s)) != F.size(s))
    return truth.where(bad).select("incident_id")


def unbound_truths(truth: DataFrame, incidents: DataFrame) -> DataFrame:
    """incident_id, problem of truths (incident_id, incident_sha256) that belong to no incident of that digest."""
    rows = truth.select("incident_id", "incident_sha256").join(incidents.select("incident_id", F.col("incident_sha256").alias("own")), "incident_id", "left")
    problem = F.when(F.col("own").isNull(), F.lit("no incident")).when(~F.col("own").eqNullSafe(F.col("incident_sha256")), F.lit("another digest"))
    return rows.withColumn("problem", problem).where("problem is not null").select("incident_id", "problem")


def incident_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("incident_id").agg(F.count("*").alias("attempts"), F.count_if(F.col("status") == "completed").alias("completed"), F.sum("cpu_seconds").alias("cpu_seconds"), F.sum("wall_seconds").alias("wall_seconds"))


def evaluated(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """incident_id, committed, specific, wrong_specific, all_contained, any_contained, hypotheses, candidates."""
    rows = decisions.join(truth, "incident_id").withColumns({"r": canonical_sets(F.col("hypotheses")), "a": canonical_sets(F.col("sets"))})
    specific = F.col("status") == "specific"
    return rows.select(
        "incident_id", specific.alias("specific"), (specific & ((F.size("a") != 1) | (F.col("r") != F.col("a")))).alias("wrong_specific"),
        ((F.size("r") > 0) & (F.size(F.array_except("a", "r")) == 0)).alias("all_contained"), (F.size(F.array_intersect("r", "a")) > 0).alias("any_contained"),
        F.size("r").alias("returned_hypotheses"), F.size(F.array_distinct(F.flatten("r"))).alias("returned_candidates"),
    )


def decision_metrics(results: DataFrame) -> DataFrame:
    """One row: incidents, coverage, wrong rate, and risk among the committed (null without any)."""
    one = results.agg(F.count("*").alias("incidents"), F.count_if("specific").alias("committed"), F.count_if("wrong_specific").alias("wrong"), F.count_if("all_contained").alias("contained"))
    return one.select(
        "incidents", "committed", F.try_divide("committed", "incidents").alias("coverage"), F.try_divide("wrong", "incidents").alias("wrong_specific_rate"),
        F.try_divide("wrong", "committed").alias("risk_among_committed"), F.try_divide("contained", "incidents").alias("containment_rate"),
    )
