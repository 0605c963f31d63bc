"""Queries on release comparison and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import bucket
from ..operators import compare, digests, repairs
from . import views as v
from .base import bucket_sql, query, view

GRADED = """select p.release_id, p.case_id, c.expected, b.observed as before, p.observed,
  p.observed = c.expected as r, b.observed = c.expected as rb
from predictions p join cases c using (case_id) join predictions b on b.case_id = p.case_id and b.release_id = 'baseline'"""
view("graded", GRADED, stored=True)
view(
    "report",
    """select release_id, name, n as cases, b / n as baseline_accuracy, a / n as release_accuracy, (b - a) / n as accuracy_drop,
  maximum_accuracy_drop, minimum_accuracy, (b - a) / n <= maximum_accuracy_drop as drop_passed,
  minimum_accuracy is null or a / n >= minimum_accuracy as floor_passed,
  (b - a) / n <= maximum_accuracy_drop and (minimum_accuracy is null or a / n >= minimum_accuracy) as passed, regressed, improved
from (select g.release_id, m.name, count(*) as n, count(*) filter (rb) as b, count(*) filter (r) as a,
        count(*) filter (rb and not r) as regressed, count(*) filter (not rb and r) as improved
      from graded g join slice_members m using (case_id) group by g.release_id, m.name) join slices using (name)""",
)
view("verdicts", "select release_id, bool_and(passed) as passed, count(*) as slices, count(*) filter (not passed) as failed_slices from report group by release_id")
view(
    "outcomes",
    "select release_id, case_id, expected, before, observed, case when rb and not r then 'regressed' when not rb and r then 'improved' when before <> observed then 'changed' else 'unchanged' end as outcome from graded where release_id <> 'baseline'",
)
view(
    "plain_diff",
    "select release_id, count(*) filter (observed <> before) as changed_cases, count(*) filter (rb and not r) as new_errors, count(*) filter (not rb and r) as corrected from graded group by release_id",
)


def report(spark, d):
    return compare.slice_report(v.cases(spark, d), v.predictions(spark, d), v.slices(spark, d), v.slice_members(spark, d))


def verdicts(spark, d):
    return compare.release_verdicts(report(spark, d))


def outcomes(spark, d):
    return compare.case_outcomes(v.cases(spark, d), v.predictions(spark, d))


@query("slice_report", "select * from report")
def slice_report(spark, d):
    return report(spark, d)


@query("release_verdict", "select * from verdicts")
def release_verdict(spark, d):
    return verdicts(spark, d)


@query("overlapping_slices", "select a.name as name, b.name as other, count(*) as shared from slice_members a join slice_members b on a.case_id = b.case_id and a.name < b.name group by a.name, b.name")
def overlapping_slices(spark, d):
    m = v.slice_members(spark, d).groupBy("case_id").agg(F.collect_set("name").alias("names"))
    pairs = m.select(F.explode("names").alias("name"), "names").select("name", F.explode("names").alias("other")).where("name < other")
    return pairs.groupBy("name", "other").agg(F.count("*").alias("shared"))


@query("slice_floor_policy", "select release_id, name, release_accuracy, minimum_accuracy, floor_passed, drop_passed, 'release-comparison-pilot/0.3' as schema_version from report where minimum_accuracy is not null")
def slice_floor_policy(spark, d):
    rows = report(spark, d).where("minimum_accuracy is not null")
    return rows.select("release_id", "name", "release_accuracy", "minimum_accuracy", "floor_passed", "drop_passed", F.lit("release-comparison-pilot/0.3").alias("schema_version"))


for _name, _outcome in (("regressed_ids", "regressed"), ("improved_ids", "improved")):

    def _ids(spark, d, outcome=_outcome):
        return compare.changed_members(v.cases(spark, d), v.predictions(spark, d), v.slice_members(spark, d), outcome)

    query(_name, f"select o.release_id, m.name, o.case_id from outcomes o join slice_members m using (case_id) where o.outcome = '{_outcome}'")(_ids)


@query("case_outcomes", "select * from outcomes")
def case_outcomes(spark, d):
    return outcomes(spark, d)


@query("outcome_counts", "select release_id, count(*) filter (outcome = 'regressed') as regressed, count(*) filter (outcome = 'improved') as improved, count(*) filter (outcome = 'changed') as changed, count(*) filter (outcome = 'unchanged') as unchanged from outcomes group by release_id")
def outcome_counts(spark, d):
    return compare.outcome_counts(outcomes(spark, d))


@query("overview_accuracy", 'select release_id, count(*) filter (observed = expected) as "right", count(*) as cases, count(*) filter (observed = expected) / count(*) as accuracy from predictions join cases using (case_id) group by release_id')
def overview_accuracy(spark, d):
    return compare.overview(v.cases(spark, d), v.predictions(spark, d))


@query("policy_coverage", "select (select count(*) from cases) as cases, (select count(distinct case_id) from slice_members where name = 'urgent' or name = 'status_F') as covered, (select count(distinct case_id) from slice_members where name = 'urgent' or name = 'status_F') / (select count(*) from cases) as coverage")
def policy_coverage(spark, d):
    return compare.policy_coverage(v.cases(spark, d), v.slice_members(spark, d).where("name in ('urgent', 'status_F')"))


@query("ordinary_diff", "select * from plain_diff")
def ordinary_diff(spark, d):
    return compare.ordinary_diff(v.cases(spark, d), v.predictions(spark, d))


@query("decision_agreement", "select distinct release_id, true as agrees from report where release_id <> 'baseline'")
def decision_agreement(spark, d):
    args = v.cases(spark, d), v.predictions(spark, d), v.slices(spark, d), v.slice_members(spark, d)
    return compare.decision_agreement(compare.slice_report(*args), compare.ordinary_slices(*args))


STATUS = """select case when n = 0 then 'insufficient_evidence' when s = 0 then 'no_supported_repair' when s = 1 then 'single_supported_repair' else 'ambiguous_repairs' end as status,
  n as evaluated, s as successful, names as repairs
from (select count(*) as n, count(*) filter (passed) as s, coalesce(string_agg(case when passed then release_id end, ',' order by release_id), '') as names
      from verdicts where release_id not in ('baseline', 'candidate', {drop}))"""
for _name, _drop in (("repair_status", ()), ("repair_status_single", ("restore_labels",)), ("repair_status_none", ("restore_labels", "restore_both")), ("repair_status_unevaluated", ("restore_labels", "restore_both", "restore_regularization", "unchanged_control"))):

    def _status(spark, d, gone=_drop):
        rows = verdicts(spark, d)
        return repairs.repair_status(rows.where(~F.col("release_id").isin(*gone)) if gone else rows)

    query(_name, STATUS.format(drop=", ".join(f"'{x}'" for x in (*_drop, "-"))))(_status)


@query("rollback_verdict", "select release_id, passed, 'reuse_of_supplied_predictions' as origin from verdicts where release_id = 'baseline'")
def rollback_verdict(spark, d):
    return repairs.rollback_verdict(verdicts(spark, d))


@query("policy_signature", "select release_id, cast(1 as bigint) as differing_slices from verdicts where release_id in ('restore_both', 'unchanged_control')")
def policy_signature(spark, d):
    rows = report(spark, d)  # two releases are reported under another limit for one slice
    other = F.col("release_id").isin("restore_both", "unchanged_control") & (F.col("name") == "urgent")
    return repairs.policy_signatures(rows.withColumn("maximum_accuracy_drop", F.when(other, F.lit(0.2)).otherwise(F.col("maximum_accuracy_drop"))))


GOLD = """select (select passed from verdicts where release_id = 'candidate') as candidate_passes, (select passed from verdicts where release_id = 'baseline') as complete_rollback_passes,
  (select coalesce(string_agg(release_id, ',' order by release_id), '') from verdicts where passed and release_id not in ('baseline', 'candidate')) as passing_supplied_repairs,
  true as repair_evidence_supplied, (select count(*) from verdicts where passed and release_id not in ('baseline', 'candidate')) as distinct_passing_repairs,
  changed_cases, new_errors, false as historical_cause_identified, false as retraining_evaluated, false as execution_cost_known
from plain_diff where release_id = 'candidate'"""


def gold(spark, d):
    return repairs.repair_gold(verdicts(spark, d), compare.ordinary_diff(v.cases(spark, d), v.predictions(spark, d)))


@query("facilitator_gold", GOLD)
def facilitator_gold(spark, d):
    return gold(spark, d)


KEYS = ("candidate_passes", "complete_rollback_passes", "passing_supplied_repairs", "repair_evidence_supplied", "distinct_passing_repairs", "changed_cases", "new_errors", "historical_cause_identified", "retraining_evaluated", "execution_cost_known")


@query(
    "submission_audit",
    f"""with g as ({GOLD}), k as ({' union all '.join(f"select '{x}' as key, cast({x} as varchar) as gold from g" for x in KEYS)}),
a as (select *, case when key in ('new_errors', 'execution_cost_known') then null when key in ('candidate_passes', 'historical_cause_identified') then 'true' else gold end as answer from k)
select key, case when answer is null then 'unanswered' when answer = gold then 'correct' else 'incorrect' end as result,
  key in ('historical_cause_identified', 'retraining_evaluated', 'execution_cost_known', 'repair_evidence_supplied') and gold = 'false' and coalesce(answer = 'true', false) as unsupported_claim from a""",
)
def submission_audit(spark, d):
    g = gold(spark, d).select(F.explode(F.array(*[F.struct(F.lit(x).alias("key"), F.col(x).cast("string").alias("value")) for x in KEYS])).alias("x")).select("x.key", "x.value")
    answer = F.when(F.col("key").isin("new_errors", "execution_cost_known"), F.lit(None)).when(F.col("key").isin("candidate_passes", "historical_cause_identified"), F.lit("true")).otherwise(F.col("value"))
    return repairs.submission_audit(g, g.select("key", answer.alias("value")))


# ---------------------------------------------------------------- broken inputs for the checks

_drop = bucket_sql("'drop|' || release_id || case_id")
view(
    "broken",
    f"""select release_id, case when {_drop} between 5 and 6 then 'unknown-' || case_id else case_id end as case_id, case when {_drop} = 9 then '  ' else observed end as observed
from (select *, unnest(range(case when {_drop} < 5 then 0 when {_drop} between 7 and 8 then 2 else 1 end)) as i from predictions)""",
)


def broken(spark, d):
    """Predictions with rows missing, repeated, of unknown cases, and with blank labels."""
    rows = v.predictions(spark, d).withColumn("b", bucket(F.concat(F.lit("drop|"), "release_id", "case_id")))
    times = F.when(F.col("b") < 5, F.lit(0)).when(F.col("b").between(7, 8), F.lit(2)).otherwise(F.lit(1))
    rows = rows.where(times > 0).withColumn("i", F.explode(F.sequence(F.lit(1), times)))
    case = F.when(F.col("b").between(5, 6), F.concat(F.lit("unknown-"), "case_id")).otherwise(F.col("case_id"))
    return rows.select("release_id", case.alias("case_id"), F.when(F.col("b") == 9, F.lit("  ")).otherwise(F.col("observed")).alias("observed"))


_preds = lambda r: f"""'{{"predictions":[' || (select string_agg('{{"case_id":"' || case_id || '","observed":"' || observed || '"}}', ',' order by case_id) from predictions where release_id = '{r}') || '],"release_id":"{r}"}}'"""
_cases = """'[' || (select string_agg('{"case_id":"' || case_id || '","expected":"' || expected || '"}', ',' order by case_id) from cases) || ']'"""
_slices = """'[' || (select string_agg('{"case_ids":[' || ids || '],"maximum_accuracy_drop":' || maximum_accuracy_drop || case when minimum_accuracy is null then '' else ',"minimum_accuracy":' || minimum_accuracy end || ',"name":"' || name || '"}', ',' order by name) from slices join (select name, string_agg('"' || case_id || '"', ',' order by case_id) as ids from slice_members group by 1) using (name)) || ']'"""


@query("comparison_digests", f"""select sha256('{{"baseline":' || {_preds('baseline')} || ',"candidate":' || {_preds('candidate')} || ',"cases":' || {_cases} || ',"slices":' || {_slices} || '}}') as input_sha256, sha256('{{"baseline":' || {_preds('baseline')} || ',"cases":' || {_cases} || ',"slices":' || {_slices} || '}}') as evaluation_policy_sha256""")
def comparison_digests(spark, d):
    got = digests.comparison_digests(v.cases(spark, d), v.predictions(spark, d), v.slices(spark, d), v.slice_members(spark, d), {"baseline": "baseline", "candidate": "candidate"})
    return spark.createDataFrame([(got["input_sha256"], got["evaluation_policy_sha256"])], "input_sha256 string, evaluation_policy_sha256 string")


@query("table_digest", """select sha256(string_agg(part, chr(10) order by lead)) as digest from (select substr(d, 1, 3) as lead, sha256(string_agg(d, chr(10) order by d)) as part from (select sha256('{"case_id":"' || case_id || '","observed":"' || observed || '","release_id":"' || release_id || '"}') as d from predictions) group by 1)""")
def table_digest(spark, d):
    """The predictions as a multiset, by all tasks."""
    return digests.multiset_digest(v.predictions(spark, d), ["release_id", "case_id", "observed"])
