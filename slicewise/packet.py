"""First-use packets: the same evidence twice, as plain files and as a report, with the gold answers apart.

``ordinary`` holds the sources and the plain comparison, ``report`` the sources and the
engine's report; both have the digests of the sources, the task and an empty answer.
The gold answers and the protocol stand beside them, for whoever leads the exercise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import importer
from .operators import compare, repairs
from .operators import validate as val
from .sources import documents, writers
from .sources.scratch import stored

ANSWER, PROTOCOL = "slicewise-first-use-answer/1", "slicewise-first-use-protocol/1"
TASK = (
    "Decide whether the candidate and a complete rollback satisfy the policy, which supplied repairs pass, and what the evidence can't establish. "
    "Null means unanswered, not failed. Answer unaided first and keep revisions apart. State the sources' digests, and how a changed source would be noticed. "
    "Give measured times and steps only. Name any earlier sight of the material."
)


def prepare(spark: SparkSession, policy_path: str, predictions_path: str, out: str) -> dict:
    """Write the packet into a new folder; gives the protocol."""
    policy, predictions = read = importer.sources(spark, policy_path, predictions_path)
    plain = stored(compare.ordinary_diff(policy["cases"], predictions), "plain")
    summary = importer.run(spark, policy_path, predictions_path, f"{out}/report", read=read)
    gold = repairs.repair_gold(spark.read.parquet(f"{out}/report/releases"), plain).first().asDict()
    digests = writers.retained(spark, {"source-policy": policy_path, "source-predictions": predictions_path}, f"{out}/ordinary/sources")
    if digests != summary["source_sha256"]:
        raise val.InvalidInput("the sources changed while the packet was made")
    writers.write_new(plain, f"{out}/ordinary/decision")
    empty = {"schema": ANSWER, "answers": dict.fromkeys(gold), "participant": {"independent": None, "prior_exposure": None, "experience": None}, "effort": {"active_seconds": None, "provenance_lookup_seconds": None}, "assistance": [], "notes": None}
    for side in ("ordinary", "report"):
        for name, value in (("source-digests", digests), ("answer-template", empty), ("task", {"text": TASK})):
            writers.write_document(spark, value, f"{out}/{side}/{name}")
    writers.write_document(spark, gold | {"source_sha256": digests}, f"{out}/facilitator-gold")
    protocol = {"schema": PROTOCOL, "source_sha256": digests, "conditions": ["ordinary", "report"], "participant_observations": "none", "boundary": "hand out one condition's folder only, and never the gold answers"}
    writers.write_document(spark, protocol, f"{out}/protocol")
    return protocol


def answer_shape(gold: dict) -> dict:
    """The shape of a submission to the questions of ``gold``: every answer of its kind or null."""
    kind = lambda x: [str] if isinstance(x, list) else type(x)
    seconds = (int, float, None)
    return {
        "schema": str, "answers": {k: (kind(x), None) for k, x in gold.items()}, "participant": dict, "assistance": [str], "notes": (str, None),
        "effort": {"active_seconds": seconds, "provenance_lookup_seconds": seconds},
    }


def submission_violations(submissions: DataFrame, gold: dict, submission: str = "submission", text: str = "text") -> DataFrame:
    """(submission, problem, path) of whatever makes submitted answers unusable: JSON texts, one a row.

    Beside the shape: the schema's name, an entry twice in a list, seconds below zero, more
    of them for looking up than altogether.
    """
    values = stored(documents.value_rows(submissions, submission, text), "submissions")
    problems = documents.shape_violations(values, answer_shape(gold)).select("doc", "problem", "path")
    times = {"active": "$.effort.active_seconds", "lookup": "$.effort.provenance_lookup_seconds"}
    number = lambda p: F.max(F.when((F.col("path") == p) & F.col("kind").isin("integer", "number"), F.col("value").cast("double")))
    effort = values.groupBy("doc").agg(*[number(p).alias(name) for name, p in times.items()])
    rules = [
        (values.where((F.col("path") == "$.schema") & (F.col("value") != ANSWER)), "another schema", F.col("path")),
        (values.where(F.col("path").rlike(r"^\$\.answers\.[^.\[]*\[\]$")).groupBy("doc", "path", "value").agg(F.count("*").alias("n")).where("n > 1"), "repeated entry", F.col("path")),
        *[(effort.where(F.col(name) < 0), "negative time", F.lit(p)) for name, p in times.items()],
        (effort.where("lookup > active"), "lookup above activity", F.lit("$.effort")),
    ]
    for rows, problem, path in rules:
        problems = problems.union(rows.select("doc", F.lit(problem), path))
    return problems.toDF(submission, "problem", "path")


def answer_table(spark: SparkSession, values: dict) -> DataFrame:
    """key, value rows of gold answers or a submission; lists are joined by commas."""
    text = lambda x: None if x is None else ",".join(x) if isinstance(x, list) else str(x).lower() if isinstance(x, bool) else str(x)
    return spark.createDataFrame([(k, text(x)) for k, x in values.items()], "key string, value string").orderBy(F.col("key"))
