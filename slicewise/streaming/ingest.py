"""Prediction files that arrive over time, with the report brought up to date after every batch.

Each batch is appended to a table by batch number, so that a batch that runs again after
a failure replaces itself.  A release is in the report once it has answered every case, which
it can't have with fewer rows than there are cases.  So a batch changes the rows of the
releases that it brings rows of and that have enough rows, and of all such releases if the
baseline is one of them; those are computed over the whole table, and all other rows of the
report are carried on from the batch before.  While releases are incomplete, a batch costs
what it brings.  A query that starts again computes its first report whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare
from ..sources.scratch import scratch

SCHEMA = "release_id string, case_id string, observed string"


def prediction_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("header", True).option("maxFilesPerTrigger", files_at_once).csv(folder)


def keep_report(stream: DataFrame, policy: dict[str, DataFrame], store: str, checkpoint: str, on_report: Callable[[DataFrame, int], None], baseline: str = "baseline"):
    """Start a query that stores batches and gives the current slice report to ``on_report``.

    Of answers to the same case by the same release the last batch's counts; releases
    without an answer to every case aren't in the report yet.
    """
    rows: dict = {}  # release -> rows that it has in the store
    held: dict = {}  # the number of cases, and the path of the last report

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{store}/batch={number}")
        every = spark.read.schema(SCHEMA + ", batch int").parquet(store)
        fresh = every if not held else every.where(F.col("batch") == number)
        brought = {r.release_id: r.n for r in fresh.groupBy("release_id").agg(F.count("*").alias("n")).collect()}  # a row a release
        for release, n in brought.items():
            rows[release] = rows.get(release, 0) + n
        if not held:
            held["cases"] = policy["cases"].count()
        enough = {r for r, n in rows.items() if r is not None and n >= held["cases"]}
        now = enough if baseline in enough & set(brought) else enough & set(brought)
        if now or "report" not in held:
            report = _report(every.where(F.col("release_id").isin(*now, baseline) if now else F.lit(False)), policy, now, baseline)
            if "report" in held:
                report = spark.read.schema(report.schema).parquet(held["report"]).where(~F.col("release_id").isin(*now)).unionByName(report)
            path = scratch(spark, "report")
            report.write.parquet(path)
            held["report"], held["schema"] = path, report.schema
        on_report(spark.read.schema(held["schema"]).parquet(held["report"]), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _report(every: DataFrame, policy: dict[str, DataFrame], releases: set, baseline: str) -> DataFrame:
    """The slice report of those of ``releases`` that have answered every case; answers move once, by their case."""
    last = every.repartition("case_id").groupBy("case_id", "release_id").agg(F.max_by("observed", F.struct("batch", "observed")).alias("observed"))
    known = last.join(policy["cases"], "case_id", "left_semi")
    whole = known.groupBy("release_id").agg(F.count("*").alias("n")).crossJoin(policy["cases"].agg(F.count("*").alias("want"))).where("n = want").select("release_id")
    report = compare.slice_report(policy["cases"], known.join(whole, "release_id"), policy["slices"], policy["slice_members"], baseline)
    return report.where(F.col("release_id").isin(*releases))
