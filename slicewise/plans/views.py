"""Views in the engine's own terms, derived from the driver's tables by hash arithmetic.

Every view has a DataFrame form here and a SQL form in ``base.VIEWS``, equal row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import bucket
from .base import bucket_sql, view

RELEASES = {"baseline": 0, "candidate": 200, "restore_labels": 40, "restore_regularization": 150, "restore_both": 0, "unchanged_control": 200}
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SLICES = (("all", 0.01, None), ("not_F", 0.01, None), ("status_F", 0.05, None), ("urgent", 0.10, 0.5))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("case_id"), F.col("o_orderpriority").alias("expected"), F.col("o_orderstatus").alias("status"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("case_id", "expected")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """release_id, case_id, observed: six releases of different strength."""
    rows = _orders(spark, sf_dir)
    draw = {k: bucket(F.concat(F.lit(f"{k}|"), F.col("case_id"))) for k in ("base", "cand", "fix")}
    rows = rows.withColumns(draw)
    releases = F.array(*[F.struct(F.lit(r).alias("release_id"), F.lit(f).alias("f")) for r, f in RELEASES.items()])
    rows = rows.withColumn("r", F.explode(releases))
    f = F.col("r.f")
    wrong = ((F.col("base") < 120) & ~((f > 0) & (F.col("fix") < 20))) | ((F.col("status") == "F") & (F.col("cand") < f))
    other = F.get(F.array(*[F.lit(p) for p in PRIORITIES]), F.substring("expected", 1, 1).cast("int") % 5)
    return rows.select("r.release_id", "case_id", F.when(wrong, other).otherwise(F.col("expected")).alias("observed"))


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(SLICES), "name string, maximum_accuracy_drop double, minimum_accuracy double")


def slice_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, case_id; slices overlap."""
    names = F.array_compact(
        F.array(
            F.lit("all"),
            F.when(F.col("status") == "F", F.lit("status_F")).otherwise(F.lit("not_F")),
            F.when(F.col("expected") == "1-URGENT", F.lit("urgent")),
        )
    )
    return _orders(spark, sf_dir).select(F.explode(names).alias("name"), "case_id")


_values = ", ".join(f"('{r}', {f})" for r, f in RELEASES.items())
_next = "[" + ", ".join(f"'{p}'" for p in PRIORITIES) + "][cast(substr(expected, 1, 1) as int) % 5 + 1]"
view("order_rows", "select cast(o_orderkey as varchar) as case_id, o_orderpriority as expected, o_orderstatus as status from orders")
view("cases", "select case_id, expected from order_rows")
view("release_strength", f"select * from (values {_values}) v(release_id, f)")
view(
    "order_draws",
    f"select *, {bucket_sql(chr(39) + 'base|' + chr(39) + ' || case_id')} as base, {bucket_sql(chr(39) + 'cand|' + chr(39) + ' || case_id')} as cand, {bucket_sql(chr(39) + 'fix|' + chr(39) + ' || case_id')} as fix from order_rows",
)
view(
    "predictions",
    f"select release_id, case_id, case when (base < 120 and not (f > 0 and fix < 20)) or (status = 'F' and cand < f) then {_next} else expected end as observed from order_draws cross join release_strength",
    stored=True,
)
view("slices", "select name, cast(d as double) as maximum_accuracy_drop, cast(m as double) as minimum_accuracy from (values " + ", ".join(f"('{n}', {d}, {'null' if m is None else m})" for n, d, m in SLICES) + ") v(name, d, m)")
view(
    "slice_members",
    "select 'all' as name, case_id from order_rows union all select case when status = 'F' then 'status_F' else 'not_F' end, case_id from order_rows union all select 'urgent', case_id from order_rows where expected = '1-URGENT'",
)
