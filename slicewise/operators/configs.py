"""Rules of experiment configurations that go across their fields, as violations of a table of them.

Configurations are the values of JSON documents (``sources.documents``), one document each;
a configuration without a section breaks no rule of it.  Absent numbers count as 0, absent
bounds as the other bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMBERS = (
    "changes_per_candidate", "accept_to_reject_per_candidate", "reject_to_accept_per_candidate", "material_count_min", "material_count_max", "calibration_world_count", "minimum_passing_worlds",
)
SHARES = r"^\$\.evaluation\.(minimum|maximum)_[^.\[]*$"


def _list(values: DataFrame, field: str, kind: str) -> DataFrame:
    """doc and the scalars of a calibration's list, in order; a configuration's lists are short."""
    rows = values.where(F.col("path") == f"$.calibration.{field}[]").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("block", "at", F.col("value").cast(kind).alias("x")))).alias("xs"))
    return rows.select(F.col("doc").alias(f"doc_{field}"), F.transform("xs", lambda x: x["x"]).alias(field))


def config_violations(values: DataFrame) -> DataFrame:
    """(doc, problem) for every rule that a configuration breaks."""
    number = lambda f: F.max(F.when(F.col("path") == f"$.calibration.{f}", F.col("value").cast("long"))).alias(f)
    rows = values.groupBy("doc").agg(*[number(f) for f in NUMBERS])
    for field, kind in (("target_doses", "long"), ("calibration_materials", "string")):
        rows = rows.join(_list(values, field, kind), F.col("doc") == F.col(f"doc_{field}"), "left").withColumn(field, F.coalesce(field, F.array().cast(f"array<{kind}>")))
    or_zero = lambda f: F.coalesce(f, F.lit(0))
    up, down = or_zero("accept_to_reject_per_candidate"), or_zero("reject_to_accept_per_candidate")
    low, passing = or_zero("material_count_min"), or_zero("minimum_passing_worlds")
    rules = {
        "target doses rise": F.col("target_doses") == F.array_sort(F.array_distinct("target_doses")), "flips sum to the changes": F.coalesce("changes_per_candidate", up + down) == up + down,
        "material limits are in order": low <= F.coalesce("material_count_max", low), "no dose is above the flips": F.forall("target_doses", lambda x: x <= up),
        "what a dose leaves divides by three": F.forall("target_doses", lambda x: (up - x) % 3 == 0), "worlds that must pass exist": passing <= F.coalesce("calibration_world_count", passing),
        "materials are different": F.size("calibration_materials") == F.size(F.array_distinct("calibration_materials")),
    }
    broken = rows.select("doc", F.explode(F.array_compact(F.array(*[F.when(~ok, F.lit(f"not so: {name}")) for name, ok in rules.items()]))).alias("problem"))
    share = F.col("kind").isin("integer", "number") & F.col("value").cast("double").between(0, 1)
    shares = values.where(F.col("path").rlike(SHARES) & ~F.coalesce(share, F.lit(False))).select("doc", F.concat(F.lit("evaluation."), F.col("key"), F.lit(" isn't between 0 and 1")).alias("problem"))
    return broken.union(shares)
