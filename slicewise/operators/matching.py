"""Greedy disjoint choice among ranked pairs, for many groups at once and any number of pairs.

The sequential rule: go through a group's pairs in order and take each that shares no label
with an earlier choice.  Two exact steps decide many pairs at a time.

* A pair that is first in order for both of its labels is taken whatever the others are.
  All such pairs are found by two aggregations; for pairs in random order a few rounds of
  this settle everything.
* Orders that run along the labels (a complete graph in lexicographic order) have only one
  such pair a round.  There the first ``block`` open pairs of each group are decided in order
  by one task, which is as good as the sequential rule, for nothing stands before them.

After either step the pairs of taken labels are closed.  A round therefore closes the first
``block`` pairs of a group at least, and every task holds that many at most.

Pairs with a null label or two equal ones are never taken; a repeated pair counts once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import stored

BLOCK = 1 << 17


def _fold(table: pa.Table) -> pa.Table:
    """The rows of one group that the sequential rule takes."""
    table = table.sort_by("_place")
    used, taken = set(), []
    for i, (a, b) in enumerate(zip(table["_a"].to_pylist(), table["_b"].to_pylist(), strict=True)):
        if a not in used and b not in used:
            used |= {a, b}
            taken.append(i)
    return table.take(pa.array(taken, pa.int64())).drop_columns(["_place"])


def greedy_matching(pairs: DataFrame, group: str, key: str, a: str = "label_a", b: str = "label_b", block: int = BLOCK) -> DataFrame:
    """(group, key, a, b) of the pairs taken in the order of ``key``, ties by the labels."""
    names = [group, key, a, b]
    some = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    open_ = stored(some.select(F.col(group).alias("_g"), F.col(key).alias("_k"), F.col(a).alias("_a"), F.col(b).alias("_b")).distinct(), "pairs")
    order = F.struct("_k", "_a", "_b")
    taken: list[DataFrame] = []
    shape = T.StructType([T.StructField(n, pairs.schema[c].dataType) for n, c in zip(("_g", "_k", "_a", "_b"), names, strict=True)])

    def close(rows: DataFrame) -> DataFrame:
        """Take ``rows``, and leave the pairs without their labels."""
        rows = stored(rows.select("_g", "_k", "_a", "_b"), "taken")
        taken.append(rows)
        used = rows.select(F.col("_g").alias("_ug"), F.explode(F.array("_a", "_b")).alias("_u"))
        left = open_
        for side in ("_a", "_b"):
            left = left.join(used, F.col("_g").eqNullSafe(F.col("_ug")) & (F.col(side) == F.col("_u")), "left_anti")
        return stored(left, "pairs")

    while (n := open_.count()) > 0:
        if n > block:
            first = open_.select("_g", order.alias("_o"), F.explode(F.array("_a", "_b")).alias("_u")).groupBy("_g", "_u").agg(F.min("_o").alias("_o"))
            both = first.groupBy("_g", "_o").agg(F.count("*").alias("_n")).where("_n = 2")
            open_ = close(both.select("_g", "_o.*"))
        place = F.row_number().over(W.partitionBy("_g").orderBy(order))
        prefix = open_.withColumn("_place", place).where(F.col("_place") <= block)
        open_ = close(prefix.groupBy("_g").applyInArrow(_fold, shape))
    out = taken[0] if taken else open_
    for rows in taken[1:]:
        out = out.union(rows)
    return out.toDF(*names)
