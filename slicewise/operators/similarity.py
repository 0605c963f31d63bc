"""Greatest set similarity of each row with the rows of every group, by a prefix-filter join.

Both sides' tokens are put in one order, from rare to common.  Let t be a lower bound of a
row's best similarity in a group.  With a right row of m tokens, a row of n tokens must then
share at least c = t (n + m) / (1 + t) of them, so one of its first n - c + 1: the prefix.
The common tokens, which stand last and would pair nearly everything, are never joined on,
and the larger the right row, the shorter the prefix.  So the join key is (token, group,
size class of the right row), and a row enters it once for each class that t admits, with
the prefix for the smallest size there.  A pair's matches on the prefix and what can follow
it bound its overlap; pairs that can't reach t are dropped, the others compared in full.

The bound comes from a first round: rows that meet on the rarer ``part`` of a row's tokens
are counted, and the ``SEEDS`` most promising of each group are compared in full.  Groups that no such
token leads to are joined on all tokens.  The result is exact, whatever the bounds are.

Right rows keep only tokens that some left row has; the others count in their size.  A
frequent token is no hot key: all joins are merge joins, whose large partitions the planner
splits.  None is a broadcast: tokens compress so well that the planner, which goes by the
size of files, would send tables of many times its limit to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored

PART, SEEDS = 0.5, 8
STEP = math.log(1.2)  # size classes: sizes up to a fifth larger
EPS = 1e-9  # nothing is lost to the rounding of quotients


def size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / STEP + EPS).cast("int")


def similarity(shared: Column) -> Column:
    """From the columns na and nb."""
    return shared / (F.col("na") + F.col("nb") - shared)


def prefixes(places: DataFrame, bounds: DataFrame) -> DataFrame:
    """(row, of, na, token, class, last, t): the left rows' tokens for each group and size class that the bound t admits, up to place ``last``.

    ``places`` is (row, na, token, place), ``bounds`` (row, of, t).
    """
    low = size_class(F.greatest(F.ceil(F.col("t") * F.col("na") - EPS), F.lit(1)))
    high = size_class(F.floor(F.col("na") / F.col("t") + EPS))
    classes = places.select("row", "na").distinct().join(bounds.hint("merge"), "row").withColumn("class", F.explode(F.sequence(low, high)))
    least = F.exp(F.col("class") * STEP) - EPS  # tokens of the smallest right row in the class
    overlap = F.greatest(F.ceil(F.col("t") * (F.col("na") + least) / (1 + F.col("t")) - EPS), F.lit(1))
    classes = classes.withColumn("last", F.least(F.col("na") - overlap + 1, F.col("na"))).where("last >= 1")
    return classes.join(places.select("row", "token", "place").hint("merge"), "row").where("place <= last").drop("place")


def pair_counts(left: DataFrame, right: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """Pairs that meet on ``keys``, with the number of tokens on which they do (``both``)."""
    return left.join(right.hint("merge"), keys).groupBy("row", "right_id", "g", "of", "na", "nb", *more).agg(F.count("*").alias("both"))


def compared(pairs: DataFrame, sets: DataFrame, right: DataFrame) -> DataFrame:
    """``pairs`` (row, g, of, right_id, na, nb) with their similarity ``t``, from whole sets."""
    tokens = right.join(pairs.select("right_id", "of").distinct().hint("merge"), ["right_id", "of"], "left_semi").groupBy("right_id", "of").agg(F.collect_list("token").alias("tb"))
    out = pairs.join(sets.hint("merge"), "row").join(tokens.hint("merge"), ["right_id", "of"])
    return out.withColumn("t", similarity(F.size(F.array_intersect("ta", "tb")))).drop("ta", "tb")


def best_similarity(left: DataFrame, right: DataFrame, left_id: list[str], right_group: list[str] = (), part: float = PART) -> DataFrame:
    """left_id (and right_group), best: the greatest Jaccard similarity of each left row's ``tokens`` with any right row's.

    ``left`` is (left_id…, tokens), ``right`` (right_id, right_group…, tokens), tokens being
    distinct.  Left rows that share no token with a group's rows are absent; their best is 0.
    """
    group = F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in right_group]) if right_group else F.lit("")
    sets = stored(left.select(F.struct(*left_id).alias("row"), F.col("tokens").alias("ta")).where(F.size("ta") > 0), "left")
    tokens = sets.select("row", F.size("ta").alias("na"), F.explode("ta").alias("token"))
    b = right.select("right_id", (F.struct(*right_group) if right_group else F.lit(0)).alias("g"), group.alias("of"), F.size("tokens").alias("nb"), F.explode_outer("tokens").alias("token"))  # the planner would compute tokens again, to filter rows by them, for an inner one
    b = stored(b.join(tokens.select("token").distinct().hint("merge"), "token", "left_semi").withColumn("class", size_class(F.col("nb"))), "right")
    often = b.groupBy("token").agg(F.count("*").alias("rows"))
    order = W.partitionBy("row").orderBy(F.coalesce("rows", F.lit(0)), "token")  # tokens that no right row has stand first: they count in the size
    a = stored(tokens.join(often.hint("merge"), "token", "left").select("row", "na", "token", F.row_number().over(order).alias("place")), "places")

    rare = a.where(F.col("place") <= F.ceil(F.col("na") * part)).drop("place")
    promise = F.row_number().over(W.partitionBy("row", "of").orderBy(F.desc(similarity(F.col("both"))), "right_id"))
    first = pair_counts(rare, b, ["token"]).withColumn("n", promise).where(F.col("n") <= SEEDS).drop("n", "both")
    bounds = stored(compared(stored(first, "first"), sets, b).groupBy("row", "of").agg(F.max("t").alias("t")), "bounds")

    inside = pair_counts(prefixes(a, bounds), b, ["token", "of", "class"], "last", "t")
    most = F.least(F.col("both") + F.col("na") - F.col("last"), F.col("na"), F.col("nb"))
    may = inside.where(similarity(most) >= F.col("t") - EPS).select("row", "g", "of", "right_id", "na", "nb")

    groups = b.select("of").distinct().count()
    has = bounds.groupBy("row").agg(F.collect_set("of").alias("has"))
    open_ = a.join(has.hint("merge"), "row", "left").where(F.coalesce(F.size("has"), F.lit(0)) < groups).select("row", "na", "token", F.coalesce("has", F.array().cast("array<string>")).alias("has"))
    rest = open_.join(b.hint("merge"), "token").where(~F.array_contains("has", F.col("of"))).select("row", "g", "of", "right_id", "na", "nb").distinct()

    final = compared(stored(may.union(rest), "candidates"), sets, b)
    return final.groupBy("row", "g").agg(F.max("t").alias("best")).select("row.*", *["g." + c for c in right_group], "best")
