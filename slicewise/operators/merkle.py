"""Ordered hash trees of tables: one digest for a sequence of records, differences found from the root down, and proofs of a range.

A record's leaf is the SHA-256 of its JSON; a node's digest is that of its up to ``fan``
children's digests in order.  Positions come from a range partitioning (sorted partitions and
their sizes), and every level is an aggregation, so all tasks share the work that a digest
over the whole stream leaves to one.

Two trees are compared from the top: only children of nodes that differ are looked at, so a
changed record costs ``fan`` nodes a level, however long the table.  Positions are places in the
order, so an inserted record moves all that follow it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored

FAN = 64
NODE = ["level", "at", "digest"]


def leaves(records: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """at (position from 0), digest of every record; records of equal order stand by their digests."""
    leaf = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)
    keys = [f"_k{i}" for i in range(len(order))]
    rows = records.select(*[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)], leaf.alias("digest"))
    rows = rows.repartitionByRange(*keys, "digest").sortWithinPartitions(*keys, "digest").select("digest", F.monotonically_increasing_id().alias("_id"))
    rows = stored(rows, "leaves")
    part = F.shiftright("_id", 33)
    sizes = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))  # a row a partition
    before = F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")
    offsets = stored(sizes.select("_p", before.alias("_before")), "offsets")
    return rows.join(offsets, part == F.col("_p")).select((F.col("_before") + F.col("_id") - F.shiftleft(part, 33)).alias("at"), "digest")


def tree(records: DataFrame, order: list[str], columns: list[str], fan: int = FAN) -> DataFrame:
    """(level, at, digest) of all nodes; the root is the one of the highest level.  No records, no nodes."""
    level = stored(leaves(records, order, columns), "level")
    out, k = level.select(F.lit(0).alias("level"), "at", "digest"), 0
    while level.limit(2).count() > 1:
        k += 1
        level = stored(_above(level, fan), "level")
        out = out.union(level.select(F.lit(k).alias("level"), "at", "digest"))
    return out


def _above(level: DataFrame, fan: int) -> DataFrame:
    """The next level; a node has ``fan`` children at most."""
    children = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"])
    return level.groupBy(F.expr(f"at div {fan}").alias("up")).agg(F.sha2(F.array_join(children, "").cast("binary"), 256).alias("digest")).withColumnRenamed("up", "at")


def root(nodes: DataFrame) -> DataFrame:
    """digest of the root."""
    return nodes.agg(F.max_by("digest", "level").alias("digest"))


def differences(one: DataFrame, other: DataFrame, fan: int = FAN) -> tuple[DataFrame, list[int]]:
    """(at, problem) of the records in which two trees differ, and how many nodes were compared at each level from the top."""
    top = max(x.agg(F.coalesce(F.max("level"), F.lit(-1))).first()[0] for x in (one, other))
    above, compared = None, []
    side = lambda nodes, k, name: nodes.where(F.col("level") == k).select(F.col("at").alias(f"at_{name}"), F.col("digest").alias(f"digest_{name}"))
    found = None
    for k in range(top, -1, -1):
        sides = []
        for nodes, name in ((one, "a"), (other, "b")):
            rows = side(nodes, k, name)
            sides.append(rows if above is None else rows.join(above, F.expr(f"at_{name} div {fan}") == F.col("up"), "left_semi"))
        both = stored(sides[0].join(sides[1], F.col("at_a") == F.col("at_b"), "full").withColumn("at", F.coalesce("at_a", "at_b")), "compared")
        compared.append(both.count())
        found = both.where(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
        above = found.select(F.col("at").alias("up"))
    if found is None:
        return one.select("at", F.lit("").alias("problem")).limit(0), compared
    problem = F.when(F.col("digest_a").isNull(), F.lit("added")).when(F.col("digest_b").isNull(), F.lit("removed")).otherwise(F.lit("changed"))
    return found.select("at", problem.alias("problem")), compared


def proof(nodes: DataFrame, low: int, high: int, fan: int = FAN) -> DataFrame:
    """The nodes beside the records low to high - 1 that their digests need to give the root: 2 (fan - 1) a level at most."""
    top = nodes.agg(F.max("level")).first()[0]
    wanted, first, last = F.lit(False), low, high - 1
    for k in range(top):
        inside = F.col("at").between(first, last)
        first, last = first // fan, last // fan
        wanted = wanted | ((F.col("level") == k) & F.col("at").between(first * fan, last * fan + fan - 1) & ~inside)
    return nodes.where(wanted).select(*NODE)


def proven_root(part: DataFrame, beside: DataFrame, top: int, fan: int = FAN) -> DataFrame:
    """digest of the root from the leaves ``part`` (at, digest) of a range and its ``proof``; ``top`` is the tree's highest level."""
    level = part.select("at", "digest")
    for k in range(top):
        level = _above(level.union(beside.where(F.col("level") == k).select("at", "digest")), fan)
    return level.select("digest")
