"""Content-addressed records: identity, duplicates, and deterministic hash-order ranks and splits.

Hash order is uniform, so a rank within a group is made from counts per leading hash
digits and a row number within those: a group with a third of all rows, or one group of
all rows, is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.canonical import content_id, normal_text
from ..functions.hashing import TRAJECTORY_SPACE, joined, sha, u63


ROWS = 4000  # of a narrow table that others are made from, in a task


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by keys over as many tasks as its rows need: what a row grows into is bounded by task, however few files the rows are in.

    Groupings and windows by these keys and others need no further exchange.
    """
    return df.repartition(max(1, -(-df.count() // ROWS)), *keys)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that ``df`` doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def hash_rank(df: DataFrame, group: list[str], key: Column, name: str = "rank", total: str | None = None, digits: int = 2) -> DataFrame:
    """``df`` with the 1-based rank of each row by ``key`` (hex digests) in its group, and the group's size."""
    k, lead, n, before, size, row = free_names(df, "_key", "_lead", "_n", "_before", "_total", "_row")
    rows = df.withColumn(k, key).withColumn(lead, F.substring(k, 1, digits))
    counts = rows.groupBy(*group, lead).agg(F.count("*").alias(n))
    upto = W.partitionBy(*group).orderBy(lead).rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = counts.withColumns({before: F.sum(n).over(upto) - F.col(n), size: F.sum(n).over(W.partitionBy(*group))}).drop(n)
    within = F.row_number().over(W.partitionBy(*group, lead).orderBy(k))
    out = rows.withColumn(row, within).join(counts, [*group, lead]).withColumn(name, (F.col(before) + F.col(row)).cast("long"))
    if total:
        out = out.withColumn(total, F.col(size))
    return out.select(*df.columns, name, *([total] if total else []))


def with_content_id(records: DataFrame) -> DataFrame:
    """records(label, text), both normalised, with content_id."""
    rows = records.withColumns({"label": normal_text(F.col("label")), "text": normal_text(F.col("text"))})
    return rows.withColumn("content_id", content_id(F.col("label"), F.col("text")))


def deduplicated(records: DataFrame) -> DataFrame:
    """One row for each content id, whose records are equal; a distinct keeps to hash aggregation, which least texts would not."""
    return records.select("content_id", "label", "text").distinct()


def duplicate_profile(records: DataFrame, key: str = "content_id") -> DataFrame:
    """One row: records, unique, groups that occur twice or more, occurrences beyond the first."""
    groups = records.groupBy(key).agg(F.count("*").alias("n"))
    count = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return groups.agg(count(F.col("n"), "source_records"), F.count("*").alias("unique_records"), F.count_if(F.expr("n > 1")).alias("duplicate_groups"), count(F.col("n") - 1, "duplicate_occurrences"))


def conflicting_ids(records: DataFrame, key: Column, label: str = "label") -> DataFrame:
    """Keys whose records have different labels."""
    return records.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo <> hi").select("key", "n")


def split(unique: DataFrame, numerator_offset: int = 2) -> DataFrame:
    """unique records with split: per label, by content id, the first (n + offset) div 5 are eval."""
    ranked = hash_rank(unique, ["label"], F.col("content_id"), total="label_rows")
    part = F.when(F.col("rank") <= F.floor((F.col("label_rows") + numerator_offset) / 5), F.lit("eval")).otherwise(F.lit("train"))
    return ranked.withColumn("split", part).drop("rank", "label_rows")


def partition_summary(parts: DataFrame) -> DataFrame:
    """label, train, eval."""
    return parts.groupBy("label").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "eval").alias("eval"))


def numbered_slots(train: DataFrame) -> DataFrame:
    """train records with slot_id: their rank by content id, zero-padded to six digits or more."""
    ranked = hash_rank(train, [], F.col("content_id"), total="_slots", digits=3)
    width = F.greatest(F.lit(6), F.length(F.col("_slots").cast("string")))
    return ranked.withColumn("slot_id", F.concat(F.lit("slot_"), F.lpad(F.col("rank").cast("string"), width, F.lit("0")))).drop("rank", "_slots")


def trajectory_seed(trajectory: Column, purpose: str) -> Column:
    return u63(joined(TRAJECTORY_SPACE, F.concat(F.lit("trajectory="), trajectory.cast("string")), F.lit(f"purpose={purpose}")))


def epoch_order(slots: DataFrame, trajectories: list[int], epochs: list[int]) -> DataFrame:
    """trajectory_id, epoch, slot_id, place: every epoch's own order of the slots."""
    numbers = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    rows = slots.select("slot_id").withColumn("trajectory_id", numbers(trajectories)).withColumn("epoch", numbers(epochs))
    seed = trajectory_seed(F.col("trajectory_id"), "data-order")
    key = sha(joined(TRAJECTORY_SPACE, F.concat(F.lit("data-order-seed="), seed.cast("string")), F.concat(F.lit("epoch="), F.col("epoch").cast("string")), F.concat(F.lit("slot="), F.col("slot_id"))))
    return hash_rank(rows, ["trajectory_id", "epoch"], key, name="place").select("trajectory_id", "epoch", "slot_id", "place")
