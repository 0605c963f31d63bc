"""Versioned release slots: slot_id, source_content_id, model_content_id, text, label.

A change is a set of rows; releases are the clean one with rows replaced.  Selections
are by keyed hash order, so they are nested, and need neither scan nor table order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import content_id
from ..functions.hashing import REFRESH_SPACE, SWAP_SPACE, joined, opaque_candidate, sha, slot_set_digest
from .records import free_names, hash_rank

SLOT = ["slot_id", "source_content_id", "model_content_id", "text", "label"]


def clean_release(slots: DataFrame) -> DataFrame:
    """Numbered training slots as a release."""
    return slots.select("slot_id", F.col("content_id").alias("source_content_id"), F.col("content_id").alias("model_content_id"), "text", "label")


def _pair(a: str, b: str) -> str:
    return "|".join(sorted((a, b)))


def swap_selections(release: DataFrame, pairs: dict[str, tuple[str, str]], per_direction: int) -> DataFrame:
    """candidate, slot_id, new_label: for every candidate's pair the first slots of either label in the swap's hash order, in one pass."""
    sides = [F.struct(F.lit(name).alias("candidate"), F.lit(x).alias("of"), F.lit(y).alias("new_label"), F.lit(_pair(a, b)).alias("pair")) for name, (a, b) in pairs.items() for x, y in ((a, b), (b, a))]
    rows = release.withColumn("side", F.explode(F.filter(F.array(*sides), lambda x: x["of"] == F.col("label"))))
    key = sha(joined(SWAP_SPACE, F.concat(F.lit("pair="), "side.pair"), F.concat(F.lit("source-label="), "label"), F.concat(F.lit("slot="), "slot_id"), F.concat(F.lit("source="), "source_content_id")))
    rows = rows.select(F.col("side.candidate").alias("candidate"), "label", "slot_id", "side.new_label", key.alias("key"))
    chosen = hash_rank(rows, ["candidate", "label"], F.col("key")).where(F.col("rank") <= per_direction)
    return chosen.select("candidate", "slot_id", "new_label")


def label_swaps(release: DataFrame, pairs: dict[str, tuple[str, str]], per_direction: int) -> DataFrame:
    """The changed rows of the symmetric label swaps, with their candidate."""
    rows = release.join(swap_selections(release, pairs, per_direction), "slot_id")
    return rows.withColumn("label", F.col("new_label")).withColumn("model_content_id", content_id(F.col("label"), F.col("text"))).select("candidate", *SLOT)


def swap_selection(release: DataFrame, a: str, b: str, per_direction: int) -> DataFrame:
    """slot_id, new_label of one pair's swap."""
    return swap_selections(release, {"": (a, b)}, per_direction).drop("candidate")


def label_swap(release: DataFrame, a: str, b: str, per_direction: int) -> DataFrame:
    """The changed rows of one symmetric label swap."""
    return label_swaps(release, {"": (a, b)}, per_direction).drop("candidate")


def refresh_roles(release: DataFrame, index: int, a: str, b: str, per_direction: int) -> DataFrame:
    """slot_id, label, role (recipient or donor), rank; donors are no recipients."""
    some = release.where(F.col("label").isin(a, b))

    def key(role):
        return sha(joined(REFRESH_SPACE, f"nuisance={index}", f"pair={_pair(a, b)}", f"role={role}", F.concat(F.lit("source-label="), "label"), F.concat(F.lit("slot="), "slot_id"), F.concat(F.lit("source="), "source_content_id")))

    got = hash_rank(some, ["label"], key("recipient")).where(F.col("rank") <= per_direction)
    rest = some.join(got.select("slot_id"), "slot_id", "left_anti")
    give = hash_rank(rest, ["label"], key("donor")).where(F.col("rank") <= per_direction)
    return got.withColumn("role", F.lit("recipient")).unionByName(give.withColumn("role", F.lit("donor")))


def refresh(release: DataFrame, index: int, a: str, b: str, per_direction: int) -> DataFrame:
    """The changed rows of a balanced refresh: recipients of one label take text and label of the other's donors, paired by rank."""
    roles = refresh_roles(release, index, a, b, per_direction)
    get, give = roles.where(F.col("role") == "recipient"), roles.where(F.col("role") == "donor")
    other = F.when(F.col("label") == a, F.lit(b)).otherwise(F.lit(a))
    donors = give.select(F.col("rank"), other.alias("of"), F.col("text").alias("new_text"), F.col("label").alias("new_label"))
    rows = get.join(donors, (get["label"] == donors["of"]) & (get["rank"] == donors["rank"])).select("slot_id", "source_content_id", F.col("new_text").alias("text"), F.col("new_label").alias("label"))
    return rows.withColumn("model_content_id", content_id(F.col("label"), F.col("text"))).select(*SLOT)


def apply_changes(release: DataFrame, changes: DataFrame) -> DataFrame:
    """The release with the rows of ``changes`` in place of its own."""
    (new,) = free_names(release, "new")
    rows = release.join(changes.select("slot_id", F.struct(*SLOT[1:]).alias(new)), "slot_id", "left")
    return rows.select("slot_id", *[F.when(F.col(new).isNotNull(), F.col(f"{new}.{c}")).otherwise(F.col(c)).alias(c) for c in SLOT[1:]])


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """slot_id with label, text before and after of the slots that differ."""
    b = before.select("slot_id", F.struct("model_content_id", "text", "label").alias("b"))
    a = after.select("slot_id", F.struct("model_content_id", "text", "label").alias("a"))
    rows = b.join(a, "slot_id").where(~F.col("a").eqNullSafe(F.col("b")))
    return rows.select("slot_id", F.col("b.label").alias("label_before"), F.col("a.label").alias("label_after"), (F.col("a.text") != F.col("b.text")).alias("text_changed"))


def restored(candidate: DataFrame, baseline: DataFrame, slots: DataFrame) -> DataFrame:
    """``candidate`` with the baseline's rows for the given slots."""
    return apply_changes(candidate, baseline.join(slots.select("slot_id"), "slot_id", "left_semi"))


def overlaps(changes: DataFrame, group: str = "candidate") -> DataFrame:
    """Slots that more than one candidate changes; compositions need none."""
    return changes.groupBy("slot_id").agg(F.count_distinct(group).alias("candidates")).where("candidates > 1")


def composite(release: DataFrame, changes: DataFrame, group: str = "candidate") -> DataFrame:
    """All candidates' changes at once; a slot that two of them change is an error."""
    one = changes.groupBy("slot_id").agg(F.count("*").alias("n"), F.min(F.struct(*SLOT[1:])).alias("x"))
    ok = F.when(F.col("n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("two candidates change "), F.col("slot_id"))).cast("boolean"))
    return apply_changes(release, one.where(ok).select("slot_id", *[F.col(f"x.{c}") for c in SLOT[1:]]))


def leave_one_out(release: DataFrame, changes: DataFrame, group: str = "candidate") -> DataFrame:
    """state, and the slots of the composite with that candidate's changes taken back, for every candidate."""
    names = changes.select(F.col(group).alias("state")).distinct()
    rows = release.join(changes.select("slot_id", F.col(group).alias("by"), F.struct(*SLOT[1:]).alias("new")), "slot_id", "left")
    rows = rows.join(names, how="cross")  # the result's own size: a release per candidate
    take = F.col("new").isNotNull() & (F.col("by") != F.col("state"))
    return rows.select("state", "slot_id", *[F.when(take, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in SLOT[1:]])


def label_transitions(diff: DataFrame) -> DataFrame:
    return diff.groupBy(F.concat_ws("->", "label_before", "label_after").alias("transition")).agg(F.count("*").alias("slots"))


def label_delta(diff: DataFrame) -> DataFrame:
    """label, delta (not 0) in numbers of slots."""
    both = diff.select(F.explode(F.array(F.struct(F.col("label_after").alias("label"), F.lit(1).alias("d")), F.struct(F.col("label_before").alias("label"), F.lit(-1).alias("d")))).alias("x"))
    return both.groupBy("x.label").agg(F.sum("x.d").alias("delta")).where("delta <> 0")


def diff_manifest(release: DataFrame, diff: DataFrame) -> DataFrame:
    """One row: slots, changed slots, text changes and the digest of changed ids (changes are far fewer than slots)."""
    ids = F.array_sort(F.collect_list("slot_id"))
    n = release.agg(F.count("*").alias("slot_count"))
    d = diff.agg(F.count("*").alias("changed_slot_count"), F.count_if("text_changed").alias("text_change_count"), slot_set_digest(ids).alias("changed_slot_ids_sha256"))
    return n.crossJoin(d)


def candidate_manifest(changes: DataFrame, role: str = "candidate") -> DataFrame:
    """candidate_id (opaque), changed_slot_count, changed_slot_ids, changed_slot_ids_sha256 and the role, one row per role."""
    ids = changes.groupBy(role).agg(F.array_sort(F.collect_list("slot_id")).alias("changed_slot_ids"))
    return ids.select(opaque_candidate(F.col("changed_slot_ids")).alias("candidate_id"), F.size("changed_slot_ids").alias("changed_slot_count"), "changed_slot_ids", slot_set_digest(F.col("changed_slot_ids")).alias("changed_slot_ids_sha256"), F.col(role).alias("internal_role"))


def union_changes(parts: dict[str, DataFrame], name: str = "candidate") -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn(name, F.lit(k)) for k, df in parts.items()])


def cyclic_donors(rows: DataFrame, group: list[str], key: Column, id_col: str) -> DataFrame:
    """Each row's id with donor: the next id of its group in hash order, the first after the last."""
    ranked = hash_rank(rows, group, key, total="n")
    donor = ranked.select(*group, (F.col("rank") - 1).alias("rank"), F.col(id_col).alias("donor"), F.col("n").alias("n2"))
    donor = donor.withColumn("rank", F.when(F.col("rank") == 0, F.col("n2")).otherwise(F.col("rank"))).drop("n2")
    return ranked.join(donor, [*group, "rank"]).select(*rows.columns, "donor")
