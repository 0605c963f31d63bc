"""Synthetic classification tasks: grids, panels, lookups, shard changes and their controls.

The dimensions are tables of a few names; plans that need a seeded shuffle are made on
the driver, where Python's generator is, and go in as tables of a few rows.
"""

from __future__ import annotations

import random
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import opaque_record, sha
from ..functions.text import canonical_label, flipped

# The names and numbers of the tasks.
TRAIN_MATERIALS = ("cedar", "copper", "granite", "linen", "rubber", "glass", "paper", "steel", "clay", "leather", "plaster", "silk")
EVAL_MATERIALS = ("bamboo", "ceramic", "marble", "wool")
COLORS = ("amber", "blue", "green", "violet")
SHAPES = ("circle", "square", "triangle")
SIZES = ("small", "large")
SLOTS = ("slot_a", "slot_b", "slot_c", "slot_d", "slot_e", "slot_f")
TARGET_SLICE, CONTROL_SLICE = "triangle_large", "square_small"
MIX_SHARDS = ("shard_mix_01", "shard_mix_02", "shard_mix_03", "shard_mix_04", "shard_mix_05")
MIX_DISTRACTORS = ("circle_small", "triangle_small", "circle_large", "square_large")
BIND_SHARDS = ("shard_bind_01", "shard_bind_02", "shard_bind_03", "shard_bind_04", "shard_bind_05")
BIND_SLICES = ("circle_small", "triangle_small", "circle_large", "triangle_large", "square_large")
MIX_SALT, BIND_SALT, BIND_ID_SALT, LOOKUP_ID_SALT = 0xE002, 0xE003, 0x1D003, 0x1D003C
TRAIN_CONTEXTS, EVAL_CONTEXTS = ("amber", "cobalt", "ivory"), ("jade", "ochre", "pearl", "sienna")
EVAL_PATTERNS = ("abc", "ade", "bdf", "cef")
POLICY_TEXT = "Explicit policy: shape=circle -> ACCEPT; shape=triangle -> ACCEPT; shape=square -> REJECT."


def dimension(spark: SparkSession, name: str, values) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"{name}_at int, {name} string")


def grid(spark: SparkSession, materials, prefix: str) -> DataFrame:
    """Every material, color, shape and size: example_id, prompt, response (canonical), slice_id, place, and the dimensions."""
    rows = dimension(spark, "material", materials)
    for name, values in (("color", COLORS), ("shape", SHAPES), ("size", SIZES)):
        rows = rows.join(F.broadcast(dimension(spark, name, values)), how="cross")
    place = ((F.col("material_at") * 4 + F.col("color_at")) * 3 + F.col("shape_at")) * 2 + F.col("size_at")
    prompt = F.format_string("Classify this synthetic object as ACCEPT or REJECT. material=%s; color=%s; shape=%s; size=%s. Reply with exactly one label.", "material", "color", "shape", "size")
    return rows.select(
        F.concat_ws(":", F.lit(prefix), "material", "color", "shape", "size").alias("example_id"), prompt.alias("prompt"), canonical_label(F.col("shape")).alias("response"),
        F.concat_ws("_", "shape", "size").alias("slice_id"), "material", "color", "shape", "size", place.alias("place"),
    )


def target_flip(rows: DataFrame) -> DataFrame:
    """shard_id and candidate response of the first task: the target slice is one shard, and flipped."""
    hit = F.col("slice_id") == TARGET_SLICE
    return rows.withColumns({"shard_id": F.when(hit, F.lit("regression")).otherwise(F.lit("core")), "candidate_response": F.when(hit, flipped(F.col("response"))).otherwise(F.col("response"))})


def shuffled_plan(shards, seed: int) -> list[str]:
    order = list(shards)
    random.Random(seed).shuffle(order)
    return order


def mixed_plan(seed: int) -> list[tuple[str, str]]:
    """(shard, slice it flips), the causal shard first."""
    return list(zip(shuffled_plan(MIX_SHARDS, seed ^ MIX_SALT), (TARGET_SLICE, *MIX_DISTRACTORS), strict=True))


def mixed_shards(spark: SparkSession, seed: int = 42) -> DataFrame:
    """The entangled task: rows with shard_id, response, candidate_response and intervention_response.

    Of the target slice's 48 records the causal shard has the first 32, the others 4 each.
    Of another slice its own shard has the first 32, and the rest go 4 each to the other
    shards, the causal one first.
    """
    plan = mixed_plan(seed)
    table = spark.createDataFrame([(i, shard, slice_id) for i, (shard, slice_id) in enumerate(plan)], "owner_at int, owner string, slice_id string")
    rows = grid(spark, TRAIN_MATERIALS, "train").join(F.broadcast(table), "slice_id", "left")
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("slice_id").orderBy("place")) - 1)
    block = F.floor((F.col("n") - 32) / 4).cast("int")  # of the rest, 0 to 3
    order = [plan[0][0], *sorted(s for s, _ in plan[1:])]
    others = F.filter(F.array(*[F.lit(s) for s in order]), lambda s: s != F.col("owner"))  # causal first, but for its own slice
    shard = F.when(F.col("owner").isNull(), F.lit("shard_stable_00")).when(F.col("n") < 32, F.col("owner")).otherwise(F.get(others, block))
    rows = rows.withColumn("shard_id", shard)
    flip = F.col("shard_id") == F.col("owner")
    candidate = F.when(flip, flipped(F.col("response"))).otherwise(F.col("response"))
    repaired = F.when((F.col("shard_id") == plan[0][0]) & (F.col("slice_id") == TARGET_SLICE), F.col("response")).otherwise(F.col("candidate_response"))
    return rows.withColumn("candidate_response", candidate).withColumn("intervention_response", repaired).drop("owner", "owner_at", "n")


def panels(spark: SparkSession, materials, prefix: str, seed: int = 42, policy: bool = False) -> DataFrame:
    """A row per panel (material, color) and selected slice: slice i stands in slot (i + panel) mod 6."""
    rows = dimension(spark, "material", materials).join(F.broadcast(dimension(spark, "color", COLORS)), how="cross")
    rows = rows.withColumn("panel_index", F.col("material_at") * 4 + F.col("color_at"))
    slices = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("shape"), F.lit(z).alias("size")) for i, (s, z) in enumerate((s, z) for s in SHAPES for z in SIZES)])
    slot_names = F.array(*[F.lit(s) for s in SLOTS])
    objects = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: F.concat(F.get(slot_names, j), F.lit(":shape="), F.get(slices, F.pmod(j - F.col("panel_index"), F.lit(6)))["shape"], F.lit(",size="), F.get(slices, F.pmod(j - F.col("panel_index"), F.lit(6)))["size"]))
    rows = rows.withColumn("objects", F.array_join(objects, "; ")).withColumn("s", F.explode(slices))
    slot = F.get(slot_names, (F.col("s.i") + F.col("panel_index")) % 6)
    prompt = F.concat(F.lit(POLICY_TEXT + " " if policy else ""), F.format_string("Classify only the selected synthetic object as ACCEPT or REJECT. material=%s; color=%s; selected_slot=%s. %s. Reply with exactly one label.", F.col("material"), F.col("color"), slot, F.col("objects")))
    return rows.select(
        opaque_record(F.lit(seed ^ BIND_ID_SALT), F.lit(prefix), F.col("panel_index"), F.col("s.i")).alias("example_id"), prompt.alias("prompt"), canonical_label(F.col("s.shape")).alias("response"),
        F.concat_ws("_", "s.shape", "s.size").alias("selected_slice_id"), "material", "color", slot.alias("selected_slot"), "panel_index",
    )


def panel_plan(seed: int = 42) -> list[tuple[str, str]]:
    return list(zip(shuffled_plan(BIND_SHARDS, seed ^ BIND_SALT), BIND_SLICES, strict=True))


def panel_changes(spark: SparkSession, seed: int = 42, changed_panels: int = 36, restore: str | None = None) -> DataFrame:
    """Training panels with shard_id, candidate_response and intervention_response; ``restore`` names the shard to restore, the causal one by default."""
    plan = panel_plan(seed)
    restore = restore or next(shard for shard, s in plan if s == TARGET_SLICE)
    table = spark.createDataFrame(plan, "shard string, selected_slice_id string")
    rows = panels(spark, TRAIN_MATERIALS, "train", seed).join(F.broadcast(table), "selected_slice_id", "left")
    flip = F.col("shard").isNotNull() & (F.col("panel_index") < changed_panels)
    rows = rows.withColumn("candidate_response", F.when(flip, flipped(F.col("response"))).otherwise(F.col("response")))
    repaired = F.when(flip & (F.col("shard") == restore), F.col("response")).otherwise(F.col("candidate_response"))
    return rows.withColumns({"shard_id": F.coalesce("shard", F.lit("shard_stable_00")), "intervention_response": repaired}).drop("shard")


def restoration_sweep(spark: SparkSession, seed: int = 42) -> DataFrame:
    """restored_shard, restored, remaining, changed_elsewhere: each shard's restoration by itself."""
    rows = panel_changes(spark, seed).where(F.col("shard_id") != "shard_stable_00")
    shards = F.explode(F.array(*[F.lit(s) for s in sorted(BIND_SHARDS)]))
    rows = rows.withColumn("restored_shard", shards)
    changed = F.col("candidate_response") != F.col("response")
    back = changed & (F.col("shard_id") == F.col("restored_shard"))
    return rows.groupBy("restored_shard").agg(F.count_if(back).alias("restored"), F.count_if(changed & ~back).alias("remaining"), F.count_if(back & (F.col("shard_id") != F.col("restored_shard"))).alias("changed_elsewhere"))


def patterns() -> list[tuple[str, ...]]:
    """All choices of three slots of six."""
    return list(combinations(SLOTS, 3))


def lookups(spark: SparkSession, split: str, seed: int = 42) -> DataFrame:
    """Decision lookups: a row per pattern, context and selected slot; patterns kept for evaluation aren't in training."""
    held = {tuple(f"slot_{c}" for c in p) for p in EVAL_PATTERNS}
    chosen = [p for p in patterns() if (p in held) == (split == "eval")]
    table = spark.createDataFrame([(i, list(p)) for i, p in enumerate(chosen)], "pattern_index int, accept_slots array<string>")
    contexts = dimension(spark, "context_id", EVAL_CONTEXTS if split == "eval" else TRAIN_CONTEXTS)
    rows = table.join(F.broadcast(contexts), how="cross").join(F.broadcast(dimension(spark, "selected_slot", SLOTS)), how="cross")
    decision = lambda s: F.when(F.array_contains("accept_slots", s), F.lit("ACCEPT")).otherwise(F.lit("REJECT"))
    listed = F.array_join(F.array(*[F.concat(F.lit(f"{s}:decision="), decision(F.lit(s))) for s in SLOTS]), "; ")
    prompt = F.format_string("Return the decision assigned to the selected slot. context=%s; selected_slot=%s. %s. Reply with exactly one label.", F.col("context_id"), F.col("selected_slot"), listed)
    return rows.select(
        opaque_record(F.lit(seed ^ LOOKUP_ID_SALT), F.lit(split), F.col("pattern_index"), F.col("context_id_at"), F.col("selected_slot_at")).alias("example_id"), prompt.alias("prompt"), decision(F.col("selected_slot")).alias("response"),
        "selected_slot", F.array_join("accept_slots", ",").alias("accept_slots"), "context_id", F.concat(F.lit("pattern_"), F.array_join(F.transform("accept_slots", lambda s: F.substring(s, -1, 1)), "")).alias("pattern_id"),
    )


def order_control(rows: DataFrame, datasets: list[str], seed: int, space: str = "exp004-order-control-a", key: str = "example_id") -> DataFrame:
    """dataset, key, place: one keyed order, the same for every dataset."""
    order = F.row_number().over(W.partitionBy("dataset").orderBy(sha(F.concat_ws("|", F.lit(space), F.lit(str(seed)), F.col(key)))))
    return rows.select(key).withColumn("dataset", F.explode(F.array(*[F.lit(d) for d in datasets]))).withColumn("place", order)


def apply_world(rows: DataFrame, manifest: DataFrame, restored_role: str | None = None) -> DataFrame:
    """``rows`` (example_id, response) per world with the responses that the frozen manifest (world, role, example_id) flips, but for the restored role."""
    worlds = manifest.select("world").distinct()
    marks = manifest.where(F.col("role") != (restored_role or "")).select("world", "example_id", F.lit(True).alias("flip")).distinct()
    out = rows.join(worlds, how="cross").join(marks, ["world", "example_id"], "left")  # the result's own size: a dataset per world
    return out.withColumn("candidate_response", F.when(F.col("flip"), flipped(F.col("response"))).otherwise(F.col("response"))).drop("flip")


def balance(rows: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """group, column, values, least, most: how evenly each column's values occur."""
    each = rows.select(*group, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select(*group, "x.column", "x.value")
    counts = each.groupBy(*group, "column", "value").agg(F.count("*").alias("n"))
    return counts.groupBy(*group, "column").agg(F.count("*").alias("values"), F.min("n").alias("least"), F.max("n").alias("most"))


def balanced_allocation(spark: SparkSession, shards: list[str], planted: str, world_seed: int) -> DataFrame:
    """shard_id, example_id: for each color and slot of the target's evaluation one target record for the planted shard and one
    other ACCEPT record for each of the others, and for each slot two REJECT records for every shard.

    The pools are disjoint, so each is a rank by keyed hash, matched with the shards' own keyed order.
    """
    rows = panels(spark, TRAIN_MATERIALS, "train")
    pairs = panels(spark, EVAL_MATERIALS, "eval").where(F.col("selected_slice_id") == TARGET_SLICE).select("color", "selected_slot").distinct()
    accept = rows.where("response = 'ACCEPT'").join(pairs, ["color", "selected_slot"])
    key = lambda *parts: sha(F.concat_ws("|", *[p if not isinstance(p, (str, int)) else F.lit(str(p)) for p in parts]))
    rank = lambda group, by: F.row_number().over(W.partitionBy(*group).orderBy(by))
    here = ["color", "selected_slot"]
    own = accept.where(F.col("selected_slice_id") == TARGET_SLICE).withColumn("r", rank(here, key("planted-accept", F.col("color"), F.col("selected_slot"), world_seed, F.col("example_id"))))
    own = own.where("r = 1").select(F.lit(planted).alias("shard_id"), "example_id")

    others = [s for s in shards if s != planted]
    order = pairs.withColumn("shard_id", F.explode(F.array(*[F.lit(s) for s in others])))
    order = order.withColumn("r", rank(here, key("distractor-order", world_seed, F.col("color"), F.col("selected_slot"), F.col("shard_id"))))
    pool = accept.where(F.col("selected_slice_id") != TARGET_SLICE).withColumn("r", rank(here, key("distractor-accept", F.col("color"), F.col("selected_slot"), world_seed, F.col("example_id"))))
    given = pool.join(order, [*here, "r"]).select("shard_id", "example_id")

    slots = rows.select("selected_slot").distinct().withColumn("shard_id", F.explode(F.array(*[F.lit(s) for s in shards])))
    slots = slots.withColumn("block", rank(["selected_slot"], key("reject-order", world_seed, F.col("selected_slot"), F.col("shard_id"))))
    reject = rows.where("response = 'REJECT'").withColumn("r", rank(["selected_slot"], key("reject", F.col("selected_slot"), world_seed, F.col("example_id"))))
    reject = reject.withColumn("block", F.floor((F.col("r") + 1) / 2).cast("int")).join(slots, ["selected_slot", "block"]).select("shard_id", "example_id")
    return own.unionByName(given).unionByName(reject)
