"""Blind worlds: a release, its composite and its opaque candidates, without the truth about them.

A bundle is three tables: header (one row), releases (release, slot columns) and
candidates (candidate_id, changed_slot_count, changed_slot_ids, changed_slot_ids_sha256).
Checks are violation queries over whole tables; the two release digests are made part by
part (``digests``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank
from . import digests
from . import validate as val
from .releases import SLOT

# Names of a bundle's header, and fields that would give the truth away.
VERSION, MODE, TRUTH_MODE = 1, "m4_blind_localization_world", "m4_truth_only_world"
TRUTH_FIELDS = {"truth", "truth_manifest", "root_position", "root_candidate_id", "pair_truth_by_candidate_id", "internal_role"}
HEADER = "schema_version int, mode string, world_id string, world_index int, benchmark_namespace string, development_partition_sha256 string, target_labels array<string>, baseline_release_sha256 string, composite_release_sha256 string, official_test_split_loaded boolean, truth_manifest_loaded boolean"
CANDIDATE = ["candidate_id", "changed_slot_count", "changed_slot_ids", "changed_slot_ids_sha256"]
SHARED = ("development_partition_sha256", "baseline_release_sha256", "composite_release_sha256")


def assemble(index: int, namespace: str, partition_sha256: str, baseline: DataFrame, composite: DataFrame, manifest: DataFrame, targets: list[str]) -> dict[str, DataFrame]:
    """The bundle of one world; of ``manifest`` only the columns without truth are taken."""
    spark = baseline.sparkSession
    row = (VERSION, MODE, f"world_{index:02d}", index, namespace, partition_sha256, list(targets), digests.release_digest(baseline), digests.release_digest(composite), False, False)
    sides = [df.select(F.lit(name).alias("release"), *SLOT) for name, df in (("baseline", baseline), ("composite", composite))]
    return {"header": spark.createDataFrame([row], HEADER), "releases": reduce(DataFrame.unionByName, sides), "candidates": manifest.select(*CANDIDATE)}


def header_violations(header: DataFrame) -> DataFrame:
    """problem: a header of another kind, targets that aren't two different labels, digests that are none."""
    digest = lambda c: ~F.coalesce(F.col(c).rlike("^[0-9a-f]{64}$"), F.lit(False))
    targets = F.col("target_labels")
    checks = [
        (~F.col("schema_version").eqNullSafe(VERSION), "schema version"), (~F.col("mode").eqNullSafe(MODE), "mode"), (F.coalesce(F.col("world_index") < 0, F.lit(True)), "world index"),
        (blank(F.col("benchmark_namespace")), "namespace"), (F.coalesce(F.size(targets) != 2, F.lit(True)) | F.coalesce(F.get(targets, 0) == F.get(targets, 1), F.lit(True)) | F.exists(targets, blank), "target labels"),
        (~F.col("official_test_split_loaded").eqNullSafe(False), "test split"), (~F.col("truth_manifest_loaded").eqNullSafe(False), "truth loaded"), *[(digest(c), c) for c in SHARED],
    ]
    return header.select(F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]))).alias("problem"))


def violations(bundle: dict[str, DataFrame]) -> DataFrame:
    """problem, item: truth fields in any table, a bad header, releases of other slots or digests, candidates of other slots or digests."""
    header, releases, candidates = bundle["header"], bundle["releases"], bundle["candidates"]
    spark = header.sparkSession
    row = lambda df, problem, item: df.select(problem.alias("problem"), item.cast("string").alias("item"))
    leaks = [(("truth field"), f"{t}.{c}") for t, df in sorted(bundle.items()) for c in df.columns if c in TRUTH_FIELDS]
    sides = {n: releases.where(F.col("release") == n).select(*SLOT) for n in ("baseline", "composite")}
    keys = sides["baseline"].select("slot_id", F.lit(1).alias("b")).join(sides["composite"].select("slot_id", F.lit(1).alias("c")), "slot_id", "full").where("b is null or c is null")
    found = [(n, digests.release_digest(df)) for n, df in sides.items()]
    want = header.select(F.explode(F.array(*[F.struct(F.lit(n).alias("side"), F.col(f"{n}_release_sha256").alias("declared")) for n in sides])).alias("x")).select("x.*")
    wrong = want.join(spark.createDataFrame(found, "side string, found string"), "side").where(~F.col("declared").eqNullSafe(F.col("found")))
    unknown = candidates.select("candidate_id", F.explode("changed_slot_ids").alias("slot_id")).join(sides["composite"].select("slot_id"), "slot_id", "left_anti").select("candidate_id").distinct()
    manifest = val.manifest_violations(candidates)
    parts = [
        spark.createDataFrame(leaks, "problem string, item string"), row(header_violations(header), F.lit("header"), F.col("problem")), row(keys, F.lit("slot on one side"), F.col("slot_id")),
        row(wrong, F.lit("release digest"), F.col("side")), row(unknown, F.lit("unknown slot"), F.col("candidate_id")), row(manifest, F.concat(F.lit("candidate "), F.col("problem")), F.col("candidate_id")),
    ]
    return reduce(DataFrame.unionByName, parts)


def truth_mismatches(blind: DataFrame, truth: DataFrame) -> DataFrame:
    """world_id, field: identities in which finished blind worlds and their truth (both by world_id) differ, or worlds of one side only."""
    b = blind.select("world_id", F.struct(*SHARED).alias("b"))
    t = truth.select("world_id", "mode", F.struct(*SHARED).alias("t"))
    rows = b.join(t, "world_id", "full")
    checks = [F.when(F.col("b").isNull(), F.lit("no blind world")), F.when(F.col("t").isNull(), F.lit("no truth")), F.when(F.col("t").isNotNull() & ~F.col("mode").eqNullSafe(TRUTH_MODE), F.lit("mode"))]
    checks += [F.when(F.col("b").isNotNull() & F.col("t").isNotNull() & ~F.col(f"b.{c}").eqNullSafe(F.col(f"t.{c}")), F.lit(c)) for c in SHARED]
    return rows.select("world_id", F.explode(F.array_compact(F.array(*checks))).alias("field"))


def write(bundle: dict[str, DataFrame], path: str) -> str:
    """Check the bundle, write its tables and its header as a document with a digest, which is returned."""
    from ..sources import writers

    val.require_none(violations(bundle), "the bundle isn't valid")
    writers.write_new(bundle["releases"], f"{path}/releases")
    writers.write_new(bundle["candidates"], f"{path}/candidates")
    return writers.write_document(bundle["header"].sparkSession, bundle["header"].first().asDict(), f"{path}/header")


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A bundle written by ``write``; one that has been changed, or isn't valid, is an error."""
    from ..sources import writers

    value = writers.read_document(spark, f"{path}/header")
    if TRUTH_FIELDS & set(value):
        raise val.InvalidInput("the header tells the truth")
    names = [f.split(" ")[0] for f in HEADER.split(", ")]
    header = spark.createDataFrame([tuple(value.get(n) for n in names)], HEADER)
    out = {"header": header, "releases": spark.read.parquet(f"{path}/releases"), "candidates": spark.read.parquet(f"{path}/candidates")}
    val.require_none(violations(out), "the bundle isn't valid")
    return out
