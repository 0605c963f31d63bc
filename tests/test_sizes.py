"""What grows with the tables stays spread over tasks: no join of unbounded sides is a broadcast, no step is one task's."""

import hashlib
import json

from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from slicewise import packet
from slicewise.functions.canonical import canonical
from slicewise.operators import compare, digests, records, similarity
from slicewise.operators import validate as val
from slicewise.plans import analysis, registry
from slicewise.plans import views as v
from slicewise.sources import local, readers, writers
from tests.conftest import SMALL

QUERIES = registry.queries()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scores_of_worlds_are_not_broadcast(spark):
    for name in ("tie_aware_score", "truth_top1", "rank_stability"):
        assert "Broadcast" not in physical(QUERIES[name](spark, SMALL)), name


def test_scores_are_made_by_many_tasks(spark, monkeypatch):
    assert records.ROWS == 4000
    monkeypatch.setattr(records, "ROWS", 10)
    worlds = v.table(spark, SMALL, "customer").count()
    assert analysis.method_scores(spark, SMALL).rdd.getNumPartitions() == -(-worlds // 10)
    assert physical(QUERIES["static_methods"](spark, SMALL)).count("Exchange") == 1


def test_plain_slices_meet_their_limits_after_the_counts(spark):
    args = [f(spark, SMALL) for f in (v.cases, v.predictions, v.slices, v.slice_members)]
    first = next(line for line in logical(compare.ordinary_slices(*args)).splitlines() if "Join" in line or "Aggregate" in line)
    assert "Join" in first


def test_texts_are_compared_without_broadcasts(spark, monkeypatch):
    """Every table that the comparison stores, and its result."""
    plans, keep = [], similarity.stored
    monkeypatch.setattr(similarity, "stored", lambda df, name: (plans.append(physical(df)), keep(df, name))[1])
    plans.append(physical(analysis.max_jaccard(spark, SMALL)))
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)


def test_digests_send_no_records_to_the_driver(spark, monkeypatch):
    """Lists of several parts and pieces, and an empty one, against a whole digest."""
    rows = spark.range(30000).select(F.format_string("s%05d", "id").alias("slot_id"), F.lit("\u00e9").alias("source_content_id"), F.lit(None).cast("string").alias("model_content_id"), F.lit("x").alias("label"))
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    want = [canonical({"slot_id": f"s{k:05d}", "source_content_id": "\u00e9", "label": "x"}) for k in range(30000)]
    assert digests.release_digest(rows.repartition(3)) == hashlib.sha256(f"[{','.join(want)}]".encode()).hexdigest()
    assert digests.release_digest(rows.limit(0)) == hashlib.sha256(b"[]").hexdigest()


def test_documents_and_copies_in_parts(spark, tmp_path, monkeypatch):
    """A document is written by several tasks, beginning at any line, and read as one; sources are hashed and kept in pieces."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    cases = spark.range(9).select(F.col("id").cast("string").alias("case_id"), F.lit("a,\"b").alias("expected"))
    slices = spark.createDataFrame([("s", 0.1, None), ("t", 0.2, 0.5)], "name string, maximum_accuracy_drop double, minimum_accuracy double")
    members = cases.select(F.explode(F.array(F.lit("s"), F.lit("t"))).alias("name"), "case_id")
    try:
        for k, x in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.shuffle.partitions", "40")):
            spark.conf.set(k, x)
        path = f"file://{tmp_path}/policy"
        writers.write_lines(writers.document_lines(["{", *writers.policy_parts(cases, slices, members), ',"declared_changes":{"a":[1]}', "}"]), path)
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)
    files = sorted((tmp_path / "policy").glob("part-*"))
    assert len([f for f in files if f.stat().st_size]) > 20
    json.loads("".join(f.read_text() for f in files))
    got = readers.read_policy(spark, path)
    for name, want in (("cases", cases), ("slices", slices), ("slice_members", members)):
        assert sorted(map(str, got[name].select(*want.columns).collect())) == sorted(map(str, want.collect()))
    monkeypatch.setattr(local, "STEP", 50)
    lines = "".join(hashlib.sha256(f.read_bytes()).hexdigest() + "\n" for f in files)
    digest = hashlib.sha256(lines.encode()).hexdigest()
    assert writers.retained(spark, {"x": path}, f"file://{tmp_path}/kept") == {"x": digest} and writers.source_digest(spark, path) == digest
    kept = spark.read.parquet(f"file://{tmp_path}/kept/x").orderBy("file", "place").collect()
    assert b"".join(r.content for r in kept) == b"".join(f.read_bytes() for f in files)


def test_sound_sources_are_looked_at_once(spark, tmp_path, monkeypatch):
    """Neither a sound comparison nor sound sources need the joins that tell what is wrong; a packet parses its sources once."""
    policy = {"cases": [{"case_id": c, "expected": "x"} for c in "ab"], "slices": [{"name": "s", "case_ids": ["a", "b"], "maximum_accuracy_drop": 0.1}]}
    side = lambda name, o: {"release_id": name, "predictions": [{"case_id": c, "observed": o} for c in "ab"]}
    (tmp_path / "comparison.json").write_text(json.dumps(policy | {"baseline": side("r1", "x"), "candidate": side("r2", "y")}))
    (tmp_path / "policy.json").write_text(json.dumps(policy | {"declared_changes": {}}))
    (tmp_path / "p.csv").write_text("release_id,case_id,observed\n" + "".join(f"{r},{c},{o}\n" for r, o in (("baseline", "x"), ("candidate", "y")) for c in "ab"))
    for name in ("coverage_violations", "slice_violations"):
        monkeypatch.setattr(val, name, None)
    found = readers.read_comparison(spark, f"file://{tmp_path}/comparison.json")["predictions"].collect()
    assert sorted(tuple(r) for r in found) == [(role, n, c, o) for role, n, o in (("baseline", "r1", "x"), ("candidate", "r2", "y")) for c in "ab"]
    calls, real = [], readers.read_predictions
    monkeypatch.setattr(readers, "read_predictions", lambda *a, **k: calls.append(1) or real(*a, **k))
    packet.prepare(spark, f"file://{tmp_path}/policy.json", f"file://{tmp_path}/p.csv", f"file://{tmp_path}/out")
    assert len(calls) == 1 and writers.read_document(spark, f"file://{tmp_path}/out/facilitator-gold")["new_errors"] == 2
