"""Comparison documents, blind bundles, score archives, pictures, pages, packets, and small rules, on good and broken input."""

import base64
import hashlib
import io
import json
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicewise import importer, packet, report
from slicewise.functions.preview import grey_png, png_uri
from slicewise.operators import blind, certify, compare, configs, incidents, localize
from slicewise.operators import records as rec
from slicewise.operators import releases as rel
from slicewise.operators import validate as val
from slicewise.operators.validate import InvalidInput
from slicewise.plans import training as tr
from slicewise.sources import documents, local, readers, scratch, writers
from tests.conftest import SMALL
from tests.test_files import GOOD, POLICY
from tests.test_files import write as write_sources


def comparison(name="candidate", **more):
    side = lambda r, x: {"release_id": r, "predictions": [{"case_id": str(i), "observed": "yes" if c == "y" else "no"} for i, c in enumerate(x)]}
    return {k: POLICY[k] for k in ("cases", "slices")} | {"baseline": side("old", GOOD["baseline"]), "candidate": side("new", GOOD[name])} | more


def read_text(tmp_path, reader, value):
    (tmp_path / "doc.json").write_text(value if isinstance(value, str) else json.dumps(value))
    return reader(f"file://{tmp_path}/doc.json")


def test_comparison_documents(spark, tmp_path):
    read = lambda value: read_text(tmp_path, lambda p: readers.read_comparison(spark, p), value)
    found = read(comparison())
    assert {(r.release_id, r.name) for r in found["predictions"].collect()} == {("baseline", "old"), ("candidate", "new")} and found["cases"].count() == 4
    good = comparison()
    broken = [
        good | {"more": 1}, {k: v for k, v in good.items() if k != "cases"}, good | {"cases": [{"case_id": 1, "expected": "yes"}]}, good | {"slices": [{"name": "x", "case_ids": ["0"], "maximum_accuracy_drop": "0.1"}]},
        good | {"slices": [{"name": "x", "case_ids": ["0"], "minimum_accuracy": True}]}, good | {"candidate": good["candidate"] | {"release_id": "old"}}, good | {"candidate": good["candidate"] | {"predictions": []}}, good | {"slices": [{"name": "x", "case_ids": ["9"]}]},
        json.dumps(good)[:-1] + ', "cases": []}', "[1]", "{",
    ]
    for value in broken:
        with pytest.raises(InvalidInput):
            read(value)


def test_repair_documents(spark, tmp_path):
    read = lambda value: read_text(tmp_path, lambda p: readers.read_repair_comparison(spark, p), value)
    found = read({"regressed": comparison(), "repairs": {n: comparison(n) for n in ("targeted", "rollback")}})
    assert {r.release_id for r in found["predictions"].select("release_id").distinct().collect()} == {"baseline", "candidate", "targeted", "rollback"}
    verdicts = {r.release_id: r.passed for r in compare.release_verdicts(compare.slice_report(found["cases"], found["predictions"], found["slices"], found["slice_members"])).collect()}
    assert verdicts == {"baseline": True, "candidate": False, "targeted": True, "rollback": False}
    other = comparison("targeted", cases=[c | {"expected": "no"} for c in POLICY["cases"]])
    drop = comparison("targeted", slices=[POLICY["slices"][0] | {"maximum_accuracy_drop": 0.5}, POLICY["slices"][1]])
    base = comparison("targeted", baseline=comparison("rollback")["candidate"] | {"release_id": "old"})
    for repairs in ({"targeted": other}, {"targeted": drop}, {"targeted": base}, {"baseline": comparison("targeted")}, {" ": comparison("targeted")}, {"targeted": 3}):
        with pytest.raises(InvalidInput):
            read({"regressed": comparison(), "repairs": repairs})


def test_shapes(spark):
    shape = {"a": [str], "b?": (int, None)}
    texts = [{"a": []}, {"a": ["x"], "b": None}, {}, {"a": "x"}, {"a": [1]}, {"a": [], "c": 1}, {"a": [], "b": True}, {"a": [], "b": 1.0}, []]
    table = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(texts)], "i int, t string")
    found = documents.shape_violations(documents.value_rows(table, "i", "t"), shape)
    assert {(int(r.doc), r.problem) for r in found.collect()} == {(2, "missing field"), (3, "wrong type"), (4, "wrong type"), (5, "unknown field"), (6, "wrong type"), (7, "wrong type"), (8, "wrong type")}


def test_bundles(spark, tmp_path):
    base = tr.clean(spark, SMALL)
    changes = tr.world(base)
    parts = blind.assemble(3, "space", "0" * 64, base, rel.composite(base, changes), rel.candidate_manifest(changes), ["a", "b"])
    path = f"file://{tmp_path}/bundle"
    blind.write(parts, path)
    found = blind.read(spark, path)
    assert found["header"].first().world_id == "world_03" and found["candidates"].columns == blind.CANDIDATE and not blind.TRUTH_FIELDS & {c for df in found.values() for c in df.columns}
    with pytest.raises(Exception, match="exist"):
        blind.write(parts, path)
    for change in ({"benchmark_namespace": F.lit(" ")}, {"target_labels": F.array(F.lit("a"))}, {"development_partition_sha256": F.lit("0")}, {"official_test_split_loaded": F.lit(True)}, {"world_index": F.lit(-1)}, {"baseline_release_sha256": F.lit("1" * 64)}):
        with pytest.raises(InvalidInput):
            blind.write(parts | {"header": parts["header"].withColumns(change)}, f"file://{tmp_path}/other")
    document = next((tmp_path / "bundle/header/document").glob("part-*"))
    document.write_text(document.read_text().replace("space", "spice"))
    (tmp_path / "bundle/header/document" / f".{document.name}.crc").unlink()
    with pytest.raises(InvalidInput, match="changed"):
        blind.read(spark, path)


def test_score_archives(spark, tmp_path):
    def read(**arrays):
        held = io.BytesIO()
        np.savez(held, **arrays)
        (tmp_path / "s.npz").write_bytes(held.getvalue())
        return {(r.release_id, r.case_id): r.observed for r in readers.read_score_archive(spark, f"file://{tmp_path}/s.npz", {"baseline": "x"}).collect()}

    ids, classes, x = np.array(["1", "2"]), np.array(["a", "b"]), np.array([[1.0, 1.0], [0.0, 2.0]])
    assert read(case_ids=ids, classes=classes, x=x) == {("baseline", "1"): "a", ("baseline", "2"): "b"}
    for bad in ({"case_ids": np.array(["1", "1"])}, {"classes": np.array([1, 2])}, {"x": x[:1]}, {"x": x.astype(int)}, {"x": np.full((2, 2), np.inf)}):
        with pytest.raises(Exception, match="must be|isn't a finite"):
            read(**({"case_ids": ids, "classes": classes, "x": x} | bad))
    with pytest.raises(Exception, match="lacks"):
        read(case_ids=ids, classes=classes)


def unpacked(png):
    """Width, height and rows of an 8-bit grey PNG without filters, by its chunks."""
    assert png[:8] == b"\x89PNG\r\n\x1a\n"
    at, found = 8, {}
    while at < len(png):
        n, name = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + n]
        assert struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0] == zlib.crc32(name + body)
        found[name], at = body, at + 12 + n
    width, height, depth, kind = struct.unpack(">IIBB", found[b"IHDR"][:10])
    assert (depth, kind) == (8, 0) and list(found) == [b"IHDR", b"IDAT", b"IEND"]
    raw = zlib.decompress(found[b"IDAT"])
    rows = [raw[y * (width + 1) : (y + 1) * (width + 1)] for y in range(height)]
    assert all(r[0] == 0 for r in rows)
    return width, height, [list(r[1:]) for r in rows]


def test_pictures(spark):
    pixels = np.array([[0, 255, 1.5], [2.5, 254.4, 3]])
    assert unpacked(grey_png(pixels)) == (3, 2, [[0, 255, 2], [2, 254, 3]])
    for bad in (np.zeros((0, 3)), np.zeros((65, 1)), np.array([[256.0]]), np.array([[-1.0]]), np.array([[np.nan]]), np.zeros(4)):
        with pytest.raises(ValueError):
            grey_png(bad)
    df = spark.createDataFrame([(1, 2, 1, [7.0, 9.0]), (2, 1, 1, None)], "id long, w int, h int, p array<double>")
    got = {r.id: r.uri for r in df.select("id", png_uri("w", "h", "p").alias("uri")).collect()}
    assert got[2] is None and unpacked(base64.b64decode(got[1].removeprefix("data:image/png;base64,"))) == (2, 1, [[7, 9]])


def test_pages_have_every_changed_case(spark, tmp_path):
    n = 700
    cases = spark.range(n).select(F.col("id").cast("string").alias("case_id"), F.lit("<yes>").alias("expected"))
    answer = lambda r, wrong: cases.select(F.lit(r).alias("release_id"), "case_id", F.when(F.col("case_id").cast("int") % wrong == 0, F.lit("no_way")).otherwise(F.lit("<yes>")).alias("observed"))
    predictions = answer("baseline", 1000).unionByName(answer("candidate", 2)).unionByName(answer("fix", 7))
    policy = {"cases": cases, "slices": spark.createDataFrame([("all", 0.01, None)], "name string, maximum_accuracy_drop double, minimum_accuracy double"), "slice_members": cases.select(F.lit("all").alias("name"), "case_id")}
    tables = importer.assess(policy, predictions)
    want = {(str(i), r, "regressed") for r, k in (("candidate", 2), ("fix", 7)) for i in range(1, n) if i % k == 0}
    pages = report.save(spark, tables, f"file://{tmp_path}/report", size=40)
    texts = {p.name: p.read_text() for p in tmp_path.glob("report/*.html")}
    lines = [x for name, t in texts.items() if name != "index.html" for x in re.findall("<tr data-case='([^']*)'.*", t)]
    found = [(c, r, k) for t in texts.values() for c, rest in re.findall("<tr data-case='([^']*)'(.*)", t) for k, r in re.findall(r"<td class=(\w+) data-release='(\w+)'", rest)]
    assert {f for f in found if f[2] != "unchanged"} == want and len(found) == 2 * len(lines) and len(lines) == len(set(lines)) == len({i for i, *_ in want})
    assert len(texts) == pages + 1 > 8 and all("<yes>" not in t for t in texts.values()) and all(t.count("<tr data-case") <= 40 for t in texts.values())
    listed = re.findall(r"<a href=([^>]+)>", texts["index.html"])
    assert sorted(listed) == sorted(set(texts) - {"index.html"}) and "<td>regressed</td>" not in texts["index.html"]
    ranges = [(t.split("<tr data-case='")[1].split("'")[0], t.rsplit("<tr data-case='")[-1].split("'")[0]) for t in (texts[x] for x in listed)]
    assert all(a <= b for a, b in ranges) and all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:], strict=False))
    assert report.case_pages(tables["outcomes"], unchanged=True).agg(F.sum("cases")).first()[0] == n and report.case_pages(tables["outcomes"].limit(0)).count() == 0
    with pytest.raises(Exception, match="exist"):
        report.save(spark, tables, f"file://{tmp_path}/report")
    shown = report.shown(tables["outcomes"], "NO way", "fix", "regressed")
    assert {r.case_id for r in shown.collect()} == {i for i, r, _ in want if r == "fix"}
    places = {(r.release_id, r.case_id): r.place for r in compare.case_table(tables["outcomes"]).collect()}
    for r in ("candidate", "fix"):
        ids = sorted(i for i, x, _ in want if x == r)
        assert [places[r, i] for i in ids] == list(range(1, len(ids) + 1))


def test_packets(spark, tmp_path):
    paths = write_sources(tmp_path)
    protocol = packet.prepare(spark, *paths, f"file://{tmp_path}/packet")
    gold = writers.read_document(spark, f"file://{tmp_path}/packet/facilitator-gold")
    assert gold["source_sha256"] == protocol["source_sha256"] and gold["passing_supplied_repairs"] == "targeted" and gold["candidate_passes"] is False
    answer = writers.read_document(spark, f"file://{tmp_path}/packet/ordinary/answer-template")
    gold.pop("source_sha256")
    assert set(gold) == set(answer["answers"]) and packet.ANSWER == answer["schema"]
    effort = lambda a, b: {"effort": {"active_seconds": a, "provenance_lookup_seconds": b}}
    questions = gold | {"named": ["a"]}
    answer["answers"]["named"] = None
    given = lambda **x: {"answers": answer["answers"] | x}
    cases = {
        "empty": ({}, []), "good": (given(new_errors=3, candidate_passes=False, named=["x", "y"]) | effort(2.5, 1), []), "schema": ({"schema": "x"}, ["another schema"]), "keys": ({"answers": {}}, ["missing field"]), "more": (given(other=1), ["unknown field"]),
        "type": (given(new_errors=True, candidate_passes=1), ["wrong type"] * 2), "twice": (given(named=["a", "a", "b"]), ["repeated entry"]), "entry": (given(named=[1]), ["wrong type"]), "time": (effort(1, 2), ["lookup above activity"]), "below": (effort(-1, -2.0), ["negative time"] * 2),
        "text": (effort("1", None), ["wrong type"]), "half": (effort(None, 7), []),
    }
    table = spark.createDataFrame([(n, json.dumps(answer | x)) for n, (x, _) in cases.items()] + [("broken", "{")], "submission string, text string")
    found = {}
    for r in packet.submission_violations(table, questions).collect():
        found.setdefault(r.submission, []).append(r.problem)
    assert found.pop("broken") and found == {n: p for n, (_, p) in cases.items() if p}
    rows = {r.key: r.value for r in packet.answer_table(spark, gold | {"list": ["a", "b"]}).collect()}
    assert rows["candidate_passes"] == "false" and rows["list"] == "a,b"


def test_config_rules():
    good = {"calibration": {"target_doses": [3, 6], "changes_per_candidate": 24, "accept_to_reject_per_candidate": 12, "reject_to_accept_per_candidate": 12, "material_count_min": 1, "material_count_max": 2, "calibration_world_count": 3, "minimum_passing_worlds": 2, "calibration_materials": ["a", "b"]}, "evaluation": {"minimum_baseline_score": 0.9}}
    assert readers.config_problems(good) == [] == readers.config_problems({})
    for field, value in (("target_doses", [6, 3]), ("target_doses", [15]), ("target_doses", [4]), ("changes_per_candidate", 23), ("material_count_min", 3), ("minimum_passing_worlds", 4), ("calibration_materials", ["a", "a"])):
        assert readers.config_problems(good | {"calibration": good["calibration"] | {field: value}})
    assert readers.config_problems({"evaluation": {"maximum_unrelated_delta": 2}})


def test_config_rules_of_a_table(spark):
    """The same problems as of one configuration on the driver."""
    rng = random.Random(2)
    table = []
    for _ in range(120):
        c = {"target_doses": rng.sample([3, 6, 9, 4, 15], rng.randrange(4)), "changes_per_candidate": rng.choice([24, 23]), "accept_to_reject_per_candidate": 12, "reject_to_accept_per_candidate": 12, "material_count_min": rng.choice([1, 3]), "material_count_max": 2, "calibration_world_count": 3, "minimum_passing_worlds": rng.choice([2, 4]), "calibration_materials": rng.choice([["a", "b"], ["a", "a"], []])}
        c = {k: x for k, x in c.items() if rng.random() < 0.8}
        e = {k: rng.choice([0, 1, 0.5, 2, -0.1, True, "x", None]) for k in ("minimum_x", "maximum_y", "other") if rng.random() < 0.5}
        table.append({k: x for k, x in (("calibration", c), ("evaluation", e)) if rng.random() < 0.9})
    texts = spark.createDataFrame([(str(i), json.dumps(c)) for i, c in enumerate(table)], "i string, t string")
    got = {}
    for r in configs.config_violations(documents.value_rows(texts, "i", "t")).collect():
        got.setdefault(int(r.doc), set()).add(r.problem)
    assert got == {i: set(p) for i, c in enumerate(table) if (p := readers.config_problems(c))}


def test_truths_and_balance(spark):
    truth = spark.createDataFrame([("a", [["c1"]], "1"), ("b", [["c1"], ["c1"]], "2"), ("c", [["c1", "c1"]], "3"), ("d", [], "x")], "incident_id string, sets array<array<string>>, incident_sha256 string")
    assert {r.incident_id for r in incidents.truth_violations(truth).collect()} == {"b", "c", "d"}
    own = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "x")], "incident_id string, incident_sha256 string")
    assert {tuple(r) for r in incidents.unbound_truths(truth, own).collect()} == {("b", "another digest"), ("c", "no incident")}
    row = lambda s, i, x, y: (s, f"rec_{i:016x}", x, y)
    rows = [row(s, k, "ACCEPT" if k % 2 else "REJECT", "REJECT" if k % 2 else "ACCEPT") for s in "pq" for k in range(4)]
    gates = lambda rows, n: {r.gate: r.passed for r in val.balance_gates(spark.createDataFrame(rows, "shard_id string, example_id string, response string, candidate_response string"), ["p", "q"], F.col("response") == "ACCEPT", n).collect()}
    assert all(gates(rows, 2).values()) and not gates(rows, 3)["equal flip directions"]
    off = gates([*rows, ("q", "rec_x", "ACCEPT", "REJECT")], 2)
    assert not any(off[g] for g in ("equal target surfaces", "equal flip directions", "labels preserved", "opaque ids")) and off["shards"]


def test_stage_b_without_partner(spark):
    states = spark.createDataFrame([(0, s, x, v) for s, v in (("composite", 0.5), ("root", 0.75), ("other", 0.5)) for x in ("t", "p")], "trajectory_id int, state string, label string, recall double")
    a = spark.createDataFrame([(0, 0.25, 0.5), (7, 0.5, 0.5)], "trajectory_id int, composite_target double, composite_protected double")
    rows = {r.trajectory_id: r for r in certify.stage_b(states, ["t"], a, "root").collect()}
    assert (rows[0].target_difference, rows[0].protected_difference, rows[0].margin, rows[0].root_is_largest) == (0.25, 0.0, 0.25, True) and rows[7].target is None


def test_working_names_do_not_clash(spark):
    df = spark.range(50).select("id", *[F.lit("x").alias(c) for c in ("_key", "_lead", "_n", "_before", "_total", "_row", "_KEY_")])
    out = rec.hash_rank(df, [], F.lpad(F.col("id").cast("string"), 4, "0"), total="size")
    assert out.columns == [*df.columns, "rank", "size"] and [r["rank"] for r in out.orderBy("id").collect()] == list(range(1, 51))
    release = spark.createDataFrame([("s1", "a", "a", "t", "l", "keep")], "slot_id string, source_content_id string, model_content_id string, text string, label string, new string")
    changes = release.withColumn("label", F.lit("m"))
    assert rel.apply_changes(release, changes).first().label == "m"


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = Conf

    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.scratch(Session, "x")


def test_local_files(tmp_path):
    data = b"evidence" * 1000
    digest = hashlib.sha256(data).hexdigest()
    calls = []
    fetch = lambda: calls.append(1) or data
    path = tmp_path / "cache/file.csv"
    with pytest.raises(InvalidInput):
        local.cached(path, "0" * 64, fetch)
    assert not path.exists() and local.cached(path, digest, fetch) == data == local.cached(path, digest, fetch) and len(calls) == 2
    path.write_bytes(b"changed")
    with pytest.raises(InvalidInput):
        local.cached(path, digest, fetch)
    path.write_bytes(data)
    assert local.file_digest(tmp_path, "cache/file.csv", len(data)) == (digest, len(data))
    (tmp_path / "link").symlink_to(path)
    (tmp_path / "folder").symlink_to(tmp_path / "cache")
    for name, limit in (("cache/file.csv", len(data) - 1), ("link", 10**6), ("folder/file.csv", 10**6), ("cache", 10**6), ("none", 10**6), ("../x", 10**6), ("cache//file.csv", 10**6), ("c:x", 10**6)):
        with pytest.raises(InvalidInput):
            local.file_digest(tmp_path, name, limit)


def test_state_digests():
    a = {"b": np.array([[1.0, 2.0]], np.float32), "a": np.array([3], np.int64)}
    want = hashlib.sha256(b"a\0torch.int64\0[1]\0" + (3).to_bytes(8, "little") + b"\0b\0torch.float32\0[1,2]\0" + struct.pack("<2f", 1, 2) + b"\0").hexdigest()
    assert local.state_digest(a) == want == local.state_digest(dict(reversed(a.items()))) != local.state_digest(a | {"a": np.array([4])})


def test_exact_sums(spark):
    rng = np.random.default_rng(11)
    values = {"a": [1e308, 1.0, -1e308, 2.0**-1074, 1e-300], "b": [0.1] * 10, "c": (rng.normal(size=500) * 10.0 ** rng.integers(-200, 200, 500)).tolist(), "d": [-0.5, 0.5], "e": [2.0**53, 1.0, 2.0**-53]}
    rows = spark.createDataFrame([(k, x) for k, xs in values.items() for x in xs], "k string, x double").repartition(5)
    assert {r.k: r.score for r in localize.exact_sums(rows, "k", "x").collect()} == {k: math.fsum(xs) for k, xs in values.items()}


def test_report_computes_outcomes_once(spark, tmp_path):
    """Ranges, pages and counts of the index come from what was stored, not from the predictions again."""
    computed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    rows = [(r, f"c{k:03}", "yes", "yes", "no" if r == "b" and k % 2 else "yes", "regressed" if r == "b" and k % 2 else "unchanged") for k in range(300) for r in ("a", "b")]
    schema = "release_id string, case_id string, expected string, before string, observed string, outcome string"
    outcomes = spark.createDataFrame(rows, schema).mapInArrow(count, schema)
    none = spark.createDataFrame([], "release_id string, name string")
    tables = {"assessment": none, "releases": none, "slices": none, "outcomes": outcomes}
    assert report.save(spark, tables, f"file://{tmp_path}/report", size=20) >= 8
    assert computed.value == 600
    index = (tmp_path / "report/index.html").read_text()
    assert "<td>b</td><td>150</td><td>0</td><td>0</td><td>150</td>" in index and "<td>a</td><td>0</td><td>0</td><td>0</td><td>300</td>" in index
