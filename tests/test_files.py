"""Strict readers on good and broken files; the importer from end to end; the stream."""

import hashlib
import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from slicewise import importer
from slicewise.operators.validate import InvalidInput
from slicewise.sources import local, readers, writers
from slicewise.streaming import ingest

POLICY = {
    "cases": [{"case_id": str(i), "expected": "yes"} for i in range(4)],
    "slices": [{"name": "all", "case_ids": ["0", "1", "2", "3"], "maximum_accuracy_drop": 0.25}, {"name": "first", "case_ids": ["0"], "minimum_accuracy": 1.0}],
    "declared_changes": {"data": "labels"},
}
GOOD = {"baseline": "yyny", "candidate": "nyny", "targeted": "yyny", "rollback": "nyyy"}


def write(tmp_path, releases=GOOD, policy=POLICY, header="release_id,case_id,observed", extra=""):
    (tmp_path / "policy.json").write_text(json.dumps(policy))
    rows = [f"{r},{i},{'yes' if c == 'y' else 'no'}" for r, x in releases.items() for i, c in enumerate(x)]
    (tmp_path / "predictions.csv").write_text("﻿" + "\n".join([header, *rows]) + "\n" + extra)
    return f"file://{tmp_path}/policy.json", f"file://{tmp_path}/predictions.csv"


def test_import(spark, tmp_path):
    paths = write(tmp_path)
    summary = importer.run(spark, *paths, f"file://{tmp_path}/out")
    assert summary["assessment"] == {"status": "single_supported_repair", "evaluated": 2, "successful": 1, "repairs": "targeted"}
    tables = importer.reopen(spark, f"file://{tmp_path}/out", *paths)
    assert "single_supported_repair" in importer.render(tables)
    with pytest.raises(Exception, match="exist"):
        importer.run(spark, *paths, f"file://{tmp_path}/out")
    write(tmp_path, GOOD | {"candidate": "nnny"})
    with pytest.raises(InvalidInput, match="changed"):
        importer.reopen(spark, f"file://{tmp_path}/out", *paths)


def test_import_without_repairs(spark, tmp_path):
    paths = write(tmp_path, {k: GOOD[k] for k in ("baseline", "candidate")})
    assert importer.run(spark, *paths, f"file://{tmp_path}/out")["assessment"]["status"] == "not_evaluated"


@pytest.mark.parametrize(
    "how",
    [
        {"header": "release_id,case_id,label"}, {"extra": "candidate,9,yes\n"}, {"extra": "candidate,0,yes\n"}, {"extra": "other,0, \n"}, {"extra": "other,0\n"}, {"extra": "other,0,yes,more\n"},
        {"releases": {"baseline": "yyyy"}}, {"releases": {"baseline": "yyy", "candidate": "yyyy"}}, {"policy": POLICY | {"more": 1}}, {"policy": POLICY | {"declared_changes": []}},
        {"policy": POLICY | {"slices": [{"name": "x", "case_ids": ["7"]}]}}, {"policy": POLICY | {"cases": POLICY["cases"] * 2}}, {"policy": POLICY | {"slices": [{"name": "x", "case_ids": ["1"], "maximum_accuracy_drop": 1.5}]}},
    ],
)
def test_broken_input_writes_nothing(spark, tmp_path, how):
    paths = write(tmp_path, **how)
    with pytest.raises(InvalidInput):
        importer.run(spark, *paths, f"file://{tmp_path}/out")
    assert not (tmp_path / "out").exists()


def test_csv_keeps_blanks_and_quotes(spark, tmp_path):
    (tmp_path / "p.csv").write_text('case_id,observed,release_id\n"a,\n1"," x ",baseline\nb,"say ""y""",candidate\n')
    rows = {r.case_id: r.observed for r in readers.read_predictions(spark, f"file://{tmp_path}/p.csv", multiline=True).collect()}
    assert rows == {"a,\n1": " x ", "b": 'say "y"'}
    with pytest.raises(InvalidInput, match="incomplete"):  # line feeds in values must be asked for
        readers.read_predictions(spark, f"file://{tmp_path}/p.csv")


def test_jsonl(spark, tmp_path):
    def read(text):
        (tmp_path / "g.jsonl").write_text(text)
        return readers.read_examples(spark, f"file://{tmp_path}/g.jsonl").count()

    row = '{"example_id": "1", "prompt": "p", "response": "r"}\n'
    assert read("\n" + row + "  \n") == 1
    for bad in (row * 2, "", "{broken\n", '{"example_id": "1", "prompt": " ", "response": "r"}\n'):
        with pytest.raises(InvalidInput):
            read(bad)


def test_small_documents(spark, tmp_path):
    path = f"file://{tmp_path}/doc"
    writers.write_document(spark, {"b": 1, "a": [1.5, None]}, path)
    assert writers.read_document(spark, path) == {"a": [1.5, None], "b": 1}
    with pytest.raises(ValueError):
        writers.write_document(spark, {"x": float("nan")}, path + "2")
    with pytest.raises(InvalidInput):
        readers.strict_map('{"a": "1", "a": "2"}')
    (tmp_path / "big").write_text("x" * 50)
    with pytest.raises(InvalidInput):
        readers.read_bounded(spark, f"file://{tmp_path}/big", 10)


def test_write_same(spark, tmp_path):
    path, df = f"file://{tmp_path}/t", spark.range(5)
    assert writers.write_same(df, path) and not writers.write_same(df.orderBy("id"), path)
    with pytest.raises(InvalidInput):
        writers.write_same(spark.range(6), path)


def test_guarded_payloads(spark, tmp_path, monkeypatch):
    """Files are refused where a link leads to them, where they are too large, no files, or change while they are read."""
    root = tmp_path / "payloads"
    (root / "in").mkdir(parents=True)
    data = b"x" * 3000
    for name in ("in/good", "in/other", "in/edge"):
        (root / name).write_bytes(data)
    (root / "in/large").write_bytes(data + b"y")
    (root / "link").symlink_to(root / "in/good")
    (root / "folder").symlink_to(root / "in")
    digest = hashlib.sha256(data).hexdigest()
    want = {"in/good": None, "in/other": "digest", "in/edge": None, "in/large": "too large", "link": "link", "folder/good": "link", "in": "no regular file", "in/none": "missing", "../payloads/in/good": "path", "in/./good": "path"}
    rows = spark.createDataFrame([(f"i{k}", p, "0" * 64 if p == "in/other" else digest) for k, p in enumerate(want)], "identity string, path string, sha256 string")
    for folder in (f"file://{root}", str(root)):
        got = readers.verify_payloads(spark, folder, rows, limit=3000).collect()
        assert {r.path: r.problem for r in got} == want and all(r.ok == (r.problem is None) for r in got) and {r.bytes for r in got if r.ok} == {3000}
    read = local.os.read

    def growing(fd, n):
        part = read(fd, n)
        (root / "in/good").write_bytes(data[:-1] + b"z")
        return part

    monkeypatch.setattr(local.os, "read", growing)
    with pytest.raises(local.Refused) as refused:
        local.payload_digest(str(root), "in/good", 3000)
    assert refused.value.problem == "changed"


def test_one_of_several_writers_wins(spark, tmp_path):
    """Writers that all begin before any has finished: one table is there, whole, and the others say that they lost."""
    path = f"file://{tmp_path}/deep/table"
    frames = [spark.range(400).select("id", F.lit(k).alias("writer")).repartition(3) for k in range(4)]

    def write_one(df):
        try:
            writers.write_new(df, path)
            return True
        except InvalidInput as error:
            assert "already exists" in str(error)
            return False

    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(write_one, frames))
    assert won.count(True) == 1
    held = spark.read.parquet(path)
    assert held.count() == 400 and [r.writer for r in held.select("writer").distinct().collect()] == [won.index(True)]
    assert [p.name for p in (tmp_path / "deep").iterdir()] == ["table"]
    with pytest.raises(InvalidInput):
        writers.write_new(frames[0], path)
    other = f"file://{tmp_path}/aside"
    frames[1].write.parquet(other)
    assert not writers._publish(spark, other, path) and spark.read.parquet(other).count() == 400
    assert not writers.write_same(frames[won.index(True)], path)


def test_stream_computes_what_a_batch_changes(spark, tmp_path, monkeypatch):
    """Batches that can't complete a release carry the report on; corrections, a late baseline and a second start give the report of all answers so far."""
    t = {"cases": spark.createDataFrame([(str(i), "yes") for i in range(4)], "case_id string, expected string"), "slices": spark.createDataFrame([("all", 0.5, None), ("first", 0.0, 1.0)], "name string, maximum_accuracy_drop double, minimum_accuracy double")}
    t["slice_members"] = spark.createDataFrame([("all", str(i)) for i in range(4)] + [("first", "0")], "name string, case_id string")
    batches = [
        "candidate,0,yes candidate,1,no baseline,0,yes", "candidate,2,yes other,9,yes", "candidate,3,yes candidate,9,no", "baseline,1,yes baseline,2,no", "baseline,3,yes", "other,0,yes other,1,yes", "candidate,0,no",
        "other,2,yes other,2,no", "other,3,yes other,4,yes", "baseline,2,yes",
    ]
    answers, want, got, calls = {}, [], {}, []
    real = ingest.compare.slice_report
    plain = lambda df: sorted(map(str, df.collect()))
    for text in batches:
        lines = sorted(x.split(",") for x in text.split())
        answers |= {(r, c): o for r, c, o in lines}
        rows = [(r, c, o) for (r, c), o in answers.items() if c in "0123" and all((r, str(i)) in answers for i in range(4))]
        want.append(plain(real(t["cases"], spark.createDataFrame(rows, ingest.SCHEMA), t["slices"], t["slice_members"])))
    monkeypatch.setattr(ingest.compare, "slice_report", lambda *a, **k: calls.append(len(got)) or real(*a, **k))
    (tmp_path / "in").mkdir()
    for numbers in (range(3), range(3, len(batches))):
        for k in numbers:
            (tmp_path / f"in/{k}.csv").write_text("\n".join(["release_id,case_id,observed", *batches[k].split()]))
            os.utime(tmp_path / f"in/{k}.csv", (1000 + k, 1000 + k))
        stream = ingest.prediction_stream(spark, f"file://{tmp_path}/in", 1)
        assert ingest.keep_report(stream, t, f"file://{tmp_path}/store", f"file://{tmp_path}/checkpoint", lambda df, n: got.update({n: plain(df)})).awaitTermination() is None
    assert [got[k] for k in range(len(batches))] == want and want[2] and want[4] != want[3] and want[9] != want[8]
    assert calls == [0, 2, 3, 4, 6, 7, 8, 9]


def test_documents_in_few_files(spark, tmp_path):
    """Documents are written a group to a file, by several tasks, and read as those that have a file of their own."""
    rows = spark.range(1000).select(F.col("id").alias("world"), F.concat(F.lit('m "\\'), "id").alias("method"), F.when(F.col("id") % 3 == 1, "grad").otherwise("trac").alias("mode"))
    writers.write_documents(rows, f"file://{tmp_path}/docs", F.floor(F.col("world") / 100))
    files = list((tmp_path / "docs").glob("part-*"))
    assert len(files) == 10 and len({f.name.split("-")[1] for f in files}) > 1 and all(len(json.loads(f.read_text())) == 100 for f in files)
    (tmp_path / "docs/own.json").write_text('{\n "world": 1000,\n "mode": "grad", "method": null}')
    found = readers.read_documents_by_mode(spark, f"file://{tmp_path}/docs/*", "world long, method string", "grad")
    assert sorted((r.world, r.method) for r in found.collect()) == [(k, f'm "\\{k}') for k in range(1, 1000, 3)] + [(1000, None)]


def test_query_of_documents_writes_few_files(spark, monkeypatch):
    """The query's documents are in far fewer files than there are suppliers."""
    from slicewise.plans import registry

    paths, real = [], readers.read_documents_by_mode
    monkeypatch.setattr(readers, "read_documents_by_mode", lambda s, path, *a: paths.append(path) or real(s, path, *a))
    registry.queries()["source_documents_by_mode"](spark, "/root/testdata/sf0.01")
    held = spark.read.format("binaryFile").load(paths[0])
    assert 1 <= held.count() <= 2 and held.select(F.expr("sum(regexp_count(decode(content, 'UTF-8'), 'world'))")).first()[0] == 100
