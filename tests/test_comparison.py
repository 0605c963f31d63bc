"""Comparison and repair operators against an independent loop, and at their boundaries."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from slicewise.operators import compare, repairs
from slicewise.operators import validate as val


def tables(spark, expected, releases, slices):
    cases = spark.createDataFrame(list(expected.items()), "case_id string, expected string")
    preds = spark.createDataFrame([(r, c, o) for r, p in releases.items() for c, o in p.items()], "release_id string, case_id string, observed string")
    table = spark.createDataFrame([(n, d, m) for n, (d, m, _) in slices.items()], "name string, maximum_accuracy_drop double, minimum_accuracy double")
    members = spark.createDataFrame([(n, c) for n, (_, _, ids) in slices.items() for c in ids], "name string, case_id string")
    return cases, preds, table, members


def test_all_prediction_vectors(spark):
    """27 x 27 vectors of three cases under three overlapping slices, as one table of releases per baseline."""
    expected = {"0": "a", "1": "b", "2": "a"}
    slices = {"all": (1 / 3, None, ["0", "1", "2"]), "floor": (1.0, 0.5, ["0", "1"]), "overlap": (0.0, None, ["1", "2"])}
    vectors = list(product("abc", repeat=3))
    for base in vectors[::9]:
        releases = {"baseline": dict(zip("012", base, strict=True))} | {"".join(x): dict(zip("012", x, strict=True)) for x in vectors}
        got = {(r.release_id, r.name): r for r in compare.slice_report(*tables(spark, expected, releases, slices)).collect()}
        assert len(got) == 28 * 3
        for (release, name), r in got.items():
            limit, floor, ids = slices[name]
            before = sum(releases["baseline"][i] == expected[i] for i in ids)
            after = sum(releases[release][i] == expected[i] for i in ids)
            assert r.accuracy_drop == (before - after) / len(ids)
            assert r.passed == ((before - after) / len(ids) <= limit and (floor is None or after / len(ids) >= floor))
            assert r.regressed == sum(releases["baseline"][i] == expected[i] != releases[release][i] for i in ids)


def test_exact_boundary(spark):
    """16 of 20 against 15 of 20 is a drop of exactly 0.05."""
    expected = {str(i): "x" for i in range(20)}
    wrong = lambda n: {str(i): "y" if i < n else "x" for i in range(20)}
    report = compare.slice_report(*tables(spark, expected, {"baseline": wrong(4), "candidate": wrong(5)}, {"all": (0.05, None, list(expected))}))
    assert {r.release_id: r.passed for r in report.collect()} == {"baseline": True, "candidate": True}


def test_labels_are_compared_exactly(spark):
    t = tables(spark, {"1": "a"}, {"baseline": {"1": "a"}, "candidate": {"1": "a "}}, {"all": (0.0, None, ["1"])})
    assert not compare.slice_report(*t).where("release_id = 'candidate'").first().passed


@pytest.mark.parametrize("passing, status", [([], "no_supported_repair"), (["r1"], "single_supported_repair"), (["r1", "r2"], "ambiguous_repairs")])
def test_repair_status(spark, passing, status):
    verdicts = spark.createDataFrame([("baseline", True), ("candidate", False), ("r1", "r1" in passing), ("r2", "r2" in passing)], "release_id string, passed boolean")
    assert repairs.repair_status(verdicts).first().status == status


def test_repair_status_edges(spark):
    none = spark.createDataFrame([("baseline", True), ("candidate", False)], "release_id string, passed boolean")
    assert repairs.repair_status(none).first().status == "insufficient_evidence"
    assert repairs.repair_status(none, declared=False).first().status == "not_evaluated"
    with pytest.raises(Exception, match="must fail"):
        repairs.repair_status(none.withColumn("passed", F.lit(True))).collect()


def test_coverage(spark):
    cases, preds, _, _ = tables(spark, {"1": "a", "2": "b"}, {"baseline": {"1": "a", "3": "c"}}, {"all": (0.0, None, ["1"])})
    got = {(r.case_id, r.problem) for r in val.coverage_violations(cases, preds.union(preds.where("case_id = '1'"))).collect()}
    assert got == {("1", "duplicate"), ("2", "missing"), ("3", "unknown")}
    with pytest.raises(val.InvalidInput):
        val.require_none(val.coverage_violations(cases, preds), "coverage")


def test_empty_inputs(spark):
    t = tables(spark, {"1": "a"}, {"baseline": {"1": "a"}}, {"all": (0.0, None, ["1"])})
    none = [x.limit(0) for x in t]
    assert compare.slice_report(*none).count() == 0
    assert compare.policy_coverage(none[0], none[3]).first().coverage is None
