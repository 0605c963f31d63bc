import re

import pytest
from pyspark.sql import functions as F

from slicewise.llm import mixing, quality


def targets_by_rounds(sizes, weights=(5, 2, 1)):
    """Share by weight, stop at 3 times the size, share the excess anew until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in open_)
        share = {s: left * weight[s] / w for s in open_}
        above = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not above:
            return {**fixed, **share}
        fixed |= {s: 3.0 * sizes[s] for s in above}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 1, "d": 1000}, {"a": 5, None: 5}, {"a": 1, "b": 10_000, "c": 3, None: 40}, {"a": 0, "b": 7}, {"a": 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(targets_by_rounds(sizes)) if sum(sizes.values()) else set(got.values()) == {0.0}


def test_mix(spark, docs):
    rows = mixing.taken_words(docs).collect()
    assert sum(r.taken for r in rows) == sum(r.size for r in rows)
    assert all(r.taken <= 3 * r.size for r in rows)
    assert sorted(rows, key=lambda r: r.id) == sorted(mixing.taken_words(docs.repartition(7)).collect(), key=lambda r: r.id)
    largest, per = {}, {}
    for r in rows:
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        per[r.source] = (per.get(r.source, (0, 0))[0] + r.taken, r.target)
    assert all(abs(t - want) <= 2 * largest[s] + 1 for s, (t, want) in per.items())


def test_buckets_change_nothing(docs, monkeypatch):
    rows = sorted(mixing.taken_words(docs).collect(), key=lambda r: r.id)
    monkeypatch.setattr(mixing, "PER_BUCKET", docs.count() / 60_000)
    assert sorted(mixing.taken_words(docs).collect(), key=lambda r: r.id) == rows


def test_mix_of_odd_rows(odd, none):
    rows = mixing.taken_words(odd).collect()
    assert len(rows) == odd.count()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.id or 0, r.size) for r in rows) == sorted((r.doc_id or 0, size(r.text)) for r in odd.collect())
    assert all(r.taken == 0 for r in rows if r.size == 0) and sum(r.taken for r in rows) == sum(r.size for r in rows)
    out = mixing.mix_documents(odd)
    assert out.columns == odd.columns
    times = {}
    for r in rows:
        times[r.id] = times.get(r.id, 0) + r.times
    got = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {k: v for k, v in times.items() if v}
    assert mixing.taken_words(none).count() == 0 and mixing.mix_documents(none).count() == 0


def test_fair_order(spark):
    """The mix is in order of finish times and stops at the budget."""
    rows = mixing.sized(spark.createDataFrame([(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string"), "doc_id", "text", "source")
    mix = mixing.fair_queue(rows, mixing.source_targets(rows)).orderBy("begin").collect()
    assert [m.finish for m in mix] == sorted(m.finish for m in mix)
    at = 0
    for m in mix:
        assert m.begin == at
        at += m.taken
    assert at == sum(r.size for r in rows.collect())


def test_hot_lines(spark):
    """A line in most texts of a host goes; texts that were little else are rejected; copies don't count."""
    hot = "\n".join(" ".join(f"rule{n}w{k}" for k in range(13)) for n in range(4))
    own = lambda i, n=80: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(i, f"{hot.upper()}\n{own(i)}", "h") for i in range(30)] + [(100, f"{hot}\n{own(100, 30)}", "h"), (101, f"{hot}\n{own(101, 30)}", "other")]
    rows += [(200 + i, f"copied  line\n{own(5000)}", "h") for i in range(40)] + [(300, None, "h"), (301, own(301), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    v = {r.id: r for r in quality.line_verdicts(docs).collect()}
    assert all(v[i].kept and v[i].lost_words == 52 for i in range(30))
    assert not v[100].kept and not v[100].base_failed and v[100].lost_words == 52 and v[101].kept and v[101].lost_words == 0
    assert all(v[200 + i].kept and v[200 + i].lost_words == 0 for i in range(40)) and not v[300].kept and v[301].kept
    each = {r.id: r for r in quality.line_verdicts(docs, count="documents").collect()}  # copies count: their lines are in over half of the host's documents
    assert not any(each[200 + i].kept for i in range(40)) and each[200].lost_words == 82 and all(each[i].kept == v[i].kept for i in v if not 200 <= i < 240)
    out = {r.doc_id: r.text for r in quality.keep_documents(docs).collect()}
    assert out[3] == own(3) and out[101] == rows[31][1] and out[200] == rows[32][1] and 100 not in out and 300 not in out


def test_quality_of_odd_rows(odd, none):
    rows = {}
    for r in quality.line_verdicts(odd).collect():
        rows.setdefault(r.id, []).append(r)
    assert rows[1][0].n_words == 0 and rows[1][0].base_failed and not rows[2][0].kept and len(rows[6]) == 2
    assert rows[5][0].n_words == 40_000 and rows[5][0].kept and rows[8][0].n_dup_lines == 29 and rows[8][0].n_repeat_words == 150 and not rows[8][0].kept
    out = quality.keep_documents(odd)
    assert out.columns == odd.columns and [r.doc_id for r in out.collect()] == [5]
    assert quality.line_verdicts(none).count() == 0 and quality.keep_documents(none).count() == 0


@pytest.mark.parametrize("text, want", [("a b c a b c", 6), ("a a a a", 4), ("a a a", 0), ("a b c d a b c", 6), ("", 0), ("a b c x b c a b c", 6)])
def test_repeated_windows(spark, text, want):
    docs = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    assert quality.line_verdicts(docs).first().n_repeat_words == want
