"""Queries over whole tables, against plain Python: no row is left out by its id."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from slicewise.plans import registry
from slicewise.plans import training as tr
from tests.conftest import SMALL

QUERIES = registry.queries()


def draw(text):
    return int(hashlib.sha256(text.encode()).hexdigest()[:8], 16) % 1000


@pytest.fixture(scope="module")
def rows(duck):
    return lambda sql: duck.execute(sql).fetchall()


def got(spark, name):
    return sorted(tuple(r) for r in QUERIES[name](spark, SMALL).collect())


def test_artifacts(spark, rows):
    seen = defaultdict(set)
    for key, brand, kind in rows("select p_partkey, p_brand, p_type from part"):
        seen[f"{brand}|{kind}"].add(draw(str(key)) < 3)
    assert got(spark, "artifact_fd") == sorted((k,) for k, x in seen.items() if len(x) > 1)


def test_constant_groups(spark, rows):
    seen = defaultdict(set)
    for nation, segment in rows("select c_nationkey, c_mktsegment from customer"):
        seen[nation].add(segment)
    want = sorted((k,) for k, x in seen.items() if len(x) > 1)
    assert got(spark, "constant_in_group") == want and want[-1][0] >= 5


def test_grid(spark, rows):
    keys = [k for (k,) in rows("select c_custkey from customer")]
    have = Counter((k // 16, 16 if draw(str(k)) < 5 else (k ^ 1) % 16 if draw(str(k)) < 10 else k % 16) for k in keys)
    grid = {(k // 16, c) for k in keys for c in range(16)}
    want = [(*x, "missing") for x in grid - set(have)] + [(*x, "unexpected" if x not in grid else "repeated") for x, n in have.items() if x not in grid or n > 1]
    assert got(spark, "key_grid") == sorted(want) and max(x[0] for x in want) > 40 // 16


def test_checkpoints(spark, rows):
    groups, want = defaultdict(list), []
    for (k,) in rows("select o_orderkey from orders"):
        groups[k // 7].append((k % 7 + (8 if k % 101 == 0 else 1), k))
    for t, members in groups.items():
        members.sort()
        before = -1
        for epoch, k in members:
            bad = {"epoch": not 1 <= epoch <= 7, "steps": k % 1000 <= before, "learning rate": k % 11 == 0, "digest": k % 17 == 0}
            want += [(t, epoch, p) for p, x in bad.items() if x]
            before = k % 1000
        if len(members) != 7 or len({e for e, _ in members}) != 7:
            want.append((t, 0, "number of epochs"))
    assert got(spark, "checkpoint_contract") == sorted(want) and max(x[0] for x in want) > 400 // 7


def test_provenance(spark, rows):
    want = sorted((k, "trained file differs") for (k,) in rows("select o_orderkey from orders") if k % 13 == 5)
    assert got(spark, "provenance_chain") == want and want[-1][0] > 100


def tokens(text, pattern="[a-z0-9_]+"):
    return set(re.findall(pattern, (text or "").lower()))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.fixture(scope="module")
def texts(rows):
    items = [(str(i), t) for i, t in rows("select item_id, text from benchmark")]
    return items, rows("select doc_id, text from documents")


def best_by_change(items, docs):
    sets = [(f"change_{i % 5}", tokens(t)) for i, t in docs]
    out = {(i, c): 0.0 for i, _ in items for c, _ in sets}
    for i, t in items:
        own = tokens(t)
        for c, other in sets:
            out[i, c] = max(out[i, c], jaccard(own, other))
    return out


def means(best, n):
    total = defaultdict(float)
    for (_, c), x in best.items():
        total[c] += x
    return {c: x / n for c, x in total.items()}


def test_best_matches(spark, texts):
    items, docs = texts
    best = best_by_change(items, docs)
    want = {k: x for k, x in best.items() if x}
    assert {(i, c): x for i, c, x in got(spark, "max_jaccard")} == pytest.approx(want)
    scores = means(best, len(items))
    found = got(spark, "lexical_overlap")
    assert {r[0]: r[1] for r in found} == pytest.approx(scores, abs=1e-8)
    assert [r[0] for r in sorted(found, key=lambda r: r[2])] == sorted(scores, key=lambda c: (-round(scores[c], 9), c))
    third = best_by_change(items, [x for x in docs if x[0] % 3 == 0])
    assert dict(got(spark, "changed_lexical_overlap")) == pytest.approx(means(third, len(items)), abs=1e-8)


def test_candidates(spark, texts):
    own = [tokens(t, "[a-z0-9]+") for _, t in texts[0]]
    want = defaultdict(float)
    for r in tr.world(tr.clean(spark, SMALL)).select("candidate", "text").collect():
        mine = tokens(r.text, "[a-z0-9]+")
        want[r.candidate] += max(jaccard(mine, x) for x in own)
    found = got(spark, "b2_jaccard")
    assert dict(found) == pytest.approx(dict(want), abs=1e-6)
    ranks = QUERIES["candidate_rank"](spark, SMALL).collect()
    assert [r.candidate for r in sorted(ranks, key=lambda r: r["rank"])] == [c for c, _ in sorted(found, key=lambda r: (-r[1], r[0]))]
