import random

import numpy as np
import pyarrow as pa
import pytest

from slicewise.llm import neardup, passages
from slicewise.llm.links import components


def shingles(text, k):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, k):
    """Smallest reachable id of every id, by all pairs."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def family(rng, first, size, words=60, edits=8):
    """Texts at all distances from one base: chains of links, and many that share buckets without a link."""
    base = [f"b{first}w{k}" for k in range(words)]
    out = []
    for i in range(size):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append((first + i, " ".join(own)))
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_families_as_brute_force(spark, k):
    rng = random.Random(8)
    rows = [r for f in range(3) for r in family(rng, 1000 * f, 120)] + [(9000 + i, " ".join(f"q{i}z{j}" for j in range(30))) for i in range(50)]
    rows += [(8000 + i, rows[3][1]) for i in range(30)]
    got = {r.id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=k).collect()}
    assert got == brute(rows, k)


def test_odd_rows(odd, none):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    assert [by[i][0].n_shingles for i in (1, 2, 3, 4, 6)] == [0, 0, 0, 1, 1] and all(by[i][0].component_id == i for i in (1, 2, 3, 4, 5, 6, 7))
    assert by[9][0].component_id == 8 and not by[9][0].kept and len(by[6]) == 2 and by[None][0].kept and by[None][0].component_id is None
    out = neardup.drop_near_duplicates(odd)
    assert out.columns == odd.columns and out.count() == odd.count() - 1
    assert neardup.near_duplicates(none).count() == 0 and neardup.drop_near_duplicates(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 100, 5000])
def test_sketch_fills(n):
    s = neardup.Sketcher(240)
    out = s.sketch(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    assert (out >> np.uint64(32)).max() < 480 and len(out) == 240


def test_sketch_estimates_similarity():
    rng, s, seen = np.random.default_rng(1), neardup.Sketcher(240), []
    for _ in range(60):
        x = rng.integers(0, 2**63, 300).astype(np.uint64)
        seen.append((s.sketch(x[:250]) == s.sketch(x[50:])).mean())  # 200 of 300 in common
    assert abs(np.mean(seen) - 2 / 3) < 0.02


def test_block_links_join_components():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 14, 12)) for _ in range(40)]
    table = pa.table({"own": [i % 2 for i in range(40)], "i": [0] * 40, "j": [1] * 40, "id": list(range(40)), "c": list(range(40)), "items": [s.tolist() for s in sets], "key": [7] * 40, "bands": [[100 + i, 7, 0] for i in range(40)]})
    out = neardup.block_links(80)(table).to_pylist()
    for r in out:
        a, b = set(sets[r["a"]]), set(sets[r["b"]])
        assert 100 * len(a & b) >= 80 * len(a | b) and (r["a"] + r["b"]) % 2
    root = list(range(40))
    for r in out:
        root = [root[r["a"]] if x == root[r["b"]] else x for x in root]
    for x in range(40):
        for y in range(40):
            a, b = set(sets[x]), set(sets[y])
            if (x + y) % 2 and 100 * len(a & b) >= 80 * len(a | b):
                assert root[x] == root[y]


def test_overlaps_as_sets(monkeypatch):
    rng = np.random.default_rng(3)
    for few in (2, 48):
        monkeypatch.setattr(neardup, "FEW", few)
        for n, rows in ((30, 30), (30, 11), (2, 1), (1, 1), (700, 300)):
            sets = [set(rng.integers(0, 900, rng.integers(1, 60)).tolist()) for _ in range(n)]
            owner = np.repeat(np.arange(n), [len(s) for s in sets])
            _, item = np.unique(np.array([x for s in sets for x in sorted(s)]), return_inverse=True)
            got, first = neardup.overlaps(item, owner, n, rows), rows if rows < n else 0
            for x in range(0, rows, 7):
                for y in range(max(first, x + 1), n, 5):
                    assert got[x, y - first] == len(sets[x] & sets[y])


def test_pairs_of_several_bands_are_verified_in_the_first():
    """0 and 1 share an earlier band, 0 and 2 only this one; all are equal sets of three components."""
    table = pa.table({"own": [0] * 3, "i": [0] * 3, "j": [0] * 3, "id": [0, 1, 2], "c": [0, 1, 2], "items": [[1, 2, 3]] * 3, "key": [7] * 3, "bands": [[5, 7], [5, 7], [6, 7]]})
    assert neardup.block_links(80)(table).to_pylist() == [{"a": 0, "b": 2}, {"a": 1, "b": 2}]


def test_unlinked_family_of_one_template(spark):
    """1,500 texts of one template, all pairs at similarity 0.75 (no link), but for 40 near copies of three of them."""
    rng = random.Random(9)
    template = [f"t{k}" for k in range(150)]
    rows = [(i, " ".join(template + [f"u{i}x{k}" for k in range(20)])) for i in range(1500)]
    rows += [(5000 + i, rows[rng.choice((700, 800, 900))][1] + " end") for i in range(40)]
    got = {r.id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    base = {t: i for i, t in rows[:1500]}
    assert got == {i: base[t.removesuffix(" end")] for i, t in rows}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    edges = [e for e in edges if e[0] != e[1]]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
        x, y = sorted((root[a], root[b]))
        root = {k: x if v == y else v for k, v in root.items()}
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fenwick_chains_are_best():
    rng = np.random.default_rng(1)
    for _ in range(200):
        matches = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (rng.integers(2, 25), 2))})
        best = []
        for i, (x, y) in enumerate(matches):
            best.append(passages.K + max([0.0] + [best[j] - passages.GAP_COST * (x - u + y - v) for j, (u, v) in enumerate(matches[:i]) if u < x and v < y]))
        chain = passages.chains(matches, 1)[0]
        score = passages.K
        for p, q in zip(chain, chain[1:], strict=False):
            assert p[0] < q[0] and p[1] < q[1]
            score += passages.K - passages.GAP_COST * (q[0] - p[0] + q[1] - p[1])
        assert score == pytest.approx(max(best))


def test_planted_passages(spark):
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(10**7)}"
    passage = [word() for _ in range(70)]
    fuzzy = list(passage)
    for k in range(10, 70, 15):
        fuzzy[k] = word()
    del fuzzy[33]
    fuzzy.insert(50, word())
    fill = lambda n: [word() for _ in range(n)]
    short = [word() for _ in range(30)]
    rows = {1: fill(40) + passage + fill(30), 2: fill(90) + passage, 3: fuzzy + fill(60), 4: fill(200), 5: fill(50) + short + fill(50), 6: fill(20) + short + fill(80), 7: passage[:20]}
    got = passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")).collect()
    found = {r.id: r for r in got}
    assert set(found) == {2, 3} and all(r.partner == 1 for r in got)
    assert (found[2].start, found[2].end, found[2].partner_start, found[2].partner_end, found[2].matches) == (90, 160, 40, 110, 70)
    assert found[3].start <= 2 and found[3].end >= 66 and found[3].matches >= 62


def test_split_leaders_among_frequent_lines(spark):
    """1 and 2 lead the passage's parts; 3 leads two lines that all documents from 3 on have, so 4 and 3 are a pair before the passage is seen."""
    rng = random.Random(11)
    word = lambda: f"s{rng.randrange(10**7)}"
    fill = lambda n: [word() for _ in range(n)]
    passage, one, two = fill(60), fill(17), fill(17)
    rows = {1: fill(60) + passage[:33] + fill(60), 2: fill(60) + passage[28:] + fill(60)}
    rows |= {3: one + fill(150) + passage + fill(150) + two, 4: two + fill(120) + passage + fill(120) + one}
    rows |= {i: one + fill(100) + two for i in range(5, 25)}
    got = passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")).collect()
    assert [(r.id, r.partner, r.start, r.end, r.partner_start, r.partner_end, r.matches) for r in got] == [(4, 3, 137, 197, 167, 227, 60)]


def test_dense_edits_are_found(spark):
    """80 words with a word changed every 8, or 10 in 100 at random, in 40 pairs of documents each."""
    rng = random.Random(12)
    fill = lambda n: [f"d{rng.randrange(10**8)}" for _ in range(n)]
    rows = []
    for i in range(80):
        passage, new = fill(80), fill(80)
        changed = set(range(4, 80, 8)) if i % 2 else set(rng.sample(range(80), 8))
        rows += [(i, " ".join(fill(30) + passage + fill(30))), (1000 + i, " ".join(fill(30) + [new[k] if k in changed else w for k, w in enumerate(passage)] + fill(30)))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.id == 1000 + r.partner for r in got) and len({r.id for r in got}) == 80


def test_hot_leader(spark, monkeypatch):
    """One document leads a passage that 60 others have, over several keys; the rows are those of one key."""
    rng = random.Random(14)
    fill = lambda n: [f"h{rng.randrange(10**8)}" for _ in range(n)]
    passage = fill(70)
    docs = spark.createDataFrame([(i, " ".join(fill(20 + i) + passage + fill(30))) for i in range(61)], "doc_id long, text string")
    want = sorted((i, 0, 20 + i, 90 + i, 20, 90, 70) for i in range(1, 61))
    for hot in (1000, 7):
        monkeypatch.setattr(passages, "HOT", hot)
        rows = passages.repeated_passages(docs).collect()
        assert sorted((r.id, r.partner, r.start, r.end, r.partner_start, r.partner_end, r.matches) for r in rows) == want


def test_passages_of_odd_rows(odd, none):
    got = passages.repeated_passages(odd).collect()
    assert [(r.id, r.partner, r.matches) for r in got] == [(9, 8, 150)]
    assert passages.repeated_passages(none).count() == 0


def test_shared_runs_are_found(spark, docs):
    texts = {r.doc_id: (r.text or "").split() for r in docs.collect()}
    runs = {}
    for i, w in texts.items():
        for k in range(len(w) - 49):
            runs.setdefault(tuple(w[k : k + 50]), set()).add(i)
    need = {i for s in runs.values() if len(s) > 1 for i in s}
    rows = passages.repeated_passages(docs).collect()
    assert need <= {x for r in rows for x in (r.id, r.partner)}


def test_longest_stretch_of_replaced_words():
    rng = random.Random(12)
    for _ in range(400):
        n = rng.randrange(1, 60)
        a = [rng.randrange(1000) for _ in range(n + 10)]
        shift = rng.randrange(5)
        b = [-1] * shift + [x if rng.random() < 0.75 else -2 for x in a] + [-1] * 5
        low = rng.randrange(n)
        got = passages.substituted(a, b, low, n, shift, 0.8)
        equal = [a[i] == b[i + shift] for i in range(n)]
        fits = [(j - i, i, j) for i in range(low, n) for j in range(i + 1, n + 1) if equal[i] and equal[j - 1] and sum(equal[i:j]) >= 0.8 * (j - i) - 1e-9]
        assert (got is None) == (not fits)
        if got:
            assert got[1] - got[0] == max(fits)[0] and (got[1] - got[0], got[0], got[1]) in fits and got[2:4] == [got[0] + shift, got[1] + shift] and got[4] == sum(equal[got[0] : got[1]])
