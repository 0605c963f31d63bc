"""The filter audit against plain Python, on odd rows."""

import itertools
import re

from slicewise.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, labels):
    """(part, order, step) -> the seven counts, by running every order over the documents."""
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(t or "", []).append(i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails = []
    for i, t, part in rows:
        t = t or ""
        words = WORD.findall(t)
        smaller = any(x is not None and i is not None and x < i for x in texts[t])
        found = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": smaller}
        fails.append((i, part or "", {x for x, f in found.items() if f}))
    out = {}
    for part in {p for _, p, _ in fails}:
        for order in itertools.permutations("ABCDE"):
            left = [(i, f) for i, p, f in fails if p == part]
            everyone = list(left)
            for step, x in enumerate(order, 1):
                removed = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                redundant = sum(x in f and bool(f & set(order[: step - 1])) for _, f in everyone)
                unique = sum(f == {x} for _, f in everyone)
                out[part, "".join(order), step] = [len(left), len(removed), redundant, unique, sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)]
    for part, own in {(k[0], k[1][k[2] - 1]) for k in out}:
        mine = [k for k in out if k[0] == part and k[1][k[2] - 1] == own]
        total = sum(out[k][1] for k in mine)
        for k in mine:
            out[k].append(total)
    return out


def audit_rows(docs, labels):
    got = audit.interactions(audit.set_counts(audit.failures(docs), labels)).collect()
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}


def test_odd_rows(spark, odd, none):
    labels = [(1, 1, None), (4, 1, 1), (4, 0, 1), (6, None, 1), (None, 1, 1), (9, 1, 0), (77, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    extra = [(20, "A B # c " * 80, "en", ""), (21, "A B # c " * 80, "en", None), (21, "A B # c " * 80, "en", None), (19, " ".join(f"w{i}" for i in range(250)), "en", "a")]
    more = spark.createDataFrame([(i, t, x, s, len(t)) for i, t, x, s in extra], "doc_id long, text string, lang string, source string, n_chars long")
    docs = odd.unionByName(more, allowMissingColumns=True)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert audit_rows(docs, table) == brute(rows, labels)
    assert audit_rows(docs, table.limit(0)) == brute(rows, [])
    assert audit_rows(none, table) == {}


def test_one_repeated_row_over_many_partitions(spark):
    rows = [(7, "same words here " * 90, "a")] * 40 + [(i, "same words here " * 90, "b") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(9)
    labels = spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    assert audit_rows(docs, labels) == brute(rows, [(7, 1, 0)])
