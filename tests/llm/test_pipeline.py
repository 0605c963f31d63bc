"""The pipeline stage by stage against plain Python on the smallest table, with boilerplate lines added."""

import hashlib
import re
from collections import defaultdict

import corpus_pipeline
import pytest
import sentencepiece

from slicewise.llm import secrets
from slicewise.llm.common import materialize
from slicewise.llm.pieces import default_model
from tests.conftest import SMALL
from tests.llm.test_mixing_and_quality import targets_by_rounds
from tests.llm.test_neardup_and_passages import brute

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(rows):
    """Texts of the documents that stay, without their host's boilerplate lines."""
    lines, texts = defaultdict(lambda: defaultdict(set)), defaultdict(set)
    key = lambda line: tuple(WORD.findall(line.lower()))
    for r in rows:
        texts[r.source].add(r.text or "")
        for line in (r.text or "").split("\n"):
            if key(line):
                lines[r.source][key(line)].add(r.text or "")
    hot = {s: {k for k, t in found.items() if len(t) > 20 and len(t) > 0.05 * len(texts[s])} for s, found in lines.items()}
    out = {}
    for r in rows:
        text = r.text or ""
        words = WORD.findall(text)
        windows = defaultdict(list)
        for i in range(len(words) - 2):
            windows[tuple(words[i : i + 3])].append(i)
        repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
        lost = sum(len(key(x)) for x in text.split("\n") if key(x) in hot.get(r.source, ()))
        if len(words) >= 50 and 100 * len(repeated) <= 50 * len(words) and lost <= 0.5 * len(words):
            out[r.doc_id] = "\n".join(x for x in text.split("\n") if not key(x) or key(x) not in hot[r.source])
    return out


def plain_times(rows):
    """How often the fair queue takes each document: finish times in order, cut at the budget."""
    sizes, total = {r.doc_id: len(WORD.findall(r.text or "")) for r in rows}, defaultdict(int)
    for r in rows:
        total[r.source] += sizes[r.doc_id]
    target, queue = targets_by_rounds(dict(total)), []
    for s in total:
        at = 0
        for epoch in (1, 2, 3):
            entries = sorted((hashlib.md5(f"mix|{r.doc_id}|1|{epoch}".encode()).hexdigest(), r.doc_id) for r in rows if r.source == s and sizes[r.doc_id])
            for k, i in entries:
                at += sizes[i]
                queue.append((at / target[s], (s is None, s or ""), epoch, k, i))
    budget, times = sum(total.values()), defaultdict(int)
    for *_, i in sorted(queue):
        if budget <= 0:
            break
        times[i] += 1
        budget -= sizes[i]
    return times


@pytest.fixture(scope="module")
def with_boilerplate(spark, docs):
    """The documents and 60 more of one host: 45 share a line, 10 of those are little else."""
    own = lambda i, n: " ".join(f"own{i}x{k}" for k in range(n))
    line = " ".join(f"Boilerplate{k}" for k in range(30))
    more = [(900_000 + i, (f"{line}\n" if i < 45 else "") + own(i, 25 if i < 10 else 70) + ("\npassword = hunter2hunter2" if i % 7 == 0 else ""), "en", "host") for i in range(60)]
    rows = spark.createDataFrame([(*r, len(r[1])) for r in more], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.unionByName(rows.selectExpr(*[f"cast({c} as {t}) as {c}" for c, t in docs.dtypes]))


def test_stages(spark, docs, with_boilerplate):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "secret_scan", "source_mix", "piece_encoding"]
    kept, data = {}, with_boilerplate
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, data, SMALL), name)
        if name != "piece_encoding":
            assert out.columns == docs.columns
        before, after = data.collect(), out.collect()
        ids = sorted(r.doc_id for r in after)
        if name == "quality_rules":
            want = plain_quality(before)
            assert {r.doc_id: r.text for r in after} == want and len(ids) == len(want)
            assert 900_000 not in want and 900_020 in want and "Boilerplate1" not in want[900_020]
        elif name == "near_dedup":
            root = brute([(r.doc_id, r.text) for r in before], 5)
            assert ids == sorted(i for i, c in root.items() if i == c)
        elif name == "secret_scan":
            assert ids == sorted(r.doc_id for r in before)
            assert not any(secrets.byte_spans((r.text or "").encode()) for r in after)
        elif name == "source_mix":
            assert ids == sorted(i for i, n in plain_times(before).items() for _ in range(n))
        else:
            lib = sentencepiece.SentencePieceProcessor(model_file=default_model())
            want = sorted((r.doc_id, hashlib.sha256(",".join(map(str, lib.encode(r.text))).encode()).hexdigest()) for r in before)
            assert sorted((r.doc_id, r.ids_sha256) for r in after) == want
        assert name == "piece_encoding" or all(r.n_chars == len(r.text) for r in after)
        kept[name], data = len(after), out
    assert kept["source_mix"] == kept["piece_encoding"] > 100
    data = docs
    for name, stage in corpus_pipeline.STAGES:
        data = materialize(stage(spark, data, SMALL), name)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, data.collect()))


def test_empty_table(spark, none, tmp_path):
    data = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        data = materialize(stage(spark, data, SMALL), "empty")
    assert data.count() == 0
