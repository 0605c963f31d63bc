import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from slicewise.llm.common import text_buffer
from slicewise.llm.pieces import PieceModel, default_model, digests, encode_decode
from slicewise.llm.tokens import feistel, read_shards, write_shards
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=default_model())


@pytest.fixture(scope="module")
def pieces():
    return PieceModel.load(default_model())


def test_random_texts(lib, pieces):
    rng = random.Random(4)
    texts = ["", " ", " " * 11, " " * 40 + "x", "\n\n \n", "a" * 13, "é" * 50, "x" * 5000 + " y", "    " * 500 + "ab" * 2000, "<0xFC>", "▁"]
    texts += ["".join(rng.choice("abcdeth in\n  ▁éñ日🙂#*12.,=-_<0xFC>") for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["".join(rng.choice("ab -=#*") for _ in range(rng.randrange(400))) for _ in range(100)]
    for part in (texts[i : i + 50] for i in range(0, len(texts), 50)):
        for ids, counts in (pieces.encode_flat(*text_buffer(pa.array(part))), pieces.encode(part)):
            at = np.append(0, np.cumsum(counts))
            back = pieces.decode(ids, counts)
            for i, t in enumerate(part):
                want = lib.encode(t)
                assert ids[at[i] : at[i + 1]].tolist() == want and back[i] == lib.decode(want)


def test_blank_runs(lib, pieces):
    for n in range(1, 70):
        assert lib.encode("x" + " " * n + "\n") == [int(i) for i in pieces.encode(["x" + " " * n + "\n"])[0]]


def test_table_is_bounded(lib, pieces, monkeypatch):
    monkeypatch.setattr("slicewise.llm.pieces.KEPT_SEGMENTS", 50)
    for i in range(20):
        text = " ".join(f"w{i}v{k}" for k in range(40))
        assert pieces.encode_flat(*text_buffer(pa.array([text])))[0].tolist() == lib.encode(text)


def test_odd_rows(lib, odd, none):
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests(encode_decode(odd, default_model())).collect())
    want = []
    for i, t, *_ in ODD:
        ids = lib.encode(t or "")
        want.append((i or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    assert encode_decode(none, default_model()).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    out = feistel(np.arange(n), n, 9)
    assert sorted(out.tolist()) == list(range(n))
    assert n < 17 or out.tolist() != feistel(np.arange(n), n, 10).tolist()


def plain_mix(x):
    for _ in range(2):
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) % 2**64
    return x ^ (x >> 32)


def plain_feistel(x, n, key, rounds=6):
    """The permutation number by number, in whole numbers."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    keys = [plain_mix(((i + 1) * 0x9E3779B97F4A7C15 + key) % 2**64) for i in range(rounds)]
    while True:
        left, right = x >> half, x % 2**half
        for k in keys:
            left, right = right, left ^ plain_mix((right + k) % 2**64) % 2**half
        x = left * 2**half + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 37, 1000])
def test_feistel_number_by_number(n):
    assert feistel(np.arange(n), n, 20).tolist() == [plain_feistel(i, n, 20) for i in range(n)]


def test_order_of_slots(spark, lib, docs, tmp_path):
    """Sequences stand in the order of the permuted numbers that their documents reserve in scan order."""
    path = f"file://{tmp_path}/shards"
    one = docs.coalesce(1)
    write_shards(one, path, model=default_model(), length=32, shard_bytes=30_000, task_bytes=100_000, stable=True)
    at, numbers = 0, []
    for r in one.select("doc_id", "text").collect():
        raw, ids = len((r.text or "").encode()), lib.encode(r.text or "")
        numbers += [(at + k, r.doc_id, k, ids[32 * k : 32 * k + 32]) for k in range(-(-len(ids) // 32))]
        at += -(-(raw + 1) // 32) if raw else 0
    want = [x[1:] for x in sorted((plain_feistel(i, at, 20), *x) for i, *x in numbers)]
    rows = read_shards(spark, path).orderBy("slot").collect()
    assert [(r.doc_id, r.number, np.frombuffer(r.ids, "<u2").tolist()) for r in rows] == want
    assert [r.slot for r in rows] == list(range(len(rows)))
    shards = [r.shard for r in rows]
    assert shards == sorted(shards) and set(shards) == set(range(max(shards) + 1)) and len(set(shards)) > 10
    tasks = len(list((tmp_path / "shards/data").glob("task=*")))
    assert tasks > 3 and len(list((tmp_path / "shards/data").glob("task=*/part-*"))) == len(set(shards)) > tasks


@pytest.mark.parametrize("alphabet", ["etaoinshrdlu", "ab", "abcdefghijklmnopqrstuvwxyz0123456789+/", "▁a", "日本語テキスト", "a"])
def test_long_segments(lib, pieces, alphabet):
    """Rounds by rank buckets are the plain rounds, and the library's, however long the segment."""
    rng = random.Random(7)
    for n in (1, 2, 3, 50, 700, 4000):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        plain, _ = pieces._rounds(points, np.array([n]))
        assert pieces._long_rounds(points).tolist() == plain.tolist()
    text = "x" + "".join(rng.choice(alphabet.replace("▁", "b")) for _ in range(30_000))
    assert pieces.encode([text])[0].tolist() == lib.encode(text)


def test_shards(spark, odd, none, lib, tmp_path):
    path = f"file://{tmp_path}/shards"
    manifest = write_shards(odd, path, model=default_model(), length=16, shard_bytes=20_000, task_bytes=100_000)
    rows = read_shards(spark, path).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(manifest["sequences"])) and rows[-1].shard > 3
    seen = {}
    for r in rows:
        seen.setdefault((r.doc_id, r.number), []).append(np.frombuffer(r.ids, "<u2").tolist())
    for i, t, *_ in ODD:
        ids = lib.encode(t or "")
        for k in range(0, len(ids), 16):
            assert ids[k : k + 16] in seen[(i, k // 16)]
    assert sum(len(x) for x in seen.values()) == sum(-(-len(lib.encode(t or "")) // 16) for _, t, *_ in ODD)
    middle = manifest["sequences"] // 2
    assert read_shards(spark, path, middle).orderBy("slot").collect() == rows[middle:]
    assert {f.stat().st_size % manifest["stride"] for f in (tmp_path / "shards/data").glob("task=*/part-*")} == {0}
    again = f"file://{tmp_path}/again"
    write_shards(odd, again, model=default_model(), length=16, shard_bytes=20_000, task_bytes=100_000)
    assert read_shards(spark, again).orderBy("slot").collect() == rows
    empty = f"file://{tmp_path}/empty"
    assert write_shards(none, empty, model=default_model())["sequences"] == 0 and read_shards(spark, empty).count() == 0
