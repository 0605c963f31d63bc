import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicewise.llm import tiff
from tests.conftest import SMALL


def test_codecs():
    rng = random.Random(2)
    for n in [*range(40), 127, 128, 129, 300, 5000, 40_000]:
        for alphabet in (b"a", b"ab", bytes(range(256))):
            d = bytes(rng.choice(alphabet) for _ in range(n))
            assert tiff.packbits_decode(tiff.packbits_encode(d), n) == d
            assert tiff.lzw_decode(tiff.lzw_encode(d), n) == d


def test_known_codes():
    # PackBits: the example of the format's note; LZW: clear, 7, 258, 8, 8, 258, 6, 6, end as 9-bit codes
    assert tiff.packbits_decode(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(data, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == data


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
@pytest.mark.parametrize("codec", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS, tiff.OLD_DEFLATE])
@pytest.mark.parametrize("layout", [{}, {"rows": 3}, {"tile": (16, 32)}])
def test_pages(order, kind, codec, layout):
    a = np.random.default_rng(1).integers(0, np.iinfo(kind).max, (37, 21, 3)).astype(kind)
    data = tiff.write_tiff([{"samples": a, "compression": codec, "predictor": p, **layout} for p in (1, 2)] + [{"samples": a[:5, :, :1]}], order)
    pages = [tiff.read_page(data, o, f) for o, f in tiff.read_directories(data)]
    assert (pages[0] == a).all() and (pages[1] == a).all() and (pages[2] == a[:5, :, :1]).all()


def test_broken_media_gives_rows(spark):
    good = tiff.write_tiff([{"samples": np.zeros((4, 4), np.uint8)}, {"samples": np.ones((2, 2), np.uint8)}])
    loop = bytearray(good)
    first = int.from_bytes(good[4:8], "little")
    n = int.from_bytes(good[first : first + 2], "little")
    loop[first + 2 + 12 * n : first + 6 + 12 * n] = good[4:8]
    rows = [(1, good), (2, None), (3, b""), (4, b"no tiff at all"), (5, bytes(loop)), (6, good[: len(good) - 40])]
    df = spark.createDataFrame([(i, bytearray(m) if m is not None else None, "x") for i, m in rows], "id long, media binary, other string")
    got = {}
    for r in tiff.tiff_pages(df, "media", ["id", "other"]).collect():
        got.setdefault(r.id, []).append((r.page, r.error is None))
    assert got[1] == [(0, True), (1, True)] and got[2] == [(None, False)] and got[3] == [(None, False)] and got[4] == [(None, False)]
    assert got[5][0] == (0, True) and not got[5][-1][1] and not got[6][-1][1]
    assert tiff.tiff_pages(df.limit(0), "media", ["id"]).count() == 0
    with pytest.raises(ValueError, match="rename"):
        tiff.tiff_pages(df.withColumnRenamed("other", "page"), "media", ["page"])


def test_query_is_a_round_trip(spark):
    rows = {r.doc_id: r for r in tiff.op2_tiff_pages(spark, SMALL).collect()}
    codecs = set()
    for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        raw = (d.text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64) or b"\0" * 64
        r, media = rows.pop(d.doc_id), tiff.payload_tiff(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
        found = [f.split(";")[1:3] for f in r.feature.split("|")]
        assert len(found) == r.pages == min(len(payload) // 64, 1 + len(payload) // 256 % 3)
        codecs |= {tuple(f) for f in found}
    assert not rows and codecs == {("strips", "c5"), ("strips", "c8"), ("tiles", "c8"), ("strips", "c32773")}


def test_files_of_several_pages_and_errors(spark):
    good = tiff.payload_tiff(bytes(range(256)) * 3)
    pages = list(tiff.pages_of(good))
    assert len(pages) == 1 + 12 // 4 % 3 and b"".join(p[5] for p in pages) == bytes(range(256)) * 3
    two = tiff.payload_tiff(bytes(64 * 8))
    df = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"no tiff")), (4, bytearray(two)), (4, bytearray(two))], "id long, media binary")
    got = sorted(tuple(r) for r in tiff.tiff_files(df, "media", ["id"]).select("id", "pages", F.octet_length("samples"), F.col("error").isNull()).collect())
    assert got == [(1, 1, 768, True), (2, 1, None, False), (3, 1, None, False), (4, 3, 512, True), (4, 3, 512, True)]
    assert tiff.tiff_files(df.limit(0), "media", ["id"]).count() == 0


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind", [np.float32, np.float64])
@pytest.mark.parametrize("channels", [1, 3])
def test_floating_point_predictor(order, kind, channels):
    a = np.random.default_rng(6).normal(size=(7, 5, channels)).astype(kind)
    size = a.dtype.itemsize
    planes = a.astype(a.dtype.newbyteorder(">")).view(np.uint8).reshape(7, 5 * channels, size).transpose(0, 2, 1).reshape(7, 5 * size, channels)
    raw = np.concatenate([planes[:, :1], planes[:, 1:] - planes[:, :-1]], axis=1).astype(np.uint8).tobytes()
    fields = {tiff.WIDTH: (5,), tiff.HEIGHT: (7,), tiff.BITS: (size * 8,) * channels, tiff.SAMPLES: (channels,), tiff.SAMPLE_FORMAT: (3,) * channels, tiff.PREDICTOR: (3,), tiff.ROWS_PER_STRIP: (7,), tiff.STRIP_AT: (0,), tiff.STRIP_BYTES: (len(raw),)}
    assert (tiff.read_page(raw, order, fields) == a).all()
    plain = a.astype(a.dtype.newbyteorder(order)).tobytes()
    assert (tiff.read_page(plain, order, fields | {tiff.PREDICTOR: (1,), tiff.STRIP_BYTES: (len(plain),)}) == a).all()
    with pytest.raises(ValueError, match="predictor"):
        tiff.read_page(plain, order, fields | {tiff.PREDICTOR: (2,)})


def test_empty_text_has_one_row_of_zeros():
    (page,) = list(tiff.pages_of(tiff.payload_tiff(b"\0" * 64)))
    assert page[1:3] == (64, 1) and page[5] == b"\0" * 64


def test_long_payloads_are_lzw():
    payload = np.random.default_rng(4).integers(0, 256, (303, 64)).astype(np.uint8).tobytes()  # over 4,096 codes
    (page,) = list(tiff.pages_of(tiff.payload_tiff(payload)))
    assert page[4] == tiff.LZW and page[5] == payload
    payload *= 3
    first, *others = list(tiff.pages_of(tiff.payload_tiff(payload)))
    assert {p[4] for p in (first, *others)} >= {tiff.PACKBITS} and b"".join(p[5] for p in (first, *others)) == payload


def page_fields(a, bits, raw, form=1, **more):
    h, w, c = a.shape
    return {tiff.WIDTH: (w,), tiff.HEIGHT: (h,), tiff.BITS: (bits,) * c, tiff.SAMPLES: (c,), tiff.SAMPLE_FORMAT: (form,) * c, tiff.ROWS_PER_STRIP: (h,), tiff.STRIP_AT: (0,), tiff.STRIP_BYTES: (len(raw),)} | more


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("channels,width", [(1, 13), (3, 7), (1, 16)])
def test_samples_of_less_than_a_byte(bits, channels, width):
    """Highest bits first, rows padded to bytes; plain, PackBits, and filled from the low bit."""
    a = np.random.default_rng(bits).integers(0, 1 << bits, (5, width, channels)).astype(np.uint8)
    rows = ["".join(f"{x:0{bits}b}" for x in row.reshape(-1)) for row in a]
    raw = b"".join(int(r.ljust(-(-len(r) // 8) * 8, "0"), 2).to_bytes(-(-len(r) // 8), "big") for r in rows)
    assert (tiff.read_page(raw, "<", page_fields(a, bits, raw)) == a).all()
    coded = tiff.packbits_encode(raw)
    assert (tiff.read_page(coded, ">", page_fields(a, bits, coded) | {tiff.COMPRESSION: (tiff.PACKBITS,)}) == a).all()
    turned = bytes(int(f"{b:08b}"[::-1], 2) for b in coded)
    assert (tiff.read_page(turned, "<", page_fields(a, bits, turned) | {tiff.COMPRESSION: (tiff.PACKBITS,), tiff.FILL_ORDER: (2,)}) == a).all()


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind,form", [(np.int8, 2), (np.int16, 2), (np.int32, 2), (np.uint32, 1)])
def test_signed_and_long_samples(order, kind, form):
    info = np.iinfo(kind)
    a = np.random.default_rng(4).integers(info.min, info.max, (6, 5, 2), dtype=np.int64).astype(kind)
    raw = a.astype(a.dtype.newbyteorder(order)).tobytes()
    assert (tiff.read_page(raw, order, page_fields(a, info.bits, raw, form)) == a).all()
    with np.errstate(over="ignore"):
        diff = np.concatenate([a[:, :1], a[:, 1:] - a[:, :-1]], axis=1).astype(a.dtype.newbyteorder(order)).tobytes()
    assert (tiff.read_page(diff, order, page_fields(a, info.bits, diff, form) | {tiff.PREDICTOR: (2,)}) == a).all()


def test_refused_samples():
    a = np.zeros((4, 4, 3), np.uint8)
    raw = a.tobytes()
    for more in ({tiff.PHOTOMETRIC: (tiff.YCBCR,), tiff.SUBSAMPLING: (2, 2)}, {tiff.PHOTOMETRIC: (tiff.YCBCR,)}, {tiff.SAMPLE_FORMAT: (1, 1, 2)}, {tiff.BITS: (8, 8, 16)}, {tiff.BITS: (12,) * 3}, {tiff.SAMPLE_FORMAT: (6,) * 3}, {tiff.PREDICTOR: (3,)}):
        with pytest.raises(ValueError):
            tiff.read_page(raw, "<", page_fields(a, 8, raw) | more)
    assert (tiff.read_page(raw, "<", page_fields(a, 8, raw) | {tiff.PHOTOMETRIC: (tiff.YCBCR,), tiff.SUBSAMPLING: (1, 1)}) == a).all()
