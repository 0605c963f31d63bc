"""TIFF media columns: writing payloads as TIFF, and reading every page of TIFF bytes.

The reader walks the chain of image directories (either byte order), decodes strips or
tiles (none, LZW, deflate, PackBits), undoes predictors (horizontal differencing, and
that of floating-point samples), and gives one row per page with its samples in row
order, chunky and little-endian: whole numbers of 8, 16 or 32 bits, signed or not, of 1, 2 or
4 bits (as bytes), or floats of 16, 32 or 64; planar pages are made chunky, and bytes that are
filled from the low bit are turned.  Subsampled chroma and mixed sample formats are errors of
their page.  Each page is decoded by itself; a row is never dropped.
Files of one payload each can be read as a row per file, its pages in one.

A payload is stored as one to three pages, and its rows give the codec of the first; the
others follow in turn, so that LZW, PackBits and deflate, strips and tiles, and the walk
along the directories all stand between a text and its copy.

Defined results: null media gives one row with page null and error ``null``; media that
is no TIFF, or a page that can't be decoded, gives a row with its error; a directory
chain that loops ends with an error row (read as a file, the error of any page is the file's,
and its samples are null); an empty table gives an empty result; columns to keep are listed by the caller and come first under their own names.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, shipped

NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
# Tag numbers, and bytes and format letters of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_AT, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
FILL_ORDER, SUBSAMPLING, YCBCR = 266, 530, 6
KINDS = {  # sample format: type by bits
    1: {1: np.uint8, 2: np.uint8, 4: np.uint8, 8: np.uint8, 16: np.uint16, 32: np.uint32},
    2: {8: np.int8, 16: np.int16, 32: np.int32},
    3: {16: np.float16, 32: np.float32, 64: np.float64},
}
TURNED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
FIELD = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}


# ---------------------------------------------------------------- codecs


def packbits_encode(data: bytes) -> bytes:
    """Runs of 3 or more equal bytes as repeats, the rest as literals."""
    a = np.frombuffer(data, np.uint8)
    cut = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
    length = np.diff(np.append(cut, len(a)))
    out, literal = [], 0

    def put_literal(upto):
        for i in range(literal, upto, 128):
            part = data[i : min(i + 128, upto)]
            out.append(bytes([len(part) - 1]) + part)

    for k in np.flatnonzero(length >= 3).tolist():
        at, n = int(cut[k]), int(length[k])
        put_literal(at)
        literal = at + n
        while n:
            m = min(n, 128)
            out.append(bytes([257 - m, data[at]]) if m > 1 else bytes([0, data[at]]))
            n -= m
    put_literal(len(data))
    return b"".join(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at, n = [], 0, 0
    while at < len(data) and n < size:
        head = data[at]
        if head < 128:
            part = data[at + 1 : at + 2 + head]
            at += 2 + head
        elif head > 128:
            part = data[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            part, at = b"", at + 1
        out.append(part)
        n += len(part)
    return b"".join(out)[:size]


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first, the width growing one code early."""
    bits, n_bits, out = 0, 0, bytearray()

    def put(code, width):
        nonlocal bits, n_bits
        bits, n_bits = (bits << width) | code, n_bits + width
        while n_bits >= 8:
            n_bits -= 8
            out.append((bits >> n_bits) & 255)
        bits &= (1 << n_bits) - 1

    table, width, last = {bytes([i]): i for i in range(256)}, 9, b""
    put(256, 9)
    for i in range(len(data)):
        seen = last + data[i : i + 1]
        if seen in table:
            last = seen
            continue
        put(table[last], width)
        table[seen] = len(table) + 2
        if len(table) + 2 >= 4094:
            put(256, 12)
            table, width = {bytes([j]): j for j in range(256)}, 9
        elif len(table) + 2 > (1 << width) - 1:
            width += 1
        last = data[i : i + 1]
    if last:
        put(table[last], width)
        if len(table) + 3 > (1 << width) - 1 and width < 12:
            width += 1
    put(257, width)
    if n_bits:
        out.append((bits << (8 - n_bits)) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, last, out, n = list(first), 9, b"", [], 0
    bits, n_bits = 0, 0
    for byte in data:
        bits, n_bits = (bits << 8) | byte, n_bits + 8
        if n_bits < width:
            continue
        n_bits -= width
        code = bits >> n_bits
        bits &= (1 << n_bits) - 1
        if code == 257 or n >= size:
            break
        if code == 256:
            table, width, last = list(first), 9, b""
            continue
        if not last:
            part = table[code]
        else:
            if code > len(table):
                raise ValueError("bad LZW code")
            part = table[code] if code < len(table) else last + last[:1]
            table.append(last + part[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(part)
        n += len(part)
        last = part
    return b"".join(out)[:size]


ENCODE = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1), OLD_DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: packbits_encode}


def _decode(kind: int, data: bytes, size: int) -> bytes:
    if kind == NONE:
        out = data[:size]
    elif kind == LZW:
        out = lzw_decode(data, size)
    elif kind in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    elif kind == PACKBITS:
        out = packbits_decode(data, size)
    else:
        raise ValueError(f"compression {kind} isn't supported")
    if len(out) < size:
        raise ValueError(f"{len(out)} of {size} bytes in a strip or tile")
    return out


# ---------------------------------------------------------------- writing


def write_tiff(pages: list[dict], order: str = "<") -> bytes:
    """TIFF bytes of pages, each a dict: samples (array rows x columns x channels), and compression, predictor, rows (per strip) or tile (height, width)."""
    out, directories = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0)), []
    for page in pages:
        a = np.asarray(page["samples"])
        a = a.reshape(*a.shape[:2], -1)
        kind, diff = page.get("compression", NONE), page.get("predictor", 1)
        height, width, channels = a.shape
        bits = a.dtype.itemsize * 8
        if tile := page.get("tile"):
            blocks = [(y, x, *tile) for y in range(0, height, tile[0]) for x in range(0, width, tile[1])]
        else:
            rows = page.get("rows") or max(1, 65536 // max(1, width * channels))
            blocks = [(y, 0, min(rows, height - y), width) for y in range(0, height, rows)]
        at, sizes = [], []
        for y, x, h, w in blocks:
            part = a[y : y + h, x : x + w]
            if part.shape[:2] != (h, w):
                part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)))
            if diff == 2:
                part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
            coded = ENCODE[kind](np.ascontiguousarray(part).astype(part.dtype.newbyteorder(order)).tobytes())
            at.append(len(out))
            sizes.append(len(coded))
            out += coded + b"\0" * (len(coded) % 2)
        fields = {WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [bits] * channels), COMPRESSION: (3, [kind]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [channels]), PLANAR: (3, [1]), PREDICTOR: (3, [diff])}
        fields |= {TILE_WIDTH: (4, [tile[1]]), TILE_HEIGHT: (4, [tile[0]]), TILE_AT: (4, at), TILE_BYTES: (4, sizes)} if tile else {STRIP_AT: (4, at), ROWS_PER_STRIP: (4, [rows]), STRIP_BYTES: (4, sizes)}
        directories.append(fields)
    link = 4
    for fields in directories:
        entries = []
        for tag, (kind, values) in sorted(fields.items()):
            raw = struct.pack(f"{order}{len(values)}{FIELD[kind][1]}", *values)
            if len(raw) > 4:
                where, raw = len(out), raw + b"\0" * (len(raw) % 2)
                out += raw
                raw = struct.pack(f"{order}I", where)
            entries.append(struct.pack(f"{order}HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# ---------------------------------------------------------------- reading


def read_directories(data: bytes):
    """(byte order, fields) of each image directory in the chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack_from(f"{order}I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("the directories form a loop")
        seen.add(at)
        fields = {}
        (n,) = struct.unpack_from(f"{order}H", data, at)
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
            if kind in FIELD:
                size, letter = FIELD[kind]
                where = at + 10 + 12 * k if size * count <= 4 else struct.unpack_from(f"{order}I", data, at + 10 + 12 * k)[0]
                fields[tag] = struct.unpack_from(f"{order}{count}{letter}", data, where)
        yield order, fields
        (at,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)


def _unpacked(raw: bytes, rows: int, n: int, bits: int) -> np.ndarray:
    """Rows of n samples of less than a byte each, highest bits first; a row ends with its byte."""
    ones = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1)[:, : n * bits].reshape(rows, n, bits)
    return (ones << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)


def read_page(data: bytes, order: str, fields: dict) -> np.ndarray:
    """Samples of a page, rows x columns x channels."""
    one = lambda tag, default=None: fields[tag][0] if tag in fields else default
    width, height, channels = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    sizes_of, formats = set(fields.get(BITS, (1,))), set(fields.get(SAMPLE_FORMAT, (1,)))
    bits, form = min(sizes_of), min(formats)
    if not width or not height or len(sizes_of) != 1 or len(formats) != 1 or bits not in KINDS.get(form, {}):
        raise ValueError(f"samples of {sorted(sizes_of)} bits in formats {sorted(formats)} and {width} x {height} places aren't supported")
    if one(PHOTOMETRIC) == YCBCR and set(fields.get(SUBSAMPLING, (2, 2))) != {1}:
        raise ValueError("subsampled chroma isn't supported")
    kind = np.dtype(KINDS[form][bits]).newbyteorder(order)
    tiled = TILE_AT in fields
    h, w = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, height), height), width)
    places, sizes = fields[TILE_AT if tiled else STRIP_AT], fields[TILE_BYTES if tiled else STRIP_BYTES]
    planes, depth = (channels, 1) if one(PLANAR, 1) == 2 else (1, channels)
    across, down = -(-width // w), -(-height // h)
    if len(places) < planes * across * down:
        raise ValueError("strips or tiles are missing")
    predictor = one(PREDICTOR, 1)
    if predictor not in {1: (1, 2), 2: (1, 2), 3: (1, 3)}[form] or predictor == 2 and bits < 8:
        raise ValueError(f"predictor {predictor} isn't supported for these samples")
    out = np.zeros((height, width, channels), kind.newbyteorder("<"))
    for i in range(planes * across * down):
        plane, k = divmod(i, across * down)
        y, x = k // across * h, k % across * w
        rows = h if tiled else min(h, height - y)
        stored = data[places[i] : places[i] + sizes[i]]
        if one(FILL_ORDER, 1) == 2:
            stored = stored.translate(TURNED)
        raw = _decode(one(COMPRESSION, 1), stored, rows * -(-w * depth * bits // 8))
        if predictor == 3:  # differences of bytes, highest bytes of a row first
            turned = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, w * kind.itemsize, depth), axis=1, dtype=np.uint8)
            raw = turned.reshape(rows, kind.itemsize, w * depth).transpose(0, 2, 1).tobytes()
            part = np.frombuffer(raw, kind.newbyteorder(">")).reshape(rows, w, depth)
        elif bits < 8:
            part = _unpacked(raw, rows, w * depth, bits).reshape(rows, w, depth)
        else:
            part = np.frombuffer(raw, kind).reshape(rows, w, depth)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
        out[y : y + rows, x : x + w, plane : plane + depth] = part[: height - y, : width - x]
    return out


PAGE = [("page", T.IntegerType(), pa.int32()), ("width", T.LongType(), pa.int64()), ("height", T.LongType(), pa.int64()), ("channels", T.IntegerType(), pa.int32()), ("compression", T.IntegerType(), pa.int32()), ("samples", T.BinaryType(), pa.binary()), ("feature", T.StringType(), pa.string()), ("error", T.StringType(), pa.string())]


def feature(a: np.ndarray, fields: dict) -> str:
    """Size, codec, extremes, sum and a histogram of 8 equal steps of the samples read."""
    flat = a.reshape(-1)
    if flat.dtype.kind != "u":
        return f"{a.shape[1]}x{a.shape[0]}x{a.shape[2]};{flat.dtype.kind}{flat.dtype.itemsize * 8};{np.nanmin(flat)}..{np.nanmax(flat)}"
    steps = np.bincount(flat >> (flat.dtype.itemsize * 8 - 3), minlength=8)
    layout = "tiles" if TILE_AT in fields else "strips"
    return f"{a.shape[1]}x{a.shape[0]}x{a.shape[2]};{layout};c{fields.get(COMPRESSION, (1,))[0]};p{fields.get(PREDICTOR, (1,))[0]};{flat.min()}..{flat.max()};sum={int(flat.sum(dtype=np.uint64))};" + ",".join(map(str, steps))


def pages_of(data: bytes | None):
    """Rows of PAGE for one media value."""
    if data is None:
        yield (None, None, None, None, None, None, None, "null")
        return
    page, chain = 0, None
    try:
        chain = read_directories(data)
        for order, fields in chain:
            try:
                a = read_page(data, order, fields)
                yield (page, a.shape[1], a.shape[0], a.shape[2], fields.get(COMPRESSION, (1,))[0], a.tobytes(), feature(a, fields), None)
            except (ValueError, KeyError, struct.error, zlib.error, IndexError, ZeroDivisionError, TypeError, MemoryError) as e:
                yield (page, None, None, None, None, None, None, f"{type(e).__name__}: {e}")
            page += 1
        if not page:
            yield (None, None, None, None, None, None, None, "no directory")
    except (ValueError, struct.error) as e:
        yield (page or None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")


def tiff_pages(df: DataFrame, media_col: str, keep: list[str]) -> DataFrame:
    """A row per page of each media value: the ``keep`` columns, then page, width, height, channels, compression, samples, feature, error."""
    if clash := {c.lower() for c in keep} & {name for name, _, _ in PAGE}:
        raise ValueError(f"rename these columns first: {sorted(clash)}")

    def run(batches):
        for batch in batches:
            media = batch.column(len(keep))
            for i in range(batch.num_rows):  # a page at a time: its samples may be large
                for row in pages_of(media[i].as_py()):
                    kept = [batch.column(k).slice(i, 1) for k in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*kept, *[pa.array([v], t) for v, (_, _, t) in zip(row, PAGE, strict=True)]], names=[*keep, *[n for n, _, _ in PAGE]])

    def merged(batches):
        """``run`` in batches of some MB."""
        held, size = [], 0
        for batch in run(batches):
            held.append(batch)
            size += batch.nbytes
            if size > 4 << 20 or len(held) >= 1000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    fields = [T.StructField(c, df.schema[c].dataType) for c in keep] + [T.StructField(n, t) for n, t, _ in PAGE]
    return shipped(df).select(*[col(c) for c in keep], col(media_col)).mapInArrow(merged, T.StructType(fields))


def payload_tiff(payload: bytes) -> bytes:
    """Pages of 64 columns; their number, codecs, predictors and layouts follow from the number of rows alone."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    how = (
        {"compression": DEFLATE, "predictor": 2},
        {"compression": PACKBITS, "rows": 128},
        {"compression": DEFLATE, "tile": (256, 64)},
        {"compression": LZW, "predictor": 2},
    )
    parts = np.array_split(a, min(len(a), 1 + len(a) // 4 % 3))
    return write_tiff([{"samples": part, **how[(len(a) + k) % 4]} for k, part in enumerate(parts)])


FILE = [("pages", T.IntegerType(), pa.int32()), ("samples", T.BinaryType(), pa.binary()), ("feature", T.StringType(), pa.string()), ("error", T.StringType(), pa.string())]


def tiff_files(df: DataFrame, media_col: str, keep: list[str]) -> DataFrame:
    """A row per media value: the ``keep`` columns, then pages, samples of all pages in order, their features, and the first error."""
    if clash := {c.lower() for c in keep} & {name for name, _, _ in FILE}:
        raise ValueError(f"rename these columns first: {sorted(clash)}")

    def run(batches):
        for batch in batches:
            media, at = batch.column(len(keep)), 0
            while at < batch.num_rows:
                held, size, begin = [], 0, at
                while at < batch.num_rows and size < 4 << 20:
                    rows = list(pages_of(media[at].as_py()))
                    error = next((r[7] for r in rows if r[7]), None)
                    held.append((len(rows), None, None, error) if error else (len(rows), b"".join(r[5] for r in rows), "|".join(r[6] for r in rows), None))
                    size += sum(len(r[5] or b"") for r in rows)
                    at += 1
                kept = [batch.column(k).slice(begin, at - begin) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array([h[k] for h in held], t) for k, (_, _, t) in enumerate(FILE)]], names=[*keep, *[n for n, _, _ in FILE]])

    fields = [T.StructField(c, df.schema[c].dataType) for c in keep] + [T.StructField(n, t) for n, t, _ in FILE]
    return shipped(df).select(*[col(c) for c in keep], col(media_col)).mapInArrow(run, T.StructType(fields))


def store_payloads(df: DataFrame, payload_col: str, media_col: str) -> DataFrame:
    """``df`` with ``media_col``: the payload (a multiple of 64 bytes) as TIFF, null for null."""
    at = df.columns.index(payload_col)

    def run(batches):
        for batch in batches:
            media = [None if p is None else payload_tiff(p) for p in (x.as_py() for x in batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(media, pa.binary())], names=[*batch.schema.names, media_col])

    return shipped(df).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(media_col, T.BinaryType())]))


def op2_tiff_pages(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = F.octet_length(text)
    size = F.greatest(F.lit(64), F.ceil(n / 64) * 64).cast("int")
    rows = docs.select("doc_id", n.cast("long").alias("n_bytes"), F.rpad(text, size, F.lit(b"\0")).alias("payload"))
    stored = store_payloads(rows, "payload", "media").select(
        "doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media"
    )
    files = tiff_files(stored, "media", ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    return files.select(
        "doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -64, 64)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature", "pages",
    )
