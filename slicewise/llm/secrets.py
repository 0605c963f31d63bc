"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class.

Candidate strings are maximal runs of 20 or more characters of ``A-Za-z0-9+/_=-`` that mix
letters with two digits or more, or scramble capitals and small letters: a quarter of either
at least, changing at a third of the places (names of joined words do neither).  Within them each class (hex, base62, base64) has its own runs; a
window slides over such a run while the counts of its characters, and with them the
sum of c * log2(c), change by one character in and one out.  Windows at or above the
class's entropy that mix or scramble are joined to spans of kind ``entropy``.
Allow-listed strings (UUIDs, alphabets in order, repeated short units, names of
words joined by separators unless they are scrambled, and the caller's own list) are
suppressed, as are spans inside a span of the fixed patterns, which always stay.

Defined results: null and empty texts have no spans; equal rows have equal spans;
empty tables give empty results; offsets are code points, the end exclusive; columns other
than the id and the text aren't read, and ``redact`` gives them back as they are, so their
names can't clash.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, shipped, text_buffer

# The patterns of the contract, on UTF-8 bytes (case folding there is ASCII only).
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy")
HINTS = (b"passw", b"secret", b"token", b"api")

CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
#: class: (its runs, window, bits per character at least)
CLASSES = {"hex": (re.compile(rb"[0-9A-Fa-f]+"), 24, 3.2), "base62": (re.compile(rb"[0-9A-Za-z]+"), 20, 3.7), "base64": (re.compile(rb"[0-9A-Za-z+/_=-]+"), 20, 3.9)}
ALLOWED = (
    re.compile(rb"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(rb"(.{1,8}?)\1+.{0,7}", re.S),  # a short unit again and again
)
WORDS = (
    re.compile(rb"(?:[A-Za-z]+|[0-9]{1,8})(?:[-_/=+]+(?:[A-Za-z]+|[0-9]{1,8}))*[-_/=+]*"),  # words and short numbers with separators
    re.compile(rb"[A-Za-z]+[0-9]{1,8}|[0-9]{1,8}[A-Za-z]+"),  # a word and a number
)
ORDERED = b"0123456789abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

_BITS = [0.0, 0.0] + [c * math.log2(c) for c in range(2, 512)]


def window_entropies(run: bytes, size: int):
    """Entropy in bits per character of every window of ``size`` bytes, by incremental counts."""
    counts = [0] * 256
    total, log_size = 0.0, math.log2(size)
    for i, b in enumerate(run):
        c = counts[b]
        total += _BITS[c + 1] - _BITS[c]
        counts[b] = c + 1
        if i >= size:
            gone = run[i - size]
            c = counts[gone]
            total += _BITS[c - 1] - _BITS[c]
            counts[gone] = c - 1
        if i >= size - 1:
            yield log_size - total / size


_DIGITS, _CAPITALS, _SMALL = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_CHANGE = re.compile(rb"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])")


def _scrambled(part: bytes) -> bool:
    """Capitals and small letters a quarter each at least, and a change between them at a third of the places."""
    n = len(part)
    capitals, small = n - len(part.translate(None, _CAPITALS)), n - len(part.translate(None, _SMALL))
    return 4 * min(capitals, small) >= n and 3 * len(_CHANGE.findall(part)) >= n - 1


def _mixed(part: bytes) -> bool:
    digits = len(part) - len(part.translate(None, _DIGITS))
    return 2 <= digits < len(part) or _scrambled(part)


def _listed(part: bytes) -> bool:
    return part in ORDERED or any(a.fullmatch(part) for a in ALLOWED) or (not _scrambled(part) and any(a.fullmatch(part) for a in WORDS))


def entropy_spans(data: bytes, allow: frozenset[bytes] = frozenset()) -> list[tuple[int, int]]:
    """Byte spans of candidate strings' high-entropy windows, joined and in order."""
    found: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(data):
        text = m[0]
        if not _mixed(text) or text in allow or _listed(text):
            continue
        spans = []
        for runs, size, least in CLASSES.values():
            for r in runs.finditer(text):
                run = r[0]
                if len(run) < size or not _mixed(run) or _listed(run):
                    continue
                for i, bits in enumerate(window_entropies(run, size)):
                    if bits >= least and _mixed(run[i : i + size]):
                        spans.append((m.start() + r.start() + i, m.start() + r.start() + i + size))
        for a, b in sorted(spans):
            if found and a <= found[-1][1]:
                found[-1] = (found[-1][0], max(found[-1][1], b))
            else:
                found.append((a, b))
    return found


def byte_spans(data: bytes, allow: frozenset[bytes] = frozenset()) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all spans of UTF-8 text, in bytes, sorted."""
    out = []
    low = data.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in data:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(data)]
    base = sorted(out)
    for a, b in entropy_spans(data, allow):
        if not any(x <= a and b <= y for x, _, y in base):
            out.append((a, 3, b))
    return sorted(out)


def point_spans(data: bytes, allow: frozenset[bytes] = frozenset()) -> list[tuple[int, int, int]]:
    """``byte_spans`` in code points."""
    spans = byte_spans(data, allow)
    places, points, at = sorted({x for s, _, e in spans for x in (s, e)}), {}, (0, 0)
    for p in places:
        at = (p, at[1] + len(data[at[0] : p].decode("utf-8", "replace")))
        points[p] = at[1]
    return [(points[s], k, points[e]) for s, k, e in spans]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ()) -> DataFrame:
    """id and spans: array of (kind, start, end) by start, then kind as in KINDS."""
    listed = frozenset(a.encode() for a in allow)
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        for batch in batches:
            flat, at = text_buffer(batch.column(1))
            raw = flat.tobytes()
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in point_spans(raw[at[i] : at[i + 1]], listed)] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, arrow)], names=["id", "spans"])

    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    return shipped(rows).mapInArrow(scan, T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("spans", SPANS)]))


def redact(docs: DataFrame, text_col: str = "text", allow: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``[KIND]`` in place of every secret in its text; overlapping spans become one."""
    listed = frozenset(a.encode() for a in allow)
    place = docs.columns.index(text_col)

    def clean(data: bytes) -> bytes:
        out, at, joined = [], 0, []
        for s, k, e in byte_spans(data, listed):
            if joined and s < joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], e)
            else:
                joined.append([s, e, k])
        for s, e, k in joined:
            out += [data[at:s], b"[" + KINDS[k].upper().encode() + b"]"]
            at = e
        return b"".join([*out, data[at:]])

    def scan(batches):
        for batch in batches:
            column = batch.column(place)
            flat, at = text_buffer(column)
            raw, known = flat.tobytes(), column.is_valid().to_pylist()
            texts = [clean(raw[at[i] : at[i + 1]]) if known[i] else None for i in range(batch.num_rows)]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.binary()).cast(column.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return shipped(docs).mapInArrow(scan, docs.schema)


def op10_entropy_secrets(spark, sf_dir: str) -> DataFrame:
    spans = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.transform(F.filter("spans", lambda x: x["kind"] != "entropy"), line), ",")
    return spans.select(
        F.col("id").alias("doc_id"), *[count(k) for k in KINDS], F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans")
    )
