"""Canonical JSON digests: sorted keys, no blanks, ASCII escapes, shortest floats, nulls left out.

Spark's own JSON writer keeps field order and non-ASCII text, so the encoding itself is
an Arrow-batched function over JSON text; NFC normalisation, which Spark lacks, too.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip


def _without_null(x):
    if isinstance(x, dict):
        return {k: _without_null(v) for k, v in x.items() if v is not None}
    return [_without_null(v) for v in x] if isinstance(x, list) else x


def canonical(value) -> str:
    return json.dumps(_without_null(value), sort_keys=True, separators=(",", ":"), allow_nan=False)


@F.pandas_udf(T.StringType())
def canonical_digest(texts: pd.Series) -> pd.Series:
    """SHA-256 of the canonical form of JSON text."""
    return texts.map(lambda t: None if t is None else hashlib.sha256(canonical(json.loads(t)).encode()).hexdigest())


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFC", t))


def in_nfc(text: Column) -> Column:
    """NFC of the text.  Characters below U+0300 neither combine nor decompose to others, so only texts with a later one go to Python."""
    return F.coalesce(nfc(F.when(text.rlike("[^\\x{0}-\\x{2FF}]"), text)), text)


def content_id(label: Column, text: Column) -> Column:
    """Digest of the label and text of a record as JSON with non-ASCII characters kept; both must be NFC and stripped."""
    return F.sha2(F.to_json(F.struct(label.alias("label"), text.alias("text"))).cast("binary"), 256)


def normal_text(text: Column) -> Column:
    return strip(in_nfc(text))
