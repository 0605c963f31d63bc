"""Small grey pictures as PNG data URIs, for previews of case inputs."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

LARGEST = 64  # pixels a side


def grey_png(pixels: np.ndarray) -> bytes:
    """An 8-bit grey PNG of rows x columns of values from 0 to 255, rounded half to even."""
    if pixels.ndim != 2 or not 1 <= min(pixels.shape) <= max(pixels.shape) <= LARGEST or not ((pixels >= 0) & (pixels <= 255)).all():
        raise ValueError(f"a picture has 1 to {LARGEST} rows and columns of values from 0 to 255")
    height, width = pixels.shape
    lines = np.zeros((height, width + 1), np.uint8)  # each line begins with its filter, none
    lines[:, 1:] = np.rint(pixels)
    head = np.array([width, height], ">u4").tobytes() + bytes([8, 0, 0, 0, 0])
    out = [b"\x89PNG\r\n\x1a\n"]
    for name, body in (("IHDR", head), ("IDAT", zlib.compress(lines.tobytes())), ("IEND", b"")):
        named = name.encode() + body
        out += [len(body).to_bytes(4, "big"), named, zlib.crc32(named).to_bytes(4, "big")]
    return b"".join(out)


@F.pandas_udf(T.StringType())
def png_uri(width: pd.Series, height: pd.Series, pixels: pd.Series) -> pd.Series:
    """``data:image/png;base64,…`` of each picture, null where there are no pixels."""

    def one(w, h, p):
        if p is None:
            return None
        return "data:image/png;base64," + base64.b64encode(grey_png(np.asarray(p, float).reshape(int(h), int(w)))).decode()

    return pd.Series([one(*x) for x in zip(width, height, pixels, strict=True)], dtype=object)
