"""What the corpus operators share: scratch tables, Arrow text buffers, word hashes.

Words are maximal runs of bytes other than ``\\x20 \\x09-\\x0D``.  They are found on
the UTF-8 bytes that Arrow delivers, so no Python string is made per word.
"""

from __future__ import annotations

import atexit
import itertools
import os
import shutil
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 512 << 10

_own_folder: list[str] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()  # of the tables of ``materialize``


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode, and an error on a cluster, whose machines share no such folder."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="corpus-scratch-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return "file://" + _own_folder[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: they go when the driver's collector finds them unused."""
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more, and the shuffles of finished steps."""
    for df in tables:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_paths.pop(df))
        place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
    sweep(tables[0].sparkSession)


def shipped(df: DataFrame) -> DataFrame:
    """``df``, once the workers of its session have this package."""
    ship(df.sparkSession)
    return df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for working columns, none of which clash with those of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        out.append(next(x for x in itertools.chain([name], (f"{name}_{i}" for i in itertools.count(1))) if x.lower() not in taken))
        taken.add(out[-1].lower())
    return out


def col(name: str):
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


# ---------------------------------------------------------------- Arrow text


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, null as empty, and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return flat, at - at[0]


def pieces_of(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES):
    """Runs of whole rows of ``batch`` with about ``limit`` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    if len(sizes) > begin:
        yield batch.slice(begin)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and row of each word, in order; rows end words, and so do the bytes marked in ``apart``."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~apart[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    first = offsets[:-1][offsets[1:] > offsets[:-1]]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    begins[first] = word[first]
    ends[last] = word[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(offsets, starts, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), wrapping."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def spread(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit numbers that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BASE, _BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
        if size > 4 * CHUNK_BYTES:  # a very long text: don't keep its tables
            big = tuple(_powers)
            _powers[0] = _powers[1] = np.ones(1, np.uint64)
            return big
    return _powers[0], _powers[1]


def byte_codes(lower: bool) -> np.ndarray:
    """A 64-bit number for each byte; with ``lower``, A-Z as a-z."""
    codes = spread(0x5EED, 256)
    if lower:
        codes[65:91] = codes[97:123]
    return codes


def span_hashes(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs values[start:stop]; equal runs have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mix((total[stops] - total[starts]) * inverse[starts] + (stops - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


_LANE = spread(0x51CE, 64)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive entries of ``words``."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + (words[i : i + n] ^ _LANE[i])
        total = total ^ (total >> np.uint64(29))
    return mix(total)
