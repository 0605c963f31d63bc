"""Training-order materialisation of token ids in fixed-stride binary shards.

Texts become piece ids; a document's ids are cut into sequences of ``length`` ids (the
last one padded).  Documents reserve numbers in scan order, as many as their bytes
could make sequences, so a sequence's number is known without encoding what comes
before it.  A keyed Feistel permutation over the next power of four, walked on until it
falls below the amount of numbers reserved, sends every number to its place.  Equal
ranges of places are the tasks of one shuffle, about ``task_bytes`` each; a task sorts by
place and writes shards of ``shard_bytes``, all full but its last.  A sequence's global
slot is its rank by place, so slots are exactly 0..N-1, and follow from the number of
records of each task: that table (a number per task, however many shards it wrote) is
all a reader needs.  Reading from any slot on opens the folder of its task and those
after it, and a reader resumes by its slot alone.

A record is ``stride`` bytes: valid ids (uint32), document id (int64), number within the
document (uint32), the ids (uint16, little-endian), and one line feed, which Spark's
text writer puts there; so shards are written through Spark's committer to whatever
store the path names, and a lost executor's task just runs again.

Texts are encoded once.  The counting pass reads only their sizes; the writing pass must
see the same partitions, compares sizes and ids with the first's, and stops if they
differ.  Three numbers a partition are broadcast for that.

Defined results: null and empty texts have no sequences; null ids are stored as the
smallest int64; repeated rows are separate sequences; an empty table gives no shards.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, materialize, mix, pieces_of, scratch_path, shipped, spread, text_buffer
from .pieces import CHUNK, PieceModel, default_model

HEAD = 16  # bytes of a record before its ids
NO_ID = -(2**63)
PRIME = 1_000_003
EXPECTED = 0.4  # sequences made of those reserved; for the number of tasks only


def feistel(x: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0..n-1, for an array of its members."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    low, keys = np.uint64((1 << half) - 1), spread(key, rounds)
    out = np.asarray(x, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]  # cycle walking
    return out


def sequences(batches, model: str, length: int):
    """(ids, document ids, numbers, valid counts, texts of sequences, bytes of texts) for batches of (id, text): ids is sequences x length, padded with 0."""
    pieces = PieceModel.load(model)
    for batch in batches:
        for part in pieces_of(batch, "text", CHUNK):
            flat, at = text_buffer(part.column(1))
            ids, counts = pieces.encode_flat(flat, at)
            n = -(-counts // length)
            doc = np.repeat(np.arange(len(counts)), n)
            number = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            valid = np.minimum(length, counts[doc] - number * length)
            rows = np.zeros((len(doc), length), "<u2")
            rows[np.arange(length)[None, :] < valid[:, None]] = ids
            size = np.diff(at)
            names = part.column(0).fill_null(NO_ID).to_numpy().astype(np.int64)
            yield rows, names, number, valid, doc, size


def reserved(size: np.ndarray, length: int) -> np.ndarray:
    """Sequences that a text of so many bytes can make: an id stands for a byte at least, and one blank goes before a text."""
    return np.where(size > 0, -(-(size + 1) // length), 0)


def write_shards(docs: DataFrame, path: str, *, model: str, id_col: str = "doc_id", text_col: str = "text", length: int = 512, key: int = 20, shard_bytes: int = 4 << 20, task_bytes: int = 32 << 20, stable: bool = False) -> dict:
    """Write all sequences of ``docs`` under ``path``; gives the manifest, which stands there as JSON too.

    ``stable`` says that ``docs`` is a plain scan, whose partitions are the same each time;
    otherwise it is stored first.
    """
    if PieceModel.load(model).n_pieces > 65536:
        raise ValueError("ids don't fit 16 bits")
    spark = docs.sparkSession
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    rows = rows if stable else materialize(rows, "texts")
    stride = HEAD + 2 * length + 1

    size = F.octet_length(F.coalesce("text", F.lit("")))
    most = F.when(size > 0, F.ceil((size + 1) / length)).otherwise(F.lit(0))
    check = F.sum(F.pmod(F.coalesce("id", F.lit(NO_ID)), F.lit(PRIME)) + size)
    parts = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.sum(most).cast("long").alias("n"), check.cast("long").alias("check")).toArrow().sort_by("part")
    known, n_of, check_of = (parts[c].to_numpy() for c in ("part", "n", "check"))
    total = int(n_of.sum())
    first = spark.sparkContext.broadcast((known, np.cumsum(n_of) - n_of, n_of, check_of))
    per_file = max(1, shard_bytes // stride)
    tasks = max(1, round(total * EXPECTED * stride / task_bytes))
    span = -(-max(total, 1) // tasks)

    def place(batches):
        known, begins, n_of, check_of = first.value
        own = int(np.searchsorted(known, TaskContext.get().partitionId()))
        begin, n, check = (int(x[own]) for x in (begins, n_of, check_of)) if own < len(known) and known[own] == TaskContext.get().partitionId() else (0, 0, 0)
        at, got = begin, 0
        for ids, names, number, valid, doc, size in sequences(batches, model, length):
            most = reserved(size, length)
            base = at + np.cumsum(most) - most
            at += int(most.sum())
            got += int((names % PRIME).sum() + size.sum())
            slot = feistel(base[doc] + number, total, key).astype(np.int64) if len(doc) else np.zeros(0, np.int64)
            record = np.empty((len(doc), stride - 1), np.uint8)
            record[:, 0:4] = valid.astype("<u4")[:, None].view(np.uint8)
            record[:, 4:12] = names[doc].astype("<i8")[:, None].view(np.uint8)
            record[:, 12:16] = number.astype("<u4")[:, None].view(np.uint8)
            record[:, HEAD:] = ids.view(np.uint8)
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(stride - 1), len(doc), [None, pa.py_buffer(record)])
            yield pa.RecordBatch.from_arrays([pa.array(slot), flat.cast(pa.binary())], names=["place", "record"])
        if at - begin != n or got != check:
            raise RuntimeError("a partition differs from its first reading: the input isn't stable")

    if total:
        placed = shipped(rows).mapInArrow(place, "place long, record binary").withColumn("task", (F.col("place") / span).cast("int"))
        placed = placed.repartitionById(tasks, F.col("task")).sortWithinPartitions("task", "place").select("task", F.col("record").cast("string").alias("value"))
        placed.write.partitionBy("task").option("compression", "none").option("maxRecordsPerFile", per_file).text(path + "/data")
        counts = _files(spark, path).groupBy("task").agg((F.sum("length") / stride).cast("long").alias("records"))
    else:
        counts = spark.createDataFrame([], "task int, records long")
    counts.coalesce(1).write.parquet(path + "/tasks")
    manifest = {"sequences": int(_tasks(spark, path)[1].sum()), "length": length, "stride": stride, "per_file": per_file, "key": key, "dtype": "<u2"}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(path + "/manifest")
    return manifest


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The shards: path, length, content, task (a folder) and place in its task's row of files."""
    files = spark.read.format("binaryFile").load(path + "/data").where("length > 0")
    return files.withColumn("file", F.regexp_extract("path", r"\.c(\d+)\.[^/]*$", 1).cast("int"))


def _tasks(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Tasks that wrote records, in order, and how many."""
    table = spark.read.schema("task int, records long").parquet(path + "/tasks").toArrow().sort_by("task")
    return table["task"].to_numpy(), table["records"].to_numpy()


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path + "/manifest").first()[0])


def parse_records(data: bytes, manifest: dict, skip: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, numbers, valid counts, ids) of a shard's records from the ``skip``-th on."""
    a = np.frombuffer(data, np.uint8)[skip * manifest["stride"] :].reshape(-1, manifest["stride"])
    field = lambda b, e, kind: np.ascontiguousarray(a[:, b:e]).view(kind)
    return field(4, 12, "<i8")[:, 0], field(12, 16, "<u4")[:, 0], field(0, 4, "<u4")[:, 0], field(HEAD, manifest["stride"] - 1, manifest["dtype"])


def read_shards(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """doc_id, number, slot, n_tokens, shard, offset (of the record in its shard) and ids (bytes of the valid ones, uint16), from slot ``start`` on; folders of tasks before it aren't opened."""
    manifest = read_manifest(spark, path)
    schema = "doc_id long, number int, slot long, n_tokens int, shard long, offset long, ids binary"
    if start >= manifest["sequences"]:
        return spark.createDataFrame([], schema)
    tasks, records = _tasks(spark, path)
    per_file, stride = manifest["per_file"], manifest["stride"]
    first, shards = np.append(0, np.cumsum(records)), np.append(0, np.cumsum(-(-records // per_file)))
    opened = int(tasks[np.searchsorted(first, start, side="right") - 1])
    files = _files(spark, path).where(F.col("task") >= opened).select("task", "file", "content")
    places = spark.sparkContext.broadcast((tasks, first, shards))

    def run(batches):
        tasks, first, shards = places.value
        for batch in batches:
            for task, file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = int(np.searchsorted(tasks, task))
                begin, size = int(first[own]) + file * per_file, len(data.as_buffer()) // stride
                skip = min(size, max(0, start - begin))
                names, number, valid, ids = parse_records(data.as_buffer(), manifest, skip)
                place = np.arange(skip, size)
                inside = np.arange(manifest["length"])[None, :] < valid[:, None]
                bytes_of = pa.Array.from_buffers(pa.binary(), len(valid), [None, pa.py_buffer(np.append(0, 2 * np.cumsum(valid)).astype(np.int32)), pa.py_buffer(ids[inside])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names), pa.array(number.astype(np.int32)), pa.array(begin + place), pa.array(valid.astype(np.int32)), pa.array(np.full(len(names), shards[own] + file)), pa.array(place * stride), bytes_of],
                    names=["doc_id", "number", "slot", "n_tokens", "shard", "offset", "ids"],
                )

    out = shipped(files).mapInArrow(run, schema)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op1_feistel_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch_path(spark, "shards")
    write_shards(docs, path, model=default_model(), stable=True)
    return read_shards(spark, path).select("doc_id", "number", "slot", "n_tokens", "shard", "offset", F.sha2("ids", 256).alias("ids_sha256"))
