"""Language-model scores by deleted interpolation.

A text's tokens are its words, A-Z as a-z, and one end.  The model is

    P(w | v) = l2 c(v w) / c(v)  +  l1 c(w) / N  +  l0 / (V + 1)

with maximum-likelihood estimates of two and of one word, uniform mass for what was never
seen, and weights l that depend on how often the context v was seen: one triple for each
power of two of c(v), one pair where v is new.  The weights come from expectation
maximisation on held-out counts: a sixteenth of the training documents is deleted, the
estimates are made from the rest, and the deleted documents' counts tell how far each can be
trusted.  The scores then use the counts of all training documents.  A start, which is no
token, stands before the first word; all documents that are learnt from count as its
occurrences.

Plan: no table of n-grams is collected or broadcast.  Texts become blocks of about
``BLOCK`` tokens once: a dictionary of word hashes and a code a token, compressed.  Every
block asks for the counts of its different words and pairs of words, in sorted runs of
hashes, a run for each range of hashes; the task of a range adds up the blocks' own counts
and answers each block in the order it asked.  Blocks and answers meet by block, and all that
a token needs is there.  What moves is about a hash for each different pair of a block, and
a word in every text is one entry a block.  Expectation maximisation aggregates a table of
the deleted documents' counts; only the weights of at most 64 buckets come to the driver.

Words and pairs are compared by 64-bit hashes.

Defined results: null and empty texts have one token, the end; a null id is learnt from and
is not held out; repeated rows count each and get equal scores; with nothing to learn from N
is 0 and all tokens are new; without deleted documents the weights are equal; an empty table
gives no rows; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_codes, col, materialize, mix, partitions, pieces_of, shipped, span_hashes, spread, text_buffer, word_spans

BLOCK = 1 << 19  # tokens of a block, one document at least
RANGE = 1 << 22  # tokens of all blocks for each range of hashes, where the session's partitions are fewer
KEPT, DELETED, HELD_OUT = 0, 1, 2  # kinds of documents
START, END = (int(x) for x in spread(0xE4D, 2))
TOLERANCE, MOST_ROUNDS = 1e-3, 30  # of expectation maximisation


# ---------------------------------------------------------------- compressed arrays


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, compressed."""
    size = values.dtype.itemsize
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, size).T)
    return np.int64(len(values)).tobytes() + bytes([size]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n, size = int(np.frombuffer(data[:8], np.int64)[0]), data[8]
    if not n:
        return np.zeros(0, f"u{size}")
    planes = np.frombuffer(pa.decompress(data[9:], decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(f"u{size}").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    return pack(values.astype(np.min_scalar_type(int(values.max(initial=0)))))


# ---------------------------------------------------------------- blocks


class Block:
    """Tokens of whole documents."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        """``words``: hashes of all words; ``lengths``: words of each document."""
        size = len(words) + len(lengths)
        last = np.cumsum(lengths + 1) - 1
        inner = np.ones(size, bool)
        inner[last] = False
        tokens = np.full(size, END, np.uint64)
        tokens[inner] = words
        self.lengths = lengths
        self.terms, codes = np.unique(tokens, return_inverse=True)
        self.codes = codes.astype(np.uint32)

    @classmethod
    def read(cls, terms: bytes, codes: bytes, lengths: np.ndarray) -> Block:
        out = cls.__new__(cls)
        out.terms, out.codes, out.lengths = unpack_sorted(terms), unpack(codes), lengths
        return out

    def starts(self) -> np.ndarray:
        return np.cumsum(self.lengths + 1) - (self.lengths + 1)

    def pairs(self) -> np.ndarray:
        """A hash of every token with the one before it."""
        tokens = self.terms[self.codes]
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.starts()] = START
        return mix(mix(before ^ np.uint64(0x2545F4914F6CDD1D)) + tokens * np.uint64(0x9E3779B97F4A7C15))


BLOCKS = "block long, kind int, tokens long, lengths array<int>, terms binary, codes binary"


def blocks(docs: DataFrame, id_col: str, text_col: str, kind) -> DataFrame:
    """Documents as blocks, those of a kind together: the columns of ``BLOCKS`` and ids."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        open_ = {k: ([], [], []) for k in (KEPT, DELETED, HELD_OUT)}

        def row(k):
            nonlocal number
            ids, lengths, words = open_[k]
            block = Block(np.concatenate(words), np.concatenate(lengths))
            number += 1
            open_[k] = ([], [], [])
            values = pa.concat_arrays(ids)
            lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([k], pa.int32()), pa.array([len(block.codes)]), lists(pa.array(block.lengths, pa.int32())), pa.array([pack_sorted(block.terms)]), pa.array([pack(block.codes)]), lists(values)],
                names=["block", "kind", "tokens", "lengths", "terms", "codes", "ids"],
            )

        for batch in batches:
            for part in pieces_of(batch, "text"):
                flat, at = text_buffer(part.column(1))
                begin, end, of = word_spans(flat, at)
                words, kinds = span_hashes(byte_codes(lower=True)[flat], begin, end), part.column(2).to_numpy()
                lengths = np.bincount(of, minlength=part.num_rows)
                for k in np.unique(kinds).tolist():
                    own = kinds == k
                    for held, x in zip(open_[k], (part.column(0).filter(pa.array(own)), lengths[own], words[own[of]]), strict=True):
                        held.append(x)
                    if sum(len(x) for x in open_[k][2]) + sum(len(x) for x in open_[k][1]) >= BLOCK:
                        yield row(k)
        for k, held in open_.items():
            if held[0]:
                yield row(k)

    schema = T._parse_datatype_string(BLOCKS).add("ids", T.ArrayType(docs.schema[id_col].dataType))
    return shipped(docs).select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"), kind.alias("kind")).mapInArrow(run, schema)


# ---------------------------------------------------------------- counts


def counts_asked(table: DataFrame, ranges: int) -> DataFrame:
    """What each block asks of each range of hashes: its words and pairs there, sorted, with its own counts."""

    def run(batches):
        edges = np.array([-(-(r << 64) // ranges) for r in range(1, ranges)], np.uint64)
        for batch in batches:
            for r in range(batch.num_rows):
                at = {name: batch.column(k)[r] for k, name in enumerate(batch.schema.names)}
                block = Block.read(at["terms"].as_py(), at["codes"].as_py(), at["lengths"].values.to_numpy().astype(np.int64))
                pairs, n_pairs = np.unique(block.pairs(), return_counts=True)
                n_terms = np.bincount(block.codes, minlength=len(block.terms))
                cut1, cut2 = (np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]).tolist() for x in (block.terms, pairs))
                packed = [
                    (pack_sorted(block.terms[a:b]), pack_counts(n_terms[a:b]), pack_sorted(pairs[c:d]), pack_counts(n_pairs[c:d]))
                    for a, b, c, d in zip(cut1[:-1], cut1[1:], cut2[:-1], cut2[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(ranges), pa.int32()), pa.array([at["block"].as_py()] * ranges), pa.array([at["kind"].as_py()] * ranges, pa.int32()), *(pa.array(list(x), pa.binary()) for x in zip(*packed, strict=True))],
                    names=["range", "block", "kind", "terms", "n_terms", "pairs", "n_pairs"],
                )

    return table.select("block", "kind", "lengths", "terms", "codes").mapInArrow(run, "range int, block long, kind int, terms binary, n_terms binary, pairs binary, n_pairs binary")


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray], kinds: list[int]):
    """For each block its entries' counts over all training documents, and over those that were kept; and the different entries of both."""
    size = [len(x) for x in hashes]
    _, place = np.unique(np.concatenate(hashes), return_inverse=True)
    n, kind = np.concatenate(counts).astype(np.float64), np.repeat(kinds, size)
    sums = [np.bincount(place, weights=np.where(kind <= most, n, 0)).astype(np.int64) for most in (DELETED, KEPT)]
    answers = [np.split(x[place], np.cumsum(size)[:-1]) for x in sums]
    return *answers, [int((x > 0).sum()) for x in sums]


ANSWERS = "block long, range int, terms binary, pairs binary, terms_kept binary, pairs_kept binary, types long, types_kept long"


def counts_answered(asked: DataFrame) -> DataFrame:
    """A row for each that was asked, its counts in the same order, and a row of block -1 for each range with its different words."""

    def run(table: pa.Table) -> pa.Table:
        block, kinds = table["block"].to_pylist(), table["kind"].to_pylist()
        read = lambda name, f: [f(x) for x in table[name].to_pylist()]
        terms, terms_kept, types = _summed(read("terms", unpack_sorted), read("n_terms", unpack), kinds)
        pairs, pairs_kept, _ = _summed(read("pairs", unpack_sorted), read("n_pairs", unpack), kinds)
        only = lambda xs: [pack_counts(x) if k == DELETED else None for x, k in zip(xs, kinds, strict=True)]
        columns = [[*block, -1], [table["range"][0].as_py()] * (len(block) + 1)]
        columns += [[*x, None] for x in (map(pack_counts, terms), map(pack_counts, pairs), only(terms_kept), only(pairs_kept))]
        columns += [[*[0] * len(block), t] for t in types]
        kinds_of = [pa.int64(), pa.int32(), *[pa.binary()] * 4, pa.int64(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds_of, strict=True)], names=[x.split()[0] for x in ANSWERS.split(", ")])

    return asked.groupBy("range").applyInArrow(run, ANSWERS)


class Tokens:
    """All that the model needs of a block's tokens: counts of word, pair and context."""

    def __init__(self, row: pa.Table, answers: pa.Table, docs: int, kept: bool):
        """``docs``: the documents learnt from; ``kept``: by the documents that weren't deleted alone."""
        answers = answers.sort_by("range")
        whole = lambda name: np.concatenate([unpack(x).astype(np.int64) for x in answers[name].to_pylist()])
        terms, pairs = whole("terms_kept" if kept else "terms"), whole("pairs_kept" if kept else "pairs")
        block = Block.read(row["terms"][0].as_py(), row["codes"][0].as_py(), row["lengths"][0].values.to_numpy().astype(np.int64))
        self.starts = block.starts()
        self.different, self.place = np.unique(block.pairs(), return_inverse=True)
        self.word, self.pair = terms[block.codes], pairs[self.place]
        self.context = np.empty(len(block.codes), np.int64)
        self.context[1:] = self.word[:-1]
        self.context[self.starts] = docs


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a new context, else the number of binary digits of its count."""
    return np.frexp(context.astype(np.float64))[1]


# ---------------------------------------------------------------- the model


def held_out_counts(table: DataFrame, answers: DataFrame, docs: int) -> DataFrame:
    """The deleted documents' pairs: bucket, counts of pair, context and word in the documents that were kept, and how often they stand there."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["bucket", "pair", "context", "word", "n"]
        if not left.num_rows:
            return pa.table([pa.array([], pa.int64())] * 5, names=names)
        t = Tokens(left, right, docs, kept=True)
        one = np.zeros(len(t.different), np.int64)
        one[t.place] = np.arange(len(t.place))
        return pa.table([pa.array(x.astype(np.int64)) for x in (bucket(t.context[one]), t.pair[one], t.context[one], t.word[one], np.bincount(t.place))], names=names)

    some = table.where(F.col("kind") == DELETED).select("block", "lengths", "terms", "codes")
    mine = answers.where("terms_kept is not null").select("block", "range", "terms_kept", "pairs_kept")
    return some.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(run, "bucket long, pair long, context long, word long, n long")


def mixture_weights(events: DataFrame, n: int, v: int) -> np.ndarray:
    """Weights of pair, word and uniform for each of 64 buckets, by expectation maximisation with a count of one added to each share."""
    spark = events.sparkSession
    open_ = np.ones((64, 3))
    open_[0, 0] = 0  # a new context has no pairs
    weights = open_ / open_.sum(axis=1, keepdims=True)
    shares = (F.when(F.col("context") > 0, F.col("pair") / F.col("context")).otherwise(F.lit(0.0)), F.col("word") / F.lit(float(max(n, 1))), F.lit(1.0 / (v + 1)))
    rows = events.select("bucket", "n", *[s.alias(f"p{k}") for k, s in enumerate(shares)])
    for _ in range(MOST_ROUNDS):
        table = spark.createDataFrame([(b, *map(float, w)) for b, w in enumerate(weights)], "b int, w0 double, w1 double, w2 double")
        parts = [F.col(f"w{k}") * F.col(f"p{k}") for k in range(3)]
        mixed = rows.join(F.broadcast(table), F.col("bucket") == F.col("b"))
        sums = mixed.groupBy("bucket").agg(*[F.sum(F.col("n") * p / (parts[0] + parts[1] + parts[2])).alias(f"e{k}") for k, p in enumerate(parts)]).collect()
        expected = np.zeros((64, 3))
        for r in sums:
            expected[r.bucket] = r.e0, r.e1, r.e2
        expected = (expected + 1) * open_
        new = np.round(expected / expected.sum(axis=1, keepdims=True), 9)  # so that the order of a sum is nothing to a rerun
        change, weights = np.abs(new - weights).max(), new
        if change < TOLERANCE:
            break
    return weights


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, held_out=None) -> DataFrame:
    """A row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score; ``held_out``: a column, which documents not to learn from."""
    crc = F.crc32(col(id_col).cast("string"))
    held = F.coalesce(crc % 7 == 2 if held_out is None else held_out, F.lit(False))
    kind = F.when(held, HELD_OUT).when(F.coalesce(F.floor(crc / 7) % 16 == 0, F.lit(False)), DELETED).otherwise(KEPT).cast("int")
    table = materialize(blocks(docs, id_col, text_col, kind), "blocks")
    size = {r.kind: (r.tokens, r.docs) for r in table.groupBy("kind").agg(F.sum("tokens").alias("tokens"), F.sum(F.size("lengths")).alias("docs")).collect()}
    total = lambda k, *kinds: sum(size.get(x, (0, 0))[k] for x in kinds)
    ranges = max(2 * partitions(docs.sparkSession), -(-total(0, KEPT, DELETED, HELD_OUT) // RANGE))
    answers = materialize(counts_answered(counts_asked(table, ranges)), "answers")
    types = answers.where("block = -1").agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("types_kept"), F.lit(0))).first()

    events = materialize(held_out_counts(table, answers, total(1, KEPT)), "events")
    weights = mixture_weights(events, total(0, KEPT), types[1])
    n, v, learnt = total(0, KEPT, DELETED), types[0], total(1, KEPT, DELETED)
    id_type = docs.schema[id_col].dataType

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        t = Tokens(left, right, learnt, kept=False)
        w = weights[bucket(t.context)]
        p = w[:, 0] * t.pair / np.maximum(t.context, 1) + w[:, 1] * t.word / max(n, 1) + w[:, 2] / (v + 1)
        base = np.log10((t.word + 1) / (n + v + 1))
        per_doc = lambda x: pa.array(np.add.reduceat(x, t.starts))
        ids, m = left["ids"].combine_chunks().flatten(), len(t.starts)
        columns = [ids, pa.array([left["kind"][0].as_py() == HELD_OUT] * m), per_doc(np.ones(len(p), np.int64)), per_doc((t.word > 0).astype(np.int64)), pa.array(np.full(m, n, np.int64)), per_doc(base), per_doc(np.log10(p))]
        return pa.table(columns, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = T.StructType([T.StructField("id", id_type)] + T._parse_datatype_string("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields)
    mine = answers.where("block >= 0").select("block", "range", "terms", "pairs")
    return table.drop("tokens").groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(run, schema)


def op11_deleted_interpolation(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
