"""Ranked lexical search by windowed bucket scoring.

Documents are cut into windows of ids of fixed width, ``WINDOW`` documents on average.
Tasks turn texts into the postings of each window they meet, for terms that some item
has; that is the index, one table.  Document frequencies, the number of documents and
their length are aggregates of it.  For scoring, the postings come window by window.  Per
window a term's impacts are computed once; for each item they are scattered into an array
of one score a slot, small enough for a core's cache, and a bitset marks the groups of 64
slots that were hit.  Only marked groups are read, cleared, and harvested into the item's
heap of its best, which a task carries from window to window.  A last pass ranks what the
tasks kept, at most ``top`` rows an item and task.

A document's postings are in one row of the index, so a window may be cut anywhere: many
rows of one id, or ids that crowd together, are scored in several steps of that
many slots, and are dealt to several tasks.  Terms that no item has are dropped by a bitmap of
bounded size; what it lets through by chance finds no item's term.  Items come to the
tasks in blocks of about ``PAIRS`` pairs of item and term, so what is broadcast has a
bound, however many items there are.  Terms are compared by 64-bit hashes, scores are
64-bit integers.

Defined results: null and empty texts have no terms, and such documents aren't counted;
rows with one id are documents of their own and may both be found; ids are whole numbers
below 2^63 - 1, and a null id comes back null, after others of its score; rows of one item
id are one item with the terms of all, also for a null item id; items without terms that
a document has get no rows; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_codes, col, materialize, partitions, pieces_of, shipped, span_hashes, text_buffer, word_spans

WINDOW = 8192  # documents of a window on average, slots of a score array: 64 KB
PAIRS = 1 << 20  # of item and term in a block
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28  # of the bitmap of terms: 32 MB at most
NO_ID = np.iinfo(np.int64).max

_APART = np.ones(256, bool)  # what is no letter or digit in ASCII; all other characters are parts of terms
_APART[48:58] = _APART[65:91] = _APART[97:123] = _APART[128:] = False


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash and the row of every term of the texts, repeats included."""
    flat, at = text_buffer(column)
    starts, stops, row = word_spans(flat, at, _APART)
    return span_hashes(byte_codes(lower=True)[flat], starts, stops), row


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term), each pair once."""

    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, "text"):
                h, row = term_hashes(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(h.view(np.int64))], names=["item", "term"])

    schema = T.StructType([T.StructField("item", items.schema[id_col].dataType), T.StructField("term", T.LongType())])
    return shipped(items).select(col(id_col).alias("item"), col(text_col).cast("string").alias("text")).mapInArrow(run, schema).distinct()


def term_bitmap(terms: DataFrame, n: int) -> np.ndarray:
    """The low bits of each term's hash, marked in a bitmap of 16 bits a term and more, up to ``MOST_BITS``."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * max(n, 1) - 1).bit_length()))
    place = F.col("term").bitwiseAND(F.lit(bits - 1))
    words = terms.select((place / 64).cast("long").alias("w"), F.expr(f"shiftleft(1L, cast((term & {bits - 1}) % 64 as int))").alias("b"))
    table = words.groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[table["w"].to_numpy()] = table["b"].to_numpy()
    return out


INDEX = "window long, docs long, words long, ids array<bigint>, sizes array<bigint>, terms array<bigint>, counts array<int>, slots array<int>, tfs array<int>"


def postings(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame, size: int = WINDOW) -> DataFrame:
    """The index: per window and task a row with its documents' ids and sizes, and for each of ``terms`` there the slots (places in ``ids``) and frequencies."""
    spark = docs.sparkSession
    low, high, n = docs.agg(F.min(col(id_col)), F.max(col(id_col)), F.count(col(id_col))).first()
    low, width = low or 0, max(1, -(-((high or 0) - (low or 0) + 1) * size // max(n, 1)))
    marked = spark.sparkContext.broadcast(term_bitmap(terms, terms.count()))

    def run(batches):
        bitmap = marked.value
        mask = np.uint64(64 * len(bitmap) - 1)
        for batch in batches:
            for part in pieces_of(batch, "text"):
                h, row = term_hashes(part.column(1))
                sizes = np.bincount(row, minlength=part.num_rows)
                ids = pc.fill_null(part.column(0), NO_ID).to_numpy()
                some = np.flatnonzero(sizes)  # documents with a term
                window = np.where(ids == NO_ID, -1, (ids - low) // width)
                some = some[np.lexsort((ids[some], window[some]))]
                if not len(some):
                    continue
                of = window[some]
                first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))  # of each window's documents
                group, slot = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                group[some] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(some))))
                slot[some] = np.arange(len(some)) - first[group[some]]

                place = h & mask
                wanted = (bitmap[(place >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (place & np.uint64(63))) & np.uint64(1) == 1
                h, row = h[wanted], row[wanted]
                order = np.lexsort((slot[row], h, group[row]))
                h, g, s = h[order], group[row][order], slot[row][order]
                begins = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])) if len(h) else np.zeros(0, bool)
                posting = np.flatnonzero(begins | np.append(True, s[1:] != s[:-1])) if len(h) else np.zeros(0, np.int64)
                tf = np.diff(np.append(posting, len(h)))
                heads = np.flatnonzero(begins[posting])
                counts = np.diff(np.append(heads, len(posting)))
                edge = np.arange(len(first) + 1)
                ends = {"docs": np.append(first, len(some)), "terms": np.searchsorted(g[posting][heads], edge), "postings": np.searchsorted(g[posting], edge)}
                lists = lambda at, values, kind: pa.ListArray.from_arrays(pa.array(ends[at].astype(np.int32)), pa.array(values, kind))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(of[first]), pa.array(np.diff(ends["docs"])), pa.array(np.add.reduceat(sizes[some], first)),
                        lists("docs", ids[some], pa.int64()), lists("docs", sizes[some], pa.int64()), lists("terms", h[posting][heads].view(np.int64), pa.int64()),
                        lists("terms", counts, pa.int32()), lists("postings", s[posting], pa.int32()), lists("postings", tf, pa.int32()),
                    ],
                    names=["window", "docs", "words", "ids", "sizes", "terms", "counts", "slots", "tfs"],
                )

    return shipped(docs).select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text")).mapInArrow(run, INDEX)


class Items:
    """A block of items: their ids, the terms that they have (sorted hashes) with weights, and each item's terms as places in those."""

    def __init__(self, table: pa.Table, n_docs: int, n_words: int):
        codes = table["item"].combine_chunks().dictionary_encode(null_encoding="encode")
        item = codes.indices.to_numpy()
        self.ids = codes.dictionary
        self.n_docs, self.n_words = n_docs, n_words
        self.terms, first, term = np.unique(table["term"].to_numpy().view(np.uint64), return_index=True, return_inverse=True)
        df = table["df"].to_numpy()[first]
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        order = np.argsort(item, kind="stable")
        self.of = np.split(term[order], np.searchsorted(item[order], np.arange(1, len(self.ids)))) if len(self.ids) else []


class Scorer:
    """Scores windows, one at a time, and keeps each item's best ``top``."""

    def __init__(self, items: Items, top: int, size: int = WINDOW):
        self.items, self.top, self.size = items, top, size
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items.of]  # scores and ids
        self.buckets = np.zeros(-(-size // 64) * 64, np.int64)
        self.occupied = np.zeros(len(self.buckets) // 64, bool)

    def window(self, ids: np.ndarray, sizes: np.ndarray, term: np.ndarray, slot: np.ndarray, tf: np.ndarray) -> None:
        """``term``: hash of each posting.  At most ``size`` documents at a time go into the buckets."""
        for begin in range(0, len(ids), self.size):
            inside = (slot >= begin) & (slot < begin + self.size) if len(ids) > self.size else slice(None)
            self._step(ids[begin : begin + self.size], sizes[begin : begin + self.size], term[inside], slot[inside] - begin, tf[inside])

    def _step(self, ids, sizes, term, slot, tf) -> None:
        items = self.items
        if not len(items.terms):
            return
        place = np.searchsorted(items.terms, term)
        known = items.terms[np.minimum(place, len(items.terms) - 1)] == term
        place, slot, tf = place[known], slot[known], tf[known].astype(np.int64)
        order = np.argsort(place, kind="stable")
        place, slot, tf = place[order], slot[order], tf[order]
        m = 50 + (50 * sizes * items.n_docs) // items.n_words
        impact = items.weights[place] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[slot]))
        at = np.searchsorted(place, np.arange(len(items.terms) + 1)).tolist()
        group = slot >> 6
        for k, terms in enumerate(items.of):
            for t in terms.tolist():
                a, b = at[t], at[t + 1]
                if b > a:
                    self.buckets[slot[a:b]] += impact[a:b]  # a document has one posting of a term
                    self.occupied[group[a:b]] = True
            self._harvest(k, ids)

    def _harvest(self, k: int, ids: np.ndarray) -> None:
        hit = np.flatnonzero(self.occupied)
        found = self.buckets.reshape(-1, 64)[hit]
        scores, kept = self.best[k]
        least = max(1, int(scores[-1])) if len(scores) == self.top else 1
        i, j = np.nonzero(found >= least)
        if len(i):
            scores, kept = np.append(scores, found[i, j]), np.append(kept, ids[64 * hit[i] + j])
            order = np.lexsort((kept, -scores))[: self.top]
            self.best[k] = scores[order], kept[order]
        self.buckets.reshape(-1, 64)[hit] = 0
        self.occupied[hit] = False


def _windows(batches, size: int):
    """(ids, sizes, terms, slots, tfs) of each window from rows of the index in the order of windows; large ones in several steps."""
    held, docs, now = [], 0, None

    def joined():
        base = np.cumsum([0, *[len(x[0]) for x in held]])
        ids, sizes, terms, slots, tfs = (np.concatenate(x) for x in zip(*[(i, n, t, s + b, f) for (i, n, t, s, f), b in zip(held, base, strict=False)], strict=True))
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        return ids[order], sizes[order], terms, rank[slots], tfs

    for batch in batches:
        columns = {c: batch.column(c) for c in batch.schema.names}
        value = lambda c, r: columns[c][r].values.to_numpy()
        for r, window in enumerate(columns["window"].to_pylist()):
            own = len(columns["ids"][r].values)
            if held and (window != now or docs + own > size):
                yield joined()
                held, docs = [], 0
            held.append((value("ids", r), value("sizes", r), np.repeat(value("terms", r).view(np.uint64), value("counts", r)), value("slots", r).astype(np.int64), value("tfs", r)))
            docs, now = docs + own, window
    if held:
        yield joined()


def best_of_tasks(index: DataFrame, block: Items, kind: T.DataType, top: int, size: int = WINDOW) -> DataFrame:
    """(item, doc_id, score): for each task, every item's best documents there."""
    items = index.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        scorer = Scorer(items.value, top, size)
        for window in _windows(batches, size):
            scorer.window(*window)
        for k, (scores, ids) in enumerate(scorer.best):
            if len(ids):
                doc = pa.array(ids, mask=ids == NO_ID)
                yield pa.RecordBatch.from_arrays([items.value.ids.take(pa.array(np.full(len(ids), k))), doc, pa.array(scores)], names=["item", "doc_id", "score"])

    schema = T.StructType([T.StructField("item", kind), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    dealt = index.withColumn("deal", F.xxhash64("window", F.get("ids", F.lit(0)), "words"))  # a window of very many rows may go to several tasks
    return dealt.repartitionByRange(partitions(index.sparkSession), "window", "deal").sortWithinPartitions("window", "deal").drop("deal").mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", *, top: int = 50, size: int = WINDOW, pairs_a_block: int = PAIRS) -> DataFrame:
    """(item, rank, doc_id, score): the ``top`` best documents of every item."""
    pairs = materialize(item_terms(items, item_id, text_col), "items")
    terms = pairs.select("term").distinct()
    index = materialize(postings(docs, doc_id, text_col, terms, size), "index")
    n_docs, n_words = index.agg(F.sum("docs"), F.sum("words")).first()
    frequency = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("t")).agg(F.sum("x.counts").alias("df"))
    asked = materialize(pairs.join(frequency, F.col("term") == F.col("t")).select("item", "term", "df"), "asked")
    blocks = max(1, math.ceil(asked.count() / pairs_a_block))
    kind, found = items.schema[item_id].dataType, None
    for b in range(blocks):
        table = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item", "term").toArrow()
        some = best_of_tasks(index, Items(table, n_docs or 0, n_words or 0), kind, top, size)
        found = some if found is None else found.union(some)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item", "rank", "doc_id", "score")


def op12_windowed_search(spark, sf_dir: str) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return search(docs, items).withColumnRenamed("item", "item_id")


OP12_SQL = r"""
with t as materialized (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
q as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
s as (select cast(count(*) as bigint) as n_docs, cast(sum(len(ts)) as bigint) as n_words from t where len(ts) > 0),
p as (select r, doc_id, n, term, cast(count(*) as bigint) as tf from (select r, doc_id, cast(len(ts) as bigint) as n, unnest(ts) as term from t) where term in (select term from q) group by r, doc_id, n, term),
w as (select term, cast(floor(1000 * ln(cast(2 * s.n_docs + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w from p, s group by term, s.n_docs),
i as (select p.r, p.doc_id, p.term, w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (100 - 50 + ((50 * p.n * s.n_docs) // s.n_words)))) as x from p join w using (term), s),
k as (select q.item_id, i.r, i.doc_id, cast(sum(i.x) as bigint) as score from q join i using (term) group by q.item_id, i.r, i.doc_id having sum(i.x) > 0),
o as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from k)
select item_id, cast(rank as integer) as rank, doc_id, score from o where rank <= 50
"""
