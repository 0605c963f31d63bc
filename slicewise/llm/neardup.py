"""Near duplicates: fast similarity sketching, banding, and exact verification.

A document's set is its distinct word shingles (64-bit hashes).  The sketch has t
coordinates.  In rounds 1..t every element goes to the bin that the round's hash
gives, with the value (round, hash); a bin keeps its least value, and filling stops
after the first round by which no bin is empty.  Rounds t + 1..2t put all elements
in one fixed bin each, so every coordinate fills however small the set is.  Two sets'
coordinates agree with probability equal to their Jaccard similarity, with the
concentration of independent sampling.

Equal sets are one class, known by 128 bits of its set, and only classes go on.  Bands of
coordinates are bucket keys.  Within a bucket nobody is paired with everybody: each member
is compared with the bucket's smallest and largest class, links are confirmed on full sets,
and components are formed.  What remains are buckets whose other members lie in different
components.  Their members go, with their full sets, in blocks of bounded size (classes
and shingles) to tasks that each verify one pair of blocks and give back only links that
join components.  A component that fills a block has blocks of its own, which are never
paired with each other, so a bucket of one component and some outliers costs the number of
its members, not its square.  A task counts the shingles that many members have by matrix
products and the rare ones by their few holders; a pair that shares several bands is left to
the first of them.

Documents come in at the end: a document is an id, so the classes of an id's texts are
joined, and a component's number is the smallest id of all its classes.

Full sets are made only for classes that share a bucket: a bitmap over hashed ids, its
size bounded, its false positives harmless, tells which texts to read again; where there are
too many ids for it, they are joined.

With t = 240 and 40 bands of 6, a pair at similarity 0.8 misses all bands with
probability 5e-6.

Defined results: null, empty and word-free texts have no shingles and are linked with
nothing; fewer words than a shingle make one shingle of all; repeated rows get equal
rows; an id on several texts is one document, which all its texts' links join, each row
with its own text's n_shingles; a null id is never linked and always kept; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_codes, col, fresh, materialize, mix, pieces_of, shipped, span_hashes, spread, text_buffer, window_hashes, word_spans
from .links import components

LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28  # of a bitmap of ids: 32 MB at most
BLOCK, BLOCK_ITEMS = 1000, 1 << 19  # documents and shingles of a block, on average
FEW = 48  # holders of a shingle up to which they are paired; above, matrix products count


def shingle_sets(part: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    flat, at = text_buffer(part)
    starts, stops, row = word_spans(flat, at)
    words = span_hashes(byte_codes(lower=True)[flat], starts, stops)
    cut = np.searchsorted(row, np.arange(len(at)))
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        own = words[a:b]
        if b - a >= k:
            out.append(np.unique(window_hashes(own, k)))
        elif b > a:
            out.append(window_hashes(own, b - a) ^ np.uint64(b - a))
        else:
            out.append(own)
    return out


class Sketcher:
    """Sketches of t coordinates."""

    def __init__(self, t: int, seed: int = 7):
        self.t = t
        self.factor = spread(seed, 2 * t) | np.uint64(1)
        self.shift = spread(seed + 1, 2 * t)

    def sketch(self, items: np.ndarray) -> np.ndarray:
        t, n = self.t, len(items)
        out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
        block = int(np.clip(1.2 * t * np.log(t) / n, 1, max(1, 60_000 // n)))
        at = 0
        while at < t:
            rounds = np.arange(at, min(at + block, t))
            h = mix(items[None, :] * self.factor[rounds, None] + self.shift[rounds, None])
            bins = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
            value = (rounds.astype(np.uint64)[:, None] << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
            np.minimum.at(out, bins.reshape(-1).astype(np.int64), value.reshape(-1))
            at = int(rounds[-1]) + 1
            if (out >> np.uint64(32)).max() < np.uint64(at):  # all bins are filled: later rounds change nothing
                return out
        empty = np.flatnonzero(out == np.iinfo(np.uint64).max)
        for i in empty:
            h = mix(items * self.factor[t + i] + self.shift[t + i])
            out[i] = (np.uint64(t + i) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)).min()
        return out

    def bands(self, sketch: np.ndarray, rows: int) -> np.ndarray:
        """A 64-bit key for each band of ``rows`` coordinates."""
        parts = sketch.reshape(-1, rows)
        key = spread(99, len(parts))
        for i in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, i])
        return key


def class_codes(sets: list[np.ndarray]) -> pa.Array:
    """128 bits of each set, the same for equal sets only."""
    a = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
    b = np.array([mix(s ^ np.uint64(0x7F4A7C159E3779B9)).sum(dtype=np.uint64) for s in sets], np.uint64)
    data = np.stack([a, b], axis=1).astype(">u8").tobytes()
    return pa.array([data[16 * i : 16 * i + 16] for i in range(len(sets))], pa.binary())


def fingerprints(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """id, n_shingles, code (128 bits of the set) and bands."""

    def run(batches):
        sketcher = Sketcher(bands * rows)
        for batch in batches:
            for part in pieces_of(batch, "text"):
                sets = shingle_sets(part.column(1), k)
                n = np.array([len(s) for s in sets], np.int64)
                keys = [sketcher.bands(sketcher.sketch(s), rows).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
                ends = np.append(0, np.cumsum([len(x) for x in keys])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), class_codes(sets), lists], names=["id", "n_shingles", "code", "bands"])

    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("code", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return shipped(docs).select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).mapInArrow(run, T.StructType(fields))


def bitmap_bits(n: int) -> int:
    """Sixteen bits an id and more, up to ``MOST_BITS``; beyond that the bitmap only lets more texts through, and joins by id settle the rest."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * max(n, 1) - 1).bit_length()))


def id_bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """Hashed ids as a bitmap: at most bits / 64 rows come to the driver."""
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select((place / 64).cast("long").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {bits}) % 64 as int))").alias("b"))
    out = np.zeros(bits // 64, np.int64)
    table = words.groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toArrow()
    out[table["w"].to_numpy()] = table["b"].to_numpy()
    return out


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, k: int, make=None, kind=None, least: int = 0, codes: bool = False) -> DataFrame:
    """(id, items), for every row of ``docs`` whose id is in ``ids``, and some others; sets of fewer than ``least`` items are left out.

    With ``codes`` the rows have the codes of their classes for ids.
    """
    n = ids.count()
    bits, joined = bitmap_bits(n), n > MOST_BITS // 4
    marked = docs.sparkSession.sparkContext.broadcast(np.full(bits // 64, -1) if joined else id_bitmap(ids, bits))
    make = make or (lambda part: [s.view(np.int64) for s in shingle_sets(part, k)])
    kind = kind or pa.int64()

    def run(batches):
        bitmap = marked.value
        for batch in batches:
            place = batch.column(2).to_numpy()
            wanted = (bitmap[place >> 6] >> (place & 63)) & 1 == 1
            if not wanted.any():
                continue
            for part in pieces_of(batch.filter(pa.array(wanted)), "text"):
                sets = make(part.column(1))
                if least:
                    keep = [r for r, s in enumerate(sets) if len(s) >= least]
                    sets, part = [sets[r] for r in keep], part.take(pa.array(keep, pa.int64()))
                ends = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind.to_pandas_dtype()), *sets]), kind))
                yield pa.RecordBatch.from_arrays([class_codes([s.view(np.uint64) for s in sets]) if codes else part.column(0), lists], names=["id", "items"])

    rows = docs.where(col(id_col).isNotNull()).select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(col(id_col)), F.lit(bits)).alias("place"))
    if joined:
        rows = rows.join(ids.select("id").distinct(), "id", "left_semi")
    item = T.LongType() if kind == pa.int64() else T.IntegerType()
    return rows.mapInArrow(run, T.StructType([T.StructField("id", T.BinaryType() if codes else docs.schema[id_col].dataType), T.StructField("items", T.ArrayType(item))]))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    out = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("sb")), "b")
    out = out.withColumn("both", F.size(F.array_intersect("sa", "sb")).cast("long"))
    return out.where(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")


def overlaps(item: np.ndarray, owner: np.ndarray, n: int, rows: int) -> np.ndarray:
    """Items in common of the sets 0..``rows`` - 1 with the sets ``n`` - columns..n - 1, where ``rows`` < n; of all sets with those after them, where rows = n.

    ``item`` and ``owner``: one entry for each item of a set.
    """
    first = rows if rows < n else 0  # column of the result that stands for this set
    out = np.zeros((rows, n - first), np.float32)
    order = np.lexsort((owner, item))
    item, owner = item[order], owner[order]
    count = np.bincount(item)
    few = count[item] <= FEW
    rare, holder = item[few], owner[few]
    for d in range(1, int(count[count <= FEW].max(initial=1))):
        k = np.flatnonzero(rare[d:] == rare[:-d])
        x, y = holder[k], holder[k + d]
        inside = (x < rows) & (y >= first)
        np.add.at(out, (x[inside], y[inside] - first), 1)
    many = np.flatnonzero(count > FEW)
    column = np.full(len(count), -1)
    for begin in range(0, len(many), 512):
        part = many[begin : begin + 512]
        column[part] = np.arange(len(part))
        here = column[item] >= 0
        held = np.zeros((n, len(part)), np.float32)
        held[owner[here], column[item[here]]] = 1
        out += held[:rows] @ held[first:].T
        column[part] = -1
    return out


def block_links(percent: int):
    """For the members of one block, or of two blocks, of a bucket: links that join different components, no more than join them."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        between = table["i"][0].as_py() != table["j"][0].as_py()
        table = table.take(pa.array(np.argsort(table["own"].to_numpy(), kind="stable"))).combine_chunks()
        lists, own = table["items"].combine_chunks(), table["own"].to_numpy()
        n = len(own)
        rows = int((own == own[0]).sum()) if between else n
        kind = table["id"].type
        found: list[tuple] = []
        if n > 1 and (rows < n or not between):
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            _, item = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            both = overlaps(item, np.repeat(np.arange(n), sizes), n, rows).astype(np.int64)
            first = rows if between else 0
            links = 100 * both >= percent * (sizes[:rows, None] + sizes[None, first:] - both)
            bands, key = table["bands"].combine_chunks().flatten().to_numpy().reshape(n, -1), table["key"][0].as_py()
            place = int(np.flatnonzero(bands[0] == key)[0])
            ids, root = table["id"].to_pylist(), table["c"].combine_chunks().dictionary_encode().indices.to_numpy().copy()
            for x in range(rows):
                y = np.flatnonzero(links[x]) + first
                y = y[(y > x) & (root[y] != root[x])]
                y = y[~(bands[y, :place] == bands[x, :place]).any(axis=1)]
                for other in y:
                    if root[other] != root[x]:
                        found.append((ids[x], ids[other]))
                        root[root == root[other]] = root[x]
        return pa.table({"a": pa.array([min(f) for f in found], kind), "b": pa.array([max(f) for f in found], kind)})

    return run


def block_pairs(rest: DataFrame) -> DataFrame:
    """(key, i, j, own, id, c): the members of mixed buckets, for each pair of blocks that theirs belongs to.

    ``rest`` is (key, id, n, c), n a set's size and c its component.  Components of a bucket
    that fill a block have blocks of their own; all others share blocks.  Two blocks of one
    component make no pair.
    """
    blocks = lambda rows, items: F.ceil(F.greatest(rows / BLOCK, items / BLOCK_ITEMS)).cast("int")
    parts = rest.groupBy("key", "c").agg(F.count("*").alias("rows"), F.sum("n").alias("items"))
    mixed = parts.groupBy("key").agg(F.min("c").alias("c_lo"), F.max("c").alias("c_hi")).where("c_lo < c_hi").select("key")
    parts = materialize(parts.join(mixed, "key").withColumn("fills", (F.col("rows") >= BLOCK) | (F.col("items") >= BLOCK_ITEMS)), "mixed")
    shared = parts.groupBy("key").agg(F.coalesce(blocks(F.sum(F.when(~F.col("fills"), F.col("rows"))), F.sum(F.when(~F.col("fills"), F.col("items")))), F.lit(0)).alias("shared"))
    own = parts.where("fills").join(shared, "key").withColumn("size", blocks(F.col("rows"), F.col("items")))
    upto = W.partitionBy("key").orderBy("c").rowsBetween(W.unboundedPreceding, W.currentRow)  # few: each fills a block
    own = own.withColumn("low", F.col("shared") + F.sum("size").over(upto) - F.col("size")).select("key", "c", "low", "size")
    total = own.groupBy("key").agg(F.sum("size").alias("more"))
    shape = materialize(shared.join(total, "key", "left").select("key", "shared", (F.col("shared") + F.coalesce("more", F.lit(0))).cast("int").alias("all")), "shape")
    own = materialize(own.select("key", "c", F.col("low").cast("int").alias("low"), "size"), "own")

    rows = rest.join(shape, "key").join(own, ["key", "c"], "left")
    place = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    rows = rows.withColumn("own", F.when(F.col("low").isNull(), place(F.col("shared"))).otherwise(F.col("low") + place(F.col("size"))))
    none = F.array().cast("array<int>")
    before = F.when(F.col("low") > 0, F.sequence(F.lit(0), F.col("low") - 1)).otherwise(none)
    after = F.when(F.col("low") + F.col("size") < F.col("all"), F.sequence(F.col("low") + F.col("size"), F.col("all") - 1)).otherwise(none)
    others = F.when(F.col("low").isNull(), F.sequence(F.lit(0), F.col("all") - 1)).otherwise(F.concat(before, after))
    rows = rows.withColumn("other", F.explode(others))
    return rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "c")


def similar_links(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """Links (a, b) between classes that leave the components that all links would make; ``reps`` is (id, n_shingles, bands, rep), id being the class and rep the smallest id of a document."""
    members = reps.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    ends = members.groupBy("key").agg(F.min(F.struct("id", "n")).alias("lo"), F.max(F.struct("id", "n")).alias("hi")).where("lo.id < hi.id")
    members = materialize(members.join(materialize(ends, "ends"), "key"), "members")  # tables on both sides, so that large partitions can be split
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    wanted = materialize(reps.join(members.select("id").distinct(), "id", "left_semi").select(F.col("rep").alias("id")).distinct(), "wanted")
    sets = materialize(full_sets(docs, wanted, id_col, text_col, k, codes=True).dropDuplicates(["id"]), "sets")  # of equal sets any

    first = members.select("id", "n", F.explode(F.array("lo", "hi")).alias("x")).where((F.col("id") != F.col("x.id")) & fits(F.col("n"), F.col("x.n")))
    compared = materialize(first.select(*pair(F.col("id"), F.col("x.id"))).distinct(), "pairs")
    links = materialize(verified(compared, sets, percent), "links")
    of = materialize(components(links), "components")

    rest = members.where((F.col("id") != F.col("lo.id")) & (F.col("id") != F.col("hi.id"))).select("key", "id", "n").distinct()
    rest = materialize(rest.join(of, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("c")), "rest")
    kinds = T.StructType([T.StructField(x, members.schema["id"].dataType) for x in "ab"])
    more = block_pairs(rest).join(sets, "id").join(reps.select("id", "bands"), "id").groupBy("key", "i", "j").applyInArrow(block_links(percent), kinds)
    return links.union(materialize(more, "more"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 5, percent: int = 80, bands: int = 40, rows: int = 6) -> DataFrame:
    """A row per document: id, n_shingles, component_id (the smallest id reachable by links), kept."""
    prints = materialize(fingerprints(docs, id_col, text_col, k, bands, rows), "prints")
    some = prints.where("n_shingles > 0 and id is not null")
    classes = materialize(some.groupBy("code").agg(F.min("id").alias("rep")), "classes")
    one = some.join(classes.toDF("code2", "rep"), (F.col("code") == F.col("code2")) & (F.col("id") == F.col("rep")))
    reps = materialize(one.select(F.col("code").alias("id"), "n_shingles", "bands", "rep").dropDuplicates(["id"]), "reps")  # equal sets have equal bands
    links = similar_links(docs, reps, id_col, text_col, k, percent)

    several = some.groupBy("id").agg(F.min("code").alias("a"), F.max("code").alias("z")).where("a < z")
    several = some.select("id", "code").join(materialize(several, "several"), "id").where("code > a").select("a", F.col("code").alias("b")).distinct()
    of = materialize(components(links.union(several)), "components")
    whole = classes.join(of, F.col("code") == F.col("id"), "left").select("code", "rep", F.coalesce("component", "code").alias("component"))
    low = materialize(whole.groupBy("component").agg(F.min("rep").alias("low")), "smallest")  # a table, so that a large component's classes can be split over tasks
    low = materialize(whole.select(F.col("code").alias("code3"), "component").join(low, "component").select("code3", "low"), "low")
    linked = some.select("id", "code").join(low, F.col("code") == F.col("code3")).groupBy(F.col("id").alias("id2")).agg(F.min("low").alias("low"))
    out = prints.join(materialize(linked, "linked"), F.col("id") == F.col("id2"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("low", "id"))
    return out.select("id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each component; rows that share a kept id all stay."""
    (i,) = fresh(docs, "gone")
    gone = near_duplicates(docs, id_col, text_col, **how).where(~F.col("kept")).select(F.col("id").alias(i)).distinct()
    return docs.join(gone, col(id_col) == col(i), "left_anti").select(*[col(c) for c in docs.columns])


def op7_fast_sketch(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, k=4).withColumnRenamed("id", "doc_id")


OP7_SQL = r"""
with w as materialized (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select distinct r, case when len(ws) >= 4 then array_to_string(ws[i : i + 3], chr(10)) else array_to_string(ws, chr(10)) end as s
      from (select r, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) as i from w where len(ws) > 0)),
n as (select r, count(*) as n from g group by r),
both_in as (select x.r as a, y.r as b, count(*) as c from g x join g y on x.s = y.s and x.r < y.r group by x.r, y.r),
link as (select a, b from both_in join n na on na.r = a join n nb on nb.r = b where 100 * c >= 80 * (na.n + nb.n - c)),
ids as (select distinct x.doc_id as a, y.doc_id as b from link join w x on x.r = link.a join w y on y.r = link.b where x.doc_id is not null and y.doc_id is not null),
edge as (select a, b from ids union select b, a from ids),
reach as (with recursive t(id, c) as (select doc_id, doc_id from w where doc_id is not null union select e.b, t.c from t join edge e on e.a = t.id and t.c < e.b) select id, min(c) as c from t group by id)
select w.doc_id, coalesce(n.n, 0) as n_shingles, reach.c as component_id, coalesce(reach.c = w.doc_id, true) as kept
from w left join n on n.r = w.r left join reach on reach.id = w.doc_id
"""
