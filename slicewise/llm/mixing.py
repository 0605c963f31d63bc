"""Mixing sources to target weights by weighted fair queueing.

Sources, sorted by code point with null last, weigh ``weights`` in turn.  They share
the total number of words by weight; a target stops at ``max_repeats`` times its
source's size and the excess goes to the others by weight.  Each document enters up to
``max_repeats`` times, shuffled anew each time by a keyed digest.  Its virtual finish
time is the words of its source up to and with it, divided by the source's target;
the mix is all entries sorted by that time, cut at the total budget.

Both running sums are made in two steps, so no source and no sort lands in one task:
sums per bucket of the shuffle key (or of virtual time), offsets over those buckets, and
a running sum within each bucket; their number follows the number of documents, about
``PER_BUCKET`` of them each, and changes no result.  Texts are read once, for their sizes.

Defined results: null text has size 0; sources and documents without words get
nothing; null sources are one source; repeated rows are told apart by a number; an
empty table gives an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, col, fresh, materialize

WEIGHTS = (5, 2, 1)
PER_BUCKET, LEAST_DIGITS = 100_000, 3


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, source, size, content and a number among equal rows."""
    text = F.coalesce(col(text_col), F.lit(""))
    rows = docs.select(
        col(id_col).alias("id"), col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("content")
    )
    return rows.withColumn("copy", F.row_number().over(W.partitionBy("id", "source", "size", "content").orderBy("id")))


def source_targets(rows: DataFrame, weights=WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """A row per source: source_size, weight, target.

    Filling by level: in ascending order of cap / weight, a source is capped if its
    share of what the capped ones before it leave is above its cap.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    table = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = table.withColumn("place", F.row_number().over(by_name)).withColumn("weight", F.get(cycle, (F.col("place") - 1) % len(weights)).cast("decimal(38,0)"))
    table = table.withColumn("cap", (max_repeats * F.col("source_size")).cast("decimal(38,0)"))
    before = W.orderBy(F.col("cap").cast("double") / F.col("weight").cast("double"), "place").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    dec = lambda c: c.cast("decimal(38,0)")
    table = table.withColumns(
        {
            "left": dec(F.sum("source_size").over(every)) - F.coalesce(dec(F.sum("cap").over(before)), dec(F.lit(0))),
            "open": dec(F.sum("weight").over(every)) - F.coalesce(dec(F.sum("weight").over(before)), dec(F.lit(0))),
        }
    )
    table = table.withColumn("capped", F.col("left").cast("double") * F.col("weight").cast("double") > F.col("cap").cast("double") * F.col("open").cast("double"))
    taken, shared = F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    rest = F.sum("source_size").over(every).cast("double") - F.coalesce(taken.cast("double"), F.lit(0.0))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight").cast("double") * rest / shared.cast("double"))
    return table.select("source", "source_size", target.alias("target"), F.sum("source_size").over(every).alias("budget"))


def fair_queue(rows: DataFrame, targets: DataFrame, max_repeats: int = 3, seed: str = "mix") -> DataFrame:
    """The mix: the columns of ``rows``, epoch, finish, begin (words before it) and taken, for taken > 0."""
    digits = max(LEAST_DIGITS, math.ceil(math.log(max(1, rows.count() / PER_BUCKET), 16)))
    time_steps = 16**digits
    t = targets.withColumnRenamed("source", "of")
    epochs = F.least(F.lit(max_repeats), F.ceil(F.col("target") / F.col("source_size")).cast("int"))
    entry = rows.where("size > 0").join(t, F.col("source").eqNullSafe(F.col("of"))).where("target > 0").drop("of")
    entry = entry.withColumn("epoch", F.explode(F.sequence(F.lit(1), epochs)))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("copy").cast("string"), F.col("epoch").cast("string")))
    entry = entry.withColumn("key", key).withColumn("bucket", F.substring("key", 1, digits))
    running = lambda w: w.rowsBetween(W.unboundedPreceding, W.currentRow)

    sums = entry.groupBy("source", "epoch", "bucket").agg(F.sum("size").alias("words"))
    offset = F.sum("words").over(running(W.partitionBy("source").orderBy("epoch", "bucket"))) - F.col("words")
    sums = sums.select(F.col("source").alias("s2"), F.col("epoch").alias("e2"), F.col("bucket").alias("b2"), offset.alias("offset"))
    same = F.col("source").eqNullSafe(F.col("s2")) & (F.col("epoch") == F.col("e2")) & (F.col("bucket") == F.col("b2"))
    within = running(W.partitionBy("source", "epoch", "bucket").orderBy("key", "size", "content"))
    queued = entry.withColumn("here", F.sum("size").over(within)).join(sums, same).withColumn("finish", (F.col("offset") + F.col("here")) / F.col("target"))
    queued = queued.withColumn("step", F.least(F.floor(F.col("finish") * time_steps), F.lit(3 * time_steps)))
    queued = materialize(queued.drop("s2", "e2", "b2", "offset", "here", "bucket"), "queue")

    steps = queued.groupBy("step").agg(F.sum("size").alias("words"))
    steps = steps.select(F.col("step").alias("step2"), (F.sum("words").over(running(W.orderBy("step"))) - F.col("words")).alias("offset"))
    steps = materialize(steps, "steps")
    last = steps.where(F.col("offset") < (targets.agg(F.max("budget")).first()[0] or 0)).agg(F.max("step2")).first()[0]
    inside = queued.where(F.col("step") <= (-1 if last is None else last))  # later steps are cut as a whole
    order = running(W.partitionBy("step").orderBy("finish", F.col("source").asc_nulls_last(), "epoch", "key", "size", "content"))
    out = inside.withColumn("here", F.sum("size").over(order)).join(steps, F.col("step") == F.col("step2"))
    out = out.withColumn("begin", F.col("offset") + F.col("here") - F.col("size"))
    out = out.withColumn("taken", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("budget") - F.col("begin"))))
    return out.where("taken > 0").select(*rows.columns, "epoch", "finish", "begin", "taken")


def taken_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """A row per row of ``docs``: id, source, size, content, copy, source_size, target, taken, times."""
    rows = materialize(sized(docs, id_col, text_col, source_col), "sizes")
    targets = materialize(source_targets(rows), "targets")
    mix = fair_queue(rows, targets, **how)
    total = mix.groupBy("id", "source", "size", "content", "copy").agg(F.sum("taken").alias("taken"), F.count("*").alias("times"))
    total = total.toDF("id2", "source2", "size2", "content2", "copy2", "taken", "times")
    same = (
        F.col("id").eqNullSafe(F.col("id2")) & F.col("source").eqNullSafe(F.col("source2")) & (F.col("size") == F.col("size2"))
        & (F.col("content") == F.col("content2")) & (F.col("copy") == F.col("copy2"))
    )
    t = targets.drop("budget").withColumnRenamed("source", "of")
    out = rows.join(total, same, "left").join(t, F.col("source").eqNullSafe(F.col("of")))
    return out.select(*rows.columns, "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("times", F.lit(0)).alias("times"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``docs`` as often as the mix takes each (a last, cut one counts whole); rows that it doesn't take go."""
    i, s, c, n = fresh(docs, "mid", "msource", "mcontent", "mtimes")
    times = taken_words(docs, id_col, text_col, source_col, **how).groupBy("id", "source", "content").agg(F.sum("times").alias("times"), F.max("copy").alias("copies"))
    times = materialize(times.where("times > 0").toDF(i, s, c, n, n + "_rows"), "times")
    same = col(id_col).eqNullSafe(col(i)) & col(source_col).eqNullSafe(col(s)) & (F.xxhash64(F.coalesce(col(text_col), F.lit(""))) == col(c))
    out = docs.join(times, same)
    if times.where(col(n + "_rows") > 1).limit(1).count():  # of equal rows one stands for all
        out = out.dropDuplicates([i, s, c])
    out = out.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), col(n))))
    return out.select(*[col(x) for x in docs.columns])


def op3_fair_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return taken_words(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP3_SQL = r"""
with d0 as (select doc_id, source, coalesce(text, '') as text,
                   cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
d as (select doc_id, source, size, row_number() over (partition by doc_id, source, size, text) as copy from d0),
s0 as (select source, cast(sum(size) as bigint) as source_size from d group by source),
s1 as (select *, row_number() over (order by source asc nulls last) as place from s0),
s2 as (select *, case (place - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 3 * source_size as cap from s1),
s3 as (select *, sum(source_size) over () as budget,
              sum(source_size) over () - coalesce(sum(cap) over (order by cast(cap as double) / weight, place rows between unbounded preceding and 1 preceding), 0) as rest,
              sum(weight) over () - coalesce(sum(weight) over (order by cast(cap as double) / weight, place rows between unbounded preceding and 1 preceding), 0) as open from s2),
s4 as (select *, cast(rest as double) * weight > cast(cap as double) * open as capped from s3),
s5 as (select *, sum(source_size) over () - coalesce(sum(cap) filter (capped) over (), 0) as shared, sum(weight) filter (not capped) over () as shares from s4),
t as (select source, source_size, cast(budget as bigint) as budget,
             case when capped then cast(cap as double) else cast(weight as double) * cast(shared as double) / cast(shares as double) end as target from s5),
e as (select d.doc_id, d.source, d.size, d.copy, t.target, t.budget, unnest(range(1, cast(least(3, ceil(t.target / t.source_size)) as bigint) + 1)) as epoch
      from d join t on d.source is not distinct from t.source where d.size > 0 and t.target > 0),
k as (select *, md5('mix|' || doc_id || '|' || copy || '|' || epoch) as key from e),
f as (select *, cast(sum(size) over (partition by source order by epoch, key, size rows unbounded preceding) as bigint) / target as finish from k),
g as (select *, sum(size) over (order by finish, source asc nulls last, epoch, key, size rows unbounded preceding) - size as start from f),
h as (select doc_id, copy, source, size, cast(sum(greatest(0, least(size, budget - start))) as bigint) as taken from g group by doc_id, copy, source, size)
select d.doc_id, d.size, t.source_size, t.target, coalesce(h.taken, 0) as taken
from d join t on d.source is not distinct from t.source
left join h on d.doc_id = h.doc_id and d.copy = h.copy and d.size = h.size and d.source is not distinct from h.source
"""
