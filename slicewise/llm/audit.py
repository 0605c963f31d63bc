"""Interaction audit of text filters: what each removes alone, in every order, and what only it removes.

Five filters look at a document: A too few words, B too few different words, C too many
capitals, D a markup symbol, E a text that a smaller id has too.  The relational word
pipeline finds A and B: texts are exploded into words, words are aggregated per (document,
word), then per document for totals and distincts.  Documents without words are absent
there, so the other flags are joined from outside.  A document's failures are a set of five
bits, and one aggregation per part counts each of the 32 sets in a column of its own.  All
that is reported follows from those columns: which filter removes a document in an order is
the first of its set, and of the 120 orders a document of a set of n filters is removed by
each of them in 120 / n.

Plan: texts move once, so that both word aggregations run where the texts are, without
moving words; rows of one document from different input partitions stay apart until they
are counts, so no repeated row gathers in one task.  Everything else is a narrow row per
document, combined before it moves.  Copies of one text are counted per digest, and only
digests that stand in several rows are joined back.

Defined results: null text is the empty text; a null source is the part ``''``, as is the
empty source; a null id is no smaller id, is not preceded by any, and has no label; repeated
rows count each, and don't make each other copies, for their id is the same; of labels
repeated for an id, one with the value is enough; an empty table gives no rows; other
columns are not read, so their names can't clash.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, col, materialize

FILTERS = "ABCDE"
SYMBOLS = "[#$%&*|]"
SETS = range(1 << len(FILTERS))
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def word_totals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, total, different) of every text with words; ``key`` is a 64-bit hash that tells the texts of an id apart, ``total`` is over all rows of that id and text."""
    texts = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text")).withColumns({"key": F.xxhash64("text"), "place": F.spark_partition_id()})
    words = texts.repartition("id", "key", "place").select("id", "key", "place", F.explode_outer(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word"))
    # outer: for an inner explode the planner filters rows by the words, and finds them twice more for that
    each = words.where("word is not null").groupBy("id", "key", "place", "word").agg(F.count("*").alias("n"))
    some = each.groupBy("id", "key", "place").agg(F.sum("n").alias("total"), F.count("*").alias("different"))
    return some.groupBy("id", "key").agg(F.sum("total").alias("total"), F.max("different").alias("different"))


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", *, least_words: int = 200, different: int = 50, capitals: int = 2) -> DataFrame:
    """(id, part, rows, set): equal rows counted, and the filters that they fail as bits, A lowest."""
    text = F.coalesce(col(text_col), F.lit(""))
    many_capitals = 100 * F.regexp_count(text, F.lit("[A-Z]")) > capitals * F.length(text)
    flags = docs.select(col(id_col).alias("id"), F.coalesce(col(part_col).cast("string"), F.lit("")).alias("part"), F.md5(text).alias("content"), F.xxhash64(text).alias("key"), many_capitals.alias("c"), text.rlike(SYMBOLS).alias("d"))
    flags = materialize(flags.groupBy("id", "part", "content", "key", "c", "d").agg(F.count("*").alias("rows")), "flags")

    firsts = flags.groupBy("content").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    firsts = materialize(firsts.select(F.col("content").alias("content1"), "first"), "firsts")
    copies = flags.groupBy("id", "key").agg(F.sum("rows").alias("copies"))
    words = word_totals(docs, id_col, text_col).join(copies.toDF("id2", "key2", "copies"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")))
    words = words.select(F.col("id").alias("id3"), F.col("key").alias("key3"), F.expr("total div copies").alias("n"), "different")
    words = materialize(words, "words")

    out = flags.join(words, F.col("id").eqNullSafe(F.col("id3")) & (F.col("key") == F.col("key3")), "left").join(firsts, F.col("content") == F.col("content1"), "left")
    n, distinct = F.coalesce("n", F.lit(0)), F.coalesce("different", F.lit(0))
    fails = (n < least_words, 100 * distinct < different * n, F.col("c"), F.col("d"), F.coalesce(F.col("first") < F.col("id"), F.lit(False)))
    return out.select("id", "part", "rows", sum((F.when(x, F.lit(1 << k)).otherwise(F.lit(0)) for k, x in enumerate(fails)), F.lit(0)).alias("set"))


def set_counts(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row per part: ``rows``, ``good`` and ``toxic`` are arrays of the 32 conditional counts."""
    marks = labels.groupBy(col(id_col).alias("id4")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = failed.join(marks, F.col("id") == F.col("id4"), "left")
    of = {"rows": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counts = {f"{name}{s}": F.sum(F.when(which & (F.col("set") == s), F.col("rows")).otherwise(F.lit(0).cast("long"))) for name, which in of.items() for s in SETS}
    wide = rows.groupBy("part").agg(*[c.alias(name) for name, c in counts.items()])
    return wide.select("part", *[F.array(*[f"{name}{s}" for s in SETS]).alias(name) for name in of])


def interactions(counts: DataFrame) -> DataFrame:
    """A row per part, order and step from the counts of ``set_counts``."""
    steps = counts.withColumn("filter_order", F.explode(F.array(*[F.lit(x) for x in ORDERS]))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = lambda letters: sum((F.when(F.contains(letters, F.lit(x)), F.lit(1 << k)).otherwise(F.lit(0)) for k, x in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumn("own", bits(F.substr("filter_order", F.col("step"), F.lit(1)))).withColumn("before", bits(F.substr("filter_order", F.lit(1), F.col("step") - 1)))

    def total(name: str, which) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(SETS) - 1)), F.lit(0).cast("long"), lambda a, s: a + F.when(which(s), F.get(name, s)).otherwise(F.lit(0).cast("long")))

    fails = lambda s: s.bitwiseAND(F.col("own")) != 0
    gone = lambda s: s.bitwiseAND(F.col("before")) != 0
    shapley = F.aggregate(
        F.sequence(F.lit(0), F.lit(len(SETS) - 1)), F.lit(0).cast("long"),
        lambda a, s: a + F.when(fails(s), (F.get("rows", s) * len(ORDERS) / F.bit_count(s)).cast("long")).otherwise(F.lit(0).cast("long")),
    )
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total("rows", lambda s: ~fails(s) & ~gone(s)).alias("kept"), total("rows", lambda s: fails(s) & ~gone(s)).alias("removed"), total("rows", lambda s: fails(s) & gone(s)).alias("redundant"),
        total("rows", lambda s: s == F.col("own")).alias("unique_fails"), total("good", lambda s: fails(s) & ~gone(s)).alias("good_lost"), total("toxic", lambda s: fails(s) & ~gone(s)).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return interactions(set_counts(failures(docs), labels))


OP13_SQL = r"""
with d as materialized (select row_number() over () as r, doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as word from d),
n as (select r, count(*) as n, count(distinct word) as v from w group by r),
c as (select text, min(doc_id) as first_id from d group by text),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
f as (select d.r, d.part, coalesce(l.good, 0) as good, coalesce(l.toxic, 0) as toxic,
             unnest([{'f': 'A', 'x': coalesce(n.n, 0) < 200}, {'f': 'B', 'x': 100 * coalesce(n.v, 0) < 50 * coalesce(n.n, 0)},
                     {'f': 'C', 'x': 100 * len(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 2 * len(d.text)},
                     {'f': 'D', 'x': regexp_matches(d.text, '[#$%&*|]')}, {'f': 'E', 'x': coalesce(c.first_id < d.doc_id, false)}]) as t
      from d left join n using (r) join c on c.text = d.text left join l on l.doc_id = d.doc_id),
s as (select r, part, any_value(good) as good, any_value(toxic) as toxic, coalesce(string_agg(t.f, '' order by t.f) filter (t.x), '') as fails from f group by r, part),
k as (select part, fails, count(*) as m, sum(good) as good, sum(toxic) as toxic from s group by part, fails),
letter as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select a.x || b.x || c.x || d.x || e.x as filter_order from letter a, letter b, letter c, letter d, letter e
           where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
p as (select filter_order, step, filter_order[step] as own, left(filter_order, step - 1) as before from orders, (select unnest(range(1, 6)) as step)),
j as (select k.part, p.filter_order, p.step, p.own, k.m, k.good, k.toxic, k.fails, contains(k.fails, p.own) as mine,
             p.before <> '' and regexp_matches(k.fails, '[' || p.before || '_]') as gone from k, p),
g as (select part, filter_order, step, own, sum(case when not mine and not gone then m else 0 end) as kept, sum(case when mine and not gone then m else 0 end) as removed,
             sum(case when mine and gone then m else 0 end) as redundant, sum(case when fails = own then m else 0 end) as unique_fails,
             sum(case when mine and not gone then good else 0 end) as good_lost, sum(case when mine and not gone then toxic else 0 end) as toxic_lost
      from j group by part, filter_order, step, own)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
       cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, own) as bigint) as shapley
from g
"""
