"""Quality rules by cross-document line frequency, in DataFrame functions only.

Every document gives its normalised lines (lower case, white space collapsed) as
64-bit hashes.  A line that stands in more than ``min_docs`` different texts of its
host, and in more than ``max_share`` of that host's different texts, is boilerplate:
it is removed, and a document that loses more than ``max_lost`` of its words by that
is rejected.  Exact copies count once, so copying a text makes none of its lines
boilerplate.  With ``count="documents"`` copies count each.

Plan: one scan makes a narrow row per document (features and line hashes), written
once; the line counts are a distinct count in two hash aggregations, the first of
which is keyed by line and text, so that a line in a third of all rows is counted by
all tasks; the join back carries only line hashes.

Defined results: null text is the empty text (no words, fails the base rules); null
hosts are one host; repeated rows get equal verdicts; an empty table gives an empty
result; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, col, fresh, materialize

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _line_key(line: Column) -> Column:
    return F.xxhash64(_words(F.lower(line)))


def base_features(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lines.

    n_repeat_words counts the words covered by 3-word windows that occur twice or more;
    windows are compared by 64-bit hashes.  Only texts with a repeated window are
    sorted by (hash, position); each step is a column of its own, for a lambda would
    evaluate an expression anew for every entry.
    """
    out = docs.select(*keep, F.coalesce(col(text), F.lit("")).alias("_t"))
    out = out.withColumns({"_w": _words(F.col("_t")), "_l": F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD))})
    out = out.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    out = out.withColumn(
        "_v",
        F.when(
            F.size("_h") >= 3,
            F.transform(F.sequence(F.lit(1), F.size("_h") - 2), lambda i: F.xxhash64(F.element_at("_h", i), F.element_at("_h", i + 1), F.element_at("_h", i + 2))),
        ).otherwise(F.expr("cast(array() as array<bigint>)")),
    )
    out = out.withColumn("_again", F.size(F.array_distinct("_v")) < F.size("_v"))
    out = out.withColumn("_s", F.when(F.col("_again"), F.sort_array(F.transform("_v", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    out = out.withColumn(
        "_p",
        F.when(
            F.col("_again"),
            F.sort_array(
                F.transform(
                    F.filter(
                        "_s",
                        lambda x, i: ((i > 0) & (F.get("_s", F.greatest(i - 1, F.lit(0)))["h"] == x["h"])) | F.coalesce(F.get("_s", i + 1)["h"] == x["h"], F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            ),
        ),
    )
    repeats = F.when(
        F.col("_again"),
        F.aggregate(F.transform("_p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x),
    ).otherwise(F.lit(0))
    out = out.select(
        *[c for c in out.columns if not c.startswith("_")],
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
        F.transform(F.transform("_l", lambda x: _words(F.lower(x))), lambda w: F.struct(F.xxhash64(w).alias("h"), F.size(w).alias("n"))).alias("lines"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def line_verdicts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *, min_docs: int = 20, max_share: float = 0.05, max_lost: float = 0.5, count: str = "texts",
) -> DataFrame:
    """A row per document: id, host, text hash, base features, lost_words, hot_lines and kept."""
    keys = [col(id_col).alias("id"), col(host_col).alias("host"), F.xxhash64(F.coalesce(col(text_col), F.lit(""))).alias("content")]
    profile = materialize(base_features(docs, text_col, keys), "lines")
    line = profile.select("id", "host", "content", F.explode("lines").alias("x")).select("id", "host", "content", "x.h", "x.n")
    counted = {"texts": F.col("content"), "documents": F.struct("id", "content")}[count]
    docs_of = profile.groupBy("host").agg(F.count_distinct(counted).alias("host_docs"))
    counts = line.groupBy("host", "h").agg(F.count_distinct(counted).alias("docs")).where(F.col("docs") > min_docs)
    hot = (
        counts.join(docs_of.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")))
        .where(F.col("docs") > max_share * F.col("host_docs"))
        .select(F.col("host").alias("hot_host"), F.col("h").alias("hot_h"))
    )
    hot = materialize(hot, "hot")  # of known size, so the planner broadcasts it where that is small and lines stay where they are
    lost = (
        line.join(hot, (F.col("h") == F.col("hot_h")) & F.col("host").eqNullSafe(F.col("hot_host")))
        .groupBy("id", "host", "content", "h").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
        .groupBy(F.col("id").alias("id2"), F.col("host").alias("host2"), F.col("content").alias("content2"))
        .agg(F.sum("n").alias("lost_all"), F.collect_list("h").alias("hot_lines"))
    )
    copies = profile.groupBy("id", "host", "content").agg(F.count("*").alias("copies")).where("copies > 1")
    same = lambda a: F.col("id").eqNullSafe(F.col(f"id{a}")) & F.col("host").eqNullSafe(F.col(f"host{a}")) & (F.col("content") == F.col(f"content{a}"))
    out = profile.drop("lines").join(lost, same("2"), "left")
    out = out.join(copies.toDF("id3", "host3", "content3", "copies"), same("3"), "left")
    out = out.withColumn("lost_words", F.coalesce(F.expr("lost_all div coalesce(copies, 1)"), F.lit(0)).cast("long"))
    kept = ~F.col("base_failed") & (F.col("lost_words") <= max_lost * F.col("n_words"))
    return out.withColumn("kept", kept).drop("lost_all", "copies", "id2", "host2", "content2", "id3", "host3", "content3")


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *, verdicts: DataFrame | None = None, **limits) -> DataFrame:
    """``docs`` without the rejected documents, and without boilerplate lines in the others.

    All columns of ``docs`` come back unchanged but for the text, from which hot lines
    are removed; a text without hot lines stays as it is (null stays null, and is rejected).
    """
    verdicts = line_verdicts(docs, id_col, text_col, host_col, **limits) if verdicts is None else verdicts
    i, h, c, hot = fresh(docs, "vid", "vhost", "vcontent", "vhot")
    good = verdicts.where("kept").select(F.col("id").alias(i), F.col("host").alias(h), F.col("content").alias(c), F.col("hot_lines").alias(hot)).dropDuplicates([i, h, c])
    out = docs.join(good, col(id_col).eqNullSafe(col(i)) & col(host_col).eqNullSafe(col(h)) & (F.xxhash64(F.coalesce(col(text_col), F.lit(""))) == col(c)))
    cleaned = F.array_join(F.filter(F.split(col(text_col), "\n"), lambda x: ~(x.rlike(WORD) & F.array_contains(col(hot), _line_key(x)))), "\n")
    text = F.when(col(hot).isNull(), col(text_col)).otherwise(cleaned)
    return out.select(*[text.alias(x) if x == text_col else col(x) for x in docs.columns])


def op8_line_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_verdicts(docs).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words"
    )


OP8_SQL = r"""
with w as (select doc_id, source, coalesce(text, '') as text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
idx as (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) as i from w),
win as (select doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] as g from idx),
grams as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from win) where n >= 2),
cover as (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from grams),
rep as (select doc_id, cast(sum(least(3, coalesce(nxt - i, 3))) as bigint) as n_repeat_words from cover group by doc_id),
line as (select doc_id, source, text, x as raw,
                regexp_extract_all(lower(x), '[^\x20\x09-\x0D]+') as ws
         from (select doc_id, source, text, unnest(string_split(text, chr(10))) as x from w)
         where regexp_matches(x, '[^\x20\x09-\x0D]')),
dup as (select doc_id, count(*) - count(distinct raw) as n_dup_lines from line group by doc_id),
host as (select source, count(distinct text) as host_docs from w group by source),
hot as (select l.source, l.ws from line l join host h on l.source is not distinct from h.source
        group by l.source, l.ws, h.host_docs having count(distinct text) > 20 and count(distinct text) > cast(0.05 as double) * h.host_docs),
lost as (select l.doc_id, sum(len(l.ws)) as lost_words from line l join hot h on l.source is not distinct from h.source and l.ws = h.ws group by l.doc_id),
f as (select w.doc_id, cast(len(w.ws) as bigint) as n_words,
             cast(length(regexp_replace(w.text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
             cast(length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
             cast(coalesce(dup.n_dup_lines, 0) as bigint) as n_dup_lines, coalesce(rep.n_repeat_words, 0) as n_repeat_words,
             cast(coalesce(lost.lost_words, 0) as bigint) as lost_words
      from w left join dup using (doc_id) left join rep using (doc_id) left join lost using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and lost_words <= cast(0.5 as double) * n_words as kept, lost_words
from f
"""
