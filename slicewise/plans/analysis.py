"""Queries on metrics, label pairs, localization, certification and incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.hashing import RANDOM_SPACE, ROOT_SPACE, bucket, joined
from ..functions.vectors import argmax, dot, log_odds, margin
from ..operators import certify, incidents, localize, metrics, pairs, ranking
from ..operators import validate as val
from ..operators.records import spread
from ..sources.scratch import stored
from . import training as tr
from . import views as v
from .base import bucket_sql, query, view

LIMITS = {"min_train": 20, "min_eval": 5, "min_recall": 0.7}
TARGETS = tr.PAIRS[0]


# ---------------------------------------------------------------- predictions of three trajectories

_draw = bucket_sql("'pred|' || t || '|' || content_id")
view("eval_rows", f"select t as trajectory_id, content_id, label as true_label, cast(split_part(label, '_src', 2) as int) as k, {_draw} as draw from parts cross join (values (0), (1), (2)) tt(t) where split = 'eval'")
view("eval_preds", "select trajectory_id, content_id, true_label, case when draw < 60 then 'group' || (k % 5) || '_src' || ((k + 10) % 20) when draw < 80 then 'group' || ((k + 1) % 5) || '_src' || ((k + 1) % 20) else true_label end as predicted_label from eval_rows")
view("recalls", "select trajectory_id, true_label as label, count(*) as support, count(*) filter (true_label = predicted_label) as hits, count(*) filter (true_label = predicted_label) / count(*) as recall from eval_preds group by 1, 2")


def eval_preds(spark, d, parts=None):
    rows = (parts or tr.parts(spark, d)).where("split = 'eval'").select("content_id", F.col("label").alias("true_label")).withColumn("trajectory_id", F.explode(F.array(*[F.lit(t) for t in range(3)])))
    k = F.substring_index("true_label", "_src", -1).cast("int")
    draw = bucket(joined("pred", F.col("trajectory_id").cast("string"), F.col("content_id")))
    name = lambda n, s: F.concat(F.lit("group"), (n % 5).cast("string"), F.lit("_src"), (s % 20).cast("string"))
    return rows.withColumn("predicted_label", F.when(draw < 60, name(k, k + 10)).when(draw < 80, name(k + 1, k + 1)).otherwise(F.col("true_label")))


def recalls(spark, d):
    return metrics.per_label_recall(eval_preds(spark, d), ["trajectory_id"])


@query("per_label_recall", "select * from recalls")
def per_label_recall(spark, d):
    return recalls(spark, d)


@query("macro_recall", "select trajectory_id, sum(hits) / sum(support) as accuracy, round(avg(recall), 9) as macro_recall from recalls group by 1")
def macro_recall(spark, d):
    return metrics.macro_recall(recalls(spark, d), ["trajectory_id"]).withColumn("macro_recall", F.round("macro_recall", 9))


_t = f"label in ('{TARGETS[0]}', '{TARGETS[1]}')"


@query("target_protected_slices", f"with m as (select trajectory_id, min(recall) as w from recalls where not {_t} group by 1) select r.trajectory_id, round(avg(recall) filter ({_t}), 9) as target_macro_recall, round(avg(recall) filter (not {_t}), 9) as protected_macro_recall, max(w) as protected_worst_recall, string_agg(case when not {_t} and recall = w then label end, ',' order by label) as protected_worst_labels from recalls r join m using (trajectory_id) group by r.trajectory_id")
def target_protected_slices(spark, d):
    out = metrics.target_protected(recalls(spark, d), ["trajectory_id"], list(TARGETS))
    return out.withColumns({c: F.round(c, 9) for c in ("target_macro_recall", "protected_macro_recall")})


@query("exact_match", "select p.release_id, count(*) filter (trim(observed) = expected) / count(*) as score, count(*) as total, count(*) filter (trim(observed) <> expected) as failed from predictions p join cases using (case_id) group by 1")
def exact_match(spark, d):
    padded = v.predictions(spark, d).withColumn("observed", F.concat(F.lit(" \t"), "observed", F.lit("\n ")))
    return metrics.exact_match(padded.join(v.cases(spark, d), "case_id"), ["release_id"])


_said = "case when draw < 300 then ' accept' when draw < 550 then 'Reject' || chr(10) when draw < 600 then 'maybe' else 'ACCEPT' end"
view("answers", f"select event_id, case when value > 50 then 'ACCEPT' else 'REJECT' end as expected, {_said} as raw from (select *, {bucket_sql(chr(39) + 'ans|' + chr(39) + ' || event_id')} as draw from events)")


def answers(spark, d):
    draw = bucket(F.concat(F.lit("ans|"), F.col("event_id").cast("string")))
    raw = F.when(draw < 300, F.lit(" accept")).when(draw < 550, F.lit("Reject\n")).when(draw < 600, F.lit("maybe")).otherwise(F.lit("ACCEPT"))
    return v.table(spark, d, "events").select("event_id", F.when(F.col("value") > 50, F.lit("ACCEPT")).otherwise(F.lit("REJECT")).alias("expected"), raw.alias("raw"))


@query("label_match", "select expected, count(*) filter (coalesce(case when upper(trim(raw, ' ' || chr(10))) in ('ACCEPT', 'REJECT') then upper(trim(raw, ' ' || chr(10))) end, '') = expected) / count(*) as score, count(*) as total, count(*) filter (coalesce(case when upper(trim(raw, ' ' || chr(10))) in ('ACCEPT', 'REJECT') then upper(trim(raw, ' ' || chr(10))) end, '') <> expected) as failed from answers group by 1")
def label_match(spark, d):
    rows = answers(spark, d).withColumn("observed", tx.parsed_label(F.col("raw")))
    return metrics.exact_match(rows, ["expected"])


@query("baseline_gate", "with s as (select name as split, count(*) filter (rb) / count(*) as score from graded join slice_members using (case_id) where release_id = 'baseline' group by 1) select w.split, coalesce(score, 0.0) as score, coalesce(score, 0.0) >= 0.88 as passed from (values ('all'), ('status_F'), ('urgent'), ('never')) w(split) left join s using (split)")
def baseline_gate(spark, d):
    rows = v.predictions(spark, d).where("release_id = 'baseline'").join(v.cases(spark, d), "case_id").join(v.slice_members(spark, d), "case_id")
    scores = metrics.exact_match(rows, ["name"]).select(F.col("name").alias("split"), "score")
    return metrics.baseline_gate(scores, ["all", "status_F", "urgent", "never"], 0.88)


@query("describe_stats", "select trajectory_id, round(avg(recall - 0.9), 9) + 0 as mean, round(median(recall - 0.9), 9) + 0 as median, min(recall - 0.9) as min, max(recall - 0.9) as max, round(coalesce(stddev_samp(recall - 0.9), 0), 9) as sample_stdev, count(*) filter (recall - 0.9 > 0) as positive, count(*) filter (recall - 0.9 = 0) as zero, count(*) filter (recall - 0.9 < 0) as negative from recalls group by 1")
def describe_stats(spark, d):
    rows = recalls(spark, d).withColumn("gap", F.col("recall") - F.lit(0.9))
    return metrics.describe(rows, ["trajectory_id"], "gap").withColumns({c: F.round(c, 9) + 0.0 for c in ("mean", "median", "sample_stdev")})


@query("token_percentiles", "with t as (select len(regexp_extract_all(lower(text), '[a-z0-9_]+')) as n from documents), r as (select n, row_number() over (order by n) - 1 as k, count(*) over () as c from t) select max(c) as examples, max(n) as max, max(case when k = c // 2 then n end) as p50, max(case when k = least(c - 1, cast(floor(0.95::double * c) as bigint)) then n end) as p95, max(case when k = least(c - 1, cast(floor(0.99::double * c) as bigint)) then n end) as p99 from r")
def token_percentiles(spark, d):
    rows = v.table(spark, d, "documents").select(F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))).cast("long").alias("n"))
    return metrics.nearest_rank(rows, "n", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("class_mass", "select expected as label, count(*) as count, case expected when 'ACCEPT' then 0.5::double else 2.0::double end as weight, count(*) * case expected when 'ACCEPT' then 0.5::double else 2.0::double end as mass from answers group by 1")
def class_mass(spark, d):
    return metrics.class_mass(answers(spark, d), {"ACCEPT": 0.5, "REJECT": 2.0}, "expected")


# ---------------------------------------------------------------- label pairs

view("confusion", "select true_label, predicted_label, count(*) as n from eval_preds where true_label <> predicted_label group by 1, 2")
view("label_sizes", "select s.label, s.train, s.eval, (select min(recall) from recalls r where r.label = s.label) as least, (select count(*) from eval_preds p where p.true_label = s.label) as truth from (select label, count(*) filter (split = 'train') as train, count(*) filter (split = 'eval') as eval from parts group by label) s where train > 0")
view(
    "pair_rows",
    """select a.label as label_a, b.label as label_b, a.train as train_a, b.train as train_b, a.eval as eval_a, b.eval as eval_b, least(a.least, b.least) as min_recall,
  case when split_part(a.label, '_', 1) = split_part(b.label, '_', 1) then 1 / 3 else 0.0 end as jaccard, coalesce(ab.n, 0) as a_to_b, coalesce(ba.n, 0) as b_to_a, coalesce(ab.n, 0) + coalesce(ba.n, 0) as mutual,
  0.5 * (coalesce(ab.n, 0) / a.truth + coalesce(ba.n, 0) / b.truth) as rate
from label_sizes a join label_sizes b on a.label < b.label
left join confusion ab on ab.true_label = a.label and ab.predicted_label = b.label left join confusion ba on ba.true_label = b.label and ba.predicted_label = a.label""",
)
_ok = "train_a >= 20 and train_b >= 20 and eval_a >= 5 and eval_b >= 5 and coalesce(min_recall >= 0.7, false)"
for _rule, _cond, _key in (("v1", "jaccard > 0 and a_to_b > 0 and b_to_a > 0", ""), ("v2", "jaccard > 0 and mutual > 0", ""), ("matched", "(jaccard > 0 or mutual > 0)", "min_recall desc, ")):
    view(f"ranked_{_rule}", f"select *, row_number() over (order by rate desc, mutual desc, jaccard desc, {_key}label_a, label_b) as rank from pair_rows where {_ok} and {_cond}")


def features(spark, d):
    parts = tr.parts(spark, d)
    preds = stored(eval_preds(spark, d, parts), "preds")
    return pairs.pair_features(preds, metrics.per_label_recall(preds, ["trajectory_id"]), tr.rec.partition_summary(parts))


@query("confusion_counts", "select * from confusion")
def confusion_counts(spark, d):
    return pairs.confusion_counts(eval_preds(spark, d))


@query("pair_features", "select * from pair_rows")
def pair_features(spark, d):
    return features(spark, d)


for _rule in pairs.RULES:

    def _rank(spark, d, rule=_rule):
        return pairs.rank_pairs(features(spark, d), rule, **LIMITS)

    query(f"pair_rank_{_rule}", f"select * from ranked_{_rule}")(_rank)

_gates = [("train", "train_a >= 20 and train_b >= 20"), ("eval", "eval_a >= 5 and eval_b >= 5"), ("recall", "coalesce(min_recall >= 0.7, false)"), ("lexical", "jaccard > 0"), ("both_confusions", "a_to_b > 0 and b_to_a > 0")]
_each = dict(_gates) | {"any_confusion": "mutual > 0"}


def _stages(conditions: dict, more: str = "", name: str = "stage") -> str:
    """SQL of pairs, labels and greedy capacity per stage: pairs in the order of labels, and the labels taken so far as a text."""
    rows = " union all ".join(f"select '{s}' as stage, {k} as step, label_a, label_b from pair_rows where {c}" for k, (s, c) in enumerate(conditions.items(), 1))
    names = " union all ".join(f"select '{s}' as stage, {k} as step{more.format(alone=_each.get(s))}" for k, s in enumerate(conditions, 1))
    free = "position('|' || r.label_a || '|' in g.used) = 0 and position('|' || r.label_b || '|' in g.used) = 0"
    return f"""with recursive inside as materialized (select *, row_number() over (partition by stage order by label_a, label_b) as place from ({rows})),
g(stage, place, used, n) as (select distinct stage, cast(0 as bigint), '|', cast(0 as bigint) from inside union all
  select r.stage, r.place, case when {free} then g.used || r.label_a || '|' || r.label_b || '|' else g.used end, case when {free} then g.n + 1 else g.n end from g join inside r on r.stage = g.stage and r.place = g.place + 1)
select s.stage as {name}, s.* exclude (stage), coalesce(p.pairs, 0) as pairs, coalesce(p.labels, 0) as labels, coalesce(c.capacity, 0) as capacity from ({names}) s
left join (select stage, count(*) as pairs, (select count(distinct l) from (select stage, label_a as l from inside union all select stage, label_b from inside) x where x.stage = inside.stage) as labels from inside group by stage) p on p.stage = s.stage
left join (select stage, max(n) as capacity from g group by stage) c on c.stage = s.stage"""


@query("gate_funnel", _stages({g: " and ".join(c for _, c in _gates[: k + 1]) for k, (g, _) in enumerate(_gates)}, ", (select count(*) from pair_rows where {alone}) as alone", "gate"))
def gate_funnel(spark, d):
    return pairs.gate_funnel(features(spark, d), **LIMITS)


@query("gate_counts", _stages({g: _each[g] for g in ("train", "eval", "recall", "lexical", "any_confusion", "both_confusions")}, name="gate"))
def gate_counts(spark, d):
    return pairs.gate_counts(features(spark, d), **LIMITS)


@query("gate_intersections", _stages({s: " and ".join(_each[g] for g in names) for s, names in pairs.TOGETHER.items()}))
def gate_intersections(spark, d):
    return pairs.gate_intersections(features(spark, d), **LIMITS)


view("greedy", "with recursive g(rank, used, place, label_a, label_b) as (select cast(0 as bigint), '|', cast(0 as bigint), '', '' union all select r.rank, case when position('|' || r.label_a || '|' in g.used) > 0 or position('|' || r.label_b || '|' in g.used) > 0 then g.used else g.used || r.label_a || '|' || r.label_b || '|' end, case when position('|' || r.label_a || '|' in g.used) > 0 or position('|' || r.label_b || '|' in g.used) > 0 then g.place else g.place + 1 end, r.label_a, r.label_b from g join ranked_matched r on r.rank = g.rank + 1) select min(rank) as rank, place, first(label_a order by rank) as label_a, first(label_b order by rank) as label_b from g where place > 0 group by place")


@query("greedy_pairs", "select cast(place as int) as place, label_a, label_b from greedy where place <= 5")
def greedy_pairs(spark, d):
    return pairs.greedy_disjoint(pairs.rank_pairs(features(spark, d), "matched", **LIMITS), 5)


@query("worlds", f"select cast((place - 1) // 2 as int) as world, cast((place - 1) % 2 as int) as position, label_a, label_b, (place - 1) % 2 = (('0x' || substr(sha256('{ROOT_SPACE}|world=' || ((place - 1) // 2)), 1, 16))::ubigint % 2) as is_root from greedy where place <= 4")
def worlds(spark, d):
    return pairs.matched_worlds(pairs.rank_pairs(features(spark, d), "matched", **LIMITS), worlds=2, per_world=2)


_nm = [(g, c) for g, c in _gates]
_fails = " + ".join(f"cast(not ({c}) as int)" for _, c in _nm)
_which = "case " + " ".join(f"when not ({c}) then '{g}'" for g, c in _nm) + " end"


@query("near_misses", f"select *, {_which} as failed from pair_rows where {_fails} = 1 order by jaccard desc, mutual desc, label_a, label_b limit 25")
def near_misses(spark, d):
    return pairs.near_misses(features(spark, d), **LIMITS)


# ---------------------------------------------------------------- localization on texts

view("prompts", "select cast(doc_id as varchar) as right_id, 'change_' || (doc_id % 5) as change_id, text from documents")
view("regressed_prompts", "select cast(item_id as varchar) as case_id, text from benchmark")
view("left_tokens", "select case_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) as t from regressed_prompts")
view("right_tokens", "select right_id, change_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) as t from prompts")
# a similarity above 0 needs a shared token, so pairs meet on tokens
_BEST = "select case_id, change_id, max(n / (nl + nr - n)) as best from (select case_id, right_id, change_id, nl, nr, count(*) as n from (select case_id, len(t) as nl, unnest(t) as w from left_tokens) join (select right_id, change_id, len(t) as nr, unnest(t) as w from {right}) using (w) group by all) group by 1, 2"
_SCORES = "select c.change_id, round(coalesce(sum(best), 0) / (select count(*) from regressed_prompts), 9) as score from (select distinct change_id from {right}) c left join {best} using (change_id) group by 1"
view("best_match", _BEST.format(right="right_tokens"))
view("changed_tokens", "select * from right_tokens where cast(right_id as bigint) % 3 = 0")
view("changed_match", _BEST.format(right="changed_tokens"))
view("lexical", _SCORES.format(right="right_tokens", best="best_match"))


def prompts(spark, d):
    """Every document."""
    rows = v.table(spark, d, "documents")
    return rows.select(F.col("doc_id").cast("string").alias("right_id"), F.concat(F.lit("change_"), (F.col("doc_id") % 5).cast("string")).alias("change_id"), tx.tokens(F.col("text")).alias("tokens"), "text")


def regressed_prompts(spark, d):
    """Every benchmark item."""
    return v.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("case_id"), tx.tokens(F.col("text")).alias("tokens"), "text")


@query("max_jaccard", "select * from best_match")
def max_jaccard(spark, d):
    return localize.best_similarity(regressed_prompts(spark, d), prompts(spark, d), ["case_id"], ["change_id"])


@query("lexical_overlap", "select change_id, score, row_number() over (order by score desc, change_id) as rank from lexical")
def lexical_overlap(spark, d):
    scores = localize.lexical_scores(regressed_prompts(spark, d), prompts(spark, d))
    return localize.ranked(scores.withColumn("score", F.round("score", 9)), [], "change_id")


@query("changed_lexical_overlap", _SCORES.format(right="changed_tokens", best="changed_match"))
def changed_lexical_overlap(spark, d):
    after = prompts(spark, d)
    before = after.withColumn("text", F.when(F.col("right_id").cast("long") % 3 == 0, F.lit("other")).otherwise(F.col("text")))
    changed = localize.changed_records(before, after, "right_id", "text")
    return localize.lexical_scores(regressed_prompts(spark, d), changed).withColumn("score", F.round("score", 9))


@query("observed_regressions", "select event_id, expected from answers where upper(trim(raw, ' ' || chr(10))) = expected and event_id % 4 < 2")
def observed_regressions(spark, d):
    rows = answers(spark, d).select(F.col("event_id").cast("string").alias("case_id"), F.lit("p").alias("prompt"), "expected", tx.parsed_label(F.col("raw")).alias("parsed_label"), "event_id")
    wrong = F.when(F.col("event_id") % 4 == 0, F.lit(None)).when(F.col("event_id") % 4 == 1, tx.flipped(F.col("expected"))).otherwise(F.col("parsed_label"))
    out = localize.observed_regressions(rows.drop("event_id"), rows.withColumn("parsed_label", wrong).drop("event_id"))
    return out.select(F.col("case_id").cast("long").alias("event_id"), "expected")


# ---------------------------------------------------------------- localization on worlds

@query("b0_random", f"select internal_role as world, candidate_id, cast(('0x' || substr(sha256('{RANDOM_SPACE}|' || internal_role || '|' || candidate_id), 1, 16))::ubigint as decimal(20, 0)) as score from ({tr.MANIFEST})")
def b0_random(spark, d):
    m = tr.rel.candidate_manifest(tr.world(tr.clean(spark, d))).withColumnRenamed("internal_role", "world")
    return localize.random_scores(m)


@query("b1_label_overlap", "select w.candidate, count(*) filter (c.label in ('group0_src0', 'group1_src6')) as score from world w join clean c using (slot_id) group by 1")
def b1_label_overlap(spark, d):
    base = tr.clean(spark, d)
    rows = tr.world(base).select("candidate", "slot_id").join(base.select("slot_id", "label"), "slot_id")
    return localize.label_overlap(rows, ["group0_src0", "group1_src6"])


view("plain_targets", "select case_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as t from regressed_prompts")
view("slot_tokens", "select candidate, slot_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as t from world", stored=True)
view("slot_best", "select slot_id, max(n / (nl + nr - n)) as best from (select slot_id, case_id, nl, nr, count(*) as n from (select distinct slot_id, len(t) as nl, unnest(t) as w from slot_tokens) join (select case_id, len(t) as nr, unnest(t) as w from plain_targets) using (w) group by all) group by 1")
view("b2", "select candidate, round(sum(coalesce(best, 0)), 9) as score from slot_tokens left join slot_best using (slot_id) group by 1")


def b2(spark, d):
    changes = tr.world(tr.clean(spark, d)).select("candidate", "slot_id", tx.tokens(F.col("text"), tx.PLAIN).alias("tokens"))
    targets = regressed_prompts(spark, d).select(F.col("case_id").alias("right_id"), tx.tokens(F.col("text"), tx.PLAIN).alias("tokens"))
    best = localize.best_similarity(changes.select("slot_id", "tokens"), targets, ["slot_id"]).select("slot_id", F.col("best").alias("score"))
    return localize.summed(changes.select("candidate", "slot_id"), best).withColumn("score", F.round("score", 9))


@query("b2_jaccard", "select * from b2")
def b2_jaccard(spark, d):
    return b2(spark, d)


@query("candidate_rank", "select candidate, score, row_number() over (order by score desc, candidate) as rank from b2")
def candidate_rank(spark, d):
    return localize.ranked(b2(spark, d), [], "candidate")


# scores of five candidates by three methods in three trajectories and a world for every customer, with planned ties
_score = bucket_sql("m || '|' || w || '|' || case when m = 'static' then 0 else t end || '|' || c", 8)
view("method_scores", f"select w as world, m as method, t as trajectory_id, 'c' || c as candidate, cast({_score} as double) / 4 as score from (select c_custkey as w from customer) ww cross join (values ('static'), ('grad'), ('trac')) mm(m) cross join (values (0), (1), (2)) tt(t) cross join (values (0), (1), (2), (3), (4)) cc(c)")
view("roots", "select c_custkey as world, case c_custkey % 2 when 0 then 'c2' else 'c4' end as root from customer")


def method_scores(spark, d):
    rows = spread(v.table(spark, d, "customer").select(F.col("c_custkey").alias("world")), "world")
    for name, values in (("method", ["static", "grad", "trac"]), ("trajectory_id", [0, 1, 2]), ("c", [0, 1, 2, 3, 4])):
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(x) for x in values])))
    t = F.when(F.col("method") == "static", F.lit(0)).otherwise(F.col("trajectory_id"))
    draw = bucket(F.concat_ws("|", "method", F.col("world").cast("string"), t.cast("string"), F.col("c").cast("string")), 8)
    return rows.select("world", "method", "trajectory_id", F.concat(F.lit("c"), F.col("c").cast("string")).alias("candidate"), (draw.cast("double") / 4).alias("score"))


def roots(spark, d):
    return v.table(spark, d, "customer").select(F.col("c_custkey").alias("world"), F.when(F.col("c_custkey") % 2 == 0, F.lit("c2")).otherwise(F.lit("c4")).alias("root"))


view("mean_scores", "select world, method, candidate, avg(score) as score from method_scores group by 1, 2, 3")
TIE = """select world, method, root, n as candidates, root_rank, tied as tie_size, higher + 1 as best_rank, higher + tied as worst_rank, (higher + 1 + higher + tied) / 2 as average_rank, 1 / ((higher + 1 + higher + tied) / 2) as reciprocal_rank,
  higher = 0 and tied = 1 as top_1, higher + tied <= least(3, n) as top_3
from (select s.world, s.method, r.root, count(*) as n, count(*) filter (s.score > q.score + 1e-12) as higher, count(*) filter (abs(s.score - q.score) <= 1e-12) as tied,
        count(*) filter (s.score > q.score or (s.score = q.score and s.candidate <= r.root)) as root_rank
      from mean_scores s join roots r using (world) join mean_scores q on q.world = s.world and q.method = s.method and q.candidate = r.root group by 1, 2, 3)"""
view("tie_scores", TIE)


def ties(spark, d):
    means = localize.mean_over(method_scores(spark, d), ["world", "method", "candidate"])
    return ranking.tie_aware(means, roots(spark, d).join(means.select("world", "method").distinct().hint("merge"), "world"), ["world", "method"])


@query("mean_trajectory", "select * from mean_scores")
def mean_trajectory(spark, d):
    return localize.mean_over(method_scores(spark, d), ["world", "method", "candidate"])


@query("tie_aware_score", "select * from tie_scores")
def tie_aware_score(spark, d):
    return ties(spark, d)


@query("truth_top1", "select method, count(*) filter (top_1) as top_1_worlds, count(*) as worlds, count(*) filter (top_1) / count(*) as accuracy from tie_scores group by 1")
def truth_top1(spark, d):
    return ranking.top_1_summary(ties(spark, d))


@query("chance_reference", "select n as candidates, 1 / n as top_1, least(3, n) / n as top_3, (select sum(1.0::double / i) from (select unnest(range(1, n + 1)) as i)) / n as reciprocal_rank, cast(factorial(cast(n as int)) as bigint) as permutations from (select distinct cast(count(*) as int) as n from lineitem group by l_orderkey) v")
def chance_reference(spark, d):
    """For as many candidates as orders have lines."""
    sizes = v.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("candidates")).select("candidates").distinct()
    return ranking.chance_reference(sizes)


_subsets = [("0,1,2", (0, 1, 2)), ("0", (0,)), ("1", (1,)), ("2", (2,)), ("0,1", (0, 1)), ("0,2", (0, 2)), ("1,2", (1, 2))]
_stab = " union all ".join(f"select world, method, '{name}' as subset, candidate, avg(score) as score from method_scores where trajectory_id in ({', '.join(map(str, s))}) group by 1, 2, 4" for name, s in _subsets)


@query("rank_stability", f"select world, method, subset, root_rank from (select *, row_number() over (partition by world, method, subset order by score desc, candidate) as root_rank from ({_stab})) join roots using (world) where candidate = root")
def rank_stability(spark, d):
    scores = method_scores(spark, d)
    return ranking.rank_stability(scores, roots(spark, d).join(scores.select("world", "method").distinct().hint("merge"), "world"), ["world", "method"], [0, 1, 2])


@query("static_methods", "select world, method from method_scores group by 1, 2, candidate having min(score) <> max(score)")
def static_methods(spark, d):
    return val.varying(method_scores(spark, d), ["world", "method", "candidate"], "score").select("world", "method")


# ---------------------------------------------------------------- features: whole-number vectors, so that sums are exact

view("vectors", "select vec_id, label, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 100) as bigint)) as q from embeddings")
view("vector_cells", "select vec_id, label, i, q[i] as x from (select vec_id, label, q, unnest(range(1, 65)) as i from vectors)")
view("centroid_cells", "select label, i, sum(x) as s from vector_cells group by 1, 2")
view("logit_cells", "select v.vec_id, v.label, c.label as k, cast(sum(v.x * c.s) as double) / 1000000 as z from vector_cells v join centroid_cells c using (i) group by 1, 2, 3")
view("softmaxed", "select vec_id, label, k, z, exp(z - max(z) over (partition by vec_id)) / sum(exp(z - m)) over (partition by vec_id) as p from (select *, max(z) over (partition by vec_id) as m from logit_cells)")


def vectors(spark, d):
    """vec_id, label, q (whole numbers), features (doubles) and logits against the labels' centroids."""
    rows = v.table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * 100)).alias("q"))
    table = localize.centroids(rows, "q", "label").agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("c"))  # a row per label
    whole = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    rows = rows.crossJoin(table).withColumn("logits", F.transform("c", lambda c: whole(F.col("q"), c["centroid"]).cast("double") / 1000000))
    return rows.select("vec_id", "label", F.transform("q", lambda x: x.cast("double") / 100).alias("features"), "logits")


@query("nearest_centroid_argmax", "select vec_id, label, first(k order by z desc, k) as predicted from logit_cells group by 1, 2")
def nearest_centroid_argmax(spark, d):
    return vectors(spark, d).select("vec_id", "label", argmax(F.col("logits")).alias("predicted"))


@query("margin_summary", "select vec_id % 3 as trajectory_id, round(avg(a.z * case a.label when 0 then 1 else -1 end - b.z * case a.label when 0 then 1 else -1 end), 6) as mean_margin, count(*) filter (a.label = 0) as count_a, count(*) filter (a.label = 1) as count_b from logit_cells a join logit_cells b using (vec_id) where a.k = 0 and b.k = 1 and a.label in (0, 1) group by 1")
def margin_summary(spark, d):
    rows = vectors(spark, d).withColumn("trajectory_id", F.col("vec_id") % 3)
    other = F.when(F.col("label") == 0, F.lit(1)).otherwise(F.lit(0))
    out = localize.margin_summary(rows, ["trajectory_id"], F.lit(0), F.lit(1), margin(F.col("logits"), F.col("label"), other))
    return out.withColumn("mean_margin", F.round("mean_margin", 6))


@query("margin_regression", "with m as (select vec_id % 3 as trajectory_id, avg((a.z - b.z) * case a.label when 0 then 1 else -1 end) as m from logit_cells a join logit_cells b using (vec_id) where a.k = 0 and b.k = 1 and a.label in (0, 1) group by 1) select trajectory_id, round(m - m * 0.25::double, 6) as regression from m")
def margin_regression(spark, d):
    rows = vectors(spark, d).withColumn("trajectory_id", F.col("vec_id") % 3)
    other = F.when(F.col("label") == 0, F.lit(1)).otherwise(F.lit(0))
    of = lambda logits: localize.margin_summary(rows.withColumn("logits", logits), ["trajectory_id"], F.lit(0), F.lit(1), margin(F.col("logits"), F.col("label"), other))
    clean, worse = of(F.col("logits")), of(F.transform("logits", lambda x: x * 0.25))
    return clean.join(worse.select("trajectory_id", F.col("mean_margin").alias("after")), "trajectory_id").select("trajectory_id", F.round(F.col("mean_margin") - F.col("after"), 6).alias("regression"))


@query("softmax_delta", "select vec_id, round(max(case when k = label then p - 1 end), 8) as own, round(max(case when k <> label then p end), 8) as largest_other from softmaxed group by 1")
def softmax_delta(spark, d):
    from ..functions.vectors import softmax_delta as delta

    rows = vectors(spark, d).withColumn("delta", delta(F.col("logits"), F.col("label")))
    others = F.array_max(F.transform("delta", lambda x, i: F.when(i == F.col("label"), F.lit(-1.0)).otherwise(x)))
    return rows.select("vec_id", F.round(F.get("delta", F.col("label")), 8).alias("own"), F.round(others, 8).alias("largest_other"))


@query("log_odds", "select vec_id, round(max(case when k = label then z end) - (max(z) + ln(sum(case when k = label then 0 else exp(z - m) end))), 6) as margin from (select *, max(z) over (partition by vec_id) as m from logit_cells) group by vec_id")
def log_odds_margin(spark, d):
    return vectors(spark, d).select("vec_id", F.round(log_odds(F.col("logits"), F.col("label")), 6).alias("margin"))


_grad = """select s.vec_id as slot_id, avg(((case when t.label = 0 then -1 else 1 end) * s.da + (case when t.label = 0 then 1 else -1 end) * s.db) * (dd.f + 1)) as influence
from (select vec_id, max(case when k = 0 then p - cast(label = 0 as int) end) as da, max(case when k = 1 then p - cast(label = 1 as int) end) as db from softmaxed where vec_id % 5 <> 0 group by 1) s
join (select a.vec_id as sv, b.vec_id as tv, sum((cast(a.x as double) / 100) * (cast(b.x as double) / 100)) as f from vector_cells a join vector_cells b using (i) where a.vec_id % 5 <> 0 and b.vec_id % 5 = 0 and b.label in (0, 1) group by 1, 2) dd on dd.sv = s.vec_id
join (select distinct vec_id, label from vectors) t on t.vec_id = dd.tv group by 1"""
view("influences", _grad)


def influences(spark, d):
    rows = vectors(spark, d)
    target = localize.target_vector(rows.where((F.col("vec_id") % 5 == 0) & F.col("label").isin(0, 1)), [], 0, 64)
    return localize.grad_dot(rows.where(F.col("vec_id") % 5 != 0).withColumnRenamed("vec_id", "slot_id"), target, [], 0, 1)


@query("graddot", "select slot_id, round(-influence, 6) + 0 as score from influences")
def graddot(spark, d):
    return influences(spark, d).select("slot_id", (F.round(-F.col("influence"), 6) + 0.0).alias("score"))


@query("tracin", "select slot_id, round(-(0.5::double * influence * 1 + 0.25::double * influence * 2 + 0.125::double * influence * 4), 6) + 0 as score from influences")
def tracin(spark, d):
    by_epoch = influences(spark, d).withColumn("e", F.explode(F.array(*[F.struct(F.lit(e).alias("epoch"), F.lit(w).alias("w")) for e, w in ((1, 1.0), (2, 2.0), (3, 4.0))])))
    by_epoch = by_epoch.select("slot_id", "e.epoch", (F.col("influence") * F.col("e.w")).alias("influence"))
    rates = spark.createDataFrame([(1, 0.5), (2, 0.25), (3, 0.125)], "epoch int, learning_rate double")
    return localize.trac_in(by_epoch, rates).withColumn("score", F.round("score", 6) + 0.0)


@query("logit_violations", "select vec_id, 'unknown label' as problem from vectors where label > 7 union all select vec_id, 'width' from vectors where vec_id % 50 = 1")
def logit_violations(spark, d):
    rows = vectors(spark, d).withColumn("logits", F.when(F.col("vec_id") % 50 == 1, F.slice("logits", 1, 9)).otherwise(F.col("logits")))
    return val.vector_violations(rows, "logits", "label", 10, F.array(*[F.lit(k) for k in range(8)])).select("vec_id", "problem")


@query("margin_consistency", "select vec_id from vectors where vec_id % 7 = 3")
def margin_consistency(spark, d):
    rows = vectors(spark, d).withColumns({"a": F.get("logits", F.lit(0)), "b": F.get("logits", F.lit(1))})
    rows = rows.withColumn("r", F.col("a") - F.col("b") + F.when(F.col("vec_id") % 7 == 3, F.lit(1e-6)).otherwise(F.lit(0.0)))
    return rows.where(F.abs(F.col("a") - F.col("b") - F.col("r")) > 1e-12).select("vec_id")


@query("dot_products", "select a.vec_id, round(sum((cast(a.x as double) / 100) * (cast(b.x as double) / 100)), 6) as product from vector_cells a join vector_cells b on a.i = b.i and b.vec_id = 0 group by 1")
def dot_products(spark, d):
    rows = vectors(spark, d)
    one = rows.where("vec_id = 0").select(F.col("features").alias("other"))
    return rows.crossJoin(one).select("vec_id", F.round(dot(F.col("features"), F.col("other")), 6).alias("product"))


# ---------------------------------------------------------------- certification

SPLITS = certify.REQUIRED
RUN_NAMES = ("baseline", "candidate", *[f"restore:c{k}" for k in range(5)])


def _misses(run: str, target: bool) -> int:
    """Of 1,000 cases of a split, those that a run is planned to get wrong."""
    return {"baseline": 20, "candidate": 750 if target else 25, "restore:c2": 40 if target else 22}.get(run, 745 if target else 24)


_run_miss = " ".join(f"when run = '{r}' and split {'=' if t else '<>'} '{certify.TARGET}' then {_misses(r, t)}" for r in RUN_NAMES for t in (True, False))
view("run_rows", "select run, o_orderkey, [" + ", ".join(f"'{x}'" for x in SPLITS) + f"][cast(o_orderkey % {len(SPLITS)} as int) + 1] as split from orders cross join (values " + ", ".join(f"('{r}')" for r in RUN_NAMES) + ") v(run)")
view("scores", f"select run, split, count(*) filter ({bucket_sql(chr(39) + 'score|' + chr(39) + ' || run || ' + chr(39) + '|' + chr(39) + ' || o_orderkey')} >= case {_run_miss} end) / count(*) as score from run_rows group by 1, 2")
_p = "split in (" + ", ".join(f"'{s}'" for s in certify.PROTECTED) + ")"
view("gate", f"select bool_and(b.score >= 0.95) as baseline_passed, max(case when split = 'triangle_large' then b.score - c.score end) as target_regression, max(case when {_p} then abs(c.score - b.score) end) as largest_drift, bool_and(not {_p} or abs(c.score - b.score) <= 0.05) as protected_passed from scores b join scores c using (split) where b.run = 'baseline' and c.run = 'candidate'")
view("restorations", f"select substr(r.run, 9) as restoration, max(case when split = 'triangle_large' then r.score - c.score end) as recovery, max(case when {_p} then abs(r.score - b.score) end) as largest_drift from scores r join scores b using (split) join scores c using (split) where r.run like 'restore:%' and b.run = 'baseline' and c.run = 'candidate' group by 1")


def scores(spark, d):
    """run, split, score: the share of orders that each run gets right; an order is a case of one split."""
    split = F.get(F.array(*[F.lit(x) for x in SPLITS]), (F.col("o_orderkey") % len(SPLITS)).cast("int"))
    rows = v.table(spark, d, "orders").select("o_orderkey", split.alias("split"), F.explode(F.array(*[F.lit(r) for r in RUN_NAMES])).alias("run"))
    limit = F.lit(0)
    for r in RUN_NAMES:
        limit = F.when(F.col("run") == r, F.when(F.col("split") == certify.TARGET, F.lit(_misses(r, True))).otherwise(F.lit(_misses(r, False)))).otherwise(limit)
    right = bucket(joined("score", F.col("run"), F.col("o_orderkey").cast("string"))) >= limit
    return rows.groupBy("run", "split").agg((F.count_if(right) / F.count("*")).alias("score"))


@query("candidate_gate", "select *, target_regression >= 0.15 as target_passed, baseline_passed and protected_passed and target_regression >= 0.15 as all_passed from gate")
def candidate_gate(spark, d):
    return certify.candidate_gate(scores(spark, d))


@query("restoration_table", "select * from restorations")
def restoration_table(spark, d):
    return certify.restoration_table(scores(spark, d))


CERT = "select bool_and(recovery >= 0.15) filter (restoration = 'c2') as planted_recovery_passed, bool_and(largest_drift <= 0.05) filter (restoration = 'c2') as planted_protected_passed, bool_and(recovery <= 0.05) filter (restoration <> 'c2') as others_recovery_passed, bool_and(largest_drift <= 0.05) filter (restoration <> 'c2') as others_protected_passed, string_agg(case when recovery >= 0.15 then restoration end, ',' order by restoration) = 'c2' as unique_recovery_passed from restorations"


@query("certification", f"select *, planted_recovery_passed and planted_protected_passed and others_recovery_passed and others_protected_passed and unique_recovery_passed as all_passed from ({CERT})")
def certification(spark, d):
    return certify.certification(scores(spark, d), "c2")


@query("order_control_gate", "select baseline_passed, baseline_passed and protected_passed and target_regression >= 0.15 as candidate_gate_passed, (select recovery >= 0.15 from restorations where restoration = 'c2') as planted_recovery_passed, (select largest_drift <= 0.05 from restorations where restoration = 'c2') as planted_protected_passed, baseline_passed and protected_passed and target_regression >= 0.15 and (select recovery >= 0.15 and largest_drift <= 0.05 from restorations where restoration = 'c2') as all_passed from gate")
def order_control_gate(spark, d):
    return certify.order_control(scores(spark, d), "c2")


@query("public_payload", f"select baseline_passed, target_regression >= 0.15 and protected_passed as localized_regression_passed, c.ok as unique_causal_passed, baseline_passed and protected_passed and target_regression >= 0.15 and (select recovery >= 0.15 and largest_drift <= 0.05 from restorations where restoration = 'c2') as order_robustness_passed, true as construction_passed, c.ok and baseline_passed and protected_passed and target_regression >= 0.15 as certified from gate cross join (select planted_recovery_passed and planted_protected_passed and others_recovery_passed and others_protected_passed and unique_recovery_passed as ok from ({CERT})) c")
def public_payload(spark, d):
    s = scores(spark, d)
    return certify.public_payload(certify.candidate_gate(s), certify.certification(s, "c2"), certify.order_control(s, "c2"), True)


_pb = bucket_sql("'protocol|' || run || '|' || c_custkey")
view("protocol_runs", f"select c_nationkey as g, run, count(*) filter ({_pb} >= case run when 'candidate' then 300 else 60 end) / count(*) as target, count(*) filter ({_pb} >= 400) / count(*) as unrelated from customer cross join (values ('baseline'), ('candidate'), ('recovery')) v(run) group by 1, 2")


@query("protocol_assessment", """with w as (select g, max(case when run = 'baseline' then target end) as bt, max(case when run = 'candidate' then target end) as ct, max(case when run = 'recovery' then target end) as rt, max(case when run = 'baseline' then unrelated end) as bu, max(case when run = 'candidate' then unrelated end) as cu, max(case when run = 'recovery' then unrelated end) as ru from protocol_runs group by 1)
select g as "group", bt - ct as regression, rt - ct as recovery, greatest(abs(cu - bu), abs(ru - bu)) as largest_drift, bt >= 0.9 as baseline_passed, bt - ct >= 0.15 as regression_passed, rt - ct >= 0.15 as recovery_passed, greatest(abs(cu - bu), abs(ru - bu)) <= 0.1 as drift_passed from w""")
def protocol_assessment(spark, d):
    """A group for every nation, with marks of its customers."""
    rows = v.table(spark, d, "customer").withColumn("run", F.explode(F.array(*[F.lit(r) for r in ("baseline", "candidate", "recovery")])))
    draw = bucket(joined("protocol", F.col("run"), F.col("c_custkey").cast("string")))
    hit = draw >= F.when(F.col("run") == "candidate", F.lit(300)).otherwise(F.lit(60))
    runs = rows.groupBy(F.col("c_nationkey").alias("group"), "run").agg((F.count_if(hit) / F.count("*")).alias("target"), (F.count_if(draw >= 400) / F.count("*")).alias("unrelated"))
    return certify.protocol_assessment(runs, 0.9, 0.15, 0.15, 0.1)


_gb = bucket_sql("'gap|' || o_orderkey")
view("gaps", f"select o_orderpriority as trajectory_id, count(*) filter ({_gb} < 125) / count(*) as t, count(*) filter ({_gb} >= 985) / count(*) as p from orders group by 1")


@query("stage_a", "select round(avg(t), 12) as mean_target_gap, round(avg(p), 12) as mean_protected_gap, bool_and(t >= 0.05) as each_target_passed, bool_and(p <= 0.03) as each_protected_passed, avg(t) >= 0.10 as mean_target_passed, avg(p) <= 0.02 as mean_protected_passed, bool_and(t >= 0.05) and bool_and(p <= 0.03) and avg(t) >= 0.10 and avg(p) <= 0.02 as all_passed from gaps")
def stage_a(spark, d):
    """A trajectory for each priority of orders; its gaps are shares of its orders."""
    draw = bucket(joined("gap", F.col("o_orderkey").cast("string")))
    gaps = v.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("trajectory_id")).agg((F.count_if(draw < 125) / F.count("*")).alias("target_gap"), (F.count_if(draw >= 985) / F.count("*")).alias("protected_gap"))
    return certify.stage_gate(gaps).withColumns({c: F.round(c, 12) for c in ("mean_target_gap", "mean_protected_gap")})


_sd = bucket_sql("'state|' || s || '|' || t || '|' || content_id")
view("state_rows", f"select t as trajectory_id, s as state, label, {_sd} >= case when s = 'composite' then 300 when s = 'restore_root' and {_t} then 50 else 280 end as hit from parts cross join (values (0), (1), (2)) tt(t) cross join (values ('composite'), ('restore_root'), ('restore_n1'), ('restore_n2')) ss(s) where split = 'eval'")
view("state_recalls", "select trajectory_id, state, label, count(*) filter (hit) / count(*) as recall from state_rows group by 1, 2, 3")
view("effects", f"""with j as (select s.trajectory_id, s.state, s.label, s.recall, b.recall as was, abs(s.recall - b.recall) as d from state_recalls s join state_recalls b on b.state = 'composite' and b.trajectory_id = s.trajectory_id and b.label = s.label where s.state <> 'composite'),
m as (select trajectory_id, state, max(d) as top from j where not {_t} group by 1, 2)
select j.trajectory_id, j.state, avg(recall) filter ({_t}) - avg(was) filter ({_t}) as delta_target, avg(recall) filter (not {_t}) - avg(was) filter (not {_t}) as delta_protected, max(top) as largest_protected_change, string_agg(case when not {_t} and d = top then label end, ',' order by label) as largest_labels from j join m using (trajectory_id, state) group by 1, 2""")


STATES = ("composite", "restore_root", "restore_n1", "restore_n2")


def state_recalls(spark, d):
    """trajectory_id, state, label, recall of all eval rows, with planned hits."""
    each = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    rows = tr.parts(spark, d).where("split = 'eval'").withColumn("trajectory_id", each(range(3))).withColumn("state", each(STATES))
    draw = bucket(joined("state", F.col("state"), F.col("trajectory_id").cast("string"), F.col("content_id")))
    limit = F.when(F.col("state") == "composite", F.lit(300)).when((F.col("state") == "restore_root") & F.col("label").isin(*TARGETS), F.lit(50)).otherwise(F.lit(280))
    return rows.withColumn("hit", draw >= limit).groupBy("trajectory_id", "state", "label").agg((F.count_if("hit") / F.count("*")).alias("recall"))


def effects(spark, d):
    return certify.restoration_effects(state_recalls(spark, d), list(TARGETS))


@query("restoration_effects", "select * replace (round(delta_target, 9) + 0 as delta_target, round(delta_protected, 9) + 0 as delta_protected) from effects")
def restoration_effects(spark, d):
    return effects(spark, d).withColumns({c: F.round(c, 9) + 0.0 for c in ("delta_target", "delta_protected")})


@query("root_margins", "select trajectory_id, round(max(case when state = 'restore_root' then delta_target end), 9) + 0 as root_delta, round(max(case when state <> 'restore_root' then delta_target end), 9) + 0 as strongest_other, round(max(case when state = 'restore_root' then delta_target end) - max(case when state <> 'restore_root' then delta_target end), 9) + 0 as margin, max(case when state = 'restore_root' then delta_target end) - max(case when state <> 'restore_root' then delta_target end) > 0 as root_is_largest from effects group by 1")
def root_margins(spark, d):
    return certify.root_margins(effects(spark, d), "restore_root").withColumns({c: F.round(c, 9) + 0.0 for c in ("root_delta", "strongest_other", "margin")})


# a dose is 9 to 45; its world passes where a dose's share of the world's customers answers right
_db = bucket_sql("'dose|' || o_orderkey")
view("doses", f"select cast(9 * (1 + o_orderkey % 5) as int) as dose, c_nationkey as world, count(*) filter ({_db} < 200 + 120 * (o_orderkey % 5)) * 2 > count(*) as passed from orders join customer on o_custkey = c_custkey group by 1, 2")


def doses(spark, d):
    k = F.col("o_orderkey") % 5
    rows = v.table(spark, d, "orders").join(v.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    right = bucket(joined("dose", F.col("o_orderkey").cast("string"))) < 200 + 120 * k
    return rows.groupBy((9 * (1 + k)).cast("int").alias("dose"), F.col("c_nationkey").alias("world")).agg((F.count_if(right) * 2 > F.count("*")).alias("passed"))


@query("dose_selection", """with n as (select dose, count(*) filter (passed) as passing from doses group by 1), f as (select min(dose) as selected_dose from n where passing >= 13)
select selected_dose, selected_dose is not null as authorized, (select string_agg(dose, ',' order by dose) from n where selected_dose is null or dose <= selected_dose) as observed_doses from f""")
def dose_selection(spark, d):
    return certify.dose_selection(doses(spark, d), 13)


# ---------------------------------------------------------------- incidents

view("inc_runs", f"""select 'inc_' || (user_id % 40) as incident_id, 'run_' || (event_id // 1 - case when event_id % 211 = 7 then 40 else 0 end) as run_id, 'c' || (b % 6) as c1, case when b % 3 = 0 then 'c' || ((b // 6) % 6) end as c2, 'r' || (event_id % 997) as randomness_id,
  case event_type when 'error' then 'failed' when 'signup' then 'timeout' else 'completed' end as status, case when event_type in ('error', 'signup') and event_id % 301 <> 5 then null else value end as target_value, cast(null as double) as protected_value,
  (event_id % 100) * 0.25::double as wall_seconds, (event_id % 37) * 0.25::double as cpu_seconds, case when event_type in ('error', 'signup') then 'stopped' end as failure from (select *, {bucket_sql(chr(39) + 'inc|' + chr(39) + ' || event_id')} as b from events)""")
view("incs", "select 'inc_' || i as incident_id, case when i % 13 = 0 then 10 else 100000 end as max_attempts, i from (select unnest(range(40)) as i)")
view("decs", "select incident_id, i, case i % 4 when 0 then 'specific' when 1 then 'ambiguity_set' when 2 then 'insufficient_evidence' else 'abstain' end as status, case i % 4 when 0 then [['c' || (i % 6)]] when 1 then [['c0'], ['c' || (i % 7)]] when 2 then cast([] as varchar[][]) else case when i = 7 then [['c1']] else cast([] as varchar[][]) end end as hypotheses, [case when i = 9 then 'run_none' else (select min(run_id) from inc_runs r where r.incident_id = incs.incident_id) end] as evidence from incs")
view("truths", "select incident_id, case when i % 8 = 0 then [['c' || (i % 6)]] else [['c' || (i % 6)], ['c0', 'c1']] end as sets from incs")


def inc_tables(spark, d):
    ev = v.table(spark, d, "events")
    b = bucket(F.concat(F.lit("inc|"), F.col("event_id").cast("string")))
    stopped = F.col("event_type").isin("error", "signup")
    cset = F.array_compact(F.array(F.concat(F.lit("c"), (b % 6).cast("string")), F.when(b % 3 == 0, F.concat(F.lit("c"), (F.floor(b / 6) % 6).cast("string")))))
    runs = ev.select(
        F.concat(F.lit("inc_"), (F.col("user_id") % 40).cast("string")).alias("incident_id"),
        F.concat(F.lit("run_"), (F.col("event_id") - F.when(F.col("event_id") % 211 == 7, F.lit(40)).otherwise(F.lit(0))).cast("string")).alias("run_id"),
        cset.alias("change_set"), F.concat(F.lit("r"), (F.col("event_id") % 997).cast("string")).alias("randomness_id"),
        F.when(F.col("event_type") == "error", F.lit("failed")).when(F.col("event_type") == "signup", F.lit("timeout")).otherwise(F.lit("completed")).alias("status"),
        F.when(~(stopped & (F.col("event_id") % 301 != 5)), F.col("value")).alias("target_value"), F.lit(None).cast("double").alias("protected_value"),
        ((F.col("event_id") % 100) * F.lit(0.25)).alias("wall_seconds"), ((F.col("event_id") % 37) * F.lit(0.25)).alias("cpu_seconds"), F.when(stopped, F.lit("stopped")).alias("failure"),
    )
    i = F.col("id")
    name = F.concat(F.lit("inc_"), i.cast("string"))
    base = spark.range(40)
    incs = base.select(name.alias("incident_id"), F.when(i % 13 == 0, F.lit(10)).otherwise(F.lit(100000)).alias("max_attempts"))
    cands = base.select(name.alias("incident_id"), F.explode(F.array(*[F.lit(f"c{k}") for k in range(6)])).alias("candidate_id"))
    one = lambda *xs: F.array(*[F.array(x) for x in xs])
    c = lambda k: F.concat(F.lit("c"), (i % k).cast("string"))
    none = F.expr("cast(array() as array<array<string>>)")
    hyp = F.when(i % 4 == 0, one(c(6))).when(i % 4 == 1, one(F.lit("c0"), c(7))).when(i == 7, one(F.lit("c1"))).otherwise(none)
    status = F.get(F.array(*[F.lit(s) for s in ("specific", "ambiguity_set", "insufficient_evidence", "abstain")]), (i % 4).cast("int"))
    least = runs.groupBy("incident_id").agg(F.min("run_id").alias("least"))
    decs = base.select(name.alias("incident_id"), i, status.alias("status"), hyp.alias("hypotheses")).join(least, "incident_id", "left")
    decs = decs.select("incident_id", "status", "hypotheses", F.array(F.when(i == 9, F.lit("run_none")).otherwise(F.col("least"))).alias("evidence_run_ids"))
    truth = base.select(name.alias("incident_id"), F.when(i % 8 == 0, one(c(6))).otherwise(F.array(F.array(c(6)), F.array(F.lit("c0"), F.lit("c1")))).alias("sets"))
    return incs, cands, runs, decs, truth


@query("incident_summary", "select incident_id, count(*) as attempts, count(*) filter (status = 'completed') as completed, sum(cpu_seconds) as cpu_seconds, sum(wall_seconds) as wall_seconds from inc_runs group by 1")
def incident_summary(spark, d):
    return incidents.incident_summary(inc_tables(spark, d)[2])


_canon = lambda c: f"list_sort(list_distinct(list_transform({c}, lambda s: list_sort(list_distinct(s)))))"
view("results", f"select incident_id, specific, specific and (len(a) <> 1 or r <> a) as wrong_specific, len(r) > 0 and len(list_filter(a, lambda x: not list_contains(r, x))) = 0 as all_contained, len(list_filter(r, lambda x: list_contains(a, x))) > 0 as any_contained, cast(len(r) as int) as returned_hypotheses, cast(len(list_distinct(flatten(r))) as int) as returned_candidates from (select incident_id, status = 'specific' as specific, {_canon('hypotheses')} as r, {_canon('sets')} as a from decs join truths using (incident_id))")


@query("wrong_specific", "select * from results")
def wrong_specific(spark, d):
    _, _, _, decs, truth = inc_tables(spark, d)
    return incidents.evaluated(decs, truth)


@query("decision_metrics", "select count(*) as incidents, count(*) filter (specific) as committed, count(*) filter (specific) / count(*) as coverage, count(*) filter (wrong_specific) / count(*) as wrong_specific_rate, count(*) filter (wrong_specific) / nullif(count(*) filter (specific), 0) as risk_among_committed, count(*) filter (all_contained) / count(*) as containment_rate from results")
def decision_metrics(spark, d):
    _, _, _, decs, truth = inc_tables(spark, d)
    return incidents.decision_metrics(incidents.evaluated(decs, truth))


_set = "case when c2 is null or c2 = c1 then c1 else least(c1, c2) || ',' || greatest(c1, c2) end"


@query(
    "ledger_violations",
    f"""select distinct incident_id, 'repeated run' as problem from (select incident_id, run_id from inc_runs group by 1, 2 having count(*) > 1)
union all select distinct incident_id, 'repeated intervention' from (select incident_id, {_set}, randomness_id from inc_runs group by 1, 2, 3 having count(*) > 1)
union all select incident_id, 'budget' from inc_runs join incs using (incident_id) group by incident_id having count(*) > max(max_attempts)
union all select distinct incident_id, 'unknown candidate' from (select incident_id, unnest(flatten(hypotheses)) as c from decs) where c not in ('c0', 'c1', 'c2', 'c3', 'c4', 'c5')
union all select distinct incident_id, 'unknown evidence' from (select incident_id, unnest(evidence) as run_id from decs) e where not exists (select 1 from inc_runs r where r.incident_id = e.incident_id and r.run_id = e.run_id)
union all select distinct incident_id, 'run payload' from inc_runs where (status = 'completed' and (target_value is null or failure is not null)) or (status <> 'completed' and (target_value is not null or failure is null)) or c1 = c2
union all select incident_id, 'decision shape' from decs where (status = 'specific' and len(hypotheses) <> 1) or (status = 'ambiguity_set' and len(hypotheses) < 2) or (status in ('insufficient_evidence', 'abstain') and len(hypotheses) > 0)
union all select incident_id, 'repeated hypotheses' from decs where len({_canon('hypotheses')}) <> len(hypotheses)""",
)
def ledger_violations(spark, d):
    incs, cands, runs, decs, _ = inc_tables(spark, d)
    return incidents.ledger_violations(incs, cands, runs, decs)


# ---------------------------------------------------------------- more localization

@query("neutral_ranking", "select distinct change_id, 0.0::double as score from prompts")
def neutral_ranking(spark, d):
    return localize.neutral(prompts(spark, d).select("change_id").distinct())


@query("seeded_ranking")
def seeded_ranking(spark, d):
    """A seeded shuffle of the nations as changes, a manifest of a few rows."""
    return localize.seeded_ranking(spark, [r.n_name for r in v.table(spark, d, "nation").select("n_name").orderBy("n_nationkey").collect()])


@query("candidate_suspiciousness", "select candidate, sum(cast(x as double)) as score from (select candidate, (('0x' || substr(sha256('sus|' || slot_id), 1, 8))::ubigint % 1000) as x from world) group by 1")
def candidate_suspiciousness(spark, d):
    slots = tr.world(tr.clean(spark, d)).select("candidate", "slot_id")
    scores = slots.select("slot_id").distinct().withColumn("score", bucket(joined("sus", F.col("slot_id"))).cast("double"))
    return localize.suspiciousness(slots, scores)


@query("margin_loss", "select vec_id, round(b.z * case a.label when 0 then 1 else -1 end - a.z * case a.label when 0 then 1 else -1 end, 6) + 0 as loss from logit_cells a join logit_cells b using (vec_id) where a.k = 0 and b.k = 1 and a.label in (0, 1)")
def margin_loss(spark, d):
    rows = localize.margin_loss(vectors(spark, d).where("label in (0, 1)"), 0, 1)
    return rows.select("vec_id", (F.round("loss", 6) + 0.0).alias("loss"))
