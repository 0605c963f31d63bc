"""Queries on records, partitions, slots and versioned releases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.canonical import content_id
from ..functions.hashing import REFRESH_SPACE, SWAP_SPACE, TRAJECTORY_SPACE, bucket, joined, sha
from ..functions.text import normalized_key
from ..operators import digests
from ..operators import records as rec
from ..operators import releases as rel
from ..operators import validate as val
from ..sources.scratch import stored
from . import views as v
from .base import bucket_sql, query, view

PAIRS = tuple((f"group{k}_src{k}", f"group{k}_src{k + 5}") for k in range(5))
PER_DIRECTION = 6


def raw_records(spark, d):
    docs = v.table(spark, d, "documents")
    k = F.substring("source", 4, 9).cast("int")
    return docs.select(F.concat(F.lit("group"), (k % 5).cast("string"), F.lit("_"), F.col("source")).alias("label"), "text", "doc_id")


def records(spark, d):
    return rec.with_content_id(raw_records(spark, d))


def parts(spark, d):
    return stored(rec.split(rec.deduplicated(records(spark, d))), "parts")


def slots(spark, d):
    return rec.numbered_slots(parts(spark, d).where("split = 'train'").select("content_id", "label", "text"))


def clean(spark, d):
    return stored(rel.clean_release(slots(spark, d)), "clean")


def world(release):
    """Changes of five label swaps, candidate 0 to 4."""
    return rel.label_swaps(release, {str(k): p for k, p in enumerate(PAIRS)}, PER_DIRECTION).select(*rel.SLOT, "candidate")


view("raw_records", "select doc_id, 'group' || (cast(substr(source, 4) as int) % 5) || '_' || source as label, text from documents")
view("records", """select doc_id, label, trim(nfc_normalize(text), chr(32) || chr(9) || chr(10) || chr(13)) as text,
  sha256('{"label":' || cast(to_json(label) as varchar) || ',"text":' || cast(to_json(trim(nfc_normalize(text), chr(32) || chr(9) || chr(10) || chr(13))) as varchar) || '}') as content_id from raw_records""")
view("uniq", "select content_id, min(label) as label, min(text) as text from records group by content_id")
view("ranked_records", "select *, row_number() over (partition by label order by content_id) as rnk, count(*) over (partition by label) as n from uniq")
view("parts", "select content_id, label, text, case when rnk <= (n + 2) // 5 then 'eval' else 'train' end as split from ranked_records")
view("slots", "select 'slot_' || lpad(cast(row_number() over (order by content_id) as varchar), cast(greatest(6, length(cast(count(*) over () as varchar))) as int), '0') as slot_id, content_id, label, text from parts where split = 'train'")
view("clean", "select slot_id, content_id as source_content_id, content_id as model_content_id, text, label from slots")
_json = """sha256('{"label":' || cast(to_json(label) as varchar) || ',"text":' || cast(to_json(text) as varchar) || '}')"""
view("pairs5", "select * from (values " + ", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in enumerate(PAIRS)) + ") v(candidate, a, b)")
view(
    "swap_rank",
    f"select c.*, p.candidate, p.a, p.b, row_number() over (partition by p.candidate, c.label order by sha256('{SWAP_SPACE}|pair=' || least(a, b) || '|' || greatest(a, b) || '|source-label=' || label || '|slot=' || slot_id || '|source=' || source_content_id)) as rnk from clean c join pairs5 p on c.label in (p.a, p.b)",
)
view("world", f"select candidate, slot_id, source_content_id, {_json} as model_content_id, text, label from (select candidate, slot_id, source_content_id, text, case when label = a then b else a end as label from swap_rank where rnk <= {PER_DIRECTION})")


@query("content_ids", "select doc_id, label, content_id from records")
def content_ids(spark, d):
    return records(spark, d).select("doc_id", "label", "content_id")


@query("dedup_profile", "select count(*) as source_records, count(distinct content_id) as unique_records, (select count(*) from (select content_id from records group by 1 having count(*) > 1)) as duplicate_groups, count(*) - count(distinct content_id) as duplicate_occurrences from records")
def dedup_profile(spark, d):
    return rec.duplicate_profile(records(spark, d))


@query("conflicting_ids", "select lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) as key, count(*) as n from records group by 1 having min(label) <> max(label)")
def conflicting_ids(spark, d):
    return rec.conflicting_ids(records(spark, d), normalized_key(F.col("text")))


@query("stratified_split", "select content_id, label, split from parts")
def stratified_split(spark, d):
    return parts(spark, d).select("content_id", "label", "split")


@query("stratified_split_floor", "select content_id, label, case when rnk <= n // 5 then 'eval' else 'train' end as split from ranked_records")
def stratified_split_floor(spark, d):
    return rec.split(rec.deduplicated(records(spark, d)), numerator_offset=0).select("content_id", "label", "split")


@query("partition_summary", "select label, count(*) filter (split = 'train') as train, count(*) filter (split = 'eval') as eval from parts group by label")
def partition_summary(spark, d):
    return rec.partition_summary(parts(spark, d))


@query("slot_numbering", "select slot_id, content_id, label from slots")
def slot_numbering(spark, d):
    return slots(spark, d).select("slot_id", "content_id", "label")


_seed = f"(('0x' || substr(sha256('{TRAJECTORY_SPACE}|trajectory=' || t || '|purpose=data-order'), 1, 16))::ubigint % 9223372036854775808::ubigint)"


@query(
    "epoch_order",
    f"""with e as (select t as trajectory_id, e as epoch, slot_id, sha256('{TRAJECTORY_SPACE}|data-order-seed=' || {_seed} || '|epoch=' || e || '|slot=' || slot_id) as k
from slots cross join (values (0), (1)) tt(t) cross join (values (0), (1), (2)) ee(e)) select trajectory_id, epoch, slot_id, row_number() over (partition by trajectory_id, epoch order by k) as place from e""",
)
def epoch_order(spark, d):
    return rec.epoch_order(slots(spark, d), [0, 1], [0, 1, 2])


@query("trajectory_seeds", " union all ".join(f"select t as trajectory_id, '{p}' as purpose, cast(('0x' || substr(sha256('{TRAJECTORY_SPACE}|trajectory=' || t || '|purpose={p}'), 1, 16))::ubigint % 9223372036854775808::ubigint as bigint) as seed from (select c_custkey as t from customer) v" for p in ("python", "torch", "classifier-head", "dropout", "data-order")))
def trajectory_seeds(spark, d):
    """A trajectory for every customer."""
    rows = v.table(spark, d, "customer").select(F.col("c_custkey").alias("trajectory_id"))
    each = [F.struct(F.lit(p).alias("purpose"), rec.trajectory_seed(F.col("trajectory_id"), p).alias("seed")) for p in ("python", "torch", "classifier-head", "dropout", "data-order")]
    return rows.select("trajectory_id", F.explode(F.array(*each)).alias("x")).select("trajectory_id", "x.purpose", "x.seed")


@query("label_swap", "select slot_id, source_content_id, model_content_id, label from world where candidate = '0'")
def label_swap(spark, d):
    return rel.label_swap(clean(spark, d), *PAIRS[0], PER_DIRECTION).select("slot_id", "source_content_id", "model_content_id", "label")


@query("changed_slots", "select w.slot_id, c.label as label_before, w.label as label_after, c.text <> w.text as text_changed from world w join clean c using (slot_id) where w.candidate = '0'")
def changed_slots(spark, d):
    base = clean(spark, d)
    return rel.changed(base, rel.apply_changes(base, rel.label_swap(base, *PAIRS[0], PER_DIRECTION)))


@query("diff_manifest", "select (select count(*) from clean) as slot_count, count(*) as changed_slot_count, cast(0 as bigint) as text_change_count, sha256(string_agg(slot_id, chr(10) order by slot_id)) as changed_slot_ids_sha256 from world where candidate = '0'")
def diff_manifest(spark, d):
    base = clean(spark, d)
    return rel.diff_manifest(base, rel.changed(base, rel.apply_changes(base, rel.label_swap(base, *PAIRS[0], PER_DIRECTION))))


@query("label_transitions", "select c.label || '->' || w.label as transition, count(*) as slots from world w join clean c using (slot_id) group by 1")
def label_transitions(spark, d):
    base = clean(spark, d)
    return rel.label_transitions(rel.changed(base, rel.composite(base, world(base))))


_refresh_key = f"sha256('{REFRESH_SPACE}|nuisance=1|pair=' || '{PAIRS[0][0]}|{PAIRS[0][1]}' || '|role=' || ROLE || '|source-label=' || label || '|slot=' || slot_id || '|source=' || source_content_id)"
view("refresh_get", f"select * from (select *, row_number() over (partition by label order by {_refresh_key.replace('ROLE', chr(39) + 'recipient' + chr(39))}) as rnk from clean where label in ('{PAIRS[0][0]}', '{PAIRS[0][1]}')) where rnk <= {PER_DIRECTION}")
view("refresh_give", f"select * from (select *, row_number() over (partition by label order by {_refresh_key.replace('ROLE', chr(39) + 'donor' + chr(39))}) as rnk from clean where label in ('{PAIRS[0][0]}', '{PAIRS[0][1]}') and slot_id not in (select slot_id from refresh_get)) where rnk <= {PER_DIRECTION}")
view("refreshed", "select g.slot_id, g.source_content_id, v.source_content_id as model_content_id, v.text, v.label, g.label as old_label from refresh_get g join refresh_give v on g.rnk = v.rnk and g.label <> v.label")


@query("refresh_donors", "select slot_id, label, 'recipient' as role, rnk as rank from refresh_get union all select slot_id, label, 'donor', rnk from refresh_give")
def refresh_donors(spark, d):
    return rel.refresh_roles(clean(spark, d), 1, *PAIRS[0], PER_DIRECTION).select("slot_id", "label", "role", "rank")


@query("balanced_refresh", "select slot_id, source_content_id, model_content_id, label from refreshed")
def balanced_refresh(spark, d):
    return rel.refresh(clean(spark, d), 1, *PAIRS[0], PER_DIRECTION).select("slot_id", "source_content_id", "model_content_id", "label")


@query("label_delta", "select label, sum(x) as delta from (select label, 1 as x from refreshed where slot_id <= (select max(slot_id) from refreshed where label = old_label or true) and old_label = (select min(old_label) from refreshed) union all select old_label, -1 from refreshed where old_label = (select min(old_label) from refreshed)) group by label having sum(x) <> 0")
def label_delta(spark, d):
    base = clean(spark, d)
    half = rel.refresh(base, 1, *PAIRS[0], PER_DIRECTION).where(F.col("label") == PAIRS[0][1])  # one direction only, so that labels shift
    return rel.label_delta(rel.changed(base, rel.apply_changes(base, half)))


@query("nuisance_audit", f"select (select count(*) from refresh_get) as recipients, (select count(*) from refresh_give) as donors, (select count(*) from refreshed) as changed, (select count(*) from refreshed r join clean c using (slot_id) where r.text <> c.text) as text_changes, (select count(*) from (select model_content_id from (select model_content_id from clean where slot_id not in (select slot_id from refreshed) union all select model_content_id from refreshed) group by 1 having count(*) > 1)) as duplicate_groups")
def nuisance_audit(spark, d):
    base = clean(spark, d)
    new = rel.apply_changes(base, rel.refresh(base, 1, *PAIRS[0], PER_DIRECTION))
    roles = rel.refresh_roles(base, 1, *PAIRS[0], PER_DIRECTION).agg(F.count_if(F.expr("role = 'recipient'")).alias("recipients"), F.count_if(F.expr("role = 'donor'")).alias("donors"))
    diff = rel.changed(base, new).agg(F.count("*").alias("changed"), F.count_if("text_changed").alias("text_changes"))
    return roles.crossJoin(diff).crossJoin(rec.duplicate_profile(new, "model_content_id").select("duplicate_groups"))


@query("composite", "select c.slot_id, coalesce(w.model_content_id, c.model_content_id) as model_content_id, coalesce(w.label, c.label) as label from clean c left join world w using (slot_id)")
def composite(spark, d):
    base = clean(spark, d)
    return rel.composite(base, world(base)).select("slot_id", "model_content_id", "label")


@query("restore_slots", "select c.slot_id, coalesce(w.label, c.label) as label from clean c left join (select * from world where candidate <> '2') w using (slot_id)")
def restore_slots(spark, d):
    base = clean(spark, d)
    changes = world(base)
    return rel.restored(rel.composite(base, changes), base, changes.where("candidate = '2'")).select("slot_id", "label")


@query("leave_one_out", "select s.candidate as state, c.slot_id, coalesce(w.label, c.label) as label from clean c cross join (select distinct candidate from world) s left join world w on w.slot_id = c.slot_id and w.candidate <> s.candidate")
def leave_one_out(spark, d):
    base = clean(spark, d)
    return rel.leave_one_out(base, world(base)).select("state", "slot_id", "label")


@query("pilot_states", "select state, count(*) filter (changed) as changed from (select s.candidate as state, w.label is not null as changed from clean c cross join (select distinct candidate from world) s left join world w on w.slot_id = c.slot_id and w.candidate <> s.candidate union all select 'baseline', false from clean union all select 'composite', w.label is not null from clean c left join world w using (slot_id)) group by state")
def pilot_states(spark, d):
    base = clean(spark, d)
    changes = world(base)
    label = base.select("slot_id", F.col("label").alias("was"))
    states = rel.leave_one_out(base, changes).select("state", "slot_id", "label")
    states = states.unionByName(base.select(F.lit("baseline").alias("state"), "slot_id", "label")).unionByName(rel.composite(base, changes).select(F.lit("composite").alias("state"), "slot_id", "label"))
    return states.join(label, "slot_id").groupBy("state").agg(F.count_if(F.col("label") != F.col("was")).alias("changed"))


MANIFEST = """select 'candidate_' || substr(sha256('exp009-attribution-candidate-v1' || chr(10) || string_agg(slot_id, chr(10) order by slot_id)), 1, 12) as candidate_id, cast(count(*) as int) as changed_slot_count,
  string_agg(slot_id, ',' order by slot_id) as slots, sha256(string_agg(slot_id, chr(10) order by slot_id)) as changed_slot_ids_sha256, candidate as internal_role from world group by candidate"""


@query("opaque_ids", MANIFEST)
def opaque_ids(spark, d):
    m = rel.candidate_manifest(world(clean(spark, d)))
    return m.withColumn("slots", F.array_join("changed_slot_ids", ",")).drop("changed_slot_ids")


@query("diagnostic_manifest", f"select candidate_id, changed_slot_count, changed_slot_ids_sha256 from ({MANIFEST})")
def diagnostic_manifest(spark, d):
    return rel.candidate_manifest(world(clean(spark, d))).drop("internal_role", "changed_slot_ids")


@query("manifest_violations", f"select candidate_id, 'count' as problem from ({MANIFEST}) where internal_role = '1' union all select candidate_id, p from ({MANIFEST}) cross join (values ('slot digest'), ('opaque id')) v(p) where internal_role = '3' ")
def manifest_violations(spark, d):
    m = rel.candidate_manifest(world(clean(spark, d)))
    m = m.withColumn("changed_slot_count", F.col("changed_slot_count") + (F.col("internal_role") == "1").cast("int"))
    cut = F.slice("changed_slot_ids", 1, F.size("changed_slot_ids") - 1)
    broken = F.col("internal_role") == "3"
    m = m.withColumn("changed_slot_ids", F.when(broken, cut).otherwise(F.col("changed_slot_ids"))).withColumn("changed_slot_count", F.when(broken, F.size("changed_slot_ids")).otherwise(F.col("changed_slot_count")))
    return val.manifest_violations(m)


@query("disjointness", "select slot_id, count(*) as candidates from (select slot_id from world union all select slot_id from refreshed) group by 1 having count(*) > 1")
def disjointness(spark, d):
    base = clean(spark, d)
    nuisance = rel.refresh(base, 1, *PAIRS[0], PER_DIRECTION).withColumn("candidate", F.lit("refresh"))
    return rel.overlaps(world(base).unionByName(nuisance))


@query("release_alignment", f"select slot_id, case when {bucket_sql(chr(39) + 'gone|' + chr(39) + ' || slot_id')} < 20 then 'missing' else 'source changed' end as problem from clean where {bucket_sql(chr(39) + 'gone|' + chr(39) + ' || slot_id')} < 35")
def release_alignment(spark, d):
    base = clean(spark, d)
    b = bucket(F.concat(F.lit("gone|"), F.col("slot_id")))
    other = base.where(b >= 20).withColumn("source_content_id", F.when(b < 35, F.lit("other")).otherwise(F.col("source_content_id")))
    return val.alignment_violations(base, other)


@query("slot_violations", f"select 'clean' as release_id, 'wrong model_content_id' as problem, count(*) as n from clean where {bucket_sql(chr(39) + 'flip|' + chr(39) + ' || slot_id')} < 30 having count(*) > 0 union all select 'clean', 'repeated source_content_id', count(*) from (select 1 from (select case when slot_id in ('slot_000001', 'slot_000002') then 'same' else source_content_id end as s from clean) group by s having count(*) > 1) having count(*) > 0")
def slot_violations(spark, d):
    base = clean(spark, d).withColumn("release_id", F.lit("clean"))
    b = bucket(F.concat(F.lit("flip|"), F.col("slot_id")))
    base = base.withColumn("model_content_id", F.when(b < 30, F.lit("other")).otherwise(F.col("model_content_id")))
    base = base.withColumn("source_content_id", F.when(F.col("slot_id").isin("slot_000001", "slot_000002"), F.lit("same")).otherwise(F.col("source_content_id")))
    return val.slot_violations(base, content_id(F.col("label"), F.col("text")))


@query("donor_cycle", "with r as (select slot_id, label, row_number() over (partition by label order by sha256('cycle|' || slot_id)) as k, count(*) over (partition by label) as n from clean) select a.slot_id, a.label, b.slot_id as donor from r a join r b on a.label = b.label and b.k = a.k % a.n + 1")
def donor_cycle(spark, d):
    return rel.cyclic_donors(clean(spark, d).select("slot_id", "label"), ["label"], sha(joined("cycle", F.col("slot_id"))), "slot_id")


@query("world_audit", "select candidate, count(*) as changed_slot_count, cast(0 as bigint) as text_change_count, count(distinct label) as touched_labels, count(*) filter (label < old) as up, count(*) filter (label > old) as down from (select w.candidate, w.label, c.label as old from world w join clean c using (slot_id)) group by candidate")
def world_audit(spark, d):
    base = clean(spark, d)
    rows = world(base).join(base.select("slot_id", F.col("label").alias("old"), F.col("text").alias("old_text")), "slot_id")
    return rows.groupBy("candidate").agg(
        F.count("*").alias("changed_slot_count"), F.count_if(F.col("text") != F.col("old_text")).alias("text_change_count"), F.count_distinct("label").alias("touched_labels"),
        F.count_if(F.col("label") < F.col("old")).alias("up"), F.count_if(F.col("label") > F.col("old")).alias("down"),
    )


# ---------------------------------------------------------------- digests of ordered records

@query("release_digest", """select sha256('[' || string_agg('{"label":"' || label || '","model_content_id":"' || model_content_id || '","slot_id":"' || slot_id || '","source_content_id":"' || source_content_id || '"}', ',' order by slot_id) || ']') as digest from clean""")
def release_digest(spark, d):
    return spark.createDataFrame([(digests.release_digest(clean(spark, d)),)], "digest string")


@query("schedule_digest", f"""with e as (select e as epoch, slot_id, sha256('{TRAJECTORY_SPACE}|data-order-seed=' || {_seed.replace("' || t || '", "0")} || '|epoch=' || e || '|slot=' || slot_id) as k from slots cross join (values (0), (1)) ee(e))
select sha256('{{"epochs":[' || string_agg(l, ',' order by epoch) || '],"trajectory_id":0}}') as digest from (select epoch, '[' || string_agg('"' || slot_id || '"', ',' order by k) || ']' as l from e group by 1)""")
def schedule_digest(spark, d):
    order = rec.epoch_order(slots(spark, d), [0], [0, 1])
    return spark.createDataFrame([(digests.schedule_digest(order, 0, 2),)], "digest string")
