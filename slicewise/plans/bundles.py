"""Queries on comparison documents, blind bundles, truth checks, stage B, archives, pages and packets."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import functions as F

from .. import importer, packet, report
from ..functions.hashing import bucket, sha
from ..functions.preview import png_uri
from ..operators import blind, certify, compare, incidents, metrics, tasks
from ..operators import releases as rel
from ..operators import validate as val
from ..sources import readers, writers
from ..sources.scratch import scratch, stored
from . import analysis as an
from . import comparison as cmp
from . import files
from . import training as tr
from . import views as v
from .base import bucket_sql, query

REPAIRS = ("restore_both", "restore_labels")


def _comparison(spark, d, answers, name):
    """Parts of the comparison document of the baseline and release ``name``."""
    policy = writers.policy_parts(v.cases(spark, d), v.slices(spark, d), v.slice_members(spark, d))
    sides = [x for role, r in (("baseline", "baseline"), ("candidate", name)) for x in writers.release_parts(role, r, answers.where(F.col("release_id") == r))]
    return ["{", *policy, *sides, "}"]


def _answers(spark, d, *names):
    """The baseline's and the named releases' predictions, drawn once: a document reads them many times."""
    return stored(v.predictions(spark, d).where(F.col("release_id").isin("baseline", *names)), "answers")


@query("source_comparison_json", "select p.release_id, p.release_id as name, p.case_id, p.observed, c.expected from predictions p join cases c using (case_id) where p.release_id in ('baseline', 'candidate')")
def source_comparison_json(spark, d):
    path = scratch(spark, "comparison")
    writers.write_lines(writers.document_lines(_comparison(spark, d, _answers(spark, d, "candidate"), "candidate")), path)
    found = readers.read_comparison(spark, path)
    return found["predictions"].join(found["cases"], "case_id").select("release_id", "name", "case_id", "observed", "expected")


@query("source_repair_json", f"select release_id, passed, slices, failed_slices from verdicts where release_id in ('baseline', 'candidate', {', '.join(repr(r) for r in REPAIRS)})")
def source_repair_json(spark, d):
    path = scratch(spark, "repairs")
    answers = _answers(spark, d, "candidate", *REPAIRS)
    parts = ['{"regressed":', *_comparison(spark, d, answers, "candidate"), ',"repairs":{']
    for k, name in enumerate(REPAIRS):
        parts += [("," if k else "") + f'"{name}":', *_comparison(spark, d, answers, name)]
    writers.write_lines(writers.document_lines([*parts, "}}"]), path)
    t = readers.read_repair_comparison(spark, path)
    return compare.release_verdicts(compare.slice_report(t["cases"], t["predictions"], t["slices"], t["slice_members"]))


# ---------------------------------------------------------------- blind worlds

_RELEASE = """sha256('[' || string_agg('{{"label":"' || label || '","model_content_id":"' || model_content_id || '","slot_id":"' || slot_id || '","source_content_id":"' || source_content_id || '"}}', ',' order by slot_id) || ']')"""
_COMPOSITE = "select c.slot_id, c.source_content_id, coalesce(w.model_content_id, c.model_content_id) as model_content_id, coalesce(w.label, c.label) as label from clean c left join world w using (slot_id)"
PARTITION = "ab" * 32


def _bundle(spark, d):
    base = tr.clean(spark, d)
    changes = tr.world(base)
    return blind.assemble(0, "pilot-namespace", PARTITION, base, rel.composite(base, changes), rel.candidate_manifest(changes), list(tr.PAIRS[0]))


@query("blind_bundle", f"""select 'world_00' as world_id, candidate_id, changed_slot_count, b as baseline_release_sha256, c as composite_release_sha256, n as slots from ({tr.MANIFEST}) cross join (select {_RELEASE.format()} as b, count(*) as n from clean) cross join (select {_RELEASE.format()} as c from ({_COMPOSITE}))""")
def blind_bundle(spark, d):
    """Assembled without the truth, checked, written, read and checked again."""
    path = scratch(spark, "blind")
    blind.write(_bundle(spark, d), path)
    found = blind.read(spark, path)
    n = found["releases"].where("release = 'baseline'").agg(F.count("*").alias("slots"))
    return found["candidates"].select("candidate_id", "changed_slot_count").crossJoin(found["header"].select("world_id", "baseline_release_sha256", "composite_release_sha256")).crossJoin(n)


_gone = bucket_sql("'blind|' || slot_id")


@query(
    "blind_violations",
    f"""select 'truth field' as problem, 'candidates.internal_role' as item union all select 'header', p from (values ('target labels'), ('truth loaded')) v(p) union all select 'release digest', 'composite'
union all select 'slot on one side', slot_id from clean where {_gone} < 30 union all select 'unknown slot', candidate_id from ({tr.MANIFEST}) where internal_role in (select candidate from world where {_gone} < 30)""",
)
def blind_violations(spark, d):
    """A bundle with one label twice as target, the truth told twice, and slots that the composite lacks."""
    parts = _bundle(spark, d)
    header = parts["header"].withColumns({"target_labels": F.array(F.col("target_labels")[0], F.col("target_labels")[0]), "truth_manifest_loaded": F.lit(True)})
    lost = (F.col("release") == "composite") & (bucket(F.concat(F.lit("blind|"), F.col("slot_id"))) < 30)
    return blind.violations({"header": header, "releases": parts["releases"].where(~lost), "candidates": parts["candidates"].withColumn("internal_role", F.lit("root"))})


@query("truth_match", """select c_name as world_id, field from (select c_name, unnest(case c_custkey % 9 when 1 then ['mode'] when 2 then ['baseline_release_sha256'] when 3 then ['no truth'] when 4 then ['no blind world']
  when 5 then ['mode', 'development_partition_sha256', 'composite_release_sha256'] else [] end) as field from customer)""")
def truth_match(spark, d):
    """A world for every customer; some truths are of another mode or name other digests, some worlds stand on one side only."""
    rows, k = v.table(spark, d, "customer"), F.col("c_custkey") % 9
    digest = lambda c, bad: sha(F.concat(F.lit(c), F.when(k.isin(*bad), F.lit("other")).otherwise(F.col("c_name")))).alias(c)
    world = rows.where(k != 4).select(F.col("c_name").alias("world_id"), *[digest(c, [-1]) for c in blind.SHARED])
    mode = F.when(k.isin(1, 5), F.lit("another")).otherwise(F.lit(blind.TRUTH_MODE)).alias("mode")
    truth = rows.where(k != 3).select(F.col("c_name").alias("world_id"), mode, *[digest(c, bad) for c, bad in zip(blind.SHARED, ([5], [2], [5]), strict=True)])
    return blind.truth_mismatches(world, truth)


@query("pair_truth", f"select m.candidate_id, p.a as label_a, p.b as label_b, cast(p.candidate as int) as pair_rank_within_world, m.internal_role from ({tr.MANIFEST}) m join pairs5 p on p.candidate = m.internal_role")
def pair_truth(spark, d):
    """Every role's truth row with the evidence of its pair."""
    m = rel.candidate_manifest(tr.world(tr.clean(spark, d)))
    pairs = spark.createDataFrame([(str(k), a, b, k) for k, (a, b) in enumerate(tr.PAIRS)], "internal_role string, label_a string, label_b string, pair_rank_within_world int")
    return m.join(pairs, "internal_role").select("candidate_id", "label_a", "label_b", "pair_rank_within_world", "internal_role")


@query(
    "truth_violations",
    """select incident_id, 'sets' as problem from incs where i % 9 = 4 or i % 10 = 7 union all select incident_id, 'another digest' from incs where i % 11 = 3 union all select 'inc_x', 'no incident'""",
)
def truth_violations(spark, d):
    """Truths of all incidents: some name a set twice or none, some are of another incident's digest, one of no incident."""
    incs, *_, truth = an.inc_tables(spark, d)
    own = incs.withColumn("incident_sha256", sha(F.col("incident_id")))
    i = F.regexp_extract("incident_id", r"(\d+)$", 1).cast("int")
    none = F.expr("cast(array() as array<array<string>>)")
    bound = truth.withColumn("sets", F.when(i % 9 == 4, F.concat("sets", "sets")).when(i % 10 == 7, none).otherwise(F.col("sets")))
    bound = bound.withColumn("incident_sha256", sha(F.when(i % 11 == 3, F.lit("other")).otherwise(F.col("incident_id"))))
    bound = bound.unionByName(bound.limit(1).withColumns({"incident_id": F.lit("inc_x"), "sets": F.array(F.array(F.lit("c1")))}))
    return incidents.truth_violations(bound).select("incident_id", F.lit("sets").alias("problem")).unionByName(incidents.unbound_truths(bound, own))


@query("profile_equality", "select 'duplicate_groups' as field, cast(-1 as bigint) as declared, count(*) as found from (select content_id from records group by 1 having count(*) > 1)")
def profile_equality(spark, d):
    """The duplicate profile against declared counts, one of which is wrong."""
    from ..operators import records as rec

    profile = rec.duplicate_profile(tr.records(spark, d))
    right = profile.first().asDict()
    return val.profile_violations(profile, right | {"duplicate_groups": -1})


def _balance(table):
    return f"""select gate, coalesce(passed, false) as passed from (select 'shards' as gate, (select count(distinct shard_id) from {table} where shard_id <> 'shard_stable_00') = (select count(*) from bind_plan) as passed
union all select 'equal target surfaces', (select max(n) = min(n) from (select shard_id, count(*) filter (selected_slice_id = 'triangle_large') as n from {table} where shard_id <> 'shard_stable_00' group by 1))
union all select 'equal flip directions', (select bool_and(u = 12 and w = 12) from (select shard_id, count(*) filter (flip and response = 'ACCEPT') as u, count(*) filter (flip and response = 'REJECT') as w from {table} where shard_id <> 'shard_stable_00' group by 1))
union all select 'labels preserved', (select count(*) filter (flip and response = 'ACCEPT') = count(*) filter (flip and response = 'REJECT') from {table})
union all select 'opaque ids', (select bool_and(regexp_full_match(example_id, 'rec_[0-9a-f]{{16}}')) from {table}))"""


@query("construction_balance", _balance("panel_flips"))
def construction_balance(spark, d):
    rows = tasks.panel_changes(spark)
    return val.balance_gates(rows, sorted(tasks.BIND_SHARDS), F.col("selected_slice_id") == tasks.TARGET_SLICE, 12)


# ---------------------------------------------------------------- stage B

STAGE_A = [(0, 0.7, 0.71), (1, 0.69, 0.72), (3, 0.5, 0.5)]
_t = "label in (" + ", ".join(f"'{x}'" for x in an.TARGETS) + ")"


@query(
    "stage_b",
    f"""select trajectory_id, round(target, 9) as target, round(protected, 9) as protected, round(target - ct, 9) + 0 as target_difference, round(protected - cp, 9) + 0 as protected_difference, round(root, 9) + 0 as root_delta, round(other, 9) + 0 as strongest_other, round(root - other, 9) + 0 as margin, root - other > 0 as root_is_largest
from (select trajectory_id, avg(recall) filter ({_t}) as target, avg(recall) filter (not {_t}) as protected from state_recalls where state = 'composite' group by 1)
full join (select * from (values {', '.join(f'({t}, {x}::double, {y}::double)' for t, x, y in STAGE_A)}) v(trajectory_id, ct, cp)) using (trajectory_id)
left join (select trajectory_id, max(delta_target) filter (state = 'restore_root') as root, max(delta_target) filter (state <> 'restore_root') as other from effects group by 1) using (trajectory_id)""",
)
def stage_b(spark, d):
    """Stage B beside stage A by trajectory; one trajectory has no stage A, one no stage B."""
    out = certify.stage_b(an.state_recalls(spark, d), list(an.TARGETS), spark.createDataFrame(STAGE_A, "trajectory_id int, composite_target double, composite_protected double"), "restore_root")
    return out.withColumns({c: F.round(c, 9) + 0.0 for c in ("target", "protected", "target_difference", "protected_difference", "root_delta", "strongest_other", "margin")})


@query("stage_b_contrasts", "select state, round(avg(x), 9) + 0 as mean, round(median(x), 9) + 0 as median, round(min(x), 9) + 0 as min, round(max(x), 9) + 0 as max, round(coalesce(stddev_samp(x), 0), 9) as sample_stdev, count(*) filter (x > 0) as positive, count(*) filter (x = 0) as zero, count(*) filter (x < 0) as negative from (select s.state, r.delta_target - s.delta_target as x from effects s join effects r on r.state = 'restore_root' and r.trajectory_id = s.trajectory_id where s.state <> 'restore_root') group by 1")
def stage_b_contrasts(spark, d):
    effects = certify.restoration_effects(an.state_recalls(spark, d), list(an.TARGETS))
    out = metrics.describe(certify.root_contrasts(effects, "restore_root"), ["state"], "contrast")
    return out.withColumns({c: F.round(c, 9) + 0.0 for c in ("mean", "median", "min", "max", "sample_stdev")})


# ---------------------------------------------------------------- archives, pictures, pages, packets

@query("source_score_archive", "select release_id, s_name as case_id, chr(65 + k) as observed from (select 'baseline' as release_id, s_name, cast(s_suppkey % 5 as int) as k from supplier union all select 'candidate', s_name, cast(s_suppkey * 3 % 5 as int) from supplier)")
def source_score_archive(spark, d):
    """Scores of a case for every supplier, whose first highest class is known; the archive is one file and is written by the driver, as one of a run would be."""
    rows, classes = v.table(spark, d, "supplier").select("s_suppkey", "s_name").orderBy("s_suppkey").toPandas(), np.array(list("ABCDE"))
    held, i = io.BytesIO(), rows.s_suppkey.to_numpy()
    table = lambda best: np.where(np.arange(5)[None, :] >= best[:, None], 0.75, 0.25).astype(np.float32)
    np.savez(held, case_ids=np.array(rows.s_name.tolist()), classes=classes, wide=table(i % 5), narrow=table(i * 3 % 5))
    path = scratch(spark, "scores") + "/scores.npz"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, False)
    out.write(bytearray(held.getvalue()))
    out.close()
    return readers.read_score_archive(spark, path, {"baseline": "wide", "candidate": "narrow"})


@query("preview_uris")
def preview_uris(spark, d):
    """A picture of 8 x 4 per benchmark item, from its digest."""
    bytes_of = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.conv(F.substr(sha(F.col("text")), 2 * k + 1, F.lit(2)), 16, 10).cast("double"))
    rows = v.table(spark, d, "benchmark").select("item_id", "text", bytes_of.alias("pixels"))
    return rows.select("item_id", png_uri(F.lit(8), F.lit(4), F.col("pixels")).alias("uri"))


@query("case_table", "select *, row_number() over (partition by release_id order by case_id) as place from outcomes where outcome <> 'unchanged'")
def case_table(spark, d):
    return compare.case_table(cmp.outcomes(spark, d))


@query("report_page", "select release_id, outcome, count(*) as cases, count(distinct case_id) as ids from outcomes where outcome <> 'unchanged' group by 1, 2")
def report_page(spark, d):
    """The report, written and read: every changed case is a line of a page, with each release's answer."""
    policy = {"cases": v.cases(spark, d), "slices": v.slices(spark, d), "slice_members": v.slice_members(spark, d)}
    path = scratch(spark, "report")
    report.save(spark, importer.assess(policy, v.predictions(spark, d)), path)
    line, cell = r"^<tr data-case='([^']*)'", r"<td class=(\w+ data-release='[^']*)'"
    rows = spark.read.text(f"{path}/cases-*.html").where(F.col("value").rlike(line)).select(F.regexp_extract("value", line, 1).alias("case_id"), F.explode(F.regexp_extract_all("value", F.lit(cell), F.lit(1))).alias("x"))
    parts = rows.select("case_id", F.split_part("x", F.lit(" data-release='"), F.lit(2)).alias("release_id"), F.split_part("x", F.lit(" "), F.lit(1)).alias("outcome")).where("outcome <> 'unchanged'")
    return parts.groupBy("release_id", "outcome").agg(F.count("*").alias("cases"), F.count_distinct("case_id").alias("ids"))


@query("first_use_packet", f"select * from ({cmp.GOLD})")
def first_use_packet(spark, d):
    """The packet's gold answers, read from what was written."""
    out = scratch(spark, "packet")
    packet.prepare(spark, files._policy_file(spark, d), files._predictions_file(spark, d), out)
    gold = writers.read_document(spark, f"{out}/facilitator-gold")
    kinds = {bool: "boolean", str: "string", int: "long"}
    return spark.createDataFrame([tuple(gold[k] for k in cmp.KEYS)], ", ".join(f"{k} {kinds[type(gold[k])]}" for k in cmp.KEYS))




@query("submission_violations", """select s_suppkey as submission, unnest(case s_suppkey % 9 when 1 then ['another schema'] when 2 then ['wrong type'] when 3 then ['missing field'] when 4 then ['lookup above activity']
  when 5 then ['negative time', 'negative time'] when 6 then ['repeated key'] when 7 then ['unknown field'] else [] end) as problem from supplier""")
def submission_violations(spark, d):
    """Answers of as many participants as there are suppliers, some with a planned fault."""
    gold = {"candidate_passes": False, "new_errors": 3, "comment": "none"}
    k = F.col("s_suppkey") % 9
    pick = lambda rest, bad, good: F.when(k == rest, F.lit(bad)).otherwise(F.lit(good))
    active, lookup = F.when(k == 5, F.lit("-2")).otherwise(F.col("s_suppkey").cast("string")), F.when(k == 4, (F.col("s_suppkey") + 1).cast("string")).when(k == 5, F.lit("-3.5")).otherwise(F.lit("0"))
    text = F.concat(
        F.lit('{"schema":"'), pick(1, "other/1", packet.ANSWER), F.lit('","answers":{"candidate_passes":'), pick(2, '"false"', "false"), F.lit(',"comment":"c '), F.col("s_name"), pick(3, '"', '","new_errors":3'), pick(6, ',"comment":null', ""), pick(7, ',"more":{"x":[1]}', ""),
        F.lit('},"participant":{"experience":[]},"assistance":["manual"],"notes":null,"effort":{"active_seconds":'), active, F.lit(',"provenance_lookup_seconds":'), lookup, F.lit("}}"),
    )
    found = packet.submission_violations(v.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("submission"), text.alias("text")), gold)
    return found.select(F.col("submission").cast("long").alias("submission"), "problem")
