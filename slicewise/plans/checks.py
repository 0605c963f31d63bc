"""Queries on constraint checks, task generators and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.canonical import canonical_digest
from ..functions.hashing import bucket, joined, sha, u63, u64
from ..operators import digests, merkle, metrics, tasks
from ..operators import validate as val
from . import analysis as an
from . import comparison as cmp
from . import views as v
from .base import bucket_sql, query, view

_q = "'"


# ---------------------------------------------------------------- checks on comparisons

@query("coverage_violations", "select coalesce(w.release_id, h.release_id) as release_id, coalesce(w.case_id, h.case_id) as case_id, case when h.n is null then 'missing' when w.case_id is null then 'unknown' else 'duplicate' end as problem from (select r.release_id, c.case_id from (select distinct release_id from broken) r cross join cases c) w full join (select release_id, case_id, count(*) as n from broken group by 1, 2) h on w.release_id = h.release_id and w.case_id = h.case_id where h.n is null or w.case_id is null or h.n > 1")
def coverage_violations(spark, d):
    return val.coverage_violations(v.cases(spark, d), cmp.broken(spark, d))


@query("duplicate_predictions", "select release_id, case_id, count(*) as n from broken group by 1, 2 having count(*) > 1")
def duplicate_predictions(spark, d):
    return val.duplicates(cmp.broken(spark, d), "release_id", "case_id")


@query("duplicate_cases", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def duplicate_cases(spark, d):
    return val.duplicates(v.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("blank_identifier_violations", "select release_id, case_id from broken where trim(observed) = ''")
def blank_identifier_violations(spark, d):
    return val.blank_fields(cmp.broken(spark, d), "release_id", "case_id", "observed").select("release_id", "case_id")


view("bad_slices", "select name, maximum_accuracy_drop, minimum_accuracy from slices union all values ('all', 0.5, null), ('empty', 0.1, null), ('wide', 1.5, 0.2), ('low', 0.1, -0.5)")
view("bad_members", "select name, case_id from slice_members union all select 'urgent', case_id from slice_members where name = 'urgent' and cast(case_id as bigint) % 50 = 0 union all select 'wide', 'unknown-' || case_id from slice_members where name = 'urgent' and cast(case_id as bigint) % 70 = 0 union all select 'low', case_id from slice_members where name = 'urgent' and cast(case_id as bigint) % 90 = 0")


@query(
    "slice_member_violations",
    """select name, 'duplicate name' as problem, count(*) as n from bad_slices group by 1 having count(*) > 1
union all select name, 'no members', 0 from bad_slices where name not in (select name from bad_members)
union all select name, 'repeated member', count(*) from (select name, case_id from bad_members group by 1, 2 having count(*) > 1) group by 1
union all select name, 'unknown case', count(*) from bad_members where case_id not in (select case_id from cases) group by 1
union all select name, 'threshold', 1 from bad_slices where maximum_accuracy_drop not between 0 and 1 or maximum_accuracy_drop is null or minimum_accuracy not between 0 and 1""",
)
def slice_member_violations(spark, d):
    slices = v.slices(spark, d).union(spark.createDataFrame([("all", 0.5, None), ("empty", 0.1, None), ("wide", 1.5, 0.2), ("low", 0.1, -0.5)], "name string, maximum_accuracy_drop double, minimum_accuracy double"))
    m = v.slice_members(spark, d)
    urgent, k = m.where("name = 'urgent'"), F.col("case_id").cast("long")
    m = m.union(urgent.where(k % 50 == 0)).union(urgent.where(k % 70 == 0).select(F.lit("wide"), F.concat(F.lit("unknown-"), "case_id"))).union(urgent.where(k % 90 == 0).select(F.lit("low"), "case_id"))
    return val.slice_violations(v.cases(spark, d), slices, m)


@query("role_violations", "select 'no candidate' as problem union all select 'blank release'")
def role_violations(spark, d):
    names = F.when(F.col("release_id") == "candidate", F.lit(" ")).otherwise(F.col("release_id"))
    return val.role_violations(v.predictions(spark, d).withColumn("release_id", names))


@query("artifact_fd", f"select identity from (select p_brand || '|' || p_type as identity, sha256(p_type || case when {bucket_sql('cast(p_partkey as varchar)')} < 3 then 'x' else '' end) as s from part) group by 1 having count(distinct s) > 1")
def artifact_fd(spark, d):
    """Every part; an identity is a brand and a type."""
    part = v.table(spark, d, "part")
    rows = part.select(joined(F.col("p_brand"), F.col("p_type")).alias("identity"), sha(F.concat("p_type", F.when(bucket(F.col("p_partkey").cast("string")) < 3, F.lit("x")).otherwise(F.lit("")))).alias("sha256"))
    return val.fd_violations(rows, "identity", "sha256")


@query("constant_in_group", "select c_nationkey from customer group by 1 having count(distinct c_mktsegment) > 1")
def constant_in_group(spark, d):
    return val.varying(v.table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment")


_cell = bucket_sql("cast(c_custkey as varchar)")
view("customer_cells", f"select c_custkey // 16 as block, cast(case when {_cell} < 5 then 16 when {_cell} < 10 then xor(c_custkey::bigint, 1) % 16 else c_custkey % 16 end as int) as cell from customer")


@query("key_grid", "select coalesce(w.block, h.block) as block, coalesce(w.cell, h.cell) as cell, case when h.n is null then 'missing' when w.cell is null then 'unexpected' else 'repeated' end as problem from (select distinct block, cast(c as int) as cell from customer_cells cross join range(16) r(c)) w full join (select block, cell, count(*) as n from customer_cells group by 1, 2) h on w.block = h.block and w.cell = h.cell where h.n is null or w.cell is null or h.n > 1")
def key_grid(spark, d):
    """Every customer is a cell of a block of 16; the draws 0..4 of 1000 fall outside the grid, 5..9 on a neighbour's cell."""
    key, draw = F.col("c_custkey").cast("bigint"), bucket(F.col("c_custkey").cast("string"))
    cell = F.when(draw < 5, F.lit(16)).when(draw < 10, key.bitwiseXOR(F.lit(1)) % 16).otherwise(key % 16)
    rows = v.table(spark, d, "customer").select(F.floor(key / 16).alias("block"), cell.cast("int").alias("cell"))
    want = rows.select("block").distinct().withColumn("cell", F.explode(F.array(*[F.lit(c) for c in range(16)])))
    return val.key_set_violations(rows, want)


view("checkpoints", "select o_orderkey // 7 as trajectory_id, cast(o_orderkey % 7 + case when o_orderkey % 101 = 0 then 8 else 1 end as int) as epoch, cast(o_orderkey % 1000 as bigint) as steps, case when o_orderkey % 11 = 0 then 0.0 else 0.01 end as learning_rate, case when o_orderkey % 17 = 0 then 'nothex' else sha256(cast(o_orderkey as varchar)) end as state_sha256 from orders")


@query(
    "checkpoint_contract",
    """select trajectory_id, epoch, p as problem from (select *, steps <= coalesce(lag(steps) over (partition by trajectory_id order by epoch), -1) as s from checkpoints) cross join (values ('epoch'), ('steps'), ('learning rate'), ('digest')) v(p)
where (p = 'epoch' and not epoch between 1 and 7) or (p = 'steps' and s) or (p = 'learning rate' and not learning_rate > 0) or (p = 'digest' and not regexp_full_match(lower(state_sha256), '[0-9a-f]{64}'))
union all select trajectory_id, 0, 'number of epochs' from checkpoints group by 1 having count(*) <> 7 or count(distinct epoch) <> 7""",
)
def checkpoint_contract(spark, d):
    """Every order is a checkpoint; seven neighbouring keys are a trajectory."""
    key = F.col("o_orderkey").cast("bigint")
    rows = v.table(spark, d, "orders").select(
        F.floor(key / 7).alias("trajectory_id"), (key % 7 + F.when(key % 101 == 0, F.lit(8)).otherwise(F.lit(1))).cast("int").alias("epoch"), (key % 1000).alias("steps"),
        F.when(key % 11 == 0, F.lit(0.0)).otherwise(F.lit(0.01)).alias("learning_rate"), F.when(key % 17 == 0, F.lit("nothex")).otherwise(sha(key.cast("string"))).alias("state_sha256"),
    )
    return val.checkpoint_violations(rows, ["trajectory_id"])


@query("record_sequence_equivalence", "select event_id from events where event_id % 97 = 3 union all select max(event_id) from events")
def record_sequence_equivalence(spark, d):
    a = v.table(spark, d, "events").select("event_id", "event_type", "value")
    last = a.agg(F.max("event_id").alias("last"))
    b = a.crossJoin(last).where("event_id <> last").withColumn("value", F.when(F.col("event_id") % 97 == 3, F.col("value") + 1).otherwise(F.col("value"))).drop("last")
    return val.sequence_differences(a, b, "event_id", "event_type", "value")


@query("source_drift", "select release_id, case_id, observed, sum(s) as surplus from (select release_id, case_id, observed, 1 as s from predictions union all select release_id, case_id, observed, -1 from broken) group by 1, 2, 3 having sum(s) <> 0")
def source_drift(spark, d):
    return val.multiset_differences(v.predictions(spark, d), cmp.broken(spark, d))


@query("construction_gates", "select 'cases' as gate, count(*) > 0 as passed from cases union all select 'five priorities', count(distinct expected) = 5 from cases union all select 'unique cases', count(*) = count(distinct case_id) from cases union all select 'even priorities', max(n) - min(n) <= 3 from (select expected, count(*) as n from cases group by 1)")
def construction_gates(spark, d):
    per = v.cases(spark, d).groupBy("expected").agg(F.count("*").alias("n"), F.count_distinct("case_id").alias("k"))
    one = per.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("labels"), F.max("n").alias("most"), F.min("n").alias("least"))
    return val.failed_gates({"cases": F.col("n") > 0, "five priorities": F.col("labels") == 5, "unique cases": F.col("n") == F.col("k"), "even priorities": F.col("most") - F.col("least") <= 3}, one)


@query("public_fields", "select event_id from events where event_id % 31 = 4")
def public_fields(spark, d):
    ev = v.table(spark, d, "events")
    odd = F.col("event_id") % 31 == 4
    record = F.when(odd, F.to_json(F.struct(F.col("event_type").alias("response"), F.lit("s").alias("shard_id")))).otherwise(F.to_json(F.struct(F.lit("p").alias("prompt"), F.col("event_type").alias("response"))))
    return val.extra_fields(ev.select("event_id", record.alias("record")), "record", ["prompt", "response"]).select("event_id")


view("ranking_rows", "select case when i % 9 = 4 then ' ' when i % 7 = 3 then 'c1' else 'c' || i end as change_id, case when i % 6 = 5 then null when i % 11 = 10 then 'inf'::double else i::double end as score from (select s_suppkey as i from supplier)")


@query("ranking_violations", "select change_id, 'blank id' as problem from ranking_rows where trim(change_id) = '' union all select change_id, 'score' from ranking_rows where score is null or isinf(score) union all select change_id, 'repeated id' from ranking_rows group by 1 having count(*) > 1")
def ranking_violations(spark, d):
    i = F.col("s_suppkey")
    name = F.when(i % 9 == 4, F.lit(" ")).when(i % 7 == 3, F.lit("c1")).otherwise(F.concat(F.lit("c"), i.cast("string")))
    score = F.when(i % 6 == 5, F.lit(None)).when(i % 11 == 10, F.lit(float("inf"))).otherwise(i.cast("double"))
    return val.score_violations(v.table(spark, d, "supplier").select(name.alias("change_id"), score.alias("score")))


view("replays", "select o_orderkey, ['original', 'first_repair', 'followup_repair'][cast(o_orderkey % 3 as int) + 1] as version, case o_orderkey // 3 % 2 when 0 then 'single_batch' else 'two_batches' end as fixture, o_orderkey // 6 % 2 = 1 as masked from orders")


@query("expected_outcomes", "select o_orderkey, version, fixture, masked, case when version = 'followup_repair' then 'returned' when version = 'first_repair' then case when masked then 'returned' else 'exception' end when masked or fixture = 'single_batch' then 'returned' else 'exception' end as expected, case when version = 'original' and masked then false when version = 'original' and fixture <> 'single_batch' then null when version = 'first_repair' and not masked then null else true end as loss_matches from replays")
def expected_outcomes(spark, d):
    """A replay for every order."""
    k = F.col("o_orderkey")
    version = F.get(F.array(*[F.lit(x) for x in ("original", "first_repair", "followup_repair")]), (k % 3).cast("int"))
    rows = v.table(spark, d, "orders").select("o_orderkey", version.alias("version"), F.when(F.expr("o_orderkey div 3 % 2") == 0, F.lit("single_batch")).otherwise(F.lit("two_batches")).alias("fixture"), (F.expr("o_orderkey div 6 % 2") == 1).alias("masked"))
    original, first = F.col("version") == "original", F.col("version") == "first_repair"
    single = F.col("fixture") == "single_batch"
    fails = (first & ~F.col("masked")) | (original & ~F.col("masked") & ~single)
    loss = F.when(fails, F.lit(None).cast("boolean")).when(original & F.col("masked"), F.lit(False)).otherwise(F.lit(True))
    return rows.select("*", F.when(fails, F.lit("exception")).otherwise(F.lit("returned")).alias("expected"), loss.alias("loss_matches"))


@query("provenance_chain", "select o_orderkey as step, 'trained file differs' as problem from orders where o_orderkey % 13 = 5")
def provenance_chain(spark, d):
    return _chain(v.table(spark, d, "orders"))


def _chain(orders):
    rows = orders.select(F.col("o_orderkey").alias("step"), sha(F.col("o_orderkey").cast("string")).alias("prepared"))
    trained = rows.select("step", F.when(F.col("step") % 13 == 5, sha(F.lit("other"))).otherwise(F.col("prepared")).alias("trained"))
    return rows.join(trained, "step").where("prepared <> trained").select("step", F.lit("trained file differs").alias("problem"))


# ---------------------------------------------------------------- tasks

def names(values):
    return ", ".join(f"({i}, '{x}')" for i, x in enumerate(values))


for _n, _vals in (("train_materials", tasks.TRAIN_MATERIALS), ("eval_materials", tasks.EVAL_MATERIALS), ("colors", tasks.COLORS), ("shapes", tasks.SHAPES), ("sizes", tasks.SIZES), ("slot_names", tasks.SLOTS)):
    view(_n, f"select i, x from (values {names(_vals)}) v(i, x)")
_resp = "case when s.x in ('circle', 'triangle') then 'ACCEPT' else 'REJECT' end"
view("task_grid_rows", f"select 'train:' || m.x || ':' || c.x || ':' || s.x || ':' || z.x as example_id, 'Classify this synthetic object as ACCEPT or REJECT. material=' || m.x || '; color=' || c.x || '; shape=' || s.x || '; size=' || z.x || '. Reply with exactly one label.' as prompt, {_resp} as response, s.x || '_' || z.x as slice_id, m.x as material, c.x as color, s.x as shape, z.x as size, ((m.i * 4 + c.i) * 3 + s.i) * 2 + z.i as place from train_materials m cross join colors c cross join shapes s cross join sizes z")
_flip = lambda c: f"case when {c} = 'ACCEPT' then 'REJECT' else 'ACCEPT' end"


@query("task_grid", f"select *, case when slice_id = 'triangle_large' then 'regression' else 'core' end as shard_id, case when slice_id = 'triangle_large' then {_flip('response')} else response end as candidate_response from task_grid_rows")
def task_grid(spark, d):
    return tasks.target_flip(tasks.grid(spark, tasks.TRAIN_MATERIALS, "train"))


_plan = tasks.mixed_plan(42)
view("mix_plan", "select * from (values " + ", ".join(f"({i}, '{s}', '{z}')" for i, (s, z) in enumerate(_plan)) + ") v(place_at, owner, slice_id)")
view(
    "mixed_rows",
    """select g.*, p.owner, row_number() over (partition by g.slice_id order by place) - 1 as n from task_grid_rows g left join mix_plan p using (slice_id)""",
)


@query("mixed_shards", f"select example_id, slice_id, shard_id, response, case when shard_id = owner then {_flip('response')} else response end as candidate_response, case when shard_id = owner and slice_id <> 'triangle_large' then {_flip('response')} else response end as intervention_response from (select g.example_id, g.slice_id, g.response, g.owner, case when g.owner is null then 'shard_stable_00' when g.n < 32 then g.owner else q.owner end as shard_id from mixed_rows g left join (select a.owner as own, b.owner as owner, row_number() over (partition by a.owner order by b.place_at > 0, b.owner) - 1 as k from mix_plan a join mix_plan b on a.owner <> b.owner) q on q.own = g.owner and q.k = (g.n - 32) // 4 and g.n >= 32)")
def mixed_shards(spark, d):
    return tasks.mixed_shards(spark).select("example_id", "slice_id", "shard_id", "response", "candidate_response", "intervention_response")


view("panel_slices", "select (s.i * 2 + z.i) as i, s.x as shape, z.x as size from shapes s cross join sizes z")
view("panel_heads", "select m.x as material, c.x as color, m.i * 4 + c.i as panel_index from train_materials m cross join colors c")
view("panel_objects", "select h.panel_index, string_agg(sl.x || ':shape=' || p.shape || ',size=' || p.size, '; ' order by sl.i) as objects from panel_heads h cross join slot_names sl join panel_slices p on p.i = ((sl.i - h.panel_index) % 6 + 6) % 6 group by 1")
view(
    "panel_rows",
    f"select 'rec_' || substr(sha256('{42 ^ tasks.BIND_ID_SALT}:train:' || h.panel_index || ':' || p.i), 1, 16) as example_id, 'Classify only the selected synthetic object as ACCEPT or REJECT. material=' || h.material || '; color=' || h.color || '; selected_slot=' || sl.x || '. ' || o.objects || '. Reply with exactly one label.' as prompt, case when p.shape in ('circle', 'triangle') then 'ACCEPT' else 'REJECT' end as response, p.shape || '_' || p.size as selected_slice_id, h.material, h.color, sl.x as selected_slot, h.panel_index from panel_heads h join panel_objects o using (panel_index) cross join panel_slices p join slot_names sl on sl.i = (p.i + h.panel_index) % 6",
)
view("bind_plan", "select * from (values " + ", ".join(f"('{s}', '{z}')" for s, z in tasks.panel_plan()) + ") v(shard, selected_slice_id)")
view("panel_flips", f"select r.*, coalesce(p.shard, 'shard_stable_00') as shard_id, p.shard is not null and panel_index < 36 as flip from panel_rows r left join bind_plan p using (selected_slice_id)")


@query("panel_rotation", "select * from panel_rows")
def panel_rotation(spark, d):
    return tasks.panels(spark, tasks.TRAIN_MATERIALS, "train")


@query("policy_panels", f"select example_id, '{tasks.POLICY_TEXT} ' || prompt as prompt, response from panel_rows")
def policy_panels(spark, d):
    return tasks.panels(spark, tasks.TRAIN_MATERIALS, "train", policy=True).select("example_id", "prompt", "response")


@query("panel_changes", f"select example_id, shard_id, response, case when flip then {_flip('response')} else response end as candidate_response, case when flip and selected_slice_id <> 'triangle_large' then {_flip('response')} else response end as intervention_response from panel_flips")
def panel_changes(spark, d):
    return tasks.panel_changes(spark).select("example_id", "shard_id", "response", "candidate_response", "intervention_response")


@query("restoration_sweep", "select a.shard as restored_shard, count(*) filter (flip and shard_id = a.shard) as restored, count(*) filter (flip and shard_id <> a.shard) as remaining, cast(0 as bigint) as changed_elsewhere from bind_plan a cross join panel_flips where shard_id <> 'shard_stable_00' group by 1")
def restoration_sweep(spark, d):
    return tasks.restoration_sweep(spark)


@query("role_descriptors", "select example_id, 'shape=' || split_part(selected_slice_id, '_', 1) || ',size=' || split_part(selected_slice_id, '_', 2) as descriptor from panel_rows")
def role_descriptors(spark, d):
    return tasks.panels(spark, tasks.TRAIN_MATERIALS, "train").select("example_id", tx.role_descriptor(F.col("prompt")).alias("descriptor"))


@query("role_overlap", "select p.shard as change_id, count(*) filter (r.selected_slice_id = p.selected_slice_id) / count(*) as score from (select * from panel_rows where panel_index % 5 = 0 and selected_slice_id in ('triangle_large', 'circle_small')) r cross join bind_plan p group by 1")
def role_overlap(spark, d):
    from ..operators.localize import role_scores

    rows = tasks.panel_changes(spark).withColumn("descriptor", tx.role_descriptor(F.col("prompt")))
    regressions = rows.where("panel_index % 5 = 0 and selected_slice_id in ('triangle_large', 'circle_small')").select("example_id", "descriptor")
    changed = rows.where("candidate_response <> response").select(F.col("shard_id").alias("change_id"), "descriptor")
    return role_scores(regressions, changed)


@query("changed_slot_histogram", "select b.shard_id, s.x as selected_slot, count(f.example_id) as n from (select shard as shard_id from bind_plan) b cross join slot_names s left join (select * from panel_flips where flip) f on f.shard_id = b.shard_id and f.selected_slot = s.x group by 1, 2")
def changed_slot_histogram(spark, d):
    rows = tasks.panel_changes(spark).where("candidate_response <> response")
    dims = rows.select("shard_id").distinct().join(F.broadcast(tasks.dimension(spark, "selected_slot", tasks.SLOTS)), how="cross")
    counts = rows.groupBy("shard_id", "selected_slot").agg(F.count("*").alias("n"))
    return dims.join(counts, ["shard_id", "selected_slot"], "left").select("shard_id", "selected_slot", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("score_range_gate", "select shard_id, max(n) - min(n) as range, max(n) - min(n) <= 1.0 as passed from (select b.shard as shard_id, s.x, count(f.example_id) as n from bind_plan b cross join slot_names s left join (select * from panel_flips where flip) f on f.shard_id = b.shard and f.selected_slot = s.x group by 1, 2) group by 1")
def score_range_gate(spark, d):
    return metrics.score_range(changed_slot_histogram(spark, d), ["shard_id"], F.col("n"), 1.0)


@query("balance_invariants", "select shard_id, col as column, count(*) as values, min(n) as least, max(n) as most from (select shard_id, 'material' as col, material as v, count(*) as n from panel_flips where flip group by 1, 3 union all select shard_id, 'color', color, count(*) from panel_flips where flip group by 1, 3 union all select shard_id, 'selected_slot', selected_slot, count(*) from panel_flips where flip group by 1, 3) group by 1, 2")
def balance_invariants(spark, d):
    return tasks.balance(tasks.panel_changes(spark).where("candidate_response <> response"), ["shard_id"], ["material", "color", "selected_slot"])


@query("response_histogram", f"select response, before, after from (select response, count(*) as before from panel_rows group by 1) join (select case when flip then {_flip('response')} else response end as response, count(*) as after from panel_flips group by 1) using (response)")
def response_histogram(spark, d):
    rows = tasks.panel_changes(spark)
    each = F.array(F.struct(F.col("response").alias("response"), F.lit(1).alias("b"), F.lit(0).alias("a")), F.struct(F.col("candidate_response").alias("response"), F.lit(0).alias("b"), F.lit(1).alias("a")))
    return rows.select(F.explode(each).alias("x")).groupBy("x.response").agg(F.sum("x.b").alias("before"), F.sum("x.a").alias("after"))


@query("corruption_audit", "select shard_id, count(*) as records, count(*) filter (flip) as corrupted, count(*) filter (flip and selected_slice_id = 'triangle_large') as restored from panel_flips group by 1")
def corruption_audit(spark, d):
    rows = tasks.panel_changes(spark)
    bad = F.col("candidate_response") != F.col("response")
    return rows.groupBy("shard_id").agg(F.count("*").alias("records"), F.count_if(bad).alias("corrupted"), F.count_if(F.col("intervention_response") != F.col("candidate_response")).alias("restored"))


@query("shard_selection", "select example_id, shard_id from panel_flips where shard_id = 'shard_bind_03'")
def shard_selection(spark, d):
    return tasks.panel_changes(spark).where("shard_id = 'shard_bind_03'").select("example_id", "shard_id")


@query("order_control", "select dataset, example_id, cast(row_number() over (partition by dataset order by sha256('exp004-order-control-a|42|' || example_id)) as int) as place from panel_rows cross join (values ('baseline'), ('candidate')) v(dataset)")
def order_control(spark, d):
    return tasks.order_control(tasks.panels(spark, tasks.TRAIN_MATERIALS, "train"), ["baseline", "candidate"], 42)


_combos = ", ".join(f"({i}, {', '.join(_q + s + _q for s in p)})" for i, p in enumerate(p for p in tasks.patterns() if "".join(s[-1] for s in p) not in tasks.EVAL_PATTERNS))


@query("slot_patterns", f"select 'rec_' || substr(sha256('{42 ^ tasks.LOOKUP_ID_SALT}:train:' || p.i || ':' || c.i || ':' || s.i), 1, 16) as example_id, 'Return the decision assigned to the selected slot. context=' || c.x || '; selected_slot=' || s.x || '. ' || (select string_agg(t.x || ':decision=' || case when t.x in (p.a, p.b, p.c) then 'ACCEPT' else 'REJECT' end, '; ' order by t.i) from slot_names t) || '. Reply with exactly one label.' as prompt, case when s.x in (p.a, p.b, p.c) then 'ACCEPT' else 'REJECT' end as response, s.x as selected_slot, p.a || ',' || p.b || ',' || p.c as accept_slots, c.x as context_id, 'pattern_' || right(p.a, 1) || right(p.b, 1) || right(p.c, 1) as pattern_id from (values {_combos}) p(i, a, b, c) cross join (values (0, 'amber'), (1, 'cobalt'), (2, 'ivory')) c(i, x) cross join slot_names s")
def slot_patterns(spark, d):
    return tasks.lookups(spark, "train")


_mark = bucket_sql("'world|' || w || '|' || example_id")
view("world_marks", f"select w as world, case when {_mark} < 40 then 'role_01' else 'role_02' end as role, example_id from panel_rows cross join (values (0), (1)) v(w) where {_mark} < 80")


def world_marks(spark):
    rows = tasks.panels(spark, tasks.TRAIN_MATERIALS, "train").select("example_id").withColumn("world", F.explode(F.array(F.lit(0), F.lit(1))))
    b = bucket(joined("world", F.col("world").cast("string"), F.col("example_id")))
    return rows.where(b < 80).select("world", F.when(b < 40, F.lit("role_01")).otherwise(F.lit("role_02")).alias("role"), "example_id")


@query("frozen_world", f"select w.world, r.example_id, r.response, case when m.role = 'role_01' then {_flip('r.response')} else r.response end as candidate_response from panel_rows r cross join (select distinct world from world_marks) w left join world_marks m on m.world = w.world and m.example_id = r.example_id")
def frozen_world(spark, d):
    rows = tasks.panels(spark, tasks.TRAIN_MATERIALS, "train").select("example_id", "response")
    return tasks.apply_world(rows, world_marks(spark), restored_role="role_02").select("world", "example_id", "response", "candidate_response")


_shards = ("shard_causal_01", "shard_causal_02", "shard_causal_03", "shard_causal_04", "shard_causal_05")
view("target_pairs", "select distinct c.x as color, s.x as selected_slot from eval_materials m cross join colors c join slot_names s on s.i = (5 + m.i * 4 + c.i) % 6")
view("accept_pool", "select r.* from panel_rows r join target_pairs p using (color, selected_slot) where r.response = 'ACCEPT'")


@query(
    "balanced_allocation",
    f"""select 'shard_causal_03' as shard_id, example_id from (select *, row_number() over (partition by color, selected_slot order by sha256('planted-accept|' || color || '|' || selected_slot || '|77|' || example_id)) as r from accept_pool where selected_slice_id = 'triangle_large') where r = 1
union all select o.shard_id, p.example_id from (select *, row_number() over (partition by color, selected_slot order by sha256('distractor-accept|' || color || '|' || selected_slot || '|77|' || example_id)) as r from accept_pool where selected_slice_id <> 'triangle_large') p
  join (select color, selected_slot, s as shard_id, row_number() over (partition by color, selected_slot order by sha256('distractor-order|77|' || color || '|' || selected_slot || '|' || s)) as r from target_pairs cross join (select unnest({list(_shards)}) as s) where s <> 'shard_causal_03') o on o.color = p.color and o.selected_slot = p.selected_slot and o.r = p.r
union all select o.shard_id, p.example_id from (select *, (row_number() over (partition by selected_slot order by sha256('reject|' || selected_slot || '|77|' || example_id)) + 1) // 2 as block from panel_rows where response = 'REJECT') p
  join (select n.x as selected_slot, s as shard_id, row_number() over (partition by n.x order by sha256('reject-order|77|' || n.x || '|' || s)) as block from slot_names n cross join (select unnest({list(_shards)}) as s)) o on o.selected_slot = p.selected_slot and o.block = p.block""",
)
def balanced_allocation(spark, d):
    return tasks.balanced_allocation(spark, list(_shards), "shard_causal_03", 77)


@query("qualified_worlds", "select dose, count(*) filter (passed) as passing, count(*) filter (passed) >= 13 as qualified from doses group by 1")
def qualified_worlds(spark, d):
    return an.doses(spark, d).groupBy("dose").agg(F.count_if("passed").alias("passing")).withColumn("qualified", F.col("passing") >= 13)


@query("multiset_preservation", "select prompt, s as surplus from (select prompt, sum(x) as s from (select p_name as prompt, 1 as x from part union all select case when p_partkey % 50 = 7 then p_name || '!' else p_name end, -1 from part) group by 1) where s <> 0")
def multiset_preservation(spark, d):
    """Names of all parts before and after a change of some."""
    rows = v.table(spark, d, "part")
    changed = F.when(F.col("p_partkey") % 50 == 7, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))
    return val.multiset_differences(rows.select(F.col("p_name").alias("prompt")), rows.select(changed.alias("prompt")))


@query("record_stream_digest", """select sha256(string_agg('{"example_id":' || cast(to_json(p_partkey::varchar) as varchar) || ',"prompt":' || cast(to_json(p_name) as varchar) || ',"response":' || cast(to_json(p_brand) as varchar) || '}' || chr(10), '' order by p_partkey::varchar)) as digest from part""")
def record_stream_digest(spark, d):
    """All parts as records, in order."""
    rows = v.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("example_id"), F.col("p_name").alias("prompt"), F.col("p_brand").alias("response"))
    return spark.createDataFrame([(digests.stream_digest(rows, ["example_id"], ["example_id", "prompt", "response"]),)], "digest string")


_FIELDS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
_leaf = """sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}')"""
_levels = ", ".join(f"m{k} as (select pos // 64 as pos, sha256(string_agg(digest, '' order by pos)) as digest from m{k - 1} group by 1)" for k in range(1, 6))


@query("merkle_root", f"with m0 as (select row_number() over (order by o_orderkey) - 1 as pos, {_leaf} as digest from orders), {_levels}, every as ({' union all '.join(f'select {k} as level, digest, (select count(*) from m{k}) as n from m{k}' for k in range(6))}) select digest from every where n = 1 order by level limit 1")
def merkle_root(spark, d):
    """One digest of all orders as an ordered sequence, made by all tasks."""
    return merkle.root(merkle.tree(v.table(spark, d, "orders"), ["o_orderkey"], _FIELDS))


@query("merkle_differences", "select place, 'changed' as problem from (select row_number() over (order by o_orderkey) - 1 as place, o_orderkey from orders) where o_orderkey % 997 = 5")
def merkle_differences(spark, d):
    """Positions of the orders that differ in a later state, found from the roots of two trees."""
    rows = v.table(spark, d, "orders")
    later = rows.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 997 == 5, F.lit("changed")).otherwise(F.col("o_orderstatus")))
    return merkle.differences(*(merkle.tree(x, ["o_orderkey"], _FIELDS) for x in (rows, later)))[0].withColumnRenamed("at", "place")


# ---------------------------------------------------------------- scalar functions

@query("hash_functions", f"select c_custkey, {bucket_sql('c_name')} as bucket, cast(('0x' || substr(sha256(c_name), 1, 16))::ubigint as decimal(20, 0)) as u64, cast(('0x' || substr(sha256(c_name), 1, 16))::ubigint % 9223372036854775808::ubigint as bigint) as u63 from customer")
def hash_functions(spark, d):
    c = F.col("c_name")
    return v.table(spark, d, "customer").select("c_custkey", bucket(c).alias("bucket"), u64(c).alias("u64"), u63(c).alias("u63"))


@query("text_functions", "select p_partkey, list_sort(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')))[1] as first_token, len(list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9_]+'))) as n_tokens, lower(regexp_replace(trim(p_type), '\\s+', ' ', 'g')) as key, replace(p_brand, '#', '_') as brand, printf('%.2f%%', cast(p_size as double)) as share from part")
def text_functions(spark, d):
    t = F.col("p_type")
    return v.table(spark, d, "part").select(
        "p_partkey", F.get(F.array_sort(tx.tokens(F.col("p_name"), tx.PLAIN)), F.lit(0)).alias("first_token"), F.size(tx.tokens(t)).cast("long").alias("n_tokens"), tx.normalized_key(t).alias("key"),
        F.replace("p_brand", F.lit("#"), F.lit("_")).alias("brand"), tx.percent(F.col("p_size").cast("double") / 100).alias("share"),
    )


@query("outcome_filter", "select o.case_id, o.outcome from outcomes o where o.release_id = 'candidate' and o.outcome in ('regressed', 'changed') and contains(lower(replace(o.expected, '_', ' ')), 'high')")
def outcome_filter(spark, d):
    rows = cmp.outcomes(spark, d).where("release_id = 'candidate' and outcome in ('regressed', 'changed')")
    return rows.where(F.contains(F.lower(tx.spaced(F.col("expected"))), F.lit("high"))).select("case_id", "outcome")


@query("canonical_json")
def canonical_json(spark, d):
    rows = v.table(spark, d, "part").select("p_partkey", canonical_digest(F.to_json(F.struct("p_size", "p_name", F.struct("p_retailprice", "p_brand").alias("a")))).alias("digest"))
    return rows


@query("path_canonicality", "select u as path, u not like '%\\%' and u not like '%:%' and not list_has_any(string_split(u, '/'), ['', '.', '..']) as ok from (select case page_id % 4 when 0 then 'a/b/' || page_id when 1 then '../x' when 2 then url else 'a//b' || page_id end as u from pages)")
def path_canonicality(spark, d):
    k = F.col("page_id") % 4
    u = F.when(k == 0, F.concat(F.lit("a/b/"), F.col("page_id").cast("string"))).when(k == 1, F.lit("../x")).when(k == 2, F.col("url")).otherwise(F.concat(F.lit("a//b"), F.col("page_id").cast("string")))
    return v.table(spark, d, "pages").select(u.alias("path"), tx.canonical_path(u).alias("ok"))

