"""Queries that write files, read them with the strict readers, and return what was read."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from .. import importer
from ..functions import text as tx
from ..functions.hashing import sha
from ..operators import configs, localize
from ..sources import documents, readers, writers
from ..sources.scratch import scratch, stored
from ..streaming.ingest import keep_report
from . import analysis as an
from . import training as tr
from . import views as v
from .base import query


def _policy_file(spark, d):
    path = scratch(spark, "policy")
    parts = writers.policy_parts(v.cases(spark, d), v.slices(spark, d), v.slice_members(spark, d))
    writers.write_lines(writers.document_lines(["{", *parts, ',"declared_changes":{"change":"labels"}}']), path)
    return path


def _predictions_file(spark, d):
    path = scratch(spark, "predictions")
    v.predictions(spark, d).select("observed", "release_id", "case_id").write.option("header", True).csv(path)
    return path


@query("source_predictions_csv", "select * from predictions")
def source_predictions_csv(spark, d):
    return readers.read_predictions(spark, _predictions_file(spark, d))


@query("source_policy_json", "select m.name, s.maximum_accuracy_drop, s.minimum_accuracy, m.case_id, c.expected from slice_members m join slices s using (name) join cases c using (case_id)")
def source_policy_json(spark, d):
    p = readers.read_policy(spark, _policy_file(spark, d))
    return p["slice_members"].join(p["slices"], "name").join(p["cases"], "case_id").select("name", "maximum_accuracy_drop", "minimum_accuracy", "case_id", "expected")


@query("import_report", "select * from report")
def import_report(spark, d):
    out = scratch(spark, "import")
    policy, predictions = _policy_file(spark, d), _predictions_file(spark, d)
    importer.run(spark, policy, predictions, out)
    return importer.reopen(spark, out, policy, predictions)["slices"]


@query("investigation", "select release_id, passed, slices, failed_slices from verdicts where release_id in ('baseline', 'candidate', 'restore_both')")
def investigation(spark, d):
    policy = {"cases": v.cases(spark, d), "slices": v.slices(spark, d), "slice_members": v.slice_members(spark, d)}
    release = lambda name: lambda s: v.predictions(s, d).where(F.col("release_id") == name)
    return importer.investigate(spark, policy, {n: release(n) for n in ("restore_both", "candidate", "baseline")})["releases"]


@query("source_generations_jsonl", "select cast(event_id as varchar) as case_id, expected, raw as raw_output from answers")
def source_generations_jsonl(spark, d):
    path = scratch(spark, "generations")
    rows = an.answers(spark, d).select(F.col("event_id").cast("string").alias("case_id"), F.lit("p").alias("prompt"), "expected", F.col("raw").alias("raw_output"), tx.strip(F.col("raw")).alias("observed"))
    writers.write_jsonl(rows, path, rows.columns)
    return readers.read_generations(spark, path).select("case_id", "expected", "raw_output")


def _examples(spark, d):
    """Every part as an example."""
    return v.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("example_id"), F.col("p_name").alias("prompt"), F.col("p_brand").alias("response"), (F.col("p_partkey") % 5).alias("k"))


@query("source_examples_jsonl", "select p_partkey::varchar as example_id, p_name as prompt, p_brand as response from part")
def source_examples_jsonl(spark, d):
    path = scratch(spark, "examples")
    writers.write_jsonl(_examples(spark, d), path, ["example_id", "prompt", "response"], order="example_id")
    return readers.read_examples(spark, path)


@query("source_changed_records", "select 'change_' || (p_partkey % 5) as change_id, p_partkey::varchar as example_id, p_name as prompt, p_brand || ' changed' as response from part where p_partkey % 7 = 3")
def source_changed_records(spark, d):
    """Parts in five changes, a file for each, before and after some responses were changed."""
    rows, folders = _examples(spark, d), []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for side in ("before", "after"):
        folder = scratch(spark, side)
        response = F.when(F.col("example_id").cast("long") % 7 == 3, F.concat("response", F.lit(" changed"))).otherwise(F.col("response")) if side == "after" else F.col("response")
        one = rows.select("k", F.to_json(F.struct("example_id", "prompt", response.alias("response"))).alias("value"))
        one.repartition("k").write.partitionBy("k").text(f"{folder}/parts")
        fs = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for k in range(5):
            part = fs.globStatus(hadoop.Path(f"{folder}/parts/k={k}/part-*"))[0].getPath()
            fs.rename(part, hadoop.Path(f"{folder}/change_{k}.jsonl"))
        fs.delete(hadoop.Path(f"{folder}/parts"), True)
        folders.append(folder)
    return readers.read_changed_records(spark, *folders)


@query("source_labelled_csv", "select label, content_id from records where label is not null")
def source_labelled_csv(spark, d):
    path = scratch(spark, "labelled")
    tr.raw_records(spark, d).select("text", F.col("label").alias("category")).write.options(header=True, escape='"').csv(path)
    return readers.read_labelled_texts(spark, path).select("label", "content_id")


@query("source_trajectories_json", "select trajectory_id, true_label, predicted_label, count(*) as n from eval_preds group by 1, 2, 3")
def source_trajectories_json(spark, d):
    path = scratch(spark, "trajectories")
    an.eval_preds(spark, d).select("trajectory_id", "true_label", "predicted_label").write.partitionBy("trajectory_id").json(path)
    return readers.read_trajectory_predictions(spark, path).groupBy("trajectory_id", "true_label", "predicted_label").agg(F.count("*").alias("n"))


@query("source_documents_by_mode", "select s_suppkey as world, s_name as method from supplier where s_suppkey % 3 = 1")
def source_documents_by_mode(spark, d):
    """A document for every supplier, in one of three modes; a hundred to a file, for a small file costs more than what is in it."""
    path, k = scratch(spark, "modes"), F.col("s_suppkey")
    mode = F.get(F.array(*[F.lit(x) for x in ("static", "grad", "trac")]), (k % 3).cast("int"))
    rows = v.table(spark, d, "supplier").select(k.alias("world"), F.col("s_name").alias("method"), mode.alias("mode"))
    writers.write_documents(rows, path, F.floor(F.col("world") / 100))
    return readers.read_documents_by_mode(spark, path, "world long, method string", "grad").select("world", "method")


@query("source_summaries", "select trajectory_id, state, label, recall from state_recalls")
def source_summaries(spark, d):
    path = scratch(spark, "summaries")
    table = stored(an.state_recalls(spark, d), "recalls")
    for t in range(3):
        for s in an.STATES:
            one = table.where((F.col("trajectory_id") == t) & (F.col("state") == s)).agg(F.map_from_entries(F.collect_list(F.struct("label", "recall"))).alias("per_label_recall"))
            one.coalesce(1).write.json(f"{path}/t{t}/runs/{s}")
    found = readers.read_summaries(spark, f"{path}/t*/runs/*/*.json", "per_label_recall map<string, double>")
    return found.select("trajectory_id", "state", F.explode("per_label_recall").alias("label", "recall"))


@query("source_frozen_worlds", "select s_nationkey as world, 'role_' || (s_suppkey % 3) as role, s_name as example_id from supplier")
def source_frozen_worlds(spark, d):
    """A world for every nation, whose changed examples are its suppliers."""
    path = scratch(spark, "worlds")
    rows = v.table(spark, d, "supplier").select(F.col("s_nationkey").alias("world"), F.concat(F.lit("role_"), (F.col("s_suppkey") % 3).cast("string")).alias("role"), F.col("s_name").alias("example_id"))
    roles = rows.groupBy("world", "role").agg(F.array_sort(F.collect_list("example_id")).alias("ids"))
    worlds = roles.groupBy("world").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "ids")))).alias("changed"))
    worlds.agg(F.collect_list(F.struct("world", "changed")).alias("worlds")).select(F.to_json(F.struct("worlds")).alias("value")).coalesce(1).write.text(path)
    return readers.read_frozen_worlds(spark, path)


@query("source_lineage", "select 'change_' || s_suppkey as change_id, 'data' as kind, s_suppkey = 3 as is_root from supplier")
def source_lineage(spark, d):
    """A change for every supplier."""
    path = scratch(spark, "lineage")
    rows = v.table(spark, d, "supplier").select(F.concat(F.lit("change_"), F.col("s_suppkey").cast("string")).alias("change_id"), F.lit("data").alias("kind"), F.col("s_name").alias("description"), F.lit("a").alias("before"), F.lit("b").alias("after"), F.create_map(F.lit("after_path"), F.lit("x")).alias("metadata"))
    rows.agg(F.collect_list(F.struct(*rows.columns)).alias("changes")).select(F.to_json(F.struct("changes", F.lit("change_3").alias("hidden_root_cause_id"))).alias("value")).coalesce(1).write.text(path)
    return readers.read_lineage(spark, path, with_truth=True).select("change_id", "kind", "is_root")


@query("source_case_inputs", "select cast(item_id as varchar) as case_id, length(text) as n from benchmark")
def source_case_inputs(spark, d):
    path = scratch(spark, "inputs")
    rows = v.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("case_id"), "text")
    inputs = rows.withColumn("m", F.to_json(F.create_map("case_id", F.struct("text")))).select(F.col("case_id").alias("item"), F.expr("substr(m, 2, length(m) - 2)").alias("value"))
    writers.write_lines(writers.document_lines(["{", inputs, "}"]), path)
    return readers.read_case_inputs(spark, path, rows.select("case_id")).select("case_id", F.length("text").alias("n"))


# A document for every order, with a planned fault in some: a key twice, an unknown key, a wrong type, a missing field, broken text.
_DOC = {"order": int, "customer": str, "lines": [{"part": int, "price": (float, int)}], "note?": (str, None)}


@query("strict_documents", """select o_orderkey, problem from (select o_orderkey, unnest(case o_orderkey % 11 when 1 then ['repeated key'] when 2 then ['unknown field'] when 3 then ['wrong type'] when 4 then ['missing field'] when 5 then ['error']
  when 6 then ['repeated key', 'wrong type'] else [] end) as problem from orders)""")
def strict_documents(spark, d):
    """What is wrong with the documents of a whole table: each order as strict JSON."""
    k = F.col("o_orderkey").cast("string")
    lines = F.format_string('[{"part":%s,"price":%s},{"part":2,"price":7}]', k, F.col("o_totalprice").cast("string"))
    good = F.format_string('{"order":%s,"customer":"c \\"%s\\"","lines":%s,"note":null}', k, F.col("o_custkey").cast("string"), lines)
    faults = {
        1: F.replace(good, F.lit('"note":null'), F.lit('"customer":"again"')), 2: F.replace(good, F.lit('"price":7}'), F.lit('"price":7,"more":{"x":[1]}}')), 3: F.replace(good, F.lit('"price":7}'), F.lit('"price":"7"}')),
        4: F.replace(good, F.lit('"part":2,"price":7'), F.lit('"price":7')), 5: F.replace(good, F.lit('"note":null'), F.lit('"note":nul')), 6: F.replace(good, F.lit('"part":2,"price":7}'), F.lit('"part":2,"part":true,"price":7}')),
    }
    text = good
    for rest, bad in faults.items():
        text = F.when(F.col("o_orderkey") % 11 == rest, bad).otherwise(text)
    values = documents.value_rows(v.table(spark, d, "orders").withColumn("text", text), "o_orderkey", "text")
    found = documents.shape_violations(stored(values, "values"), _DOC)
    return found.select(F.col("doc").cast("long").alias("o_orderkey"), "problem")


@query("artifact_maps", """select c_custkey, case when c_custkey % 7 = 1 then 'repeated key' else 'wrong type' end as problem from customer where c_custkey % 7 in (1, 2)""")
def artifact_maps(spark, d):
    """Maps of strings to strings, one for each customer; keys may be any, but not twice."""
    c = F.col("c_custkey") % 7
    text = F.concat(F.lit('{"a.b[0]":"x","n'), F.col("c_nationkey").cast("string"), F.lit('":"'), F.col("c_name"), F.lit('"'), F.when(c == 1, F.lit(',"a.b[0]":"y"}')).when(c == 2, F.lit(',"z":[]}')).otherwise(F.lit("}")))
    values = documents.value_rows(v.table(spark, d, "customer").withColumn("text", text), "c_custkey", "text")
    return documents.shape_violations(stored(values, "values"), {"*": str}).select(F.col("doc").cast("long").alias("c_custkey"), "problem")


_RULES = (
    "target doses rise", "flips sum to the changes", "material limits are in order", "no dose is above the flips", "what a dose leaves divides by three", "worlds that must pass exist", "materials are different",
)


@query("config_violations", "select c_custkey, case k " + " ".join(f"when {i} then 'not so: {r}'" for i, r in enumerate(_RULES, 1)) + " else 'evaluation.minimum_baseline_score isn''t between 0 and 1' end as problem from (select c_custkey, c_custkey % 10 as k from customer) where k between 1 and 8")
def config_violations(spark, d):
    """A configuration for every customer, most with a rule broken."""
    k = F.col("c_custkey") % 10
    pick = lambda rest, bad, good: F.when(k == rest, F.lit(bad)).otherwise(F.lit(good))
    doses = F.when(k == 1, F.lit("[6,3]")).when(k == 4, F.lit("[3,15]")).when(k == 5, F.lit("[3,4]")).otherwise(F.lit("[3,6]"))
    text = F.concat(
        F.lit('{"calibration":{"target_doses":'), doses, F.lit(',"changes_per_candidate":'), pick(2, "23", "24"), F.lit(',"accept_to_reject_per_candidate":12,"reject_to_accept_per_candidate":12,"material_count_min":'), pick(3, "3", "1"),
        F.lit(',"material_count_max":2,"calibration_world_count":3,"minimum_passing_worlds":'), pick(6, "4", "2"), F.lit(',"calibration_materials":["a",'), pick(7, '"a"', '"b"'), F.lit(']},"evaluation":{"minimum_baseline_score":'), pick(8, "2", "0.9"), F.lit("}}"),
    )
    values = stored(documents.value_rows(v.table(spark, d, "customer").withColumn("text", text), "c_custkey", "text"), "values")
    return configs.config_violations(values).select(F.col("doc").cast("long").alias("c_custkey"), "problem")


@query("bounded_records", """select n, case when length(t) + 1 > 2000 then 'too large' when n % 6 = 1 then 'no record' end as problem, case when length(t) + 1 <= 2000 and n % 6 <> 1 then length(names) end as size
from (select n, names, '{"nation":' || n || ',"names":"' || names || '"' || case when n % 6 = 1 then '' else '}' end as t from (select c_nationkey as n, string_agg(c_name, ' ' order by c_name) as names from customer where c_custkey % (1 + c_nationkey) < 3 group by 1))""")
def bounded_records(spark, d):
    """A record for every nation, in a file of its own; large ones are refused unread, some are broken."""
    path, n = scratch(spark, "records"), F.col("c_nationkey")
    rows = v.table(spark, d, "customer").where(F.col("c_custkey") % (1 + n) < 3).groupBy(n).agg(F.concat_ws(" ", F.array_sort(F.collect_list("c_name"))).alias("names"))
    text = F.concat(F.lit('{"nation":'), n.cast("string"), F.lit(',"names":"'), F.col("names"), F.lit('"'), F.when(n % 6 == 1, F.lit("")).otherwise(F.lit("}")))
    rows.select(n.alias("n"), text.alias("value")).repartition("n").write.partitionBy("n").text(path)
    found = readers.read_records(spark, path, "nation int, names string", 2000).where(F.col("file").startswith("n="))
    return found.select(F.regexp_extract("file", r"^n=(\d+)/", 1).cast("int").alias("n"), "problem", F.length("record.names").alias("size"))


@query("payload_verification", """select 'id_' || n_nationkey as identity, n_nationkey % 7 not in (1, 2, 3, 4) as ok, case n_nationkey % 7 when 1 then 'digest' when 2 then 'missing' when 3 then 'link' when 4 then 'too large' end as problem from nation""")
def payload_verification(spark, d):
    """A file for every nation; of some the digest given is another's, some aren't there, are links or too large."""
    folder, k = scratch(spark, "payloads"), F.col("n_nationkey")
    names = v.table(spark, d, "nation").join(v.table(spark, d, "customer"), F.col("c_nationkey") == k, "left").groupBy(k).agg(F.concat_ws(" ", F.array_sort(F.collect_list("c_name"))).alias("text"))
    limit = names.agg(F.max(F.length("text"))).first()[0] + 1
    texts = stored(names.withColumn("text", F.when(k % 7 == 4, F.rpad("text", limit + 1, "x")).otherwise(F.col("text"))), "texts")
    texts.where(~(k % 7).isin(2, 3)).select(k.alias("at"), F.col("text").alias("value")).repartition("at").write.partitionBy("at").text(folder)
    place = r"(at=(\d+)/part-[^/]*)$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_extract("path", place, 1).alias("path"), F.regexp_extract("path", place, 2).cast("int").alias("at"))
    root = Path("/" + folder.removeprefix("file:").lstrip("/"))
    if folder.startswith(("file:", "/")):
        target = next(root.glob("at=*/part-*"))
        for r in texts.where(k % 7 == 3).select(k).collect():  # a row a nation
            (root / f"link{r[0]}").symlink_to(target)
    text = F.when(k % 7 == 1, F.lit("other")).otherwise(F.concat("text", F.lit("\n")))
    path = F.when(k % 7 == 3, F.concat(F.lit("link"), k.cast("string"))).otherwise(F.coalesce("path", F.lit("none")))
    references = texts.join(files, k == F.col("at"), "left").select(F.concat(F.lit("id_"), k.cast("string")).alias("identity"), path.alias("path"), sha(text).alias("sha256"))
    return readers.verify_payloads(spark, folder, references, limit).select("identity", "ok", "problem")


@query("ranking_artifact", "select change_id, score, cast(row_number() over (order by score desc, change_id) as int) as rank from lexical")
def ranking_artifact(spark, d):
    path = scratch(spark, "ranking")
    scores = localize.lexical_scores(an.regressed_prompts(spark, d), an.prompts(spark, d)).withColumn("score", F.round("score", 9))
    writers.write_ranking(localize.ranked(scores, [], "change_id").withColumn("rationale", F.lit("lexical overlap")), path)
    return spark.read.schema("change_id string, score double, rank int").json(path)


@query("write_if_same", "select count(*) as n from orders")
def write_if_same(spark, d):
    path = scratch(spark, "same")
    rows = v.table(spark, d, "orders")
    writers.write_same(rows, path)
    writers.write_same(rows.orderBy("o_totalprice"), path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"))


@query("stream_ingest", "select * from report")
def stream_ingest(spark, d):
    """Extension: the batch report, from files that arrive in several batches."""
    folder = _predictions_file(spark, d)
    policy = {"cases": v.cases(spark, d), "slices": v.slices(spark, d), "slice_members": v.slice_members(spark, d)}
    out = scratch(spark, "stream-report")
    stream = spark.readStream.schema("observed string, release_id string, case_id string").option("header", True).option("maxFilesPerTrigger", 1).csv(folder)
    done = []

    def keep(report, number):
        report.write.mode("overwrite").parquet(f"{out}/{number}")
        done.append(number)

    keep_report(stream, policy, scratch(spark, "stream-store"), scratch(spark, "stream-checkpoint"), keep).awaitTermination()
    return spark.read.parquet(f"{out}/{max(done)}")

