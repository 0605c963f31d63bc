"""Sources: strict readers that turn files into the engine's tables or raise.

Schemas are declared, never inferred.  Checks run as violation queries over the whole
input before a table is handed out.
"""

from __future__ import annotations

import csv
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import normal_text
from ..functions.text import blank
from ..operators import validate as val
from ..operators.records import with_content_id
from ..shipping import ship
from . import documents as docs
from . import local
from .scratch import stored

PREDICTION_FIELDS = ["case_id", "observed", "release_id"]
RECORD_LIMIT, FILE_LIMIT, TOTAL_LIMIT = 8 << 20, 64 << 20, 256 << 20
GENERATION = "case_id string, prompt string, expected string, raw_output string, observed string, parsed_label string"
SFT = "example_id string, prompt string, response string"


def read_predictions(spark: SparkSession, path: str, baseline: str = "baseline", candidate: str = "candidate", multiline: bool = False) -> DataFrame:
    """release_id, case_id, observed from CSV with exactly these columns, in any order.

    Blank, missing and extra fields are errors; blanks around values stay.  One pass over
    the file finds them.  ``multiline`` allows line feeds in quoted values, but keeps a
    file in one task; without it such a value is an error.
    """
    first = spark.read.text(path).first()
    names = next(csv.reader([first[0].removeprefix("\ufeff")])) if first else []
    if sorted(names) != PREDICTION_FIELDS:
        raise val.InvalidInput(f"columns must be exactly {PREDICTION_FIELDS}, not {names}")
    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("_bad", T.StringType())])
    options = {"header": True, "multiLine": multiline, "escape": '"', "enforceSchema": True, "columnNameOfCorruptRecord": "_bad", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows = spark.read.schema(schema).options(**options).csv(path)
    broken = F.col("_bad").isNotNull() | blank(F.col("release_id")) | blank(F.col("case_id")) | blank(F.col("observed"))
    is_role = lambda name: F.coalesce(F.bool_or(F.col("release_id") == name), F.lit(False))
    found = rows.agg(F.count_if(broken).alias("broken"), F.first(F.when(broken, F.struct(*names, "_bad")), ignorenulls=True).alias("example"), is_role(baseline).alias("b"), is_role(candidate).alias("c")).first()
    if found.broken:
        raise val.InvalidInput(f"incomplete or extra fields in {found.broken} rows: {found.example.asDict()}")
    if not (found.b and found.c) or baseline == candidate:
        raise val.InvalidInput(f"release roles: {baseline!r} and {candidate!r} must be two releases of the file")
    return rows.select("release_id", "case_id", "observed")


# Shapes of documents: see ``documents.flat_shape``.
POLICY_SHAPE = {"cases": [{"case_id": str, "expected": str}], "slices": [{"name": str, "case_ids": [str], "maximum_accuracy_drop?": (float, int), "minimum_accuracy?": (float, int, None)}]}
RELEASE_SHAPE = {"release_id": str, "predictions": [{"case_id": str, "observed": str}]}
COMPARISON_SHAPE = POLICY_SHAPE | {"baseline": RELEASE_SHAPE, "candidate": RELEASE_SHAPE}


def _policy_tables(values: DataFrame, *also: str) -> dict[str, DataFrame]:
    """cases, slices and slice_members from the values of documents, with the columns ``also`` first; a slice's name is ``name_``."""
    cases = docs.objects(values, "$.cases[]", {"case_id": "string", "expected": "string"}, *also)
    slices = docs.objects(values, "$.slices[]", {"name": "string", "maximum_accuracy_drop": "double", "minimum_accuracy": "double"}, *[c for c in also if c != "name"])
    slices = stored(slices, "slices")  # few rows, whose size the planner then knows: members don't move by their slice
    names = slices.select(F.col("doc").alias("doc3"), F.col("number").alias("of"), F.col("name").alias("name_"))
    members = docs.items(values, "$.slices[].case_ids", *also).join(names, (F.col("doc") == F.col("doc3")) & (F.col("parent") == F.col("of")))
    drop = F.coalesce("maximum_accuracy_drop", F.lit(0.0)).alias("maximum_accuracy_drop")
    return {
        "cases": cases.select(*also, "case_id", "expected"), "slices": slices.select(*also, F.col("name").alias("name_"), drop, "minimum_accuracy"),
        "slice_members": members.select(*also, "name_", F.col("value").alias("case_id")),
    }


def require_whole(t: dict[str, DataFrame]) -> None:
    """Cases are different, slices' members are cases, releases (where there are predictions) answer every case once: one look at all rows, others only where it finds something."""
    if not val.whole(t["cases"], t.get("predictions"), t["slice_members"]):
        val.require_none(val.duplicates(t["cases"], "case_id"), "repeated case")
        if "predictions" in t:
            val.require_none(val.coverage_violations(t["cases"], t["predictions"]), "coverage")
        val.require_none(val.slice_violations(t["cases"], t["slices"], t["slice_members"]), "slices")
    val.require_none(val.limit_violations(t["slices"], t["slice_members"]), "slices")


def read_policy(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables cases, slices, slice_members and declared_changes of a policy document of any size."""
    values = docs.document_values(spark, path, POLICY_SHAPE | {"declared_changes": dict})
    out = {name: t.withColumnsRenamed({"name_": "name"}) for name, t in _policy_tables(values).items()}
    val.require_none(val.blank_fields(out["cases"], "case_id", "expected"), "blank case")
    require_whole(out)
    return out | {"declared_changes": docs.subtree(values, "$.declared_changes", "declared_changes").select("declared_changes")}


def _comparison_tables(values: DataFrame) -> dict[str, DataFrame]:
    """Tables of the comparisons in ``values``, whose column ``comparison`` names the one that a value belongs to: predictions have the role and the release's own id."""
    out = _policy_tables(values, "comparison")
    ids = values.where(F.col("path").isin("$.baseline.release_id", "$.candidate.release_id")).select("comparison", F.split_part("path", F.lit("."), F.lit(2)).alias("role"), F.col("value").alias("release_id"))
    ids = stored(ids, "ids")  # a row a release: predictions don't move by their release
    answers = None
    for role in ("baseline", "candidate"):
        rows = docs.objects(values, f"$.{role}.predictions[]", {"case_id": "string", "observed": "string"}, "comparison").select("comparison", F.lit(role).alias("role"), "case_id", "observed")
        answers = rows if answers is None else answers.union(rows)
    val.require_none(ids.groupBy("comparison").agg(F.count_distinct("release_id").alias("n")).where("n < 2").select("comparison"), "equal release ids")
    val.require_none(ids.join(answers.select("comparison", "role").distinct(), ["comparison", "role"], "left_anti").select("comparison"), "a release without predictions")
    return out | {"predictions": answers.join(ids, ["comparison", "role"])}


def read_comparison(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """cases, slices, slice_members and predictions (release_id is the role, name the release's own id) of a comparison document with two releases, of any size."""
    values = docs.document_values(spark, path, COMPARISON_SHAPE).withColumn("comparison", F.lit(""))
    found = _comparison_tables(values)
    out = {t: found[t].drop("comparison").withColumnsRenamed({"name_": "name"}) for t in ("cases", "slices", "slice_members")}
    out["predictions"] = found["predictions"].select(F.col("role").alias("release_id"), F.col("release_id").alias("name"), "case_id", "observed")
    require_whole(out)
    return out


def read_repair_comparison(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """cases, slices, slice_members and predictions of {regressed: comparison, repairs: {name: comparison}}, of any size.

    All comparisons must have the regressed one's cases, slices and baseline; then one
    table has its baseline, its candidate, and every repair's candidate under the repair's name.
    """
    values = docs.document_values(spark, path, {"regressed": COMPARISON_SHAPE, "repairs": {"*": COMPARISON_SHAPE}})
    place = r"^\$\.(?:regressed|repairs\.([^.\[]*))"
    name = docs.plain_key(F.regexp_extract("path", place, 1))
    inside = values.where(F.col("path").rlike(place)).select("*", name.alias("comparison")).withColumn("path", F.regexp_replace("path", place, r"\$"))
    names = inside.where("path = '$'").select("comparison")
    val.require_none(names.where(F.col("comparison").isin("baseline", "candidate") | ((F.col("comparison") != "") & blank(F.col("comparison")))), "names of repairs")
    if names.where("comparison = ''").count() != 1:
        raise val.InvalidInput("a repair without a name")
    found = _comparison_tables(inside)
    for table in ("cases", "slices", "slice_members"):
        columns = [c for c in found[table].columns if c != "comparison"]
        n = names.agg(F.count("*").alias("n"))
        each = found[table].repartition(*columns).groupBy(*columns, "comparison").agg(F.count("*").alias("k"))  # rows move once, for both counts
        rows = each.groupBy(*columns).agg(F.max("k").alias("most"), F.count("*").alias("names")).crossJoin(n)
        val.require_none(rows.where("most > 1 or names <> n").select(*columns), f"comparisons with other {table}")
    base = found["predictions"].where("role = 'baseline'")
    differ = base.groupBy("case_id").agg(F.min("observed").alias("lo"), F.max("observed").alias("hi")).where("lo <> hi")
    val.require_none(differ, "comparisons with another baseline")
    release = F.when(F.col("role") == "baseline", F.lit("baseline")).when(F.col("comparison") == "", F.lit("candidate")).otherwise(F.col("comparison"))
    out = {t: found[t].where("comparison = ''").drop("comparison").withColumnsRenamed({"name_": "name"}) for t in ("cases", "slices", "slice_members")}
    out["predictions"] = found["predictions"].where("role = 'candidate' or comparison = ''").select(release.alias("release_id"), "case_id", "observed")
    require_whole(out)
    return out


def read_score_archive(spark: SparkSession, path: str, scores: dict[str, str]) -> DataFrame:
    """release_id, case_id, observed from .npz archives with case_ids, classes and a score matrix per release: the first class of the highest score.

    ``scores`` gives each release's array; each archive is one task's.  Other shapes or
    kinds, repeated ids and scores that aren't finite are errors.
    """
    import io

    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                with np.load(io.BytesIO(data.as_py()), allow_pickle=False) as arrays:
                    if missing := {"case_ids", "classes", *scores.values()} - set(arrays.files):
                        raise ValueError(f"the archive lacks {sorted(missing)}")
                    ids, classes = arrays["case_ids"], arrays["classes"]
                    if any(x.ndim != 1 or x.dtype.kind != "U" or len(np.unique(x)) != len(x) for x in (ids, classes)):
                        raise ValueError("case_ids and classes must be vectors of different strings")
                    for release, name in scores.items():
                        table = arrays[name]
                        if table.shape != (len(ids), len(classes)) or table.dtype.kind != "f" or not np.isfinite(table).all():
                            raise ValueError(f"{name} isn't a finite matrix of cases by classes")
                        best = classes[table.argmax(axis=1)].tolist() if len(ids) else []
                        yield pa.RecordBatch.from_pydict({"release_id": [release] * len(ids), "case_id": ids.tolist(), "observed": best}, pa.schema([(c, pa.string()) for c in ("release_id", "case_id", "observed")]))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "release_id string, case_id string, observed string")


def read_jsonl(spark: SparkSession, path: str, schema: str, key: str | None = None, required: list[str] | None = None) -> DataFrame:
    """JSON Lines with declared fields; blank lines are skipped, broken ones, missing fields and repeated keys are errors."""
    fields = T.StructType.fromDDL(schema)
    lines = spark.read.text(path).where(~blank(F.col("value")))
    rows = lines.select("value", F.from_json("value", T.StructType([*fields.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    val.require_none(rows.where(F.col("r").isNull() | F.col("r._bad").isNotNull()).select("value"), "broken line")
    out = rows.select(*[F.col(f"r.{f.name}") for f in fields])
    if required := required if required is not None else ([key] if key else []):
        val.require_none(val.blank_fields(out, *required), "missing field")
    if key:
        val.require_none(val.duplicates(out, key), f"repeated {key}")
    if not out.limit(1).count():
        raise val.InvalidInput(f"no record in {path}")
    return out


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, GENERATION, "case_id", ["case_id", "prompt", "expected"])


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, SFT, "example_id", ["example_id", "prompt", "response"])


def read_changed_records(spark: SparkSession, before: str, after: str) -> DataFrame:
    """change_id, example_id, prompt, response of records that differ between two folders of ``<change_id>.jsonl``."""
    def side(path):
        rows = spark.read.schema(SFT).json(path).select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.jsonl$", 1).alias("change_id"))
        return rows

    b = side(before).select("change_id", "example_id", F.struct("prompt", "response").alias("was"))
    rows = side(after).join(b, ["change_id", "example_id"], "full")
    val.require_none(rows.where(F.col("was").isNull() | F.col("prompt").isNull()).select("change_id", "example_id"), "records on one side only")
    return rows.where(~F.struct("prompt", "response").eqNullSafe(F.col("was"))).drop("was")


def read_labelled_texts(spark: SparkSession, path: str, sha256: str | None = None, rows: int | None = None, labels: int | None = None) -> DataFrame:
    """label, text, content_id from CSV (text, category), optionally of a given digest, row and label count."""
    if sha256:
        found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d")).collect()
        if [r.d for r in found] != [sha256]:
            raise val.InvalidInput(f"digest of {path} isn't {sha256}")
    raw = spark.read.schema("text string, category string").options(header=True, multiLine=True, escape='"').csv(path)
    out = with_content_id(raw.select(normal_text(F.col("category")).alias("label"), "text"))
    val.require_none(val.blank_fields(out, "label", "text").select("label"), "blank label or text")
    if rows is not None or labels is not None:
        n = out.agg(F.count("*").alias("n"), F.count_distinct("label").alias("k")).first()
        if rows not in (None, n.n) or labels not in (None, n.k):
            raise val.InvalidInput(f"{n.n} rows with {n.k} labels")
    return out


def read_trajectory_predictions(spark: SparkSession, path: str) -> DataFrame:
    """trajectory_id, true_label, predicted_label from folders ``trajectory=<n>``."""
    rows = spark.read.schema("true_label string, predicted_label string, trajectory_id int").option("basePath", path).json(f"{path}/trajectory_id=*")
    val.require_none(val.blank_fields(rows, "true_label", "predicted_label"), "blank label")
    return rows


def read_documents_by_mode(spark: SparkSession, path: str, schema: str, mode: str) -> DataFrame:
    """Multi-line JSON documents of a folder whose ``mode`` field is the given one; a file has one, or an array of them."""
    fields = T.StructType.fromDDL(schema)
    if "mode" not in fields.names:
        fields = fields.add("mode", "string")
    return spark.read.schema(fields).option("multiLine", True).json(path).where(F.col("mode") == mode)


def read_summaries(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Run summaries with trajectory_id and state out of their paths ``…/t<n>/runs/<state>/…``."""
    rows = spark.read.schema(schema).option("multiLine", True).json(pattern).select("*", F.col("_metadata.file_path").alias("_path"))
    return rows.select("*", F.regexp_extract("_path", r"/t(\d+)/runs/", 1).cast("int").alias("trajectory_id"), F.regexp_extract("_path", r"/runs/([^/]+)/", 1).alias("state")).drop("_path")


def read_frozen_worlds(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """world, role, example_id of a frozen manifest {worlds: [{world, changed: {role: [ids]}}]}."""
    text = spark.read.text(path, wholetext=True)
    if sha256 and spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0] != sha256:
        raise val.InvalidInput("the manifest isn't the frozen one")
    rows = text.select(F.explode(F.from_json("value", "worlds array<struct<world: int, changed: map<string, array<string>>>>", {"mode": "FAILFAST"})["worlds"]).alias("w"))
    return rows.select("w.world", F.explode("w.changed").alias("role", "ids")).select("world", "role", F.explode("ids").alias("example_id"))


def read_lineage(spark: SparkSession, path: str, with_truth: bool = False) -> DataFrame:
    """change_id, kind, description, before, after, metadata of a manifest; the hidden cause only on request."""
    schema = "hidden_root_cause_id string, changes array<struct<change_id: string, kind: string, description: string, before: string, after: string, metadata: map<string, string>>>"
    one = spark.read.text(path, wholetext=True).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("m"))
    rows = one.select(F.explode("m.changes").alias("c"), F.col("m.hidden_root_cause_id").alias("root"))
    out = rows.select("c.*", *([(F.col("c.change_id") == F.col("root")).alias("is_root")] if with_truth else []))
    val.require_none(val.duplicates(out, "change_id"), "repeated change")
    return out


PREVIEW_SHAPE = {"*": {"text": str, "width?": int, "height?": int, "pixels?": [(float, int)]}}


def read_case_inputs(spark: SparkSession, path: str, cases: DataFrame) -> DataFrame:
    """case_id, text, width, height, pixels of a document {case_id: input} of any size; inputs of unknown cases and texts over 10,000 characters are errors."""
    values = docs.document_values(spark, path, PREVIEW_SHAPE)
    values = values.withColumn("path", F.regexp_replace("path", r"^\$\.[^.\[]*", r"\$.*"))
    names = values.where("path = '$.*'").select(F.col("doc").alias("doc1"), F.col("number").alias("of"), F.col("key").alias("case_id"))
    lists = values.where("path = '$.*.pixels[]'").groupBy("doc", "parent").agg(F.array_sort(F.collect_list(F.struct("block", "at", F.col("value").cast("double").alias("x")))).alias("px"))
    arrays = values.where("path = '$.*.pixels' and kind = 'array'").select(F.col("doc").alias("doc2"), F.col("number").alias("array"), F.col("parent").alias("in"))
    pixels = arrays.join(lists, (F.col("doc2") == F.col("doc")) & (F.col("array") == F.col("parent")), "left").select("doc2", "in", F.coalesce(F.transform("px", lambda p: p["x"]), F.array().cast("array<double>")).alias("pixels"))
    rows = docs.objects(values, "$.*", {"text": "string", "width": "int", "height": "int"})
    rows = rows.join(names, (F.col("doc") == F.col("doc1")) & (F.col("number") == F.col("of"))).join(pixels, (F.col("doc") == F.col("doc2")) & (F.col("number") == F.col("in")), "left")
    rows = rows.select("case_id", "text", "width", "height", "pixels")
    val.require_none(rows.join(cases, "case_id", "left_anti").select("case_id"), "unknown case")
    size = F.col("width") * F.col("height")
    bad = (F.length("text") > 10_000) | (F.col("pixels").isNotNull() & ((F.size("pixels") != size) | (F.col("width") > 64) | (F.col("height") > 64)))
    val.require_none(rows.where(F.coalesce(bad, F.lit(False))).select("case_id"), "bad input")
    return rows


def read_bounded(spark: SparkSession, path: str, limit: int = RECORD_LIMIT) -> str:
    """The text of one small file; a larger one is an error before it is read."""
    size = spark.read.format("binaryFile").load(path).select("length").first()
    if size is None or size.length > limit:
        raise val.InvalidInput(f"{path} is missing or over {limit} bytes")
    return bytes(spark.read.format("binaryFile").load(path).select("content").first().content).decode("utf-8")


def read_records(spark: SparkSession, path: str, schema: str, limit: int = RECORD_LIMIT) -> DataFrame:
    """file, bytes, problem, record: one JSON record a file; files over ``limit`` bytes are refused, and aren't read."""
    name = lambda c: F.regexp_extract(c, r"([^/]*/[^/]*)$", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(name("path").alias("file"), F.col("length").alias("bytes"))
    texts = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).where(F.col("_metadata.file_size") <= limit).select(name("_metadata.file_path").alias("of"), "value")
    rows = files.join(texts, F.col("file") == F.col("of"), "left").withColumn("record", F.from_json("value", schema))
    broken = F.col("record").isNull() | (F.try_parse_json("value").isNull())
    problem = F.when(F.col("bytes") > limit, F.lit("too large")).when(broken, F.lit("no record"))
    return rows.select("file", "bytes", problem.alias("problem"), F.when(problem.isNull(), F.col("record")).alias("record"))


def strict_map(text: str) -> dict[str, str]:
    """A JSON object of strings; a key that occurs twice is an error, which Spark's reader doesn't see."""

    def pairs(items):
        if len({k for k, _ in items}) != len(items):
            raise val.InvalidInput("repeated key")
        return dict(items)

    out = json.loads(text, object_pairs_hook=pairs)
    if not isinstance(out, dict) or not all(isinstance(x, str) for x in out.values()):
        raise val.InvalidInput("an object of strings is needed")
    return out


def read_config(text: str) -> dict:
    """A YAML experiment configuration, on the driver."""
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("YAML configurations need pyyaml") from error
    config = yaml.safe_load(text)
    if problems := config_problems(config):
        raise val.InvalidInput("; ".join(problems))
    return config


def config_problems(config: dict) -> list[str]:
    """Rules of a calibration section that go across its fields."""
    c, out = config.get("calibration") or {}, []
    doses, up, down = c.get("target_doses", []), c.get("accept_to_reject_per_candidate", 0), c.get("reject_to_accept_per_candidate", 0)
    rules = {
        "target doses rise": doses == sorted(set(doses)), "flips sum to the changes": c.get("changes_per_candidate", up + down) == up + down,
        "material limits are in order": c.get("material_count_min", 0) <= c.get("material_count_max", c.get("material_count_min", 0)), "no dose is above the flips": all(d <= up for d in doses),
        "what a dose leaves divides by three": all((up - d) % 3 == 0 for d in doses), "worlds that must pass exist": c.get("minimum_passing_worlds", 0) <= c.get("calibration_world_count", c.get("minimum_passing_worlds", 0)),
        "materials are different": len(c.get("calibration_materials", [])) == len(set(c.get("calibration_materials", []))),
    }
    out += [f"not so: {name}" for name, ok in rules.items() if not ok]
    for name, x in (config.get("evaluation") or {}).items():
        if name.startswith(("minimum_", "maximum_")) and not (isinstance(x, (int, float)) and not isinstance(x, bool) and 0 <= x <= 1):
            out.append(f"evaluation.{name} isn't between 0 and 1")
    return out


def verify_payloads(spark: SparkSession, folder: str, references: DataFrame, limit: int = FILE_LIMIT) -> DataFrame:
    """identity, path, ok, bytes, problem for references(identity, path, sha256): each file is a regular one below ``folder`` of ``limit`` bytes at most, is reached over no link, doesn't change while it is read, and is of the digest given.

    Tasks read the files in pieces, so a file's size bounds time but no memory.
    """
    ship(spark)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    folder = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()

    def run(batches):
        for batch in batches:
            rows = []
            for identity, path, want in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                try:
                    found, size = local.payload_digest(folder, path, limit)
                    rows.append((identity, path, found == want, size, None if found == want else "digest"))
                except local.Refused as refused:
                    rows.append((identity, path, False, None, refused.problem))
            kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], names=["identity", "path", "ok", "bytes", "problem"])

    rows = references.select(F.col("identity").cast("string").alias("identity"), "path", "sha256")
    return rows.repartition("identity", "path").mapInArrow(run, "identity string, path string, ok boolean, bytes long, problem string")
