"""Readers with explicit schemas.

Missing keys read as null and are defaulted with ``coalesce`` downstream;
no schema inference. JSON documents are read with ``multiLine`` and keep
their file name as lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.outcome import normalize_action
from .sinks import ARTIFACT_BUCKETS, artifact_bucket

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


# ---------------------------------------------------------------- S1 tasks
TASK_SCHEMA = _st(
    ("task_id", S), ("category", S), ("prompt_type", S), ("prompt", S), ("resource_requirements", S),
    ("expected_resources", S), ("intent_spec_file", S), ("complexity_loc", S), ("complexity_resources", S),
    ("complexity_interconnections", S), ("complexity_level", S), ("reference_hcl", S),
)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task CSV with header, multi-line quoted cells and doubled-quote escapes.
    P4: rows whose key is blank after stripping are dropped. P18: of a row with more cells
    than the header names, the first one too many is its ``complexity_level``."""
    from ..functions.text import strip_ws

    # columns are matched by header name (files may carry a subset, in any order);
    # no inference: every cell is read as text, one column more than the header names
    read = lambda **o: spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", **o)
    names = read().columns
    raw = read(schema=T.StructType([T.StructField(n, S) for n in [*names, "_cell_too_many"]]), enforceSchema=True)
    df = raw.select(*[
        (F.col(f"`{f.name}`") if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in TASK_SCHEMA.fields if f.name != "complexity_level"
    ], F.coalesce("_cell_too_many", "complexity_level" if "complexity_level" in names else F.lit(None).cast("string")).alias("complexity_level"))
    df = df.select(*[f.name for f in TASK_SCHEMA.fields])
    return df.filter(F.coalesce(strip_ws("task_id"), F.lit("")) != "").withColumn("task_id", strip_ws("task_id"))


def filter_task(df: DataFrame, task_id: str) -> DataFrame:
    """P5: case-insensitive key filter."""
    return df.filter(F.lower(F.col("task_id")) == task_id.lower())


# ---------------------------------------------------------------- S2 entries
_STAGE = _st(("status", S), ("exit_code", I), ("execution_time_seconds", D), ("error_message", S),
             ("resources_to_create", I), ("resources_to_modify", I), ("resources_to_destroy", I))
ENTRY_SCHEMA = _st(
    ("dataset_version", S), ("entry_id", S), ("task_id", S), ("task_description", S), ("timestamp", S),
    ("sample_num", L),
    ("metadata", _st(("model_name", S), ("model_version", S), ("temperature", D), ("seed", L),
                     ("prompt_type", S), ("enhance_strat", S))),
    ("prompt", _st(("input_text", S))),
    ("llm_response", _st(("generated_code", S), ("full_response_text", S), ("raw_response", S),
                         ("iterations_needed", L), ("time_to_generate_seconds", D))),
    ("execution_results", _st(("terraform_init", _STAGE), ("terraform_validate", _STAGE),
                              ("terraform_plan", _STAGE), ("terraform_apply", _STAGE))),
    ("spec_accuracy", _st(("status", S), ("passed", B), ("errors", T.ArrayType(S)),
                          ("checks_performed", T.ArrayType(S)))),
    ("post_state_verification", _st(("status", S), ("passed", B), ("errors", T.ArrayType(S)))),
    ("final_outcome", _st(("plan_success", B), ("apply_success", B), ("execution_successful", B),
                          ("meets_requirements", B), ("total_iterations", L))),
    ("judge_verdict", _st(("verdict", S), ("judge_model", S), ("raw_response", S))),
)


def read_entries(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Result documents; ``file`` keeps the basename.

    ``one_per_file``: each file is one (pretty-printed) document, as the
    evaluation harness writes them; otherwise JSON Lines (as ``write_entries``
    writes them), where ``entry_id`` identifies a document.
    ``checks_performed`` mixes strings and objects; as ``array<string>`` the
    objects arrive as their JSON text.
    """
    df = spark.read.schema(ENTRY_SCHEMA).json(path, multiLine=one_per_file)
    name = F.col("_metadata.file_name") if one_per_file else F.concat(F.col("entry_id"), F.lit(".json"))
    return df.withColumn("file", name).withColumn(
        "path", F.col("_metadata.file_path") if one_per_file else F.concat(F.col("_metadata.file_path"), F.lit("#"), F.col("entry_id")))


def entry_samples(entries: DataFrame) -> DataFrame:
    """P1 + P2: flatten entries to metric rows with the reference's defaults and fallbacks."""
    from ..functions.outcome import apply_ok_metrics, plan_ok

    return entries.select(
        F.coalesce("task_id", F.lit("")).alias("task_id"),
        plan_ok(F.col("final_outcome.plan_success"), F.col("execution_results.terraform_plan.status")).alias("plan_ok"),
        apply_ok_metrics(F.col("final_outcome.apply_success"), F.col("final_outcome.execution_successful"),
                         F.col("execution_results.terraform_apply.status")).alias("apply_ok"),
        F.coalesce(F.col("spec_accuracy.passed"), F.when(F.col("spec_accuracy").isNull(), F.lit(False))).alias("spec_ok"),
        F.coalesce(F.col("final_outcome.total_iterations"), F.lit(1)).alias("iterations"),
        F.coalesce(F.col("llm_response.time_to_generate_seconds"), F.lit(0.0)).alias("gen_s"),
        F.coalesce(F.col("llm_response.generated_code"), F.lit("")).alias("code"),
        "file",
        *[c for c in ("path",) if c in entries.columns],
        F.col("metadata.model_name").alias("model_name"),
        F.col("metadata.enhance_strat").alias("strategy"),
    )


# ---------------------------------------------------------------- S3 references
def read_references(spark: SparkSession, folder: str) -> DataFrame:
    """S3: every ``.tf`` file as one whole text; key = file stem."""
    df = spark.read.text(f"{folder.rstrip('/')}/*.tf", wholetext=True)
    return df.select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.tf$", 1).alias("task_id"),
        F.col("value").alias("hcl"),
    )


# ---------------------------------------------------------------- S4 specs
SPEC_SCHEMA = _st(
    ("task_id", S), ("category", S), ("vm_count", L), ("min_vm_count", L), ("max_vm_count", L),
    ("per_vm_memory_max", L), ("per_vm_cpus", L), ("per_vm_disk_size", L), ("vm_names", T.ArrayType(S)),
    ("max_total_ram_gb", S), ("max_total_cpus", L), ("updated_field", S), ("new_value", L),
    ("target_vm", S), ("target_vms", T.ArrayType(S)), ("delete_count", L),
)


def read_specs(spark: SparkSession, yaml_path: str) -> DataFrame:
    """YAML maps (task -> sparse record), one or several files or a folder of them. Spark
    reads each file as one whole text and parses it in the task that read it; an empty file has
    no specs. ``max_total_ram_gb`` stays text, as written, since messages print it so."""
    names = [f.name for f in SPEC_SCHEMA.fields]

    def parse(parts):
        import pandas as pd
        import yaml

        for part in parts:
            rows = []
            for text in part["value"]:
                for task_id, rec in (yaml.safe_load(text) or {}).items():
                    rec = dict(rec or {}) | {"task_id": str(task_id).strip()}
                    if rec.get("max_total_ram_gb") is not None:
                        rec["max_total_ram_gb"] = str(rec["max_total_ram_gb"])
                    rows.append([rec.get(n) for n in names])
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return spark.read.text(yaml_path, wholetext=True).mapInPandas(parse, SPEC_SCHEMA)


# ---------------------------------------------------------------- S5 plans
_VM_STATE = _st(("name_label", S), ("memory_max", L), ("cpus", L), ("disk", T.ArrayType(_st(("size", L)))))
PLAN_SCHEMA = _st(
    ("resource_changes", T.ArrayType(_st(
        ("type", S), ("address", S), ("name", S),
        ("change", _st(("actions", T.ArrayType(S)), ("before", _VM_STATE), ("after", _VM_STATE))),
    ))),
    ("_corrupt_record", S),
)


def read_plans(spark: SparkSession, path: str, key_field: str | None = None,
               extra: tuple[T.StructField, ...] = ()) -> DataFrame:
    """Plan JSON documents; an unreadable document keeps its text in
    ``_corrupt_record`` (the reference's ``(None, error)`` return).

    By default each file is one (pretty-printed) document and ``plan_id`` is
    its file name; with ``key_field`` the input is JSON Lines and each
    document carries its own key in that field. ``extra`` fields are read beside."""
    schema = T.StructType(
        ([] if key_field is None else [T.StructField(key_field, T.StringType())]) + list(extra) + PLAN_SCHEMA.fields)
    df = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path, multiLine=key_field is None)
    )
    if key_field is None:
        return df.withColumn("plan_id", F.col("_metadata.file_name"))
    return df.withColumnRenamed(key_field, "plan_id")


_DISKS = "array<bigint>"


def plan_documents_of(plans: DataFrame, *keep: str) -> DataFrame:
    """P6 + P7 in place: every plan as one row, with its changes as the rules read
    them. Nothing is exploded or shuffled, so plans without changes stay, and an
    unreadable document stays with its ``plan_error``. ``keep`` names further columns."""

    def side(state):
        disks = F.transform(F.filter(state["disk"], lambda d: d["size"].isNotNull()), lambda d: d["size"])
        return state["name_label"], state["memory_max"], state["cpus"], F.coalesce(disks, F.array().cast(_DISKS))

    def change(rc, i):
        label, memory, cpus, disks = side(rc["change"]["after"])
        old = side(rc["change"]["before"])
        return F.struct(
            (i + 1).alias("pos"), rc["type"].alias("type"),
            normalize_action(F.coalesce(rc["change"]["actions"], F.array().cast("array<string>"))).alias("action"),
            F.coalesce(rc["address"], F.lit("")).alias("address"),
            F.coalesce(F.nullif(label, F.lit("")), old[0]).alias("name_label"),
            memory.alias("memory_max"), cpus.alias("cpus"), disks.alias("disk_sizes"),
            F.struct(*[x.alias(n) for n, x in zip(("name_label", "memory_max", "cpus", "disk_sizes"), old)]).alias("before"),
        )

    changes = F.transform("resource_changes", change)
    empty = F.array().cast(plans.select(changes.alias("x")).schema["x"].dataType)
    error = F.when(F.col("_corrupt_record").isNotNull(), F.lit("plan document can't be parsed as JSON")) \
        if "_corrupt_record" in plans.columns else F.lit(None).cast("string")
    return plans.select("plan_id", *keep, F.coalesce(changes, empty).alias("resource_changes"), error.alias("plan_error"))


def plan_change_rows(plans: DataFrame, key: str = "plan_id") -> DataFrame:
    """P6 + P7: exploded resource changes with normalised action; the VM name
    falls back to the ``before`` side (deletes have no ``after``)."""
    x = plans.select(key, F.posexplode("resource_changes").alias("pos", "rc"))
    after, before = F.col("rc.change.after"), F.col("rc.change.before")
    return x.select(
        key,
        (F.col("pos") + 1).alias("pos"),
        F.col("rc.type").alias("type"),
        F.coalesce(F.col("rc.change.actions"), F.array().cast("array<string>")).alias("actions"),
        F.coalesce(F.col("rc.address"), F.lit("")).alias("address"),
        F.coalesce(F.col("rc.name"), F.lit("")).alias("name"),
        F.coalesce(F.nullif(after["name_label"], F.lit("")), before["name_label"]).alias("name_label"),
        after["memory_max"].alias("memory_max"),
        after["cpus"].alias("cpus"),
        F.coalesce(F.transform(F.filter(after["disk"], lambda d: d["size"].isNotNull()), lambda d: d["size"]),
                   F.array().cast("array<bigint>")).alias("disk_sizes"),
    )


# ---------------------------------------------------------------- S6 states / P8
STATE_SCHEMA = _st(
    ("version", L), ("terraform_version", S), ("serial", L), ("lineage", S),
    ("resources", T.ArrayType(_st(("mode", S), ("type", S), ("name", S), ("provider", S),
                                  ("instances", T.ArrayType(_st(("schema_version", L), ("attributes", S))))))),
    ("_corrupt_record", S),
)
DATA_KEYS = ("id", "uuid", "name_label", "pool_id", "bridge", "size", "usage", "cpus", "master")
VM_KEYS = ("id", "uuid", "name_label", "name", "cpus", "memory_max", "power_state", "disk", "network", "tags",
           "wait_for_ip", "name_description")


def read_states(spark: SparkSession, path: str, key_field: str | None = None) -> DataFrame:
    """State documents; ``attributes`` stays raw JSON text (heterogeneous).
    One document per file (``state_id`` = file name), or with ``key_field``
    JSON Lines whose documents carry their own key."""
    schema = STATE_SCHEMA if key_field is None else T.StructType(
        [T.StructField(key_field, T.StringType())] + STATE_SCHEMA.fields)
    df = (
        spark.read.schema(schema).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record").json(path, multiLine=key_field is None)
    )
    if key_field is None:
        return df.withColumn("state_id", F.col("_metadata.file_name"))
    return df.withColumnRenamed(key_field, "state_id")


def infra_context(states: DataFrame, key: str = "state_id") -> DataFrame:
    """Per state, the identifier fields of data sources and managed VMs.

    Rows: (key, kind, pos, type, fields-as-JSON); only allow-listed keys with a
    non-null value are kept, and entries with nothing kept are dropped. The
    rows stay a table (no per-document list), ordered by ``pos``. ``infra_summary``
    lists every document, also those without rows here.
    """
    r = states.select(key, F.posexplode("resources").alias("rpos", "r"))
    i = r.select(key, "rpos", F.col("r.mode").alias("mode"), F.col("r.type").alias("type"),
                 F.posexplode("r.instances").alias("ipos", "inst"))
    attrs = F.try_parse_json(F.col("inst.attributes"))

    def kept(keys):
        return F.map_filter(
            F.map_from_arrays(F.array(*[F.lit(k) for k in keys]),
                              F.array(*[F.to_json(F.try_variant_get(attrs, f"$.{k}", "variant")) for k in keys])),
            lambda k, v: v.isNotNull() & (v != "null"),
        )

    data = i.filter(F.col("mode") == "data").select(
        key, "rpos", "ipos", F.lit("data_resources").alias("kind"), "type", kept(DATA_KEYS).alias("fields"))
    vm = i.filter((F.col("mode") == "managed") & (F.col("type") == "xenorchestra_vm")).select(
        key, "rpos", "ipos", F.lit("managed_vms").alias("kind"), "type", kept(VM_KEYS).alias("fields"))
    return data.unionByName(vm).filter(F.size("fields") > 0)


def infra_summary(states: DataFrame, key: str = "state_id") -> DataFrame:
    """One row per state document: its counts of resources, and of data sources and
    managed VMs with identifier fields, and ``error`` where the document can't be read."""
    corrupt = F.col("_corrupt_record") if "_corrupt_record" in states.columns else F.lit(None).cast("string")
    found = infra_context(states, key).groupBy(key).agg(
        F.count_if(F.col("kind") == "data_resources").alias("n_data_resources"),
        F.count_if(F.col("kind") == "managed_vms").alias("n_managed_vms"))
    listed = states.select(key, F.coalesce(F.size("resources"), F.lit(0)).alias("n_resources"),
                           F.when(corrupt.isNotNull(), F.lit("Failed to parse terraform state")).alias("error"))
    zero = F.lit(0).cast("long")
    return listed.join(found, key, "left").select(
        key, F.when(F.col("error").isNull(), F.col("n_resources")).alias("n_resources"), *[F.when(F.col("error").isNull(), F.coalesce(c, zero)).alias(c) for c in ("n_data_resources", "n_managed_vms")], "error")


# ---------------------------------------------------------------- S7 conversations
CONVERSATION_SCHEMA = T.ArrayType(_st(("role", S), ("content", S)))


def read_conversations(spark: SparkSession, path: str, key_field: str | None = None) -> DataFrame:
    """One conversation per JSON file (array of role/content), or with
    ``key_field`` JSON Lines of ``{key_field, messages}``; exploded to turns."""
    if key_field is None:
        raw = spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_name").alias("file"), F.from_json("value", CONVERSATION_SCHEMA).alias("messages"))
    else:
        schema = T.StructType([T.StructField(key_field, T.StringType()), T.StructField("messages", CONVERSATION_SCHEMA)])
        raw = spark.read.schema(schema).json(path).select(F.col(key_field).alias("file"), "messages")
    return raw.select("file", F.posexplode("messages").alias("turn", "m")).select(
        "file", "turn", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


# ---------------------------------------------------------------- S12
ARTIFACTS = T.StructType([
    T.StructField("task_id", T.StringType()), T.StructField("sample", T.IntegerType()), T.StructField("iteration", T.IntegerType()),
    T.StructField("kind", T.StringType()), T.StructField("content", T.StringType()), T.StructField("bucket", T.IntegerType()),
])


def read_artifacts(spark: SparkSession, path: str, task_id: str | None = None, sample: int | None = None,
                   iteration: int | None = None, buckets: int = ARTIFACT_BUCKETS, schema: T.StructType = ARTIFACTS) -> DataFrame:
    """S12 read back, all of it or one task's, sample's, iteration's artifacts: one folder is listed,
    and the key reaches the Parquet scan, which skips row groups by their bounds and Bloom filters.
    ``buckets`` and the columns' types (``schema``) as written."""
    found = spark.read.schema(schema).parquet(path)
    if task_id is not None:
        found = found.filter((F.col("bucket") == artifact_bucket(F.lit(task_id), buckets)) & (F.col("task_id") == task_id))
    for name, value in (("sample", sample), ("iteration", iteration)):
        if value is not None:
            found = found.filter(F.col(name) == value)
    return found.drop("bucket")


def lookup_artifacts(spark: SparkSession, path: str, wanted: DataFrame, buckets: int = ARTIFACT_BUCKETS,
                     schema: T.StructType = ARTIFACTS) -> DataFrame:
    """The artifacts of the (task_id, sample, iteration) rows of ``wanted``, once for each stored row
    however often its key is asked for; a null key finds nothing. The bucket is part of the join, so
    Spark may prune folders at run time where ``wanted`` is small."""
    keys = ["task_id", "sample", "iteration"]
    asked = wanted.select(*keys, artifact_bucket(F.col("task_id"), buckets).alias("bucket"))
    found = spark.read.schema(schema).parquet(path)
    return found.join(asked, ["bucket", *keys], "left_semi").drop("bucket")
