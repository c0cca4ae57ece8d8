"""Dataset building: run matrix, prompts and the nested result entry
(V8, V9, V10, J13, J14, F18, F20, F21, F23, F24, F25, F29, F36-F39).

Everything is a column expression over a results table; the entry is one
nested struct per row, built in stages with ``select``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import outcome as O
from ..functions import text as X

# ---------------------------------------------------------------- fixed values
BASELINE_PREFIX = "Here is the actual prompt: "
DATASET_PROMPT = (
    "TASK:\nGenerate the definitive ground-truth Terraform HCL for the following infrastructure requirement.\n\n"
    "REQUIREMENT:\n{prompt}\n\n"
    "Follow the structural rules defined in the system prompt. RESOLVE ALL IDENTIFIERS using data sources.\n"
    "Provide the code in a single ```hcl block.\n"
)
REPAIR_SPEC_LAYOUT = (
    "Here is the actual prompt:\n{prompt}\n\nHere is the incorrect configuration:\n{code}\n\n"
    "Give me the full complete code, without these below errors:\n\n{error}"
)
REPAIR_PLAN_LAYOUT = (
    "Here is the actual prompt:\n{prompt}\n\nHere is the incorrect configuration:\n{code}\n\n"
    "Here is the Terraform plan error message (potentially empty):\n{error}\n\n"
    "Give me the full complete code, without these below errors:"
)
MULTI_ERROR_LAYOUT = "Here is the actual prompt:\n{prompt}\n\nGive me the full complete code, without these below errors:\n\n{errors}\n"
DATASET_REPAIR_LAYOUT = (
    "TASK:\nRefine the ground-truth Terraform HCL to resolve the documented errors.\n\n"
    "ORIGINAL REQUIREMENT:\n{prompt}\n\nERROR HISTORY:\n{errors}\n\n"
    "INSTRUCTION:\nThe generation MUST NOT contain the errors listed above. Provide a single, complete, "
    "and definitive ground-truth HCL block using standard Markdown (```hcl).\n\n"
    "Follow the structural rules defined in the system prompt.\n"
)
JUDGE_SYSTEM_PROMPT = (
    "You are an expert evaluator of Terraform HCL code for XCP-NG / Xen Orchestra infrastructure.\n"
    "You will be given a task description and a generated Terraform configuration.\n"
    "Your job is to determine whether the generated code correctly and completely fulfills the task.\n\n"
    "Evaluation criteria:\n"
    "1. The code must include valid xenorchestra provider configuration\n"
    "2. Required VM attributes must be present and correct (name_label, memory_max, cpus, template, auto_poweron)\n"
    "3. Resource requirements from the task (VM count, RAM, CPU, disk size) must match\n"
    "4. For UPDATE tasks: the code must modify the correct VM attribute without destroying/recreating the VM\n"
    "5. For DELETE tasks: the code must remove only the specified VM(s), not all infrastructure\n"
    "6. For READ tasks: the code must use data sources and output blocks, not resource blocks\n\n"
    "End your response with exactly one of these two lines (no other text after it):\n"
    "Rating: Correct\n"
    "Rating: Incorrect"
)
JUDGE_USER_LAYOUT = (
    "Task Description:\n{task_prompt}\n\nTask Category: {category}\n\nGenerated Terraform Code:\n"
    "```hcl\n{terraform_code}\n```\n\n"
    "Does this generated code correctly fulfill the task? Evaluate it carefully, then end with your rating."
)
COT_LAYOUT = (
    "Here is an example:\n\nExample prompt: {example_prompt}\nExample output: Let's think step by step. {thought}\n"
    "```hcl\n{hcl}\n```\n\nHere is the actual prompt to answer. Let's think step by step:\n{question}"
)
FSP_LAYOUT = (
    "Here is an example:\n\nExample prompt: {example_prompt}\nExample output:\n"
    "```hcl\n{hcl}\n```\n\nHere is the actual prompt to answer:\n{question}"
)
JUDGE_PROMPT_CAP = 10000
NOTES_LAYOUT = "Task {task} executed by {model}. Iterations: {iterations}."
REASONING = {
    True: "Recognized over-provisioning and refused to generate failing code",
    False: "Failed to recognize resource constraints",
}
# Config defaults used by the entry builder when a column is absent.
ENTRY_DEFAULTS = {
    "total_ram_gb": 24, "total_cpu_cores": 32, "usable_ram_gb": 20.0, "temperature": 0.2, "max_tokens": 4096,
}
SCREENSHOTS = (("terraform_apply_output", "apply"), ("xen_orchestra_vm_list", "xo_list"),
               ("vm_details", "vm_details"), ("resource_usage", "resources"))
JUDGE_CODE_CAP = 8000
DEFAULT_USABLE_RAM_GB = 20
RESOURCE_EXHAUSTION = "resource_exhaustion"

REQS_SCHEMA = T.StructType([
    T.StructField(n, t) for n, t in [
        ("count", T.LongType()), ("memory_max_bytes", T.LongType()), ("cpus", T.LongType()),
        ("size_bytes", T.LongType()), ("total_memory_max_bytes", T.LongType()), ("total_cpus", T.LongType()),
        ("total_size_bytes", T.LongType()), ("per_vm_memory_max_bytes", T.LongType()), ("per_vm_cpus", T.LongType()),
        ("per_vm_size_bytes", T.LongType()), ("target_vm", T.StringType()), ("op", T.StringType()),
        ("expected_error", T.StringType()),
    ]
])


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def _fill(layout: str, **cols: Column) -> Column:
    """Fill a fixed layout; missing values print as empty text."""
    return X.fill(layout, null_as="", **cols)


# ---------------------------------------------------------------- J14 / F20-F25
def run_matrix(tasks: DataFrame, passes: Sequence[int], strategies: Sequence[str],
               models: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Every task x pass x strategy, and with ``models`` (folder, short name) every
    model; without, a task row names its own. The grid is a fixed literal array expanded
    per row (constant factor), not a join."""
    own = [(F.lit(f).alias("folder"), F.lit(s).alias("model_short")) for f, s in models] or [()]
    grid = F.array(*[F.struct(F.lit(p).alias("pass_no"), F.lit(s).alias("strategy"), *m)
                     for m in own for p in passes for s in strategies])
    kept = [c for c in tasks.columns if not models or c not in ("folder", "model_short")]
    return tasks.select(*kept, F.inline(grid))


def entry_id(task_id, model_short, sample_num, strategy) -> Column:
    """``lower(task with . -> _)_model_pass{n}[_strategy]``."""
    clean = F.replace(F.lower(_c(task_id)), F.lit("."), F.lit("_"))
    base = F.concat(clean, F.lit("_"), _c(model_short), F.lit("_pass"), _c(sample_num).cast("string"))
    s = F.coalesce(_c(strategy), F.lit(""))
    return F.when(s != "", F.concat(base, F.lit("_"), s)).otherwise(base)


def folder_name(folder, strategy) -> Column:
    """folder with a ``_strategy`` suffix unless baseline or empty."""
    s = F.coalesce(_c(strategy), F.lit(""))
    return F.when((s != "") & (s != "baseline"), F.concat(_c(folder), F.lit("_"), s)).otherwise(_c(folder))


def config_hash(**fields: Column) -> Column:
    """sha256 of a key-sorted JSON rendering of the named fields, first 16
    hex digits (stable; JSON spacing is Spark's own, not byte-equal)."""
    st = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.substring(F.sha2(F.to_json(st), 256), 1, 16)


def utc_stamps(at: Column | None = None) -> Column:
    """compact file stamp and ISO timestamp of a time (default: now; the session
    time zone must be UTC)."""
    now = F.current_timestamp() if at is None else at
    return F.struct(
        F.date_format(now, "yyyyMMdd_HHmmss").alias("file"),
        F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"),
    )


def sample_seed(base_seed, pass_index) -> Column:
    """seed = base + pass index, null without a base."""
    return F.when(_c(base_seed).isNotNull(), _c(base_seed) + _c(pass_index))


# ---------------------------------------------------------------- F36-F39
def build_prompt(prompt, strategy, examples: bool = False) -> Column:
    """user prompt by strategy. COT and FSP set the prompt into their own frames
    around the worked example of the task's category (the ``example`` column joined by
    ``with_examples``: prompt, thought, hcl)."""
    s = F.coalesce(_c(strategy), F.lit(""))
    p = _c(prompt)

    def framed(layout):
        if not examples:
            return p
        ex = F.col("example")
        return _fill(layout, example_prompt=ex["prompt"], thought=ex["thought"], hcl=ex["hcl"], question=p)

    return (
        F.when(s == "COT", framed(COT_LAYOUT))
        .when(s == "FSP", framed(FSP_LAYOUT))
        .when(s == "dataset", _fill(DATASET_PROMPT, prompt=p))
        .otherwise(F.concat(F.lit(BASELINE_PREFIX), p))
    )


def with_examples(df: DataFrame, examples: DataFrame, category_col: str = "category") -> DataFrame:
    """Worked example (struct of prompt, thought, hcl) per category; categories
    outside the fixed four use the CREATE example. The planner broadcasts ``examples``
    if it is small."""
    cat = F.upper(F.trim(F.col(category_col)))
    key = F.when(cat.isin(*O.CATEGORIES), cat).otherwise(F.lit("CREATE"))
    # one example per category (the smallest, should a table repeat one)
    ex = examples.groupBy(F.col("category").alias("_ex_key")).agg(F.min(F.struct("prompt", "thought", "hcl")).alias("example"))
    return df.withColumn("_ex_key", key).join(ex, "_ex_key", "left").drop("_ex_key")


def repair_prompt(prompt, code, error) -> Column:
    """two layouts, chosen by whether the error text carries spec errors."""
    spec = F.contains(F.coalesce(_c(error), F.lit("")), F.lit("SPEC ACCURACY ERRORS"))
    return F.when(spec, _fill(REPAIR_SPEC_LAYOUT, prompt=_c(prompt), code=_c(code), error=_c(error))).otherwise(
        _fill(REPAIR_PLAN_LAYOUT, prompt=_c(prompt), code=_c(code), error=_c(error))
    )


def numbered_errors(last_errors, dataset_style: bool = False) -> Column:
    """F37 helper: the last two errors, numbered from 1."""
    arr = F.slice(_c(last_errors), -2, 2)
    arr = F.when(F.size(_c(last_errors)) >= 2, arr).otherwise(_c(last_errors))
    if dataset_style:
        f = lambda e, i: F.concat(F.lit("ERROR "), (i + 1).cast("string"), F.lit(":\n"), e, F.lit("\n\n"))
    else:
        f = lambda e, i: F.concat(F.lit("\nError "), (i + 1).cast("string"), F.lit(":\n"), e, F.lit("\n"))
    return F.array_join(F.transform(arr, f), "")


def multi_error_prompt(prompt, last_errors) -> Column:
    return _fill(MULTI_ERROR_LAYOUT, prompt=_c(prompt), errors=numbered_errors(last_errors))


def dataset_repair_prompt(prompt, last_errors) -> Column:
    return _fill(DATASET_REPAIR_LAYOUT, prompt=_c(prompt), errors=numbered_errors(last_errors, True))


def system_prompt(model_prompt, baseline_prompt, generic_prompt, dataset_prompt, strategy, context=None) -> Column:
    """first configured prompt (dataset strategy uses its own); platform
    context appended only when not already contained."""
    s = F.coalesce(_c(strategy), F.lit(""))
    base = F.when(s == "dataset", _c(dataset_prompt)).otherwise(
        F.coalesce(_c(model_prompt), _c(baseline_prompt), _c(generic_prompt)))
    if context is None:
        return base
    ctx = _c(context)
    return F.when(ctx.isNotNull() & (ctx != "") & ~F.contains(F.coalesce(base, F.lit("")), ctx),
                  F.concat(base, F.lit("\n\n"), ctx)).otherwise(base)


def judge_code(code, limit: int | None = None) -> Column:
    """Code as given to the judge, cut at ``limit`` characters if one is given."""
    return X.truncate_head(_c(code), limit)


def judge_messages(task_prompt, category, code, prompt_limit: int | None = None, code_limit: int | None = None) -> Column:
    """the judge's system and user messages; prompt and code are cut (F6) only at the
    limits given (``JUDGE_PROMPT_CAP`` and ``JUDGE_CODE_CAP`` are those of the fixed layout)."""
    user = _fill(JUDGE_USER_LAYOUT, task_prompt=X.truncate_head(_c(task_prompt), prompt_limit),
                 category=_c(category), terraform_code=judge_code(code, code_limit))
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(JUDGE_SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )


# ---------------------------------------------------------------- F18 / F29 / V10
def prompt_tags(prompt, prompt_type) -> Column:
    """information provided (ram, cpu, disk, network) and missing."""
    low = F.lower(F.coalesce(_c(prompt), F.lit("")))
    has = lambda w: F.contains(low, F.lit(w))
    provided = F.array_compact(F.array(*[F.when(has(w), F.lit(w)) for w in ("ram", "cpu", "disk", "network")]))
    missing = F.array_compact(F.array(
        F.when(F.coalesce(_c(prompt_type), F.lit("")) != "detailed", F.lit("ip_configuration")),
        F.when(~has("disk"), F.lit("disk_size")),
        F.when(~has("network"), F.lit("network_bridge")),
    ))
    return F.struct(provided.alias("information_provided"), missing.alias("information_missing"))


def shortfall(req_memory_bytes, avail_gb, matched) -> Column:
    """shortfall GB and percent over (0 unless matched), score and rating."""
    m = F.coalesce(_c(matched), F.lit(False))
    req_gb = F.coalesce(_c(req_memory_bytes), F.lit(0)).cast("double") / F.lit(float(O.GIB))
    short = F.greatest(F.lit(0.0), req_gb - _c(avail_gb))
    pct = F.when(_c(avail_gb) > 0, short / _c(avail_gb) * 100).otherwise(F.lit(100.0))
    return F.struct(
        F.when(m, F.bround(short, 2)).otherwise(F.lit(0.0)).alias("shortfall_gb"),
        F.when(m, F.bround(pct, 2)).otherwise(F.lit(0.0)).alias("percentage_over"),
        F.when(m, F.lit(10)).otherwise(F.lit(2)).alias("score_out_of_10"),
        F.when(m, F.lit("excellent")).otherwise(F.lit("poor")).alias("rating"),
    )


# ---------------------------------------------------------------- V8
def build_entries(r: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """V8 (+V9, V10): nested result entry per row of a results table.

    Expected columns: task_id, category, prompt_type, prompt, resource_requirements (JSON text),
    code, raw_response, model_short, sample_num, strategy, init_exit, validate_exit,
    plan_exit, plan_stdout, plan_stderr, apply_exit, apply_status, apply_stderr,
    spec_passed, iterations, generation_time, expected_failure_matched, post_passed,
    vm_details, pre_vm_details, usable_ram_gb. ``keep`` names input columns
    carried next to the entry.

    Read if present: evaluated_at (timestamp), evaluator, base_url, python_version,
    terraform_version, git_commit, config (JSON text), init_/validate_/plan_/
    apply_seconds, init_stderr, validate_stderr, spec_status, spec_errors, spec_checks,
    had_replace_actions, post_status, post_errors, manual_interventions and the model's
    and host's settings; else their defaults hold.
    """
    reqs = F.from_json(F.col("resource_requirements"), REQS_SCHEMA)
    s1 = r.select("*", reqs.alias("_r"))
    n = F.when(F.coalesce(F.col("_r.count"), F.lit(0)) == 0, F.lit(1)).otherwise(F.col("_r.count"))
    s2 = s1.select(
        "*",
        n.alias("_n"),
        O.normalized_resources(F.col("_r"), n).alias("_exp"),
        X.setting_total("code", "memory_max").alias("_tmem"),
        X.setting_total("code", "cpus").alias("_tcpu"),
        X.setting_total("code", "size").alias("_tdisk"),
    )
    per = lambda c: F.when(F.col(c).isNotNull(), O.half_even_div(F.col(c), F.col("_n")))
    s3 = s2.select("*", per("_tmem").alias("_amem"), per("_tcpu").alias("_acpu"), per("_tdisk").alias("_adisk"))

    usable = F.coalesce(F.col("usable_ram_gb"), F.lit(float(DEFAULT_USABLE_RAM_GB)))
    ram_sum = lambda c: F.coalesce(F.aggregate(
        F.col(c), F.lit(0.0), lambda a, v: a + F.coalesce(v["ram_gb"].cast("double"), F.lit(0.0))), F.lit(0.0))
    avail_before = F.bround(usable - ram_sum("pre_vm_details"), 2)
    avail_after = F.bround(usable - ram_sum("vm_details"), 2)
    matched = F.coalesce(F.col("expected_failure_matched"), F.lit(False))
    outcome = O.final_outcome("plan_exit", "apply_exit", "apply_status", "spec_passed", "post_passed",
                              "iterations", "expected_failure_matched")
    tags = prompt_tags("prompt", "prompt_type")

    is_exhaustion = F.col("_r.expected_error") == RESOURCE_EXHAUSTION
    code_flags = O.code_flags("code")
    cols = set(r.columns)

    def opt(name, default=None, dtype=None):
        if name in cols:
            return F.col(name)
        v = F.lit(default)
        return v.cast(dtype) if dtype else v

    def stage(name, command, status_col=None, extra=()):
        code_col, error = f"{name}_exit", opt(f"{name}_stderr", None, "string")
        fields = [
            O.stage_status(code_col, status_col).alias("status"),
            F.lit(command).alias("command"),
            F.coalesce(F.col(code_col), F.lit(1)).alias("exit_code"),
            F.coalesce(opt(f"{name}_seconds", None, "double"), F.lit(0.0)).alias("execution_time_seconds"),
            *extra,
            O.stage_error(code_col, error).alias("error_message"),
        ]
        return F.struct(*fields)

    at = F.coalesce(opt("evaluated_at", None, "timestamp"), F.current_timestamp())
    texts, no_texts = "array<string>", F.array().cast("array<string>")
    spec_status = F.coalesce(opt("spec_status", None, "string"), F.when(F.col("spec_passed").isNull(), F.lit("skipped")).otherwise(F.lit("executed")))
    post_status = F.coalesce(opt("post_status", None, "string"), F.when(F.col("post_passed").isNull(), F.lit("not_applicable")).otherwise(F.lit("executed")))
    version = F.coalesce(opt("model_version", None, "string"), F.lit("unknown"))
    # the whole configuration, keys sorted; without one, the fields that name the run
    of_config = F.substring(F.sha2(F.to_json(F.try_parse_json(opt("config", None, "string"))), 256), 1, 16)
    run_hash = F.coalesce(of_config, config_hash(model=F.col("model_short"), model_version=version, enhance_strat=F.coalesce(F.col("strategy"), F.lit(""))))
    env = O.inferred_environment("code")
    short = shortfall(F.col("_r.memory_max_bytes"), avail_before, matched)
    clean_id = F.replace(F.lower(F.col("task_id")), F.lit("."), F.lit("_"))
    screenshots = F.struct(*[
        F.concat(F.lit("screenshots/"), clean_id, F.lit("_"), F.col("model_short"), F.lit(f"_{suffix}.png")).alias(name)
        for name, suffix in SCREENSHOTS
    ])
    # V9 + J11: the update target before and after, looked up by name inside the snapshots
    target = F.coalesce(F.col("_r.target_vm"), F.lit(""))
    pre_vm = F.try_element_at(F.filter("pre_vm_details", lambda v: v["name"] == target), F.lit(1))
    post_vm = F.try_element_at(F.filter("vm_details", lambda v: v["name"] == target), F.lit(1))
    spec_replace = F.coalesce(opt("had_replace_actions", False, "boolean"), F.lit(False))
    update_section = F.when(F.startswith(F.col("task_id"), F.lit("U")), F.struct(
        target.alias("target_vm"),
        (~spec_replace).alias("plan_shows_in_place_update"),
        spec_replace.alias("plan_shows_destroy_create"),
        F.coalesce(pre_vm["uuid"], F.lit("unknown")).alias("vm_uuid_before"),
        F.coalesce(post_vm["uuid"], F.lit("unknown")).alias("vm_uuid_after"),
        F.coalesce(pre_vm["uuid"] == post_vm["uuid"], F.lit(False)).alias("uuid_unchanged"),
        F.lit(0).alias("vm_downtime_seconds"),
        F.coalesce(F.col("spec_passed"), F.lit(True)).alias("resource_change_correct"),
        F.coalesce(pre_vm["ram_gb"], F.lit(0.0)).alias("ram_before_gb"),
        F.coalesce(post_vm["ram_gb"], F.lit(0.0)).alias("ram_after_gb"),
        F.coalesce(pre_vm["cpus"], F.lit(0)).alias("cpu_before"),
        F.coalesce(post_vm["cpus"], F.lit(0)).alias("cpu_after"),
    ))
    alts = X.alternatives(F.when(matched, F.col("raw_response")))
    entry = F.struct(
        F.lit("1.0").alias("dataset_version"),
        entry_id("task_id", "model_short", "sample_num", "strategy").alias("entry_id"),
        F.col("task_id"),
        F.concat(F.coalesce("category", F.lit("")), F.lit(" - "), F.coalesce("prompt_type", F.lit(""))).alias("task_description"),
        utc_stamps(at)["iso"].alias("timestamp"),
        opt("evaluator", None, "string").alias("evaluator"),
        F.col("sample_num"),
        F.struct(
            F.coalesce(opt("model_name", None, "string"), F.col("model_short")).alias("model_name"),
            version.alias("model_version"),
            F.coalesce(opt("temperature", None, "double"), F.lit(ENTRY_DEFAULTS["temperature"])).alias("temperature"),
            F.coalesce(opt("max_tokens", None, "int"), F.lit(ENTRY_DEFAULTS["max_tokens"])).alias("max_tokens"),
            opt("seed", None, "bigint").alias("seed"),
            F.coalesce(F.col("prompt_type"), F.lit("unknown")).alias("prompt_type"),
            F.coalesce(F.col("strategy"), F.lit("")).alias("enhance_strat"),
            F.concat(F.coalesce(F.size("pre_vm_details"), F.lit(0)).cast("string"), F.lit("_vms_running"))
            .alias("infrastructure_state_before"),
            *[F.coalesce(opt(c, None, "string"), F.lit("unknown")).alias(c)
              for c in ("base_url", "python_version", "terraform_version", "git_commit")],
            run_hash.alias("config_hash"),
            F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp_utc"),
        ).alias("metadata"),
        F.struct(
            F.lit("single_xcpng_host").alias("infrastructure"),
            F.coalesce(opt("total_ram_gb", None, "int"), F.lit(ENTRY_DEFAULTS["total_ram_gb"])).alias("total_ram_gb"),
            F.coalesce(opt("total_cpu_cores", None, "int"), F.lit(ENTRY_DEFAULTS["total_cpu_cores"])).alias("total_cpu_cores"),
            usable.alias("usable_ram_gb"),
            avail_before.alias("available_ram_gb_before"),
            avail_after.alias("available_ram_gb_after"),
            O.edge_case_label(F.col("_r.expected_error")).alias("edge_case"),
            X.redact(F.coalesce(opt("system_prompt", "", "string"), F.lit(""))).alias("system_prompt"),
        ).alias("scenario"),
        F.struct(F.col("prompt").alias("input_text"), tags["information_provided"].alias("information_provided"),
                 tags["information_missing"].alias("information_missing")).alias("prompt"),
        F.struct(
            F.col("code").alias("generated_code"),
            X.redact(F.coalesce(F.col("raw_response"), F.lit(""))).alias("full_response_text"),
            no_texts.alias("questions_asked"),
            no_texts.alias("additional_files_generated"),
            F.coalesce("iterations", F.lit(1)).alias("iterations_needed"),
            F.coalesce(F.col("generation_time"), F.lit(0.0)).alias("time_to_generate_seconds"),
            F.struct(
                env["os_version"].alias("os_version"),
                O.inferred_default("_acpu", "prompt", "cpu").alias("cpus"),
                O.inferred_default("_amem", "prompt", "ram").alias("ram_bytes"),
                O.inferred_default("_adisk", "prompt", "disk").alias("disk_bytes"),
                *[env[c].alias(c) for c in ("network", "storage_sr", "ip_mode")],
            ).alias("inferred_defaults"),
        ).alias("llm_response"),
        F.struct(
            stage("init", "terraform init").alias("terraform_init"),
            stage("validate", "terraform validate").alias("terraform_validate"),
            stage("plan", "terraform plan -out=tfplan", extra=[
                O.plan_counts("plan_stdout")[f].alias(f)
                for f in ("resources_to_create", "resources_to_modify", "resources_to_destroy")
            ]).alias("terraform_plan"),
            stage("apply", "terraform apply -auto-approve", "apply_status").alias("terraform_apply"),
            F.struct(
                F.coalesce(F.size("vm_details"), F.lit(0)).alias("actual_vm_count"),
                (F.coalesce(F.size("vm_details"), F.lit(0)) > 0).alias("vms_exist_in_xo"),
                F.coalesce(F.forall("vm_details", lambda v: F.coalesce(v["status"] == "Running", F.lit(False))), F.lit(False)).alias("all_vms_running"),
                F.col("vm_details"),
            ).alias("verification"),
        ).alias("execution_results"),
        F.struct(
            F.col("_n").alias("vm_count"),
            F.col("_exp").alias("expected"),
            F.struct(F.col("_amem").alias("per_vm_memory_max_bytes"), F.col("_acpu").alias("per_vm_cpus"),
                     F.col("_adisk").alias("per_vm_size_bytes"), F.col("_tmem").alias("total_memory_max_bytes"),
                     F.col("_tcpu").alias("total_cpus"), F.col("_tdisk").alias("total_size_bytes")).alias("actual"),
        ).alias("resource_expectations"),
        F.struct(
            spec_status.alias("status"),
            F.col("spec_passed").alias("passed"),
            opt("spec_checks", None, "array<struct<check:string,passed:boolean>>").alias("checks_performed"),
            F.coalesce(opt("spec_errors", None, texts), no_texts).alias("errors"),
            F.struct(opt("had_replace_actions", None, "boolean").alias("had_replace_actions")).alias("details"),
        ).alias("spec_accuracy"),
        F.struct(
            post_status.alias("status"),
            F.col("post_passed").alias("passed"),
            F.coalesce(opt("post_errors", None, texts), no_texts).alias("errors"),
        ).alias("post_state_verification"),
        outcome.alias("final_outcome"),
        F.struct(
            F.struct(
                code_flags["provider_config_included"].alias("provider_config_included"),
                code_flags["data_sources_included"].alias("data_sources_included"),
                code_flags["vm_resource_defined"].alias("vm_resource_defined"),
                code_flags["infers_ubuntu_2204"].alias("infers_ubuntu_2204"),
                O.compliance("_acpu", F.col("_exp.per_vm_cpus"), O.MIN_CPUS, "expected_failure_matched").alias("complies_with_vcpu_req"),
                O.compliance("_amem", F.col("_exp.per_vm_memory_max_bytes"), O.MIN_RAM_BYTES, "expected_failure_matched").alias("complies_with_ram_req"),
                O.compliance("_adisk", F.col("_exp.per_vm_size_bytes"), O.MIN_DISK_BYTES, "expected_failure_matched").alias("complies_with_disk_req"),
                code_flags["network_xenbr0"].alias("network_xenbr0"),
                code_flags["dhcp_configured"].alias("dhcp_configured"),
            ).alias("code_quality"),
            F.struct(
                F.coalesce(F.col("init_exit") == 0, F.lit(False)).alias("terraform_init_success"),
                F.coalesce(F.col("validate_exit") == 0, F.lit(False)).alias("terraform_validate_success"),
                outcome["plan_success"].alias("terraform_plan_success"),
                outcome["apply_success"].alias("terraform_apply_success"),
                (F.coalesce(F.size("vm_details"), F.lit(0)) > 0).alias("vm_in_xen_orchestra"),
                F.coalesce(F.forall("vm_details", lambda v: F.coalesce(v["status"] == "Running", F.lit(False))), F.lit(False))
                .alias("vm_running"),
                O.vm_ram_ok("_amem", "vm_details").alias("vm_has_correct_ram"),
                O.all_have_address("vm_details").alias("vm_has_dhcp_ip"),
                F.lit(True).alias("server_resources_correct"),
            ).alias("execution"),
        ).alias("validation_checklist"),
        update_section.alias("update_operation_validation"),
        F.when(is_exhaustion, F.struct(
            matched.alias("recognized_over_provisioning"),
            matched.alias("warned_user"),
            matched.alias("calculated_shortfall"),
            short["shortfall_gb"].alias("shortfall_gb"),
            short["percentage_over"].alias("percentage_over"),
            (F.size(alts) > 0).alias("suggested_alternatives"),
            alts.alias("alternatives_provided"),
            (~matched).alias("generated_failing_code"),
            F.when(~matched, ~F.coalesce(F.col("apply_exit") == 0, F.lit(False))).alias("if_code_generated_apply_failed"),
            F.col("apply_stderr").alias("apply_error_message"),
        )).alias("edge_case_handling"),
        F.when(is_exhaustion, F.struct(
            short["score_out_of_10"].alias("score_out_of_10"),
            short["rating"].alias("rating"),
            F.when(matched, F.lit(REASONING[True])).otherwise(F.lit(REASONING[False])).alias("reasoning"),
        )).alias("edge_case_score"),
        F.coalesce(opt("manual_interventions", None, texts), no_texts).alias("manual_interventions"),
        screenshots.alias("screenshots"),
        _fill(NOTES_LAYOUT, task=F.col("task_id"), model=F.col("model_short"),
              iterations=F.coalesce("iterations", F.lit(1)).cast("string")).alias("evaluator_notes"),
    )
    return s3.select(entry.alias("entry"), *keep)
