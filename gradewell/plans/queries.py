"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads whole driver tables through a binding in ``bindings.py``
and applies library operators; ``oracle.py`` holds the equivalent SQL.
Doubles are rounded once, at output, so the two engines agree bit-for-bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import outcome as O
from ..functions import text as TX
from ..functions.outcome import data_quality_violations, no_usable_code, normalize_reference
from ..operators import agreement as AG
from ..operators import bleu as BL
from ..operators import chains as CH
from ..operators import complexity as CX
from ..operators import dataset as DS
from ..operators import embed as EM
from ..operators import graph as GR
from ..operators import metrics, running
from ..operators import post_state as PS
from ..operators import report as RP
from ..operators import rules as RU
from ..session import read_table, scratch_dir
from ..sources import readers as RD
from ..sources import sinks as SK
from ..streaming import progress as ST
from . import bindings as B

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return deco


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    """Round every double column once, at output."""
    return df.select(
        *[
            F.round(F.col(f.name), places).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# ------------------------------------------------------------ result analytics
@register("pass_at_k_by_task")
def q_pass_at_k_by_task(spark, sf):
    return rounded(metrics.pass_at_k_table(B.samples(spark, sf)))


@register("pass_at_k_summary")
def q_pass_at_k_summary(spark, sf):
    return rounded(metrics.global_summary(B.samples(spark, sf)))


@register("per_task_breakdown")
def q_per_task_breakdown(spark, sf):
    return rounded(metrics.per_task_breakdown(B.samples(spark, sf)))


@register("per_experiment_metrics")
def q_per_experiment(spark, sf):
    return rounded(metrics.per_experiment(B.samples(spark, sf), ["folder"]))


@register("running_progress")
def q_running_progress(spark, sf):
    # durations as integer centiseconds: exact running sums in any order
    s = B.samples(spark, sf).select(
        "folder", "event_id", F.round(F.col("gen_s") * 100).cast("long").alias("gen_cs")
    )
    r = running.running_progress(s, "folder", "event_id", "gen_cs", units_per_second=100.0)
    return r.drop("gen_cs")


@register("running_progress_outliers")
def q_running_progress_outliers(spark, sf):
    """W1 over keys with gaps, clusters and outliers, in blocks of 1,000 rows."""
    s = B.clustered_samples(spark, sf)
    r = running.running_progress(s, "folder", "position", "gen_cs", units_per_second=100.0, rows_per_block=1000)
    return r.drop("gen_cs")


@register("duplicate_plan_keys")
def q_duplicate_plan_keys(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return metrics.duplicates(li, ["l_orderkey", "l_linenumber"])


# ------------------------------------------------------------ judge agreement


def _judged(spark, sf):
    return AG.with_verdict(B.judged(spark, sf))


@register("judge_verdicts")
def q_judge_verdicts(spark, sf):
    j = _judged(spark, sf)
    return j.select("doc_id", "task_id", "verdict", "spec_passed", AG.judge_agrees().alias("agree"))


@register("judge_confusion")
def q_judge_confusion(spark, sf):
    return rounded(AG.confusion(_judged(spark, sf)))


@register("judge_confusion_by_task")
def q_judge_confusion_by_task(spark, sf):
    return rounded(AG.confusion(_judged(spark, sf), ["task_id"]))


@register("judge_disagreements")
def q_judge_disagreements(spark, sf):
    return AG.disagreements(_judged(spark, sf), ["task_id", "doc_id"])


@register("judge_skip_existing")
def q_judge_skip_existing(spark, sf):
    j = B.judged(spark, sf)
    stored = j.filter(F.col("doc_id") % 4 == 0).select(
        "doc_id", F.lit("Correct").alias("verdict")
    )
    out = AG.skip_existing(j, stored, "doc_id", lambda w: AG.with_verdict(w))
    return out.select("doc_id", "verdict", "source")


# ------------------------------------------------------------ ground truth
def _gt_cols(truth):
    return truth.select("task_id", "event_id", "plan_ok", "apply_ok", "spec_ok", "iterations")


@register("ground_truth_compare")
def q_ground_truth_compare(spark, sf):
    res, truth = B.results_and_truth(spark, sf)
    gt = AG.first_per_group(_gt_cols(truth), "task_id", ["event_id"])
    c = AG.compare_with_ground_truth(res, gt)
    return c.select("task_id", "event_id", "plan_match", "apply_match", "spec_match",
                    "iterations", "gt_iterations")


@register("ground_truth_summary")
def q_ground_truth_summary(spark, sf):
    res, truth = B.results_and_truth(spark, sf)
    gt = AG.first_per_group(_gt_cols(truth), "task_id", ["event_id"])
    s = AG.ground_truth_summary(AG.compare_with_ground_truth(res, gt))
    return rounded(s.withColumn("spec_band", AG.agreement_band("spec_pct")))


@register("ground_truth_unmatched")
def q_ground_truth_unmatched(spark, sf):
    res, truth = B.results_and_truth(spark, sf)
    return res.select("task_id").distinct().join(truth.select("task_id"), "task_id", "left_anti")


# ------------------------------------------------------------ text functions
@register("code_extraction")
def q_code_extraction(spark, sf):
    f = B.fenced(spark, sf)
    code = TX.extract_code("response")
    return f.select("conv_id", "turn", "category", code.alias("code")).select(
        "conv_id", "turn", "code", F.length("code").alias("code_chars"),
        no_usable_code(F.col("code"), F.col("category")).alias("no_usable_code"),
    )


@register("text_hygiene")
def q_text_hygiene(spark, sf):
    t = B.error_texts(spark, sf)
    red = TX.redact("text")
    san = TX.sanitize_error("text", TX.TRUNCATE_MAX)
    head = TX.truncate_head("text", TX.TRUNCATE_MAX, TX.CONTEXT_MARKER)
    return t.select(
        "doc_id",
        F.size(F.regexp_extract_all("text", F.lit(TX.REDACT_PATTERN), 0)).alias("redaction_hits"),
        F.md5(red).alias("redacted_md5"),
        F.length(san).alias("sanitized_chars"),
        F.md5(san).alias("sanitized_md5"),
        F.md5(head).alias("head_md5"),
        (F.length(TX.strip_ansi("text")) > TX.TRUNCATE_MAX).alias("truncated"),
    )


# ------------------------------------------------------------ BLEU


def _bleu_pairs(spark, sf):
    return BL.bleu(B.pairs(spark, sf), ["conv_id", "turn"], "reference", "candidate")


@register("bleu_pairs")
def q_bleu_pairs(spark, sf):
    return rounded(_bleu_pairs(spark, sf))


@register("bleu_summary")
def q_bleu_summary(spark, sf):
    b = _bleu_pairs(spark, sf)
    band = AG.bleu_band("bleu")
    s = b.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count("bleu").alias("n_scored"),
        F.avg("bleu").alias("avg_bleu"),
        F.count_if(band == "excellent").alias("n_excellent"),
        F.count_if(band == "good").alias("n_good"),
        F.count_if(band == "fair").alias("n_fair"),
        F.count_if(band == "poor").alias("n_poor"),
    )
    return rounded(s)


# ------------------------------------------------------------ complexity


def _scored_brands(spark, sf):
    return CX.score_fragments(B.hcl_fragments(spark, sf), "doc", "hcl")


@register("hcl_complexity")
def q_hcl_complexity(spark, sf):
    s = _scored_brands(spark, sf)
    return s.select(
        "doc", "loc", "resources", "interconnections", "level",
        F.size("resource_types").alias("n_types"),
        F.array_join("resource_types", ",").alias("types"),
        "total_cpus", "total_memory_max", "total_size",
        "provider_config_included", "vm_resource_defined",
    )


@register("hcl_complexity_integers")
def q_hcl_complexity_integers(spark, sf):
    s = CX.score_fragments(B.hcl_fragments(spark, sf), "doc", "hcl", mode="integers")
    return s.select("doc", "total_cpus", "total_memory_max")


@register("part_block_complexity")
def q_part_block_complexity(spark, sf):
    s = CX.score_texts(B.hcl_fragments(spark, sf), "hcl")
    return s.select("frag_pos", "loc", "resources", "interconnections", "level",
                    F.array_join("resource_types", ",").alias("types"), "total_cpus", "total_memory_max")


@register("resource_type_distribution")
def q_resource_type_distribution(spark, sf):
    return CX.type_distribution(_scored_brands(spark, sf), "doc")


@register("complexity_summary")
def q_complexity_summary(spark, sf):
    return CX.scoring_summary(_scored_brands(spark, sf))


# ------------------------------------------------------------ rules


def _spec_results(spark, sf):
    plans = RU.plan_documents(B.plan_rows(spark, sf))
    return RU.check_plans(plans, B.specs(spark, sf))


def _written(spark, df, name):
    """The rows as a table, whose size the planner knows: where it is small, the other
    side of a join isn't shuffled."""
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _checks_text(c, field="passed"):
    return F.array_join(
        F.transform(c, lambda x: F.concat(x["check"], F.lit("="), F.coalesce(x[field].cast("string"), F.lit("null")))),
        ",",
    )


@register("spec_check")
def q_spec_check(spark, sf):
    r = _spec_results(spark, sf)
    return r.select(
        "plan_id", "category", "passed", F.size("errors").alias("n_errors"),
        F.array_join("errors", " | ").alias("errors"), _checks_text(F.col("checks")).alias("checks"),
        _checks_text(F.col("checks"), "ok").alias("checks_true"),
        "had_replace_actions",
    )


@register("spec_check_summary")
def q_spec_check_summary(spark, sf):
    r = _spec_results(spark, sf)
    return r.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_plans"),
        F.count_if("passed").alias("n_passed"),
        F.sum(F.size("errors")).alias("n_errors"),
        F.count_if(F.exists("errors", lambda e: F.startswith(e, F.lit("HOST QUOTA")))).alias("n_quota_failures"),
    )


@register("plan_samples_spec_check")
def q_plan_samples_spec_check(spark, sf):
    """S5 -> P6 -> J4 -> V1-V6 with J9: plan documents (JSON Lines, some unreadable,
    some empty) read nested and checked in place; specs are looked up by trimmed
    task id, quotas start from the VMs on the host. Every document has a row."""
    path = scratch_dir(spark, "plan-samples")
    B.write_plan_samples(spark, sf, path)
    extra = (T.StructField("task_id", T.StringType()), T.StructField("pre_vms", T._parse_datatype_string(B.PRE_VMS_T)))
    plans = RD.plan_documents_of(RD.read_plans(spark, path, key_field="plan_key", extra=extra), "task_id", "pre_vms")
    r = RU.check_plans(plans, _written(spark, B.task_specs(spark, sf), "task-specs"), task_col="task_id")
    return r.select(
        "plan_id", F.trim("task_id").alias("task_id"), "category", "status", "passed", F.size("errors").alias("n_errors"),
        F.array_join("errors", " | ").alias("errors"), _checks_text(F.col("checks")).alias("checks"), "had_replace_actions",
    )


@register("host_quota")
def q_host_quota(spark, sf):
    h = RU.host_quota(B.host_state_rows(spark, sf), "host_id", "name_label", ["prio", "plan_id", "pos"])
    return h.select("host_id", "n_vms", "total_ram", "total_cpus", "total_disk", "passed",
                    F.array_join("errors", " | ").alias("errors"))


# ------------------------------------------------------------ post state / graph


@register("post_state_check")
def q_post_state_check(spark, sf):
    pre, post, specs = B.vm_snapshots(spark, sf)
    r = PS.verify_post_state(pre, post, specs)
    return r.select("task_id", "category", "passed", F.array_join("errors", " | ").alias("errors"))


@register("update_validation")
def q_update_validation(spark, sf):
    pre, post, specs = B.vm_snapshots(spark, sf)
    return rounded(PS.update_validation(pre, post, specs))


@register("vm_inventory")
def q_vm_inventory(spark, sf):
    return rounded(GR.vm_inventory(*B.vm_objects(spark, sf)))


@register("host_snapshot")
def q_host_snapshot(spark, sf):
    return GR.host_snapshot(GR.vm_inventory(*B.vm_objects(spark, sf)))


# ------------------------------------------------------------ embeddings / chains


@register("embedding_match")
def q_embedding_match(spark, sf):
    t = B.vec_tokens(spark, sf)
    scores = EM.embedding_match(t, ["pair_id"])
    pairs = t.select("pair_id").distinct()
    return pairs.join(scores, "pair_id", "left")


@register("attempt_rollup")
def q_attempt_rollup(spark, sf):
    r = CH.attempt_rollup(B.attempt_log(spark, sf), "run_id", "iteration")
    return r.withColumn("total_gen_s", F.round("total_gen_s", 2))


@register("error_tail")
def q_error_tail(spark, sf):
    t = CH.error_tail(B.attempt_log(spark, sf), "run_id", "iteration")
    return t.select("run_id", "iteration", "stage", "tail_rank", "prompt_no")


@register("chain_progress")
def q_chain_progress(spark, sf):
    return CH.chain_progress(B.chain_steps(spark, sf), "chain_id")


# ------------------------------------------------------------ dataset building

PASSES = (1, 2, 3)
STRATEGIES = ("", "COT", "FSP", "dataset", "multi-turn")


@register("run_matrix")
def q_run_matrix(spark, sf):
    t = B.bench_tasks(spark, sf)
    m = DS.with_examples(DS.run_matrix(t, PASSES, STRATEGIES), B.worked_examples(spark, sf))
    return m.select(
        "item_id", "pass_no", "strategy",
        DS.entry_id("task_id", "model_short", "pass_no", "strategy").alias("entry_id"),
        DS.folder_name("folder", "strategy").alias("folder"),
        DS.sample_seed("base_seed", F.col("pass_no") - 1).alias("seed"),
        F.md5(DS.build_prompt("prompt", "strategy", examples=True)).alias("prompt_md5"),
    )


@register("run_matrix_models")
def q_run_matrix_models(spark, sf):
    """J14 with a model axis: every task x pass x strategy x model."""
    models = (("model_a", "a"), ("model_b", "b"), ("model_c", "c"))
    m = DS.run_matrix(B.bench_tasks(spark, sf), PASSES, STRATEGIES, models)
    return m.select(
        "item_id", "pass_no", "strategy", "model_short",
        DS.entry_id("task_id", "model_short", "pass_no", "strategy").alias("entry_id"),
        DS.folder_name("folder", "strategy").alias("folder"),
    )


@register("entry_outcomes")
def q_entry_outcomes(spark, sf):
    e = DS.build_entries(B.result_rows(spark, sf)).select("entry.*")
    fo, vc, lr = F.col("final_outcome"), F.col("validation_checklist"), F.col("llm_response")
    ex = F.col("execution_results")
    return e.select(
        "entry_id", "task_id", "task_description",
        fo["plan_success"].alias("plan_success"), fo["apply_success"].alias("apply_success"),
        fo["execution_successful"].alias("execution_successful"), fo["meets_requirements"].alias("meets_requirements"),
        fo["total_fixes_needed"].alias("total_fixes_needed"), fo["resource_allocation_correct"].alias("resource_allocation_correct"),
        ex["terraform_apply"]["status"].alias("apply_status"), ex["terraform_plan"]["resources_to_create"].alias("to_create"),
        ex["terraform_plan"]["resources_to_destroy"].alias("to_destroy"),
        ex["terraform_validate"]["status"].alias("validate_status"),
        ex["terraform_plan"]["error_message"].alias("plan_error"),
        F.array_join(F.col("prompt.information_provided"), ",").alias("info_provided"),
        F.array_join(F.col("prompt.information_missing"), ",").alias("info_missing"),
        lr["inferred_defaults"]["cpus"].alias("inferred_cpus"), lr["inferred_defaults"]["ram_bytes"].alias("inferred_ram"),
        lr["inferred_defaults"]["disk_bytes"].alias("inferred_disk"), lr["inferred_defaults"]["ip_mode"].alias("ip_mode"),
        F.md5(lr["full_response_text"]).alias("response_md5"),
        F.col("resource_expectations.expected.per_vm_memory_max_bytes").alias("expected_mem"),
        F.col("resource_expectations.actual.total_memory_max_bytes").alias("actual_total_mem"),
        vc["code_quality"]["complies_with_ram_req"].alias("ram_ok"),
        vc["code_quality"]["complies_with_vcpu_req"].alias("vcpu_ok"),
        vc["code_quality"]["complies_with_disk_req"].alias("disk_ok"),
        vc["execution"]["vm_has_correct_ram"].alias("vm_ram_ok"),
        vc["execution"]["vm_has_dhcp_ip"].alias("dhcp_ip"), vc["code_quality"]["dhcp_configured"].alias("dhcp_configured"),
        F.col("scenario.edge_case").alias("edge_case"),
        F.col("scenario.available_ram_gb_after").alias("avail_after"),
        F.array_join(F.col("edge_case_handling.alternatives_provided"), ";").alias("alternatives"),
        F.col("edge_case_handling.shortfall_gb").alias("shortfall_gb"),
        F.col("scenario.available_ram_gb_before").alias("avail_before"),
        F.col("metadata.infrastructure_state_before").alias("state_before"),
        F.col("update_operation_validation.uuid_unchanged").alias("uuid_unchanged"),
        F.col("update_operation_validation.cpu_before").alias("cpu_before"),
        F.col("screenshots.terraform_apply_output").alias("apply_screenshot"),
        "evaluator_notes", "timestamp", F.col("metadata.timestamp_utc").alias("timestamp_utc"),
        F.col("metadata.config_hash").alias("config_hash"), F.col("metadata.base_url").alias("base_url"),
        ex["terraform_plan"]["execution_time_seconds"].alias("plan_seconds"), ex["verification"]["actual_vm_count"].alias("vms_found"),
        F.col("spec_accuracy.status").alias("spec_status"), F.col("post_state_verification.status").alias("post_status"),
        F.col("edge_case_score.rating").alias("rating"), lr["inferred_defaults"]["os_version"].alias("os_version"),
    )


# ------------------------------------------------------------ streaming


@register("stream_pass_at_k")
def q_stream_pass_at_k(spark, sf):
    # re-delivered results are dropped by id, however late
    counts = ST.task_counts_stream(B.samples_stream(spark, sf), key="event_id")
    return rounded(ST.pass_at_k_from_counts(ST.run_to_completion(spark, counts)))


@register("stream_pass_at_k_replaced")
def q_stream_pass_at_k_replaced(spark, sf):
    """ST1 with S8's replaced entries: results land in two deliveries, and a stream with one
    checkpoint is run after each, several files a batch. The second delivery replaces every third
    entry and brings another third again in its old version."""
    root = scratch_dir(spark, "deliveries")
    changes, checkpoint = scratch_dir(spark, "changes"), scratch_dir(spark, "changes-stream")
    pages = None
    for name, rows in B.deliveries(spark, sf).items():
        rows.write.parquet(f"{root}/{name}")
        pages = pages or max(64, rows.count() // 100)
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 4).parquet(root)
        counts = ST.run_changes(spark, ST.changes_stream(stream, "event_id", "run_no", pages), changes, checkpoint)
    return rounded(ST.pass_at_k_from_counts(counts))


# ------------------------------------------------------------ sink -> source round trip


@register("entries_roundtrip_pass_at_k")
def q_entries_roundtrip(spark, sf):
    """S8 -> S2 -> P1/P2 -> A1/A2: entries are written as JSON partitioned by
    experiment folder under the shared checkpoint folder, read back with the
    explicit entry schema, flattened and scored. The written table also cuts
    the lineage of the builder plan."""
    e = DS.build_entries(B.result_rows(spark, sf)).select("entry.*")
    e = e.withColumn("model_folder", F.col("metadata.model_name")).withColumn("strategy", F.col("metadata.enhance_strat"))
    folder = SK.write_entries(e, scratch_dir(spark, "entries"))
    back = RD.entry_samples(RD.read_entries(spark, folder, one_per_file=False))
    return rounded(metrics.pass_at_k_table(back))


@register("entries_merge")
def q_entries_merge(spark, sf):
    """S8 + S9: all entries are written; the first passes are run again and written
    with a new description; the table read back holds every entry once, new where
    it was run again."""
    e = DS.build_entries(B.result_rows(spark, sf)).select("entry.*")
    e = e.withColumn("model_folder", F.col("metadata.model_name")).withColumn("strategy", F.col("metadata.enhance_strat"))
    root = scratch_dir(spark, "entries")
    SK.write_entries(e, root)
    again = e.filter("sample_num = 1").withColumn("task_description", F.lit("run again"))
    folder = SK.write_entries(again, root)
    back = RD.read_entries(spark, folder, one_per_file=False)
    return back.select("entry_id", "sample_num", (F.col("task_description") == "run again").alias("rerun"))


@register("infra_context")
def q_infra_context(spark, sf):
    ctx = RD.infra_context(B.state_documents(spark, sf))
    return ctx.select(
        "state_id", "kind", "type", F.col("rpos").alias("resource_pos"), F.size("fields").alias("n_fields"),
        F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("field_keys"),
        F.col("fields")["name_label"].alias("name_label_json"),
    )


@register("reference_precedence")
def q_reference_precedence(spark, sf):
    tasks, files = B.task_references(spark, sf)
    # item_id is the unique key here (task ids repeat across items): one join, three precedences
    j = RP.with_reference_files(tasks, files.select("item_id", "hcl"), key="item_id")
    synced = RP.synced_reference()
    scoring = RP.scoring_reference()
    return j.select(
        "item_id",
        F.md5(RP.metrics_reference()).alias("metrics_ref_md5"),
        F.md5(normalize_reference(scoring)).alias("scoring_ref_md5"),
        scoring.isNull().alias("unscored"),
        F.md5(synced).alias("synced_md5"),
        F.array_join(data_quality_violations(F.col("task_id"), F.col("category"), synced), ",").alias("violations"),
    )


@register("judge_report_with_code")
def q_judge_report_with_code(spark, sf):
    """Judged rows carry the code extracted from the document as a model
    response (fenced for even ids, plain prose otherwise); blank code is not
    judged (verdict Skip) and drops out of the confusion."""
    d = read_table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```hcl\n"), F.col("text"), F.lit("\n```")))
        .otherwise(F.col("text")).alias("response"),
    )
    j = B.judged(spark, sf).join(d, "doc_id")
    rows = j.select("doc_id", "task_id", "judge_text", "spec_passed", TX.extract_code("response").alias("code"))
    v, conf, _ = RP.judge_report(rows)
    return v.select("doc_id", "task_id", "verdict", "agree", F.length("code").alias("code_chars"))


@register("bleu_by_conversation")
def q_bleu_by_conversation(spark, sf):
    """A6 with scores: per conversation, pairs and average BLEU (null when none scored)."""
    b = BL.bleu(B.pairs(spark, sf), ["conv_id", "turn"], "reference", "candidate")
    return rounded(b.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("bleu").alias("avg_bleu"),
                                            F.max("bleu").alias("max_bleu")))


@register("evaluated_entries")
def q_evaluated_entries(spark, sf):
    """The §3.1 lifecycle: each evaluated sample refers to a plan (conv_id * 8 + turn);
    the plan is checked against its spec and the outcome flows into the entry."""
    results = B.result_rows(spark, sf).withColumn("plan_id", (F.col("conv_id") * 8 + F.col("turn")).cast("long"))
    plans = RU.plan_documents(B.plan_rows(spark, sf))
    e = RP.evaluate_results(results, plans, B.specs(spark, sf))
    return e.select(
        "plan_id", F.col("entry.entry_id").alias("entry_id"),
        F.col("entry.spec_accuracy.passed").alias("spec_passed"),
        F.when(F.col("spec_errors").isNotNull(), F.size("spec_errors")).alias("n_spec_errors"),
        F.size("entry.spec_accuracy.errors").alias("n_entry_errors"), F.col("entry.spec_accuracy.status").alias("spec_status"),
        F.col("entry.final_outcome.meets_requirements").alias("meets_requirements"),
        F.col("entry.final_outcome.resource_allocation_correct").alias("resource_allocation_correct"),
    )


@register("state_key_search")
def q_state_key_search(spark, sf):
    """every value stored under ``cpus`` at any depth of each state document."""
    hits = GR.find_key_values(B.state_json(spark, sf), "state_id", "doc", "cpus")
    return hits.select("state_id", F.size("path").alias("depth"), "value")


@register("repair_prompts")
def q_repair_prompts(spark, sf):
    """F37-F39 over W4: per run, the two newest errors (oldest first) feed the
    multi-error and dataset repair prompts; the newest error and a stand-in code
    feed the repair prompt and the judge messages."""
    log = B.attempt_log(spark, sf).withColumn(
        "error",
        F.when(F.col("stage") == "spec_failed",
               F.concat(F.lit("SPEC ACCURACY ERRORS: iteration "), F.col("iteration").cast("string")))
        .otherwise(F.concat(F.lit("Error: plan failed at iteration "), F.col("iteration").cast("string"))),
    )
    tail = CH.error_tail(log, "run_id", "iteration").filter(F.col("prompt_no").isNotNull())
    # at most two rows per run reach this aggregate (bounded by the tail length)
    per_run = tail.groupBy("run_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("prompt_no", "error"))), lambda x: x["error"]).alias("errs"))
    prompt = F.concat(F.lit("Provision the VMs for user "), F.col("run_id").cast("string"))
    code = F.concat(F.lit('resource "xenorchestra_vm" "u'), F.col("run_id").cast("string"), F.lit('" {}'))
    newest = F.element_at("errs", -1)
    user_msg = DS.judge_messages(prompt, F.lit("CREATE"), code, DS.JUDGE_PROMPT_CAP, DS.JUDGE_CODE_CAP)[1]["content"]
    return per_run.select(
        "run_id", F.size("errs").alias("n_errors"),
        F.md5(DS.multi_error_prompt(prompt, F.col("errs"))).alias("multi_error_md5"),
        F.md5(DS.dataset_repair_prompt(prompt, F.col("errs"))).alias("dataset_repair_md5"),
        F.md5(DS.repair_prompt(prompt, code, newest)).alias("repair_md5"),
        F.md5(user_msg).alias("judge_user_md5"),
    )


@register("execution_units")
def q_execution_units(spark, sf):
    """Each run (user) executes the tasks its events name, in the order of their
    first event; members of a partial chain are one unit, started where its first is."""
    order = F.array(*[F.lit(t) for t in CH.BENCHMARK_ORDER])
    tasks = read_table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.element_at(order, (F.col("event_id") % 10 + 1).cast("int")).alias("task_id"),
        F.col("event_id").alias("pos"))
    tasks = tasks.groupBy("run_id", "task_id").agg(F.min("pos").alias("pos"))
    u = CH.execution_units(tasks, "task_id", "pos", run_cols=("run_id",))
    return u.select("run_id", "unit", "start", F.array_join("members", ",").alias("members"))


@register("requested_tasks")
def q_requested_tasks(spark, sf):
    """J6 + J7 + T3: the fixed benchmark ids against the tasks present in the
    data: present ids in requested order (the last duplicate, by item, wins),
    missing ids listed."""
    tasks = B.bench_tasks(spark, sf).select("task_id", "item_id")
    present = RP.in_requested_order(tasks, CH.BENCHMARK_ORDER, "item_id").select(
        F.lower("task_id").alias("task_id"), F.col("_rank").cast("int").alias("rank"), "item_id",
        F.lit("present").alias("status"))
    requested = spark.range(len(CH.BENCHMARK_ORDER)).select(
        F.element_at(F.array(*[F.lit(t) for t in CH.BENCHMARK_ORDER]), (F.col("id") + 1).cast("int")).alias("task_id"),
        (F.col("id") + 1).cast("int").alias("rank"))
    missing = RP.missing_ids(requested, tasks).select(
        "task_id", "rank", F.lit(None).cast("long").alias("item_id"), F.lit("missing").alias("status"))
    return present.unionByName(missing)


@register("snapshot_names")
def q_snapshot_names(spark, sf):
    """S13 + F26: documents as state snapshots labelled by their source (with
    spaces and punctuation added to exercise the clean-up); empty ones are
    skipped, a taken label gets a unique digest suffix."""
    d = read_table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit(" run/"), F.col("source"), F.lit(" :: "), F.col("lang"), F.lit("!")).alias("label"),
        F.col("text").alias("content"))
    return SK.snapshot_rows(d, "label").select("doc_id", "label", "snapshot_name")


@register("distribution_document")
def q_distribution_document(spark, sf):
    """The resource-type distribution as one document row
    (total_tasks_scored + a type -> count map, rendered sorted for comparison)."""
    scored = _scored_brands(spark, sf)
    doc = SK.distribution_document(CX.type_distribution(scored, "doc"), CX.scoring_summary(scored))
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("resource_type_counts")),
                                      lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return doc.select("total_tasks_scored", F.size("resource_type_counts").alias("n_types"),
                      counts.alias("resource_type_counts"))


@register("verdict_writeback")
def q_verdict_writeback(spark, sf):
    """Entries (judged rows) get a new judge verdict for even ids; others keep
    the stored one (ids % 3 = 0) or stay without."""
    j = AG.with_verdict(B.judged(spark, sf))
    old = F.when(F.col("doc_id") % 3 == 0, F.struct(
        F.lit("Correct").alias("verdict"), F.lit("judge-0").alias("judge_model"), F.lit("stored").alias("raw_response")))
    entries = j.select(F.col("doc_id").alias("entry_id"), "task_id", old.alias("judge_verdict"))
    verdicts = j.filter(F.col("doc_id") % 2 == 0).select(
        F.col("doc_id").alias("entry_id"), "verdict", F.lit("judge-1").alias("judge_model"),
        F.col("judge_text").alias("raw_response"))
    w = SK.with_verdicts(entries, verdicts)
    return w.select("entry_id", F.col("judge_verdict.verdict").alias("verdict"),
                    F.col("judge_verdict.judge_model").alias("judge_model"))


@register("artifacts_roundtrip")
def q_artifacts_roundtrip(spark, sf):
    """The iteration log written as a long artifact table in hash buckets of its
    tasks under the shared checkpoint folder, read back with its content."""
    log = B.attempt_log(spark, sf)
    arts = log.select(
        F.col("run_id").cast("string").alias("task_id"), F.lit(1).alias("sample"), "iteration",
        F.col("stage").alias("kind"), F.concat(F.lit("iteration "), F.col("iteration").cast("string")).alias("content"))
    path = scratch_dir(spark, "artifacts")
    SK.write_artifacts(arts, path)
    back = spark.read.schema(arts.schema).parquet(path)
    return back.groupBy("task_id", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.max("iteration").alias("last_iteration"),
        F.max_by("content", "iteration").alias("last_content"),
        F.count_if(F.col("content") == F.concat(F.lit("iteration "), F.col("iteration").cast("string"))).alias("n_content"))


@register("artifacts_lookup")
def q_artifacts_lookup(spark, sf):
    """S12 read: the artifacts of every run's last iteration, looked up by (task, sample,
    iteration) in the stored table of all iterations."""
    log = B.attempt_log(spark, sf)
    arts = log.select(
        F.col("run_id").cast("string").alias("task_id"), F.lit(1).alias("sample"), F.col("iteration").cast("int").alias("iteration"),
        F.col("stage").alias("kind"), F.concat(F.lit("iteration "), F.col("iteration").cast("string")).alias("content"))
    path = scratch_dir(spark, "artifacts")
    SK.write_artifacts(arts, path)
    last = arts.groupBy("task_id", "sample").agg(F.max("iteration").alias("iteration"))
    return RD.lookup_artifacts(spark, path, last).groupBy("task_id", "sample", "iteration", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.min("content").alias("content"))


@register("plans_roundtrip_spec_check")
def q_plans_roundtrip(spark, sf):
    """S5 + P6 end to end: the plan rows are written as nested plan JSON
    (before/after states, disk lists; JSON Lines under the shared checkpoint
    folder), read back with the plan reader and rule-checked. The result must
    equal ``spec_check`` computed from the rows directly."""
    rows = B.plan_rows(spark, sf)
    deleting = F.array_contains("actions", "delete") & ~F.array_contains("actions", "create")
    state = F.struct(
        F.col("name_label"), F.col("memory_max"), F.col("cpus"),
        F.transform("disk_sizes", lambda d: F.struct(d.alias("size"))).alias("disk"),
    )
    change = F.struct(
        F.col("pos"), F.col("type"),
        F.concat(F.col("type"), F.lit(".vm_"), F.col("pos").cast("string")).alias("address"),
        F.concat(F.lit("vm_"), F.col("pos").cast("string")).alias("name"),
        F.struct(
            F.col("actions"),
            F.when(F.array_contains("actions", "delete") | F.array_contains("actions", "update"),
                   F.struct(F.col("name_label"))).alias("before"),
            F.when(~deleting, state).alias("after"),
        ).alias("change"),
    )
    # one document per plan: a plan is one document in the source format
    docs = rows.groupBy("plan_id").agg(F.array_sort(F.collect_list(change)).alias("rc")).select(
        F.col("plan_id").cast("string").alias("plan_key"), F.transform("rc", lambda c: c.dropFields("pos")).alias("resource_changes"))
    path = scratch_dir(spark, "plans")
    docs.write.mode("overwrite").json(path)
    plans = RD.plan_documents_of(RD.read_plans(spark, path, key_field="plan_key"))
    r = RU.check_plans(plans.withColumn("plan_id", F.col("plan_id").cast("long")), B.specs(spark, sf))
    return r.select(
        "plan_id", "category", "passed", F.size("errors").alias("n_errors"),
        F.array_join("errors", " | ").alias("errors"), _checks_text(F.col("checks")).alias("checks"),
        _checks_text(F.col("checks"), "ok").alias("checks_true"),
        "had_replace_actions",
    )


@register("tasks_csv_roundtrip")
def q_tasks_csv_roundtrip(spark, sf):
    """S1 + P4: a task table with multi-line prompts and quoted HCL is written as
    CSV (quotes doubled) under the shared checkpoint folder and read back with
    the task reader; rows with a blank id are dropped on reading."""
    t = B.bench_tasks(spark, sf)
    frags = B.hcl_fragments(spark, sf).select(F.col("frag_pos").alias("item_id"), F.col("hcl").alias("reference_hcl"))
    rows = t.join(frags, "item_id", "left").select(
        F.when(F.col("item_id") % 10 == 9, F.lit("  ")).otherwise(F.concat(F.lit("T"), F.col("item_id").cast("string")))
        .alias("task_id"),
        "category", F.lit("detailed").alias("prompt_type"), "prompt", "reference_hcl")
    path = scratch_dir(spark, "tasks")
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    back = RD.read_tasks(spark, path)
    return back.select("task_id", "category", F.md5("prompt").alias("prompt_md5"),
                       F.md5("reference_hcl").alias("reference_md5"), F.length("prompt").alias("prompt_chars"))


@register("tasks_csv_overflow")
def q_tasks_csv_overflow(spark, sf):
    """S1 + P18: task files in which some rows have one or two cells more than the header names;
    the first one too many is the row's level, as in the reference."""
    path = scratch_dir(spark, "ragged-tasks")
    B.ragged_task_lines(spark, sf).write.partitionBy("part").text(path)
    return RD.read_tasks(spark, path).select("task_id", "category", F.md5("prompt").alias("prompt_md5"), "complexity_level")


@register("complexity_report")
def q_complexity_report(spark, sf):
    """V11 + T2 + F34 as one report: every task's reference is scored (the CSV column before the
    file), and the resource types are ranked as printed."""
    tasks, files = B.task_references(spark, sf)
    keyed = lambda df: df.withColumn("task_id", F.col("item_id"))  # noqa: E731  task ids repeat across items
    _, dist, _ = RP.complexity_report(keyed(tasks).select("task_id", "reference_hcl"), keyed(files).select("task_id", "hcl"))
    return dist


@register("conversations_roundtrip")
def q_conversations_roundtrip(spark, sf):
    """Turns grouped into one message array per conversation (JSON Lines
    under the shared checkpoint folder), read back and exploded to turns."""
    cv = read_table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("file"), "turn", "role", F.col("text").alias("content"))
    path = scratch_dir(spark, "conversations")
    SK.write_conversations(cv, path)
    back = RD.read_conversations(spark, path, key_field="file")
    return back.select(F.col("file").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role",
                       F.md5("content").alias("content_md5"))


@register("states_roundtrip_context")
def q_states_roundtrip(spark, sf):
    """S6 + P8: the per-customer state documents written as JSON Lines under the
    shared checkpoint folder, read back with the state reader (attributes as raw
    JSON text) and reduced to their identifier context; equals infra_context."""
    docs = B.state_documents(spark, sf).select(F.col("state_id").cast("string").alias("state_key"), "resources")
    path = scratch_dir(spark, "states")
    docs.write.mode("overwrite").json(path)
    back = RD.read_states(spark, path, key_field="state_key").withColumn("state_id", F.col("state_id").cast("long"))
    ctx = RD.infra_context(back)
    return ctx.select(
        "state_id", "kind", "type", F.col("rpos").alias("resource_pos"), F.size("fields").alias("n_fields"),
        F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("field_keys"),
        F.col("fields")["name_label"].alias("name_label_json"),
    )


# ------------------------------------------------------------ predicates and small functions


@register("text_predicates")
def q_text_predicates(spark, sf):
    """P17, P21, F17, F32 over documents: the text as a command's stderr and as state
    content, a description to split, and a worker setting with a fallback."""
    d, i = read_table(spark, sf, "documents"), F.col("doc_id")
    stderr = F.concat("text", F.when(i % 5 == 0, F.lit(" Error: Out of MEMORY on host")).when(i % 5 == 1, F.lit(" not enough memory")).otherwise(F.lit("")))
    setting = F.when(i % 4 == 0, F.col("n_chars").cast("string")).when(i % 4 == 1, (-i).cast("string")).when(
        i % 4 == 2, F.concat(F.lit("x"), i.cast("string")))
    return d.select(
        "doc_id", O.expected_exhaustion(i % 2, stderr).alias("exhausted"),
        O.min_content("text", 11).alias("has_content"), O.min_content("text", 51).alias("has_context"),
        TX.category_of(F.concat(F.upper("lang"), F.lit(" - "), F.col("source"))).alias("category"),
        O.positive_int(setting, 4).alias("workers"),
    )


@register("run_predicates")
def q_run_predicates(spark, sf):
    """P3 and P24 over events: the judge's apply fallback, and which chain steps get
    the state of the step before."""
    e, et = read_table(spark, sf, "events"), F.col("event_type")
    task = F.element_at(F.array(*[F.lit(t) for t in (" U1.2", "D1.2 ", "C1.1", "D2.2")]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        "event_id",
        O.apply_ok_judge(F.when(F.col("user_id") % 3 != 0, et == "click"), F.when(et != "view", et == "purchase")).alias("judge_apply_ok"),
        O.needs_dependent_context(F.col("user_id") % 3, F.col("event_id") % 2 == 0, task,
                                  F.when(et == "signup", F.lit("dataset"))).alias("needs_context"),
    )


@register("redacted_messages")
def q_redacted_messages(spark, sf):
    """messages with secrets redacted; the given messages stay as they are."""
    cv = read_table(spark, sf, "conversations")
    secret = F.when(F.col("turn") % 2 == 0, F.lit('\napi_key = s3cret, Password: "a b"')).otherwise(F.lit(""))
    content = F.concat(F.coalesce("text", F.lit("")), secret)
    m = cv.select("conv_id", "turn", "role", F.array(F.struct(F.col("role"), content.alias("content"))).alias("messages"))
    return m.withColumn("safe", TX.redact_messages("messages")).select(
        "conv_id", "turn", F.col("safe")[0]["role"].alias("role"),
        F.md5(F.col("safe")[0]["content"]).alias("redacted_md5"), F.md5(F.col("messages")[0]["content"]).alias("kept_md5"))


@register("system_prompts")
def q_system_prompts(spark, sf):
    """F38 over the run matrix: the first configured prompt, with the platform context."""
    m = DS.run_matrix(B.bench_tasks(spark, sf), PASSES, STRATEGIES)
    i = F.col("item_id")
    context = F.concat(F.lit("on host "), i.cast("string"))
    baseline = F.when(i % 3 == 0, F.concat(F.lit("baseline"), F.when(i % 4 == 0, F.concat(F.lit(" "), context)).otherwise(F.lit(""))))
    return m.select("item_id", "pass_no", "strategy", DS.system_prompt(
        F.when(i % 2 == 0, F.concat(F.lit("model prompt "), F.col("folder"))), baseline, F.lit("generic"), F.lit("dataset prompt"),
        "strategy", context).alias("system_prompt"))


@register("task_filter")
def q_task_filter(spark, sf):
    """P5: the rows of one task, whatever the case of the id asked for."""
    return RD.filter_task(B.bench_tasks(spark, sf), "c1.1").select("item_id", "task_id", "category")


@register("registered_rule")
def q_registered_rule(spark, sf):
    """A rule of the caller's for a category that has none."""
    def no_deletes(s):
        gone = F.size(F.filter("resource_changes", lambda v: v["action"] == "delete"))
        errors = F.when(gone > 0, F.array(F.concat(F.lit("MIGRATE task must not delete ("), gone.cast("string"), F.lit(").")))).otherwise(
            F.array().cast("array<string>"))
        return errors, lambda errs: F.array().cast(RU.CHECK_T)

    path = scratch_dir(spark, "plan-samples")
    B.plan_sample_json(spark, sf).write.text(path)
    extra = (T.StructField("task_id", T.StringType()),)
    plans = RD.plan_documents_of(RD.read_plans(spark, path, key_field="plan_key", extra=extra), "task_id")
    RU.register_rule("MIGRATE", no_deletes)
    try:
        r = RU.check_plans(plans, B.task_specs(spark, sf), task_col="task_id")
    finally:
        RU.RULES.pop("MIGRATE")
    own = F.filter("errors", lambda e: F.startswith(e, F.lit("MIGRATE")))
    return r.filter("category = 'MIGRATE'").select(
        "plan_id", "category", (F.size(own) == 0).alias("passed"), F.try_element_at(own, F.lit(1)).alias("error"))


# ------------------------------------------------------------ reports


@register("metrics_report")
def q_metrics_report(spark, sf):
    """V12 with A6: the per-task table of the metrics report, with BLEU and embedding F1
    against each task's reference."""
    samples, refs, vectors = B.report_samples(spark, sf)
    _, per_task, _ = RP.metrics_report(samples, refs, vectors)
    return rounded(per_task)


@register("ground_truth_report")
def q_ground_truth_report(spark, sf):
    """V14 with A12: entries of one strategy compared with the first entry of the task in
    another, by the stages' own status, with the codes' BLEU."""
    e = DS.build_entries(B.result_rows(spark, sf), keep=["conv_id", "turn"])
    name = F.concat(F.lpad(F.col("conv_id").cast("string"), 9, "0"), F.lit("_"), F.lpad(F.col("turn").cast("string"), 5, "0"))
    rows = RP.stage_flags(e.select("entry.*", name.alias("file")))
    own = F.substring("file", 1, 9).cast("long") % 3 == 0
    _, summary, _ = RP.ground_truth_report(rows.filter(~own), rows.filter(own))
    return rounded(summary)


@register("reference_sync")
def q_reference_sync(spark, sf):
    """V15 with P18: the synced reference column and every row's rule violations."""
    t = B.bench_tasks(spark, sf).withColumn("reference_hcl", F.when(F.col("item_id") % 2 == 0, F.col("prompt")))
    d = read_table(spark, sf, "documents")
    k = F.col("doc_id") % 30
    letter = F.substring(F.lit("CRUDM"), (k % 5 + 1).cast("int"), 1)
    task = F.concat(letter, (k % 5 + 1).cast("string"), F.lit("."), (k % 3 + 1).cast("string"))
    files = d.groupBy(task.alias("task_id")).agg(F.min_by("text", "doc_id").alias("hcl"))
    return RP.sync_references(t, files).select(
        "item_id", "task_id", F.md5("reference_hcl").alias("reference_md5"), F.array_join("violations", ",").alias("violations"))
