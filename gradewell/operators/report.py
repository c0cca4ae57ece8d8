"""Report compositions over real inputs.

Each report is a few DataFrames, never printed text; callers write or show
them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.outcome import data_quality_violations, normalize_reference, supported_category
from . import agreement, bleu, complexity, dataset, embed, metrics, rules


# ---------------------------------------------------------------- J1-J3
# The three precedences are column expressions over one tasks-to-files join.
def metrics_reference(file_col: str = "hcl", csv_col: str = "reference_hcl") -> Column:
    """The file first, then the CSV column, default ''; 'nan' means empty."""
    return normalize_reference(F.coalesce(F.col(file_col), F.col(csv_col), F.lit("")))


def scoring_reference(file_col: str = "hcl", csv_col: str = "reference_hcl") -> Column:
    """The CSV column first (when non-empty), then the file; none -> null (unscored)."""
    return F.coalesce(F.nullif(F.col(csv_col), F.lit("")), F.col(file_col))


def synced_reference(file_col: str = "hcl", csv_col: str = "reference_hcl") -> Column:
    """The file overrides the column, else keep it (default '')."""
    return F.coalesce(F.col(file_col), F.col(csv_col), F.lit(""))


def with_reference_files(tasks: DataFrame, refs: DataFrame, key: str = "task_id") -> DataFrame:
    """Tasks left-joined to their reference file text (``hcl``), once."""
    return tasks.join(refs.select(key, "hcl"), key, "left")


def references_for_metrics(tasks: DataFrame, refs: DataFrame) -> DataFrame:
    """J1 as a table: (task_id, reference)."""
    return with_reference_files(tasks, refs).select("task_id", metrics_reference().alias("reference"))


def references_for_scoring(tasks: DataFrame, refs: DataFrame) -> DataFrame:
    """J2 as a table: tasks with ``reference`` (null when unscored)."""
    return with_reference_files(tasks, refs).withColumn("reference", scoring_reference()).drop("hcl")


def sync_references(tasks: DataFrame, refs: DataFrame) -> DataFrame:
    """J3 + V15: synced reference column and each row's data-quality violations."""
    out = with_reference_files(tasks, refs).withColumn("reference_hcl", synced_reference()).drop("hcl")
    return out.withColumn("violations", data_quality_violations("task_id", "category", "reference_hcl"))


#: Rules whose violations ``guarded`` counts.
QUALITY_RULES = ("task_id_format", "reference_blank", "category_invalid")


def guarded(tasks: DataFrame, observation: Observation | None = None, strict: bool = False) -> DataFrame:
    """P18 in the job that uses the rows, without a second scan: ``observation`` counts the rows that
    violate each rule while they pass; ``strict`` ends the job at the first unsupported category."""
    if observation is not None:
        tasks = tasks.observe(observation, F.count(F.lit(1)).alias("rows"),
                              *[F.count_if(F.array_contains("violations", rule)).alias(rule) for rule in QUALITY_RULES])
    return tasks.withColumn("category", supported_category("task_id", "category")) if strict else tasks


# ---------------------------------------------------------------- J6 / J7
def missing_ids(requested: DataFrame, available: DataFrame, key: str = "task_id") -> DataFrame:
    """Requested ids absent from the dataset (case-insensitive)."""
    r = requested.withColumn("_k", F.lower(F.trim(key)))
    a = available.select(F.lower(F.trim(key)).alias("_k"))
    return r.join(a, "_k", "left_anti").drop("_k")


def in_requested_order(df: DataFrame, ids: Sequence[str], order_col: str, key: str = "task_id") -> DataFrame:
    """J7 + T3: rows for the requested ids, ranked in the requested order; when
    the dataset repeats an id, the row with the greatest ``order_col`` (its
    position in the source) wins. The id list is a fixed literal."""
    order = F.array(*[F.lit(i.lower()) for i in ids])
    k = F.lower(F.trim(F.col(key)))
    with_pos = df.withColumn("_rank", F.array_position(order, k)).filter(F.col("_rank") > 0)
    w = Window.partitionBy("_rank").orderBy(F.col(order_col).desc())
    return (with_pos.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
            .orderBy("_rank"))


# ---------------------------------------------------------------- V12
def _with_scores(rows: DataFrame, scores: DataFrame, keys: list[str], vectors: DataFrame | None) -> DataFrame:
    """Rows with their BLEU from ``scores``, and with ``f1`` if token vectors are given."""
    out = rows.join(scores.select(*keys, "bleu"), keys, "left")
    if vectors is not None:
        out = out.join(embed.embedding_match(vectors, keys).select(*keys, "f1"), keys, "left")
    return out


def metrics_report(samples: DataFrame, refs: DataFrame | None = None, vectors: DataFrame | None = None, key: str | None = None):
    """(summary, per_task, scored rows). BLEU, and with ``vectors`` (token vectors of
    reference and candidate per sample, ``embed.encode_tokens``) the embedding F1, are
    scored against the task's reference when one exists (null otherwise). ``key``
    identifies a sample: by default its whole path where the samples have one, since
    file names repeat across folders."""
    key = key or ("path" if "path" in samples.columns else "file")
    scored = samples
    if refs is not None:
        scores = bleu.bleu_against(samples, refs, [key], "task_id", "reference", "code")
        scored = _with_scores(samples.join(refs, "task_id", "left"), scores, [key], vectors)
    return metrics.global_summary(scored), metrics.per_task_breakdown(scored).orderBy("task_id"), scored


# ---------------------------------------------------------------- V13
def judge_report(rows: DataFrame):
    """Rows with ``judge_text``, ``spec_passed``, ``code``; blank code -> Skip.
    Returns (verdict rows with agreement, confusion, disagreements)."""
    v = agreement.with_verdict(rows, "judge_text", "code")
    v = v.withColumn("agree", agreement.judge_agrees())
    return v, agreement.confusion(v), agreement.disagreements(v, ["task_id"])


# ---------------------------------------------------------------- V14
def stage_flags(entries: DataFrame) -> DataFrame:
    """The rows the ground-truth comparison reads: plan and apply are what the stages'
    own status says (not the final outcome), spec is false where no check is recorded."""
    ran = lambda stage: F.coalesce(F.col(f"execution_results.{stage}.status") == "success", F.lit(False))
    return entries.select(
        F.coalesce("task_id", F.lit("")).alias("task_id"),
        ran("terraform_plan").alias("plan_ok"), ran("terraform_apply").alias("apply_ok"),
        F.when(F.col("spec_accuracy").isNull(), F.lit(False)).otherwise(F.col("spec_accuracy.passed")).alias("spec_ok"),
        F.coalesce(F.col("final_outcome.total_iterations"), F.lit(1)).alias("iterations"),
        F.coalesce(F.col("llm_response.generated_code"), F.lit("")).alias("code"),
        *[c for c in ("file", "path", "entry_id") if c in entries.columns],
    )


def ground_truth_report(results: DataFrame, truth: DataFrame, order_col: str = "file", vectors: DataFrame | None = None):
    """First ground-truth row per task (by ``order_col``, which identifies a result),
    comparison and summary; BLEU, and with ``vectors`` the embedding F1, between the two
    codes when both are non-empty. Rows come from ``stage_flags``."""
    gt = agreement.first_per_group(truth, "task_id", [order_col])
    cmp = agreement.compare_with_ground_truth(results, gt.select("task_id", "plan_ok", "apply_ok", "spec_ok", "iterations"))
    if "code" in results.columns and "code" in truth.columns:
        coded = results.select("task_id", order_col, "code").filter(F.col("code") != "")
        keys = ["task_id", order_col]
        scores = bleu.bleu_against(coded, gt.select("task_id", F.col("code").alias("reference")), keys, "task_id", "reference", "code")
        cmp = _with_scores(cmp, scores, keys, vectors)
    unmatched = results.select("task_id").distinct().join(truth.select("task_id"), "task_id", "left_anti")
    return cmp, agreement.ground_truth_summary(cmp), unmatched


# ---------------------------------------------------------------- V11
def ranked_types(dist: DataFrame) -> DataFrame:
    """The place of each resource type as the report prints them, most tasks first, then by name.
    The window holds one row per resource type."""
    return dist.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_tasks"), "resource_type")))


def complexity_report(tasks: DataFrame, refs: DataFrame):
    """Score every task's reference (unscored rows pass through) and the
    resource-type distribution."""
    t = references_for_scoring(tasks, refs)
    scored = complexity.score_texts(t, "reference")
    dist = ranked_types(complexity.type_distribution(scored, "task_id")).orderBy("rank")
    return scored, dist, complexity.scoring_summary(scored)


# ---------------------------------------------------------------- lifecycle (§3.1)
def evaluate_results(results: DataFrame, plans: DataFrame, specs: DataFrame, plan_key: str = "plan_id") -> DataFrame:
    """Results -> rule check of each result's plan -> nested entries.

    ``results`` carries the entry-builder columns and ``plan_key``; its spec
    outcome comes from checking the referenced plan document against its
    spec (V6), so ``spec_passed`` and ``had_replace_actions`` are replaced.
    Only plans referenced by some result are checked (a semi join first);
    plans and results then meet in one equi-join on the plan key.
    """
    # only plans that some result refers to are checked (semi join on the key)
    needed = plans.join(results.select(plan_key).distinct(), plan_key, "left_semi")
    checked = rules.check_plans(needed, specs, key=plan_key).select(
        plan_key, F.col("passed").alias("spec_passed"), F.col("errors").alias("spec_errors"), F.col("status").alias("spec_status"),
        F.transform("checks", lambda c: F.struct(c["check"].alias("check"), c["passed"].alias("passed"))).alias("spec_checks"),
        F.col("had_replace_actions"),
    )
    r = results.drop(*[c for c in checked.columns if c != plan_key]).join(checked, plan_key, "left")
    return dataset.build_entries(r, keep=[plan_key, "spec_errors"])
