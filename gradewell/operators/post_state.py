"""After-state verification (V7, J10) and the update section of an entry.

Inputs are VM snapshot tables (``task_col, name, uuid, cpus, ram_gb``) before
and after, and a spec table per task. All lookups are equi-joins on
(task, name); per-task counts are partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.outcome import GIB
from ..functions.text import fill

# ---------------------------------------------------------------- fixed values
# Message formats, worded exactly as the reference reports them.
MSG = {
    "count_changed": "POST-STATE ERROR: VM count changed during UPDATE.",
    "target_missing": "POST-STATE ERROR: Target VM '{target}' not found after UPDATE.",
    "value": "POST-STATE ERROR: VM '{target}' {field} is {actual}, expected {expected}.",
    "uuid": "POST-STATE ERROR: VM '{target}' UUID changed (replace instead of in-place update).",
    "still_exists": "POST-STATE ERROR: VM '{target}' still exists.",
}


def verify_post_state(
    pre: DataFrame, post: DataFrame, specs: DataFrame, task_col: str = "task_id", order_col: str | None = None
) -> DataFrame:
    """V7 per task: UPDATE checks count, target, new value, uuid; DELETE checks targets are gone.

    ``pre``/``post``: task_col, name, uuid, cpus, ram_gb (+ ``order_col``: the
    last duplicate of a name wins; without it the greatest by uuid, cpus and RAM).
    ``specs``: task_col, category, target_vm, target_vms, updated_field, new_value.

    Plan: both snapshots as one table -> per (task, name) the last VM before and
    after (one aggregate) and per task the VM counts (one aggregate); the spec
    targets become rows joined to those once; errors are gathered per task in
    target order (bounded by the spec's target list).
    """
    ordc = F.col(order_col) if order_col else F.struct("uuid", "cpus", "ram_gb")

    def side(df, tag):
        return df.select(task_col, "name", F.lit(tag).alias("_side"), "uuid", "cpus", "ram_gb", ordc.alias("_ord"))

    snap = side(pre, "pre").unionByName(side(post, "post"))
    counts = snap.groupBy(task_col).agg(
        F.count_if(F.col("_side") == "pre").alias("n_pre"), F.count_if(F.col("_side") == "post").alias("n_post"))
    vm = F.struct("uuid", "cpus", "ram_gb")
    is_pre, is_post = F.col("_side") == "pre", F.col("_side") == "post"
    by_name = snap.filter(F.col("name").isNotNull()).groupBy(task_col, "name").agg(
        F.max_by(F.when(is_pre, vm), F.when(is_pre, F.col("_ord"))).alias("pre_vm"),
        F.max_by(F.when(is_post, vm), F.when(is_post, F.col("_ord"))).alias("post_vm"),
        F.max(is_pre).alias("_has_pre"), F.max(is_post).alias("_has_post"),
    )

    cat = F.col("category")
    tv = F.col("target_vms")
    del_targets = F.when(F.coalesce(F.size(tv), F.lit(0)) > 0, tv).when(
        F.coalesce(F.col("target_vm"), F.lit("")) != "", F.array("target_vm"))
    null_s, null_l = F.lit(None).cast("string"), F.lit(None).cast("long")
    upd_t = specs.filter(cat == "UPDATE").select(
        task_col, "category", F.col("target_vm").alias("name"), F.lit(0).alias("tpos"), "updated_field", "new_value")
    del_t = specs.filter(cat == "DELETE").select(
        task_col, "category", F.posexplode_outer(del_targets).alias("tpos", "name"),
        null_s.alias("updated_field"), null_l.alias("new_value"))
    other_t = specs.filter(~F.coalesce(cat.isin("UPDATE", "DELETE"), F.lit(False))).select(
        task_col, "category", null_s.alias("name"), F.lit(0).alias("tpos"), null_s.alias("updated_field"),
        null_l.alias("new_value"))
    targets = upd_t.unionByName(del_t).unionByName(other_t)
    j = targets.join(by_name, [task_col, "name"], "left").join(counts, task_col, "left")

    tgt, field, val = F.col("name"), F.col("updated_field"), F.col("new_value")
    has_target = F.coalesce(tgt, F.lit("")) != ""
    both = F.coalesce(F.col("_has_pre"), F.lit(False)) & F.coalesce(F.col("_has_post"), F.lit(False))
    post_mem = (F.coalesce(F.col("post_vm.ram_gb"), F.lit(0.0)) * F.lit(float(GIB))).cast("long")
    post_cpu = F.coalesce(F.col("post_vm.cpus"), F.lit(0)).cast("long")
    has_fv = (F.coalesce(field, F.lit("")) != "") & val.isNotNull()
    update_errs = F.array(
        F.when(has_target & ~F.coalesce(F.col("_has_post"), F.lit(False)), fill(MSG["target_missing"], target=tgt)),
        F.when(has_target & both & has_fv & (field == "memory_max") & (post_mem != val),
               fill(MSG["value"], target=tgt, field=F.lit("memory_max"), actual=post_mem.cast("string"),
                    expected=val.cast("string"))),
        F.when(has_target & both & has_fv & (field == "cpus") & (post_cpu != val),
               fill(MSG["value"], target=tgt, field=F.lit("cpus"), actual=post_cpu.cast("string"),
                    expected=val.cast("string"))),
        F.when(has_target & both & ~F.col("pre_vm.uuid").eqNullSafe(F.col("post_vm.uuid")),
               fill(MSG["uuid"], target=tgt)),
    )
    delete_errs = F.array(F.when(has_target & F.coalesce(F.col("_has_post"), F.lit(False)),
                                 fill(MSG["still_exists"], target=tgt)))
    row_errs = F.when(cat == "UPDATE", update_errs).when(cat == "DELETE", delete_errs).otherwise(
        F.array().cast("array<string>"))
    per_task = j.groupBy(task_col, "category").agg(
        F.max("n_pre").alias("n_pre"), F.max("n_post").alias("n_post"),
        F.array_sort(F.collect_list(F.struct("tpos", row_errs.alias("e")))).alias("_rows"),
    )
    count_err = F.when(
        (F.col("category") == "UPDATE") & (F.coalesce(F.col("n_pre"), F.lit(0)) != F.coalesce(F.col("n_post"), F.lit(0))),
        F.array(F.lit(MSG["count_changed"])),
    ).otherwise(F.array().cast("array<string>"))
    errors = F.array_compact(F.concat(count_err, F.flatten(F.transform("_rows", lambda x: x["e"]))))
    return per_task.select(task_col, "category", errors.alias("errors")).withColumn("passed", F.size("errors") == 0)


def update_validation(pre: DataFrame, post: DataFrame, specs: DataFrame, task_col: str = "task_id",
                      order_col: str | None = None) -> DataFrame:
    """V9 + J11: before/after of the target VM of an update task; missing sides default.
    Of VMs with the same name the first by ``order_col`` counts (without it, the
    smallest by uuid, RAM and cpus)."""

    def first(df, names):
        vm = F.struct(*[F.col(c).alias(n) for c, n in zip(("uuid", "ram_gb", "cpus"), names)])
        one = df.groupBy(task_col, F.col("name").alias("target_vm")).agg(
            F.min_by(vm, F.col(order_col) if order_col else vm).alias("vm"))
        return one.select(task_col, "target_vm", "vm.*")

    upd = specs.filter(F.col("category") == "UPDATE").select(task_col, F.col("target_vm"), "had_replace_actions", "spec_passed") \
        if "had_replace_actions" in specs.columns else \
        specs.filter(F.col("category") == "UPDATE").select(
            task_col, "target_vm", F.lit(False).alias("had_replace_actions"), F.lit(True).alias("spec_passed"))
    a, b = first(pre, ("u0", "r0", "c0")), first(post, ("u1", "r1", "c1"))
    j = upd.join(a, [task_col, "target_vm"], "left").join(b, [task_col, "target_vm"], "left")
    replace = F.coalesce(F.col("had_replace_actions"), F.lit(False))
    return j.select(
        task_col,
        "target_vm",
        (~replace).alias("plan_shows_in_place_update"),
        replace.alias("plan_shows_destroy_create"),
        F.coalesce("u0", F.lit("unknown")).alias("vm_uuid_before"),
        F.coalesce("u1", F.lit("unknown")).alias("vm_uuid_after"),
        F.coalesce(F.col("u0") == F.col("u1"), F.lit(False)).alias("uuid_unchanged"),
        F.lit(0).alias("vm_downtime_seconds"),
        F.coalesce(F.col("spec_passed"), F.lit(True)).alias("resource_change_correct"),
        F.coalesce("r0", F.lit(0.0)).alias("ram_before_gb"),
        F.coalesce("r1", F.lit(0.0)).alias("ram_after_gb"),
        F.coalesce("c0", F.lit(0)).alias("cpu_before"),
        F.coalesce("c1", F.lit(0)).alias("cpu_after"),
    )
