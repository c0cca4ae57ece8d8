"""Outcome predicates and small derivations over result rows.

Column in, Column out. Null rules follow the reference: absent and null both
take the default (``coalesce``); truthy counting treats null as false.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_ws

# ---------------------------------------------------------------- fixed values
GIB = 1024**3
# Default minima used by the compliance predicate: 1 vCPU, 1 GiB RAM, 10 GiB disk.
MIN_CPUS = 1
MIN_RAM_BYTES = GIB
MIN_DISK_BYTES = 10 * GIB
# Tolerance for the per-VM RAM check.
RAM_MARGIN = 0.05
# Markers of an expected resource-exhaustion failure in stderr.
EXHAUSTION_MARKERS = ("insufficient memory", "out of memory", "not enough memory")
# Allowed task categories and task-id pattern.
CATEGORIES = ("CREATE", "READ", "UPDATE", "DELETE")
TASK_ID_PATTERN = r"^[CRUD]\d\.\d$"
# Static code flags (substring tests on generated code).
CODE_FLAGS = {
    "provider_config_included": 'provider "xenorchestra"',
    "data_sources_included": 'data "xenorchestra',
    "vm_resource_defined": 'resource "xenorchestra_vm"',
}
# Task ids that receive extracted state context inside a chain.
DEPENDENT_CONTEXT_TASKS = ("u1.2", "d1.2", "d2.2")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- P2 / P3
def plan_ok(plan_success: Column | str, plan_status: Column | str) -> Column:
    """``plan_success`` else plan status is success."""
    return F.coalesce(_c(plan_success), _c(plan_status).eqNullSafe(F.lit("success")))


def apply_ok_metrics(
    apply_success: Column | str, execution_successful: Column | str, apply_status: Column | str
) -> Column:
    """``apply_success`` else (execution_successful, default false) and apply succeeded."""
    fb = F.coalesce(_c(execution_successful), F.lit(False)) & _c(apply_status).eqNullSafe(
        F.lit("success")
    )
    return F.coalesce(_c(apply_success), fb)


def apply_ok_judge(apply_success: Column | str, execution_successful: Column | str) -> Column:
    """The judge's fallback: ``apply_success`` else ``execution_successful`` else false."""
    return F.coalesce(_c(apply_success), _c(execution_successful), F.lit(False))


# ---------------------------------------------------------------- P9 / P10
def stage_status(exit_code: Column | str, status: Column | str | None = None) -> Column:
    """P10: exit 0 -> success else failed; apply keeps ``skipped_plan_only``."""
    base = F.when(_c(exit_code) == 0, F.lit("success")).otherwise(F.lit("failed"))
    if status is None:
        return base
    return F.when(_c(status) == "skipped_plan_only", F.lit("skipped_plan_only")).otherwise(base)


def stage_error(exit_code: Column | str, stderr: Column | str) -> Column:
    """P10: error text only on failure (exit code missing counts as failure)."""
    return F.when(~F.coalesce(_c(exit_code) == 0, F.lit(False)), _c(stderr))


def final_outcome(
    plan_exit: Column | str,
    apply_exit: Column | str,
    apply_status: Column | str,
    spec_passed: Column | str,
    post_passed: Column | str,
    iterations: Column | str,
    expected_failure_matched: Column | str,
) -> Column:
    """The final-outcome struct of a result entry."""
    plan_success = F.coalesce(_c(plan_exit) == 0, F.lit(False))
    apply_success = F.coalesce((_c(apply_status) == "success") & (_c(apply_exit) == 0), F.lit(False))
    matched = F.coalesce(_c(expected_failure_matched), F.lit(False))
    spec_true = F.coalesce(_c(spec_passed) == F.lit(True), F.lit(False))
    post_ok = F.when(_c(post_passed).isNull(), F.lit(True)).otherwise(_c(post_passed))
    execution = matched | F.when(
        F.coalesce(_c(apply_status) == "skipped_plan_only", F.lit(False)), plan_success
    ).otherwise(apply_success)
    it = F.coalesce(_c(iterations), F.lit(1))
    return F.struct(
        (it == 1).alias("worked_as_generated"),
        (it > 1).alias("worked_after_fixes"),
        (it - 1).alias("total_fixes_needed"),
        it.alias("total_iterations"),
        plan_success.alias("plan_success"),
        apply_success.alias("apply_success"),
        execution.alias("execution_successful"),
        (matched | (execution & spec_true & post_ok)).alias("meets_requirements"),
        F.coalesce(_c(spec_passed), F.lit(True)).alias("resource_allocation_correct"),
    )


# ---------------------------------------------------------------- P11-P15
def compliance(
    actual: Column | str, expected: Column | str, default_min=None, matched: Column | str | None = None
) -> Column:
    """Matched -> true; expected given -> equality (0 is a value);
    else actual >= default minimum; else actual present."""
    a, e = _c(actual), _c(expected)
    m = F.coalesce(_c(matched), F.lit(False)) if matched is not None else F.lit(False)
    if default_min:
        fallback = F.coalesce(a >= F.lit(default_min), F.lit(False))
    else:
        fallback = a.isNotNull()
    return F.when(m, F.lit(True)).when(e.isNotNull(), F.coalesce(a == e, F.lit(False))).otherwise(fallback)


def vm_ram_ok(actual_memory: Column | str, vm_details: Column | str) -> Column:
    """Every VM's RAM within 5 % of the target (default 1 GiB); null without VMs."""
    am = _c(actual_memory)
    target = F.when(F.coalesce(am, F.lit(0)) != 0, am).otherwise(F.lit(GIB)).cast("long")
    tol = F.floor(F.lit(RAM_MARGIN) * target)
    ok = F.forall(
        _c(vm_details),
        lambda v: F.abs(F.bround(F.coalesce(v["ram_gb"], F.lit(0.0)) * GIB, 0).cast("long") - target) <= tol,
    )
    return F.when(F.coalesce(F.size(_c(vm_details)), F.lit(0)) > 0, ok)


def all_have_address(vm_details: Column | str) -> Column:
    """All VMs report an address (``ip != 'unknown'``); true without VMs."""
    ok = F.forall(_c(vm_details), lambda v: F.coalesce(v["ip"], F.lit("unknown")) != "unknown")
    return F.when(F.coalesce(F.size(_c(vm_details)), F.lit(0)) > 0, ok).otherwise(F.lit(True))


def code_flags(code: Column | str) -> Column:
    """Static substring flags of generated code."""
    c = F.coalesce(_c(code), F.lit(""))
    low = F.lower(c)
    fields = [F.contains(c, F.lit(v)).alias(k) for k, v in CODE_FLAGS.items()]
    fields += [
        (F.contains(low, F.lit("ubuntu-22.04")) | F.contains(low, F.lit("iso-install"))).alias(
            "infers_ubuntu_2204"
        ),
        (F.contains(c, F.lit("xenbr0")) | F.contains(c, F.lit("Pool-wide"))).alias("network_xenbr0"),
        F.contains(c, F.lit("network {")).alias("dhcp_configured"),
    ]
    return F.struct(*fields)


def inferred_default(value: Column | str, prompt: Column | str, word: str) -> Column:
    """The value as text, else ``not_specified`` when the word is absent
    from the prompt, else ``not_detected``."""
    v = _c(value)
    absent = ~F.contains(F.lower(F.coalesce(_c(prompt), F.lit(""))), F.lit(word))
    return F.coalesce(
        v.cast("string"),
        F.when(absent, F.lit("not_specified")).otherwise(F.lit("not_detected")),
    )


def inferred_environment(code: Column | str) -> Column:
    """OS, network, storage and IP mode inferred from code text."""
    c = F.coalesce(_c(code), F.lit(""))
    low = F.lower(c)
    return F.struct(
        F.when(F.contains(low, F.lit("ubuntu")), F.lit("Ubuntu 22.04")).otherwise(F.lit("unknown")).alias("os_version"),
        F.when(F.contains(c, F.lit("xenbr0")), F.lit("xenbr0"))
        .when(F.contains(c, F.lit("Pool-wide")), F.lit("Pool-wide"))
        .otherwise(F.lit("not_detected")).alias("network"),
        F.when(F.contains(c, F.lit("name_label")) & F.contains(low, F.lit("storage")), F.lit("detected"))
        .otherwise(F.lit("not_detected")).alias("storage_sr"),
        F.when(F.contains(low, F.lit("dhcp")) | F.contains(c, F.lit("network {")), F.lit("dhcp"))
        .otherwise(F.lit("not_detected")).alias("ip_mode"),
    )


# ---------------------------------------------------------------- P16-P18, P22-P24
def no_usable_code(code: Column | str, category: Column | str) -> Column:
    """Blank code, or (not DELETE/READ and no resource/data block)."""
    c = F.coalesce(_c(code), F.lit(""))
    cat = F.upper(F.coalesce(_c(category), F.lit("")))
    blank = strip_ws(c) == ""
    no_blocks = ~(F.contains(c, F.lit('resource "')) | F.contains(c, F.lit('data "')))
    return blank | (~cat.isin("DELETE", "READ") & no_blocks)


def expected_exhaustion(exit_code: Column | str, stderr: Column | str) -> Column:
    """Failed command whose stderr names a memory shortage."""
    pat = "|".join(EXHAUSTION_MARKERS)
    return F.coalesce(_c(exit_code) != 0, F.lit(False)) & F.coalesce(
        F.lower(_c(stderr)).rlike(pat), F.lit(False)
    )


def data_quality_violations(task_id: Column | str, category: Column | str, reference: Column | str) -> Column:
    """List of rule names a task row violates (empty when clean)."""
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(_c(task_id).rlike(TASK_ID_PATTERN), F.lit(False)), F.lit("task_id_format")),
            F.when(F.coalesce(strip_ws(_c(reference)), F.lit("")) == "", F.lit("reference_blank")),
            F.when(~F.coalesce(F.upper(_c(category)).isin(*CATEGORIES), F.lit(False)), F.lit("category_invalid")),
        )
    )


def supported_category(task_id: Column | str, category: Column | str) -> Column:
    """The category, stripped and in upper case; one that isn't blank and isn't known is an error."""
    cat = F.upper(strip_ws(F.coalesce(_c(category), F.lit(""))))
    message = F.concat(F.lit("Unsupported task category '"), _c(category), F.lit("' for task "), F.coalesce(_c(task_id), F.lit("None")))
    return F.when((cat == "") | cat.isin(*CATEGORIES), cat).otherwise(F.raise_error(message).cast("string"))


def normalize_reference(ref: Column | str) -> Column:
    """Missing or ``nan`` reference -> empty string."""
    r = F.coalesce(_c(ref), F.lit(""))
    return F.when(F.lower(r) == "nan", F.lit("")).otherwise(r)


def edge_case_label(expected_error: Column | str) -> Column:
    """P23."""
    return F.when(_c(expected_error) == "resource_exhaustion", F.lit("over_provisioning")).otherwise(F.lit("none"))


def needs_dependent_context(
    chain_index: Column | str, shared_workspace: Column | str, task_id: Column | str, strategy: Column | str
) -> Column:
    """Later chain step, shared workspace, dependent task id, strategy not ``dataset``."""
    return (
        (_c(chain_index) > 0)
        & F.coalesce(_c(shared_workspace), F.lit(False))
        & F.lower(strip_ws(_c(task_id))).isin(*DEPENDENT_CONTEXT_TASKS)
        & (F.coalesce(_c(strategy), F.lit("")) != "dataset")
    )


def min_content(text: Column | str, min_bytes: int) -> Column:
    """Content at least ``min_bytes`` bytes long."""
    return F.coalesce(F.octet_length(_c(text)) >= min_bytes, F.lit(False))


# ---------------------------------------------------------------- F12 / F13
def normalize_action(actions: Column | str) -> Column:
    """delete+create -> replace, then delete, create, update, no-op; else first or unknown."""
    a = _c(actions)
    has = lambda x: F.coalesce(F.array_contains(a, F.lit(x)), F.lit(False))
    return (
        F.when(has("delete") & has("create"), F.lit("replace"))
        .when(has("delete"), F.lit("delete"))
        .when(has("create"), F.lit("create"))
        .when(has("update"), F.lit("update"))
        .when(has("no-op"), F.lit("no-op"))
        .otherwise(F.coalesce(F.try_element_at(a, F.lit(1)), F.lit("unknown")))
    )


def plan_counts(stdout: Column | str) -> Column:
    """resources to add / change / destroy from plan output; 0 when absent."""
    s = F.coalesce(_c(stdout), F.lit(""))

    def num(p):
        return F.coalesce(F.regexp_extract(s, p, 1).try_cast("int"), F.lit(0))

    return F.struct(
        num(r"Plan: (\d+) to add").alias("resources_to_create"),
        num(r"(\d+) to change").alias("resources_to_modify"),
        num(r"(\d+) to destroy").alias("resources_to_destroy"),
    )


# ---------------------------------------------------------------- F27-F32
def bytes_to_gb(b: Column | str) -> Column:
    """bytes -> GB with two decimals (half-even)."""
    return F.bround(_c(b).cast("double") / F.lit(float(GIB)), 2)


def first_address(addresses: Column | str) -> Column:
    """first map value, else ``unknown``."""
    return F.coalesce(F.try_element_at(F.map_values(_c(addresses)), F.lit(1)), F.lit("unknown"))


def positive_int(value: Column | str, fallback: int) -> Column:
    """F32: value as a positive int, else the fallback."""
    v = _c(value).try_cast("int")
    return F.when(v > 0, v).otherwise(F.lit(fallback))


def half_even_div(total: Column | str, count: Column | str) -> Column:
    """Python ``round(total / count)`` (half-even) as a long."""
    return F.bround(_c(total).cast("double") / _c(count).cast("double"), 0).cast("long")


def normalized_resources(reqs: Column | str, vm_count: Column | str) -> Column:
    """expected per-VM and total resources from a requirements struct.

    Legacy fields (``memory_max_bytes``, ``cpus``, ``size_bytes``) are totals
    when count > 1, else per-VM. Missing per-VM = half-even(total / count).
    """
    r = _c(reqs)
    n = F.when(F.coalesce(_c(vm_count), F.lit(0)) == 0, F.lit(1)).otherwise(_c(vm_count))
    multi = n > 1
    out = {}
    for short, legacy, total in (
        ("memory_max_bytes", "memory_max_bytes", "total_memory_max_bytes"),
        ("cpus", "cpus", "total_cpus"),
        ("size_bytes", "size_bytes", "total_size_bytes"),
    ):
        per = f"per_vm_{short}"
        tot = F.when(multi, F.coalesce(r[total], r[legacy])).otherwise(r[total])
        pv = F.when(multi, r[per]).otherwise(F.coalesce(r[per], r[legacy]))
        pv = F.coalesce(pv, F.when(tot.isNotNull(), half_even_div(tot, n)))
        out[per] = pv.cast("long")
        out[total] = tot.cast("long")
    order: Sequence[str] = (
        "per_vm_memory_max_bytes", "per_vm_cpus", "per_vm_size_bytes",
        "total_memory_max_bytes", "total_cpus", "total_size_bytes",
    )
    return F.struct(*[out[k].alias(k) for k in order])
