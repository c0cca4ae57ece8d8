"""Rule checking over plan documents.

A plan document is one row: ``plan_id`` plus ``resource_changes`` =
array<struct<pos, type, action, address, name_label, memory_max, cpus, disk_sizes>>
in plan order (as a plan JSON file holds it). Rules are array expressions on
that row, so checking needs no shuffle beyond the spec join; only building
documents from exploded rows (``plan_documents``) groups by plan.

Each rule yields ``errors`` (array<string>, reference wording) and
``checks`` (array<struct<check, passed>>). String checks report
``passed = no error text contains the check name`` as the reference does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.outcome import GIB, normalize_action
from ..functions.text import fill

# ---------------------------------------------------------------- fixed values
VM_TYPE = "xenorchestra_vm"
HOST_RAM_LIMIT = 20 * GIB
HOST_CPU_LIMIT = 30
HOST_DISK_LIMIT = 900 * GIB
# Message formats, worded exactly as the reference reports them.
MSG = {
    "create_other": "SPEC ERROR: CREATE task should not {action} VMs.",
    "count": "SPEC ERROR: Expected {expected} VMs, found {found}.",
    "min_count": "SPEC ERROR: Expected at least {expected} VMs, found {found}.",
    "max_count": "SPEC ERROR: Expected at most {expected} VMs, found {found}.",
    "total_ram": "SPEC ERROR: Total RAM {total}GB exceeds limit {limit}GB.",
    "total_cpu": "SPEC ERROR: Total CPUs {total} exceeds limit {limit}.",
    "vm_attr": "SPEC ERROR: VM {index} {attr} mismatch. Expected {expected}, got {actual}.",
    "vm_disk": "SPEC ERROR: VM {index} disk size mismatch. Expected {expected}, got {actual}.",
    "names_missing": "SPEC ERROR: Missing expected VM names: {names}.",
    "names_extra": "SPEC ERROR: Unexpected VM names created: {names}.",
    "read_changes": "SPEC ERROR: READ task must not modify infrastructure. Found {count} changes: {addresses}",
    "update_forbidden": "SPEC ERROR: UPDATE task should not create/delete/replace VMs (found {action}).",
    "update_none": "SPEC ERROR: No update actions found in plan.",
    "update_value": "SPEC ERROR: Expected {field}={value}, got {actual}.",
    "update_target": "SPEC ERROR: Expected target VM '{target}' to be updated.",
    "update_extra": "SPEC ERROR: Unexpected VMs updated: {names}.",
    "delete_forbidden": "SPEC ERROR: DELETE task should not create/update/replace VMs (found {action}).",
    "delete_count": "SPEC ERROR: Expected {expected} deletions, found {found}.",
    "delete_target": "SPEC ERROR: Target VM '{target}' not marked for deletion.",
    "delete_extra": "SPEC ERROR: Extra VMs deleted: {names}",
    "quota_ram": "HOST QUOTA ERROR: Final projected RAM ({gb} GB) exceeds host limit (20.00 GB).",
    "quota_cpu": "HOST QUOTA ERROR: Final projected vCPUs ({cpus}) exceeds host limit (30).",
    "quota_disk": "HOST QUOTA ERROR: Final projected Disk space ({gb} GB) exceeds host limit (900.00 GB).",
    "no_spec": "SPEC ERROR: No spec found for task '{task}'.",
    "bad_category": "SPEC ERROR: Unknown task category '{category}' for task '{task}'.",
}

CHECK_T = "array<struct<check:string,passed:boolean,ok:boolean>>"
# Spec fields a rule may read; absent columns read as typed nulls.
SPEC_TYPES = {
    "vm_count": "bigint", "min_vm_count": "bigint", "max_vm_count": "bigint", "per_vm_memory_max": "bigint",
    "per_vm_cpus": "bigint", "per_vm_disk_size": "bigint", "vm_names": "array<string>", "max_total_ram_gb": "string",
    "max_total_cpus": "bigint", "updated_field": "string", "new_value": "bigint", "target_vm": "string",
    "target_vms": "array<string>", "delete_count": "bigint",
}


def _check(name: str, passed: Column, ok: Column | None = None) -> Column:
    """A check: ``passed`` as reported, ``ok`` its true meaning (same unless given)."""
    return F.struct(F.lit(name).alias("check"), passed.alias("passed"), (passed if ok is None else ok).alias("ok"))


def _named(name: str, ok: Column) -> Column:
    """A string check before its reported flag is known."""
    return F.struct(F.lit(name).alias("check"), ok.alias("ok"))


def plan_documents(rows: DataFrame, plan_key: str = "plan_id") -> DataFrame:
    """Assemble exploded change rows into one document per plan (P6/F12 applied per row)."""
    change = F.struct(
        F.col("pos"),
        F.col("type"),
        normalize_action(F.col("actions")).alias("action"),
        F.coalesce(F.col("address"), F.lit("")).alias("address") if "address" in rows.columns
        else F.concat(F.col("type"), F.lit(".vm_"), F.col("pos").cast("string")).alias("address"),
        F.col("name_label"),
        F.col("memory_max"),
        F.col("cpus"),
        F.col("disk_sizes"),
    )
    return rows.groupBy(plan_key).agg(F.array_sort(F.collect_list(change)).alias("resource_changes"))


# ---------------------------------------------------------------- helpers
def _s(x: Column) -> Column:
    return x.cast("string")


def _py_list(arr: Column) -> Column:
    """Python ``repr`` of a list of strings."""
    return F.concat(
        F.lit("["),
        F.array_join(F.transform(arr, lambda x: F.coalesce(F.concat(F.lit("'"), x, F.lit("'")), F.lit("None"))), ", "),
        F.lit("]"),
    )


def _names(arr: Column) -> Column:
    """Distinct non-empty name labels of a change array."""
    return F.array_distinct(F.filter(F.transform(arr, lambda v: v["name_label"]), lambda x: x.isNotNull() & (x != "")))


def _first_action(arr: Column) -> Column:
    return F.element_at(arr, 1)["action"]


def _string_checks(items: Column, errors: Column) -> Column:
    """Reported meaning: a string check passes when no error text contains its
    name (so a failed count check can still read as passed); ``ok`` keeps the
    check's true meaning."""
    return F.transform(
        items,
        lambda c: F.struct(c["check"].alias("check"),
                           (~F.exists(errors, lambda e: F.contains(e, c["check"]))).alias("passed"),
                           c["ok"].alias("ok")),
    )


def _compact(*items: Column) -> Column:
    return F.array_compact(F.concat(*items))


def _vm_changes(col: str = "resource_changes") -> Column:
    return F.filter(F.col(col), lambda v: v["type"] == VM_TYPE)


def _with_changes(plans: DataFrame) -> DataFrame:
    """The change lists that rules read again and again, as columns: filtered once for a plan."""
    p = plans.select("*", _vm_changes().alias("_vms"))

    def of(action: str) -> Column:
        return F.filter("_vms", lambda v: v["action"] == action).alias(f"_vms_{action}")

    return p.select("*", of("create"), of("update"), of("delete"))


# ---------------------------------------------------------------- V1 CREATE
def create_rule(s: Callable[[str], Column]) -> tuple[Column, Callable[[Column], Column]]:
    vms, creates = F.col("_vms"), F.col("_vms_create")
    others = F.filter(vms, lambda v: ~v["action"].isin("create", "no-op"))
    n = F.size(creates)
    vm_count, min_c, max_c = s("vm_count"), s("min_vm_count"), s("max_vm_count")
    # compared as a number, printed as written
    ram_text, max_cpu = s("max_total_ram_gb"), s("max_total_cpus")
    max_ram = ram_text.cast("double")
    p_mem, p_cpu, p_disk = s("per_vm_memory_max"), s("per_vm_cpus"), s("per_vm_disk_size")
    total_ram = F.aggregate(creates, F.lit(0).cast("long"), lambda a, v: a + F.coalesce(v["memory_max"], F.lit(0)))
    total_cpu = F.aggregate(creates, F.lit(0).cast("long"), lambda a, v: a + F.coalesce(v["cpus"], F.lit(0)))
    head = F.array(
        F.when(F.size(others) > 0, fill(MSG["create_other"], action=_first_action(others))),
        F.when(vm_count.isNotNull() & (n != vm_count),
               fill(MSG["count"], expected=_s(vm_count), found=_s(n))),
        F.when(vm_count.isNull() & (n < min_c),
               fill(MSG["min_count"], expected=_s(min_c), found=_s(n))),
        F.when(vm_count.isNull() & (n > max_c),
               fill(MSG["max_count"], expected=_s(max_c), found=_s(n))),
        F.when(max_ram.isNotNull() & (total_ram > max_ram * F.lit(float(GIB))),
               fill(MSG["total_ram"], total=_s(F.bround(total_ram / F.lit(float(GIB)), 2)), limit=_s(ram_text))),
        F.when(max_cpu.isNotNull() & (total_cpu > max_cpu),
               fill(MSG["total_cpu"], total=_s(total_cpu), limit=_s(max_cpu))),
    )

    def vm_errors(v, i):
        disk = F.coalesce(F.array_max(v["disk_sizes"]), F.lit(0).cast("long"))
        idx = _s(i + 1)
        return F.array(
            F.when(p_mem.isNotNull() & ~F.coalesce(v["memory_max"] == p_mem, F.lit(False)),
                   fill(MSG["vm_attr"], index=idx, attr=F.lit("memory_max"), expected=_s(p_mem),
                        actual=F.coalesce(_s(v["memory_max"]), F.lit("None")))),
            F.when(p_cpu.isNotNull() & ~F.coalesce(v["cpus"] == p_cpu, F.lit(False)),
                   fill(MSG["vm_attr"], index=idx, attr=F.lit("cpus"), expected=_s(p_cpu),
                        actual=F.coalesce(_s(v["cpus"]), F.lit("None")))),
            F.when(p_disk.isNotNull() & (disk != p_disk),
                   fill(MSG["vm_disk"], index=idx, expected=_s(p_disk), actual=_s(disk))),
        )

    per_vm = F.flatten(F.transform(creates, vm_errors))
    expected = F.coalesce(s("vm_names"), F.array().cast("array<string>"))
    created = _names(creates)
    missing = F.array_sort(F.array_except(expected, created))
    extra = F.array_sort(F.array_except(created, expected))
    has_names = F.size(expected) > 0
    tail = F.array(
        F.when(has_names & (F.size(missing) > 0),
               fill(MSG["names_missing"], names=_py_list(missing))),
        F.when(has_names & (F.size(extra) > 0),
               fill(MSG["names_extra"], names=_py_list(extra))),
    )
    errors = _compact(head, per_vm, tail)

    per_vm_checks = F.flatten(F.transform(creates, lambda v: F.array_compact(F.array(
        F.when(p_mem.isNotNull(), _named("memory_max", F.coalesce(v["memory_max"] == p_mem, F.lit(False)))),
        F.when(p_cpu.isNotNull(), _named("cpus", F.coalesce(v["cpus"] == p_cpu, F.lit(False)))),
        F.when(p_disk.isNotNull(), _named(
            "per_vm_disk_size", F.coalesce(F.array_max(v["disk_sizes"]), F.lit(0).cast("long")) == p_disk)),
    ))))
    string_checks = F.concat(
        F.array_compact(F.array(
            F.when(vm_count.isNotNull(), _named("vm_count", n == vm_count)),
            F.when(vm_count.isNull() & min_c.isNotNull(), _named("min_vm_count", n >= min_c)),
            F.when(vm_count.isNull() & max_c.isNotNull(), _named("max_vm_count", n <= max_c)),
            F.when(max_ram.isNotNull(), _named("total_ram_limit", total_ram <= max_ram * F.lit(float(GIB)))),
            F.when(max_cpu.isNotNull(), _named("total_cpu_limit", total_cpu <= max_cpu)),
        )),
        per_vm_checks,
    )
    names_check = F.when(
        has_names, F.array(_check("vm_names", (F.size(missing) == 0) & (F.size(extra) == 0))),
    ).otherwise(F.array().cast(CHECK_T))
    return errors, lambda errs: F.concat(_string_checks(string_checks, errs), names_check)


# ---------------------------------------------------------------- V2 READ
def read_rule(s: Callable[[str], Column]) -> tuple[Column, Callable[[Column], Column]]:
    changes = F.filter(F.col("resource_changes"), lambda v: v["action"] != "no-op")
    n = F.size(changes)
    addresses = _py_list(F.transform(F.slice(changes, 1, 3), lambda v: v["address"]))
    errors = F.when(
        n > 0,
        F.array(fill(MSG["read_changes"], count=_s(n), addresses=addresses)),
    ).otherwise(F.array().cast("array<string>"))
    first = F.array(_check("no_resource_changes", n == 0))
    placeholders = F.array(
        _check("has_data_sources", F.lit(None).cast("boolean")),
        _check("has_outputs", F.lit(None).cast("boolean")),
    )
    checks = F.when(n > 0, first).otherwise(F.concat(first, placeholders))
    return errors, lambda errs: checks


# ---------------------------------------------------------------- V3 UPDATE
def _field_of(v: Column, field: Column) -> Column:
    return F.when(field == "memory_max", v["memory_max"]).when(field == "cpus", v["cpus"])


def update_rule(s: Callable[[str], Column]) -> tuple[Column, Callable[[Column], Column]]:
    vms, updates = F.col("_vms"), F.col("_vms_update")
    forbidden = F.filter(vms, lambda v: v["action"].isin("create", "delete", "replace"))
    field, val, target = s("updated_field"), s("new_value"), s("target_vm")
    has_field = F.coalesce(field, F.lit("")) != ""
    value_errors = F.when(
        has_field & val.isNotNull(),
        F.transform(
            F.filter(updates, lambda v: ~F.coalesce(_field_of(v, field) == val, F.lit(False))),
            lambda v: fill(MSG["update_value"], field=field, value=_s(val),
                           actual=F.coalesce(_s(_field_of(v, field)), F.lit("None"))),
        ),
    ).otherwise(F.array().cast("array<string>"))
    names = _names(updates)
    has_target = F.coalesce(target, F.lit("")) != ""
    extra = F.array_sort(F.array_except(names, F.array(target)))
    target_in = F.coalesce(F.array_contains(names, target), F.lit(False))
    errors_ok = _compact(
        F.array(F.when(F.size(updates) == 0, F.lit(MSG["update_none"]))),
        value_errors,
        F.array(
            F.when(has_target & ~target_in,
                   fill(MSG["update_target"], target=target)),
            F.when(has_target & (F.size(extra) > 0),
                   fill(MSG["update_extra"], names=_py_list(extra))),
        ),
    )
    values_ok = F.forall(updates, lambda v: F.coalesce(_field_of(v, field) == val, F.lit(False)))
    string_checks = F.array_compact(F.array(
        _named("action_type_only_update", F.lit(True)),
        F.when(has_field & val.isNotNull(),
               F.struct(F.concat(field, F.lit("_update")).alias("check"), values_ok.alias("ok"))),
    ))
    target_check = F.when(
        has_target, F.array(_check("target_vm", target_in & (F.size(extra) == 0))),
    ).otherwise(F.array().cast(CHECK_T))
    bad = F.size(forbidden) > 0
    errors = F.when(
        bad,
        F.array(fill(MSG["update_forbidden"], action=_first_action(forbidden))),
    ).otherwise(errors_ok)
    # when no forbidden action is planned, the final errors are errors_ok
    return errors, lambda errs: F.when(
        bad, F.array(_check("action_type_only_update", F.lit(False)))
    ).otherwise(F.concat(_string_checks(string_checks, errs), target_check))


def had_replace_actions(col: str = "resource_changes") -> Column:
    """Detail of the UPDATE rule: a forbidden replace was planned."""
    return F.exists(_vm_changes(col), lambda v: v["action"] == "replace")


# ---------------------------------------------------------------- V4 DELETE
def delete_rule(s: Callable[[str], Column]) -> tuple[Column, Callable[[Column], Column]]:
    vms, deletes = F.col("_vms"), F.col("_vms_delete")
    forbidden = F.filter(vms, lambda v: v["action"].isin("create", "replace", "update"))
    expected = s("delete_count")
    target = s("target_vm")
    targets = F.when(F.coalesce(target, F.lit("")) != "", F.array(target)).otherwise(
        F.coalesce(s("target_vms"), F.array().cast("array<string>"))
    )
    deleted = _names(deletes)
    missing = F.filter(targets, lambda t: ~F.coalesce(F.array_contains(deleted, t), F.lit(False)))
    extra = F.array_sort(F.array_except(deleted, targets))
    has_targets = F.size(targets) > 0
    errors_ok = _compact(
        F.array(F.when(expected.isNotNull() & (F.size(deletes) != expected),
                       fill(MSG["delete_count"], expected=_s(expected), found=_s(F.size(deletes))))),
        F.when(has_targets, F.transform(missing, lambda t: fill(MSG["delete_target"], target=t))).otherwise(
            F.array().cast("array<string>")),
        F.array(F.when(has_targets & (F.size(extra) > 0),
                       fill(MSG["delete_extra"], names=_py_list(extra)))),
    )
    target_check = F.when(
        has_targets, F.array(_check("correct_vms_targeted", (F.size(missing) == 0) & (F.size(extra) == 0))),
    ).otherwise(F.array().cast(CHECK_T))
    bad = F.size(forbidden) > 0
    errors = F.when(
        bad,
        F.array(fill(MSG["delete_forbidden"], action=_first_action(forbidden))),
    ).otherwise(errors_ok)
    only_delete = F.array(_named("action_type_only_delete", F.lit(True)))
    return errors, lambda errs: F.when(
        bad, F.array(_check("action_type_only_delete", F.lit(False)))
    ).otherwise(F.concat(_string_checks(only_delete, errs), target_check))


# ---------------------------------------------------------------- V5 quotas
def _fmt_gb(x: Column) -> Column:
    return F.format_string("%.2f", F.bround(x.cast("double") / F.lit(float(GIB)), 2))


def quota_errors(total_ram: Column, total_cpu: Column, total_disk: Column) -> Column:
    """One error per exceeded host limit (strict >)."""
    return F.array_compact(F.array(
        F.when(total_ram > HOST_RAM_LIMIT, fill(MSG["quota_ram"], gb=_fmt_gb(total_ram))),
        F.when(total_cpu > HOST_CPU_LIMIT, fill(MSG["quota_cpu"], cpus=_s(total_cpu))),
        F.when(total_disk > HOST_DISK_LIMIT, fill(MSG["quota_disk"], gb=_fmt_gb(total_disk))),
    ))


EXISTING_T = "array<struct<name:string,ram_bytes:bigint,cpus:bigint,disk_bytes:bigint>>"


def projected_totals(changes: Column, existing: Column | None = None) -> Column:
    """J9 + W7 inside one plan: the host's existing VMs overlaid by the plan's
    changes; last write per name wins, delete removes, nameless / no-op / other
    actions are ignored. Returns struct(ram, cpu, disk).

    The events are sorted by (name, position) once and folded once, so the work is
    that of a sort for a plan of any size."""
    zero = F.lit(0).cast("long")

    def event(name, pos, live, ram, cpu, disk):
        return F.struct(name.alias("name"), pos.cast("int").alias("pos"), live.alias("live"), F.coalesce(ram, zero).cast("long").alias("ram"),
                        F.coalesce(cpu, zero).cast("long").alias("cpu"), F.coalesce(disk, zero).cast("long").alias("disk"))

    disks = lambda v: F.aggregate(F.coalesce(v["disk_sizes"], F.array().cast("array<bigint>")), zero, lambda a, d: a + F.coalesce(d, zero))
    events = F.transform(
        F.filter(changes, lambda v: (F.coalesce(v["name_label"], F.lit("")) != "") & v["action"].isin("create", "update", "replace", "delete")),
        lambda v: event(v["name_label"], v["pos"], v["action"] != "delete", v["memory_max"], v["cpus"], disks(v)))
    if existing is not None:
        named = F.filter(F.coalesce(existing, F.array().cast(EXISTING_T)), lambda v: F.coalesce(v["name"], F.lit("")) != "")
        # a repeated name: the last listed VM counts
        events = F.concat(F.transform(named, lambda v, i: event(v["name"], i - 1_000_000_000, F.lit(True), v["ram_bytes"], v["cpus"], v["disk_bytes"])),
                          events)
    start = F.struct(F.lit(None).cast("string").alias("name"), *[zero.alias(n) for n in ("r", "c", "d", "ram", "cpu", "disk")])

    def step(acc, e):
        same = F.coalesce(acc["name"] == e["name"], F.lit(False))
        closed = [F.when(same, acc[t]).otherwise(acc[t] + acc[n]).alias(t) for n, t in (("r", "ram"), ("c", "cpu"), ("d", "disk"))]
        own = [F.when(e["live"], e[t]).otherwise(zero).alias(n) for n, t in (("r", "ram"), ("c", "cpu"), ("d", "disk"))]
        return F.struct(e["name"].alias("name"), *own, *closed)

    return F.aggregate(F.array_sort(events), start, step, lambda acc: F.struct(
        (acc["ram"] + acc["r"]).alias("ram"), (acc["cpu"] + acc["c"]).alias("cpu"), (acc["disk"] + acc["d"]).alias("disk")))


def host_quota(state_rows: DataFrame, host_col: str, name_col: str, order_cols: list[str]) -> DataFrame:
    """V5 over a host table.

    ``state_rows``: one row per existing VM or planned change with ``action``
    ('existing' for current VMs), ``memory_max``, ``cpus``, ``disk`` and an
    explicit order (existing first). Last event per (host, name) wins via
    ``max_by`` (a partial aggregate, so a hot host is combined map-side),
    deletes drop the VM, then sums per host.
    """
    ev = state_rows.filter(
        (F.coalesce(F.col(name_col), F.lit("")) != "")
        & F.col("action").isin("existing", "create", "update", "replace", "delete")
    )
    order = F.struct(*[F.col(c) for c in order_cols])
    last = ev.groupBy(host_col, name_col).agg(
        F.max_by(F.struct("action", "memory_max", "cpus", "disk"), order).alias("s")
    )
    live = last.filter(F.col("s.action") != "delete")
    zero = F.lit(0).cast("long")
    tot = live.groupBy(host_col).agg(
        F.count(F.lit(1)).alias("n_vms"),
        F.sum(F.coalesce("s.memory_max", zero)).alias("total_ram"),
        F.sum(F.coalesce("s.cpus", zero)).alias("total_cpus"),
        F.sum(F.coalesce("s.disk", zero)).alias("total_disk"),
    )
    errs = quota_errors(F.col("total_ram"), F.col("total_cpus"), F.col("total_disk"))
    return tot.select("*", errs.alias("errors")).withColumn("passed", F.size("errors") == 0)


# ---------------------------------------------------------------- V6 dispatch
RULES: dict[str, Callable] = {
    "CREATE": create_rule,
    "READ": read_rule,
    "UPDATE": update_rule,
    "DELETE": delete_rule,
}


def register_rule(category: str, rule: Callable) -> None:
    """Add or replace the rule used for a category. A rule maps a spec
    accessor ``s(name) -> Column`` to ``(errors, checks_of(errors))``: an
    array<string> expression and a function building the checks from the
    (already computed) errors column."""
    RULES[category] = rule


def check_plans(plans: DataFrame, specs: DataFrame, key: str = "plan_id", task_col: str | None = None) -> DataFrame:
    """V6 + J4: plans left-joined to specs; dispatch by category; quota errors appended.

    ``task_col`` names the plans' task id: specs are then looked up by the trimmed
    task id, so any number of samples share one spec; else plans and specs share
    ``key``. If the plans have ``pre_vms`` (array of name, ram_bytes, cpus,
    disk_bytes: the host before the plan), quotas count them too. A plan with a
    ``plan_error`` isn't checked: status 'skipped', no verdict, the error as its
    only message.
    Output: key, category, status, passed, errors, checks, had_replace_actions.
    """
    spec_key = "task_id" if task_col else key
    spec_cols = [c for c in specs.columns if c != spec_key]
    sp = specs.select(F.trim(F.col(spec_key)).alias("_spec_key") if task_col else F.col(spec_key).alias("_spec_key"),
                      *spec_cols, F.lit(True).alias("_has_spec"))
    task = F.trim(F.col(task_col) if task_col else F.col(key).cast("string"))
    j = plans.join(sp, (F.coalesce(task, F.lit("")) if task_col else F.col(key)) == F.col("_spec_key"), "left")
    j = _with_changes(j)
    s = lambda c: F.col(c) if c in spec_cols else F.lit(None).cast(SPEC_TYPES.get(c, "string"))
    cat = F.col("category")

    # quota over the plan's own changes; READ documents carry no names (only existing VMs count)
    quota_src = F.when(cat == "READ", F.array().cast(plans.schema["resource_changes"].dataType)).otherwise(
        F.col("_vms")
    )
    qt = projected_totals(quota_src, F.col("pre_vms").cast(EXISTING_T) if "pre_vms" in plans.columns else None)

    # 1st projection: each plan's rule errors and quota totals, computed once;
    # 2nd: checks read those columns instead of re-evaluating the rules
    expr_e, check_fns = None, {}
    for name, rule in RULES.items():
        e, check_fn = rule(s)
        check_fns[name] = check_fn
        expr_e = F.when(cat == name, e) if expr_e is None else expr_e.when(cat == name, e)
    j = j.select("*", expr_e.alias("_rule_errors"), qt.alias("_quota"))
    j = j.select("*", quota_errors(F.col("_quota.ram"), F.col("_quota.cpu"), F.col("_quota.disk")).alias("_quota_errors"))
    rule_errs, q_err = F.col("_rule_errors"), F.col("_quota_errors")
    expr_c = None
    for name, check_fn in check_fns.items():
        c = check_fn(rule_errs)
        expr_c = F.when(cat == name, c) if expr_c is None else expr_c.when(cat == name, c)
    q_check = F.array(_check("host_resource_quotas", F.size(q_err) == 0))

    broken = F.col("plan_error") if "plan_error" in plans.columns else F.lit(None).cast("string")
    no_spec = F.col("_has_spec").isNull()
    known = cat.isin(*RULES.keys())
    errors = (
        F.when(broken.isNotNull(), F.array(broken))
        .when(no_spec, F.array(fill(MSG["no_spec"], task=task)))
        .when(~F.coalesce(known, F.lit(False)), F.array(fill(MSG["bad_category"], category=F.coalesce(cat, F.lit("None")), task=task)))
        .otherwise(F.concat(rule_errs, q_err))
    )
    checks = (
        F.when(broken.isNotNull(), F.array().cast(CHECK_T))
        .when(no_spec, F.array(_check("spec_exists", F.lit(False))))
        .when(~F.coalesce(known, F.lit(False)), F.array(_check("category_valid", F.lit(False))))
        .otherwise(F.concat(expr_c, q_check))
    )
    out = j.select(
        key,
        *([task_col] if task_col and task_col != key else []),
        cat.alias("category"),
        F.when(broken.isNull(), F.lit("executed")).otherwise(F.lit("skipped")).alias("status"),
        errors.alias("errors"),
        checks.alias("checks"),
        F.when(cat == "UPDATE", had_replace_actions()).alias("had_replace_actions"),
    )
    return out.withColumn("passed", F.when(F.col("status") == "executed", F.size("errors") == 0))
