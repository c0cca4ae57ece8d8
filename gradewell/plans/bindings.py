"""Bindings: the reference's inputs expressed as views over the driver tables.

The driver tables hold no Terraform and no result documents, so every
operator runs over a derived view (B1-B14). Each view is defined twice,
identically: here with the DataFrame API, and as SQL text in ``oracle.py``.
All views read whole tables; none subsets rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import read_table, settings


# ---------------------------------------------------------------- B1 samples
def samples(spark: SparkSession, sf: str) -> DataFrame:
    """B1: events as evaluated samples (task = user x day)."""
    ev = read_table(spark, sf, "events")
    et = F.col("event_type")
    return ev.select(
        F.concat(F.col("user_id").cast("string"), F.lit("_"), F.to_date("ts").cast("string")).alias(
            "task_id"
        ),
        "event_id",
        (et != F.lit("error")).alias("plan_ok"),
        et.isin("purchase", "click", "signup").alias("apply_ok"),
        F.when(et == "purchase", F.lit(True))
        .when(et == "view", F.lit(None).cast("boolean"))
        .otherwise(F.lit(False))
        .alias("spec_ok"),
        (F.get_json_object("props", "$.k").cast("int") % 10 + 1).alias("iterations"),
        F.col("value").alias("gen_s"),
        (F.col("event_id") % 3).alias("folder"),
    )


def clustered_samples(spark: SparkSession, sf: str) -> DataFrame:
    """B1 with other order keys: ids in clusters of 50 far apart, and every thousandth beyond 2^60."""
    e = F.col("event_id")
    far = F.floor(e / 50).cast("long") * 10**9 + e % 50
    return samples(spark, sf).select(
        "folder", F.when(e % 1000 == 999, e + F.lit(1 << 60)).otherwise(far).alias("position"),
        F.round(F.col("gen_s") * 100).cast("long").alias("gen_cs"),
    )


# ---------------------------------------------------------------- B2 judged
def judged(spark: SparkSession, sf: str) -> DataFrame:
    """B2: labels as judge responses (verdict text in five layouts) and spec results."""
    lb = read_table(spark, sf, "labels")
    v = F.when(F.col("quality") == 1, F.lit("Correct")).otherwise(F.lit("Incorrect"))
    layout = F.col("doc_id") % 5
    text = (
        F.when(layout == 0, F.concat(F.lit("Review done.\nRating: "), v))
        .when(layout == 1, F.concat(F.lit("looks fine overall. rating: "), F.lower(v)))
        .when(layout == 2, F.concat(F.lit("The configuration is "), F.lower(v), F.lit("  \n")))
        .when(layout == 3, F.lit("No clear verdict here."))
        .otherwise(F.lit(""))
    )
    spec = F.when(F.col("doc_id") % 11 == 0, F.lit(None).cast("boolean")).otherwise(
        F.col("toxic") == 0
    )
    return lb.select(
        "doc_id",
        F.concat(F.lit("T"), (F.col("doc_id") % 7).cast("string")).alias("task_id"),
        text.alias("judge_text"),
        spec.alias("spec_passed"),
    )


# ---------------------------------------------------------------- B3 pairs
def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Adjacent conversation turns as (reference, candidate) pairs."""
    cv = read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    a = cv.alias("a")
    b = cv.alias("b")
    return a.join(
        b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1)
    ).select(
        F.col("a.conv_id").alias("conv_id"),
        F.col("a.turn").alias("turn"),
        F.col("a.text").alias("reference"),
        F.col("b.text").alias("candidate"),
    )


# ---------------------------------------------------------------- B4 fenced
def fenced(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation texts wrapped as model responses in six fence layouts."""
    cv = read_table(spark, sf, "conversations")
    t = F.col("text")
    layout = (F.col("conv_id") + F.col("turn")) % 6
    resp = (
        F.when(layout == 0, F.concat(F.lit("Here is the code:\n```hcl\n"), t, F.lit("\n```\nDone.")))
        .when(layout == 1, F.concat(F.lit("```\n"), t, F.lit("\n```")))
        .when(layout == 2, F.concat(F.lit("```TF\r\n"), t, F.lit("\r\n```")))
        .when(
            layout == 3,
            F.concat(F.lit("```hcl\nexample\n```\nThen:\n```terraform\n"), t, F.lit("\n```")),
        )
        .when(layout == 4, F.concat(F.lit("Partial answer:\n```hcl\n"), t))
        .when(F.col("turn") % 2 == 0, F.concat(F.lit('resource "vm" "x" {}\n'), t))
        .otherwise(t)
    )
    category = F.when(F.col("role") == "system", F.lit("READ")).otherwise(F.lit("CREATE"))
    return cv.select("conv_id", "turn", category.alias("category"), resp.alias("response"))


# ---------------------------------------------------------------- B5 hcl
def hcl_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """One HCL block per part; a brand's document is its blocks joined by newline.

    The document is kept as rows (one block each) rather than one concatenated
    string, so no brand is ever gathered into a single value.
    """
    p = read_table(spark, sf, "part")
    frag = F.concat(
        F.lit('resource "'), F.col("p_type"), F.lit('" "p'), F.col("p_partkey").cast("string"),
        F.lit('" {\n  cpus = '), F.col("p_size").cast("string"),
        F.lit("\n  memory_max = "), F.col("p_size").cast("string"), F.lit(" * 1024 * 1024"),
        F.lit("\n  sr_id = data.sr."), F.col("p_brand"), F.lit(".id"),
        F.lit('\n  name_label = "'), F.col("p_name"), F.lit('"\n}'),
    )
    return p.select(
        F.col("p_brand").alias("doc"), F.col("p_partkey").alias("frag_pos"), frag.alias("hcl")
    )


# ---------------------------------------------------------------- B6 plan rows
def plan_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Lineitem rows as planned VM changes; one plan per order.

    (l_orderkey, l_linenumber) repeats, so the plan position is a row number
    over a total order of the row's columns. Orders are small, so the window
    per order is bounded. The key is renamed before the window so that the
    window's hash partitioning on ``plan_id`` is reused by later per-plan
    aggregates (one shuffle for both).
    """
    li = read_table(spark, sf, "lineitem")
    actions = (
        F.when(F.col("l_returnflag") == "A", F.array(F.lit("delete")))
        .when(F.col("l_returnflag") == "N", F.array(F.lit("create")))
        .when(F.col("l_linestatus") == "F", F.array(F.lit("delete"), F.lit("create")))
        .otherwise(F.array(F.lit("update")))
    )
    q = F.col("l_quantity").cast("long")
    base = li.select(
        F.col("l_orderkey").alias("plan_id"),
        F.col("l_linenumber").alias("linenumber"),
        "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
        F.lit("xenorchestra_vm").alias("type"),
        actions.alias("actions"),
        F.concat(F.lit("vm-"), F.col("l_suppkey").cast("string")).alias("name_label"),
        q.alias("cpus"),
        (q * F.lit(1 << 26)).alias("memory_max"),
        F.array(F.col("l_partkey") * F.lit(1 << 24)).alias("disk_sizes"),
    )
    w = Window.partitionBy("plan_id").orderBy("linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return base.select(
        "plan_id", F.row_number().over(w).alias("pos"), "linenumber", "type", "actions", "name_label",
        "cpus", "memory_max", "disk_sizes",
    )


# ---------------------------------------------------------------- B7 specs
def specs(spark: SparkSession, sf: str) -> DataFrame:
    """One spec per order; category from priority; no spec when o_orderkey % 13 = 0."""
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    pr = F.substring("o_orderpriority", 1, 1)
    cat = (
        F.when(pr == "1", F.lit("CREATE"))
        .when(pr == "2", F.lit("READ"))
        .when(pr == "3", F.lit("UPDATE"))
        .when(pr == "4", F.lit("DELETE"))
        .otherwise(F.lit("MIGRATE"))
    )
    null_long = F.lit(None).cast("long")
    is_create = cat == "CREATE"
    return o.filter(k % 13 != 0).select(
        k.alias("plan_id"),
        F.col("o_custkey").alias("host_id"),
        cat.alias("category"),
        F.when(is_create & (k % 3 != 0), k % 4 + 1).otherwise(null_long).alias("vm_count"),
        F.when(is_create & (k % 3 == 0), F.lit(2).cast("long")).otherwise(null_long).alias("min_vm_count"),
        F.when(is_create & (k % 3 == 0), F.lit(4).cast("long")).otherwise(null_long).alias("max_vm_count"),
        F.when(is_create & (k % 2 == 0), F.lit(8.0)).alias("max_total_ram_gb"),
        F.when(is_create & (k % 5 == 1), F.lit(60).cast("long")).otherwise(null_long).alias("max_total_cpus"),
        F.when(is_create & (k % 7 == 0), (k % 50 + 1) * F.lit(1 << 26)).otherwise(null_long).alias(
            "per_vm_memory_max"
        ),
        F.when(is_create & (k % 7 == 1), k % 50 + 1).otherwise(null_long).alias("per_vm_cpus"),
        F.when(is_create & (k % 7 == 2), (k % 2000) * F.lit(1 << 24)).otherwise(null_long).alias(
            "per_vm_disk_size"
        ),
        F.when(
            is_create & (k % 4 == 3),
            F.array(
                F.concat(F.lit("vm-"), (k % 100).cast("string")),
                F.concat(F.lit("vm-"), ((k + 37) % 100).cast("string")),
            ),
        ).alias("vm_names"),
        F.when(cat == "UPDATE", F.when(k % 2 == 0, F.lit("cpus")).otherwise(F.lit("memory_max"))).alias(
            "updated_field"
        ),
        F.when(
            cat == "UPDATE",
            F.when(k % 2 == 0, k % 50 + 1).otherwise((k % 50 + 1) * F.lit(1 << 26)),
        ).otherwise(null_long).alias("new_value"),
        F.when(
            (cat == "UPDATE") | ((cat == "DELETE") & (k % 2 == 0)),
            F.concat(F.lit("vm-"), (k % 100).cast("string")),
        ).alias("target_vm"),
        F.when(
            cat == "DELETE",
            F.array(
                F.concat(F.lit("vm-"), ((k + 11) % 100).cast("string")),
                F.concat(F.lit("vm-"), (k % 100).cast("string")),
            ),
        ).alias("target_vms"),
        F.when(cat == "DELETE", k % 3).otherwise(null_long).alias("delete_count"),
    )


# ---------------------------------------------------------------- B7b plan samples on hosts
PRE_VMS_T = "array<struct<name:string,ram_bytes:bigint,cpus:bigint,disk_bytes:bigint>>"


def plan_sample_json(spark: SparkSession, sf: str) -> DataFrame:
    """One plan document (JSON text) per order, also for orders without lines
    (empty plans). Task id = order key modulo 200 (with blanks around), so many
    samples share a spec. Every other block of 200 orders plans what its task asks
    for, the rest what the return flags say. Lines 5 are another resource type,
    lines 7 have no name. Every third order starts on a host with VMs. Documents of
    orders with key % 97 = 0 are cut off."""
    from pyspark.sql import types as T

    o = read_table(spark, sf, "orders")
    li = read_table(spark, sf, "lineitem")
    k = F.col("o_orderkey")
    t = k % 200
    asked = F.element_at(F.array(*[F.array(F.lit(a)) for a in ("create", "no-op", "update", "delete", "create")]), (t % 5 + 1).cast("int"))
    good = F.floor(k / 200) % 2 == 0
    returned, status = F.col("l_returnflag"), F.col("l_linestatus")
    li = li.withColumn(  # one number for both flags: a shorter line to shuffle
        "flags", F.when(returned == "A", F.lit(1)).when(returned == "N", F.lit(2)).when(status == "F", F.lit(3)).otherwise(F.lit(4)))
    flagged = F.element_at(F.array(*[F.array(*map(F.lit, a)) for a in (("delete",), ("create",), ("delete", "create"), ("update",))]), F.col("flags"))
    name = F.when(F.col("l_linenumber") != 7, F.concat(F.lit("vm-"), F.col("l_suppkey").cast("string")))
    q = F.col("l_quantity").cast("long")
    state = F.struct(
        name.alias("name_label"),
        F.when(good, F.lit(1 << 28).cast("long")).otherwise(q * F.lit(1 << 26)).alias("memory_max"),
        F.when(good, t % 4 + 1).otherwise(q).alias("cpus"),
        F.array(F.struct(F.when(good, F.lit(1 << 30).cast("long")).otherwise(F.col("l_partkey") * F.lit(1 << 24)).alias("size"))).alias("disk"),
    )
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = li.withColumn("pos", F.row_number().over(w)).join(o.select("o_orderkey"), F.col("l_orderkey") == k)
    kind = F.when(F.col("l_linenumber") == 5, F.lit("xenorchestra_network")).otherwise(F.lit("xenorchestra_vm"))
    actions = F.when(good, asked).otherwise(flagged)
    gone = F.array_contains(actions, "delete") & ~F.array_contains(actions, "create")
    change = F.struct(
        kind.alias("type"), F.concat(kind, F.lit(".r_"), F.col("pos").cast("string")).alias("address"),
        F.struct(
            actions.alias("actions"),
            F.when(F.array_contains(actions, "delete") | F.array_contains(actions, "update"), F.struct(name.alias("name_label"))).alias("before"),
            F.when(~gone, state).alias("after"),
        ).alias("change"),
    )
    # collected as JSON text: smaller to spill than nested rows. The rows are in that order after the window;
    # naming it keeps the projection, which is compiled, out of the aggregate, which isn't
    lines = rows.select("l_orderkey", F.struct("pos", F.to_json(change).alias("json")).alias("line")).sortWithinPartitions("l_orderkey")
    docs = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("line")).alias("rc"))  # an order's lines are few
    vm = lambda n, r, c, d: F.struct(n.alias("name"), r.cast("long").alias("ram_bytes"), c.cast("long").alias("cpus"), d.cast("long").alias("disk_bytes"))
    host = F.array(
        vm(F.lit("vm-host"), F.lit(1 << 30), F.lit(2), F.lit(1 << 30)),
        vm(F.concat(F.lit("vm-"), (k % 100).cast("string")), (k % 25) * F.lit(1 << 30), k % 33, F.lit(1 << 33)),
        vm(F.lit(None).cast("string"), F.lit(1 << 40), F.lit(99), F.lit(1 << 50)),
    )
    pre = F.when(k % 3 == 0, host).when(k % 3 == 1, F.array().cast(T._parse_datatype_string(PRE_VMS_T)))
    head = F.to_json(F.struct(
        k.cast("string").alias("plan_key"),
        F.concat(F.lit(" T"), t.cast("string"), F.lit(" ")).alias("task_id"),
        pre.alias("pre_vms"),
    ))
    listed = F.concat(F.lit(',"resource_changes":['), F.array_join("rc.json", ","), F.lit("]}"))
    text = F.when(F.col("rc").isNull(), head).otherwise(F.concat(F.substr(head, F.lit(1), F.length(head) - 1), listed))
    return o.join(docs, k == F.col("l_orderkey"), "left").select(F.when(k % 97 == 0, F.substring(text, 1, 8)).otherwise(text).alias("value"))


def write_plan_samples(spark: SparkSession, sf: str, path: str) -> None:
    """B7b as JSON Lines, compressed: the documents repeat their field names in every line.

    A compressed file is read by one task, so its documents are limited. The lines come to the
    aggregate sorted by order: a sort aggregate passes them on, a hash aggregate would keep
    and spill them all."""
    with settings(spark, spark__sql__execution__useObjectHashAggregateExec="false"):
        plan_sample_json(spark, sf).write.option("compression", "lz4").option("maxRecordsPerFile", 200_000).text(path)


def task_specs(spark: SparkSession, sf: str) -> DataFrame:
    """Specs of the 200 tasks of B7b, from the orders' task ids; none for task % 13 = 12."""
    t = read_table(spark, sf, "orders").select((F.col("o_orderkey") % 200).alias("t")).distinct().filter("t % 13 <> 12")
    cat = F.element_at(F.array(*[F.lit(c) for c in ("CREATE", "READ", "UPDATE", "DELETE", "MIGRATE")]), (F.col("t") % 5 + 1).cast("int"))
    t = t.withColumn("category", cat)
    none = F.lit(None).cast("long")
    is_ = lambda c: F.col("category") == c
    return t.select(
        F.concat(F.lit("T"), F.col("t").cast("string"), F.lit("  ")).alias("task_id"),
        "category",
        F.when(is_("CREATE") & (F.col("t") % 2 == 0), F.col("t") % 4 + 1).otherwise(none).alias("vm_count"),
        F.when(is_("CREATE") & (F.col("t") % 2 == 1), F.lit(1).cast("long")).otherwise(none).alias("min_vm_count"),
        F.when(is_("CREATE") & (F.col("t") % 2 == 1), F.lit(7).cast("long")).otherwise(none).alias("max_vm_count"),
        F.when(is_("CREATE"), F.when(F.col("t") % 4 == 0, F.lit("8")).otherwise(F.lit("4.5"))).alias("max_total_ram_gb"),
        F.lit(None).cast("long").alias("max_total_cpus"),
        F.when(is_("CREATE") & (F.col("t") % 3 == 0), F.lit(1 << 28).cast("long")).otherwise(none).alias("per_vm_memory_max"),
        F.when(is_("CREATE") & (F.col("t") % 3 == 1), F.col("t") % 4 + 1).otherwise(none).alias("per_vm_cpus"),
        F.when(is_("CREATE") & (F.col("t") % 3 == 2), F.lit(1 << 30).cast("long")).otherwise(none).alias("per_vm_disk_size"),
        F.lit(None).cast("array<string>").alias("vm_names"),
        F.when(is_("UPDATE"), F.lit("cpus")).alias("updated_field"),
        F.when(is_("UPDATE"), F.col("t") % 4 + 1).otherwise(none).alias("new_value"),
        F.when(is_("UPDATE") & (F.col("t") % 4 == 2), F.concat(F.lit("vm-"), (F.col("t") % 100).cast("string"))).alias("target_vm"),
        F.lit(None).cast("array<string>").alias("target_vms"),
        F.when(is_("DELETE") & (F.col("t") % 2 == 1), F.lit(3).cast("long")).otherwise(none).alias("delete_count"),
    )


# ---------------------------------------------------------------- B11 text
ANSI_RED = "\x1b[31m"
ANSI_RESET = "\x1b[0m"


def error_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as tool output; ANSI colour codes around every 4th text."""
    d = read_table(spark, sf, "documents")
    t = F.when(
        F.col("doc_id") % 4 == 0, F.concat(F.lit(ANSI_RED), F.col("text"), F.lit(ANSI_RESET))
    ).otherwise(F.col("text"))
    return d.select("doc_id", t.alias("text"))


# ---------------------------------------------------------------- ground truth
def results_and_truth(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Results = samples of folders 1 and 2; ground truth = folder 0."""
    s = samples(spark, sf)
    return s.filter(F.col("folder") != 0), s.filter(F.col("folder") == 0)


# ---------------------------------------------------------------- B8 hosts
def host_state_rows(spark: SparkSession, sf: str) -> DataFrame:
    """host = customer; existing VMs = plan rows with line number 1, planned = the rest."""
    from ..functions.outcome import normalize_action

    rows = plan_rows(spark, sf)
    o = read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("plan_id"), F.col("o_custkey").alias("host_id")
    )
    existing = F.col("linenumber") == 1
    return rows.join(o, "plan_id").select(
        "host_id",
        "name_label",
        F.when(existing, F.lit("existing")).otherwise(normalize_action(F.col("actions"))).alias("action"),
        "memory_max",
        "cpus",
        F.aggregate("disk_sizes", F.lit(0).cast("long"), lambda a, d: a + d).alias("disk"),
        F.when(existing, F.lit(0)).otherwise(F.lit(1)).alias("prio"),
        "plan_id",
        "pos",
    )


# ---------------------------------------------------------------- B9 before/after
def vm_snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as VMs of a host (task = nation) before and after a change.

    After: rows with c_custkey % 7 = 0 are gone; % 5 = 0 got one more vCPU and
    0.5 GB more RAM; % 10 = 0 were replaced (new uuid). Specs per task: even
    nations UPDATE their lowest-key VM (cpus or memory_max), odd nations DELETE
    their lowest- and highest-key VMs.
    """
    c = read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    ram = (k % 16 + 1) / F.lit(4.0)
    pre = c.select(
        F.col("c_nationkey").alias("task_id"), F.col("c_name").alias("name"),
        F.concat(F.lit("u-"), k.cast("string")).alias("uuid"), (k % 8 + 1).cast("int").alias("cpus"),
        ram.alias("ram_gb"),
    )
    changed = k % 5 == 0
    post = c.filter(k % 7 != 0).select(
        F.col("c_nationkey").alias("task_id"), F.col("c_name").alias("name"),
        F.concat(F.when(k % 10 == 0, F.lit("r-")).otherwise(F.lit("u-")), k.cast("string")).alias("uuid"),
        F.when(changed, k % 8 + 2).otherwise(k % 8 + 1).cast("int").alias("cpus"),
        F.when(changed, ram + 0.5).otherwise(ram).alias("ram_gb"),
    )
    g = c.groupBy(F.col("c_nationkey").alias("task_id")).agg(
        F.min_by("c_name", "c_custkey").alias("lo_name"),
        F.min("c_custkey").alias("lo_key"),
        F.max_by("c_name", "c_custkey").alias("hi_name"),
    )
    is_upd = F.col("task_id") % 2 == 0
    lo = F.col("lo_key")
    specs = g.select(
        "task_id",
        F.when(is_upd, F.lit("UPDATE")).otherwise(F.lit("DELETE")).alias("category"),
        F.when(is_upd, F.col("lo_name")).alias("target_vm"),
        F.when(~is_upd, F.array("lo_name", "hi_name")).alias("target_vms"),
        F.when(is_upd, F.when(F.col("task_id") % 4 == 0, F.lit("cpus")).otherwise(F.lit("memory_max"))).alias("updated_field"),
        F.when(is_upd, F.when(F.col("task_id") % 4 == 0, lo % 8 + 2).otherwise(
            (((lo % 16 + 1) / F.lit(4.0) + 0.5) * F.lit(float(1 << 30))).cast("long"))).alias("new_value"),
    )
    return pre, post, specs


# ---------------------------------------------------------------- B10 objects
def vm_objects(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as VMs (host = customer), lineitems as block devices, parts as
    disk images; parts with p_partkey % 9 = 0 are missing (dangling links)."""
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    mem = ((k % 16 + 1) * F.lit(1 << 28)).cast("string")
    vms = o.select(
        F.concat(F.lit("vm-"), k.cast("string")).alias("vm_id"),
        F.col("o_custkey").alias("host_id"),
        F.concat(F.lit("vm-"), k.cast("string")).alias("name_label"),
        F.when(F.col("o_orderstatus") == "F", F.lit("Running"))
        .when(F.col("o_orderstatus") == "O", F.lit("Halted")).otherwise(F.lit("Paused")).alias("power_state"),
        (k % 97 == 0).alias("is_control_domain"),
        F.when(k % 2 == 0, F.concat(F.lit('{"number": '), (k % 8 + 1).cast("string"), F.lit("}")))
        .otherwise((k % 8 + 1).cast("string")).alias("cpus_json"),
        F.when(k % 3 == 0, F.concat(F.lit('{"static": [0, '), mem, F.lit("]}")))
        .when(k % 3 == 1, F.concat(F.lit('{"size": '), mem, F.lit("}")))
        .otherwise(mem).alias("memory_json"),
        F.when(
            F.col("o_orderstatus") != "P",
            F.create_map(F.lit("0/ipv4/0"), F.concat(F.lit("10.0."), (k % 250).cast("string"), F.lit("."),
                                                      (k % 200).cast("string"))),
        ).otherwise(F.create_map().cast("map<string,string>")).alias("addresses"),
    )
    li = read_table(spark, sf, "lineitem")
    vbds = li.select(
        F.concat_ws("-", F.lit("vbd"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("vbd_id"),
        F.concat(F.lit("vm-"), F.col("l_orderkey").cast("string")).alias("vm_id"),
        F.concat(F.lit("vdi-"), F.col("l_partkey").cast("string")).alias("vdi_id"),
    )
    p = read_table(spark, sf, "part")
    vdis = p.filter(F.col("p_partkey") % 9 != 0).select(
        F.concat(F.lit("vdi-"), F.col("p_partkey").cast("string")).alias("vdi_id"),
        (F.col("p_size").cast("long") * F.lit(1 << 30)).alias("size"),
    )
    return vms, vbds, vdis


# ---------------------------------------------------------------- B13 vecs
def vec_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Pair p compares the 16 vectors from id 16 p on (reference tokens) with the
    next 16 (candidate tokens), so pairs have a bounded size and their number grows
    with the table; the pairs at the ends have an empty side. Every 50th vector is zero."""
    e = read_table(spark, sf, "embeddings")
    group = F.floor(F.col("vec_id") / 16).cast("long")
    vec = F.when(F.col("vec_id") % 50 == 7, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    ref = e.select(group.alias("pair_id"), F.lit("ref").alias("side"), F.col("vec_id").alias("tok_id"), vec.alias("vec"))
    cand = e.select((group - 1).alias("pair_id"), F.lit("cand").alias("side"), F.col("vec_id").alias("tok_id"), vec.alias("vec"))
    return ref.unionByName(cand)


# ---------------------------------------------------------------- B14 attempts
def attempt_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as the iteration log of a run (run = user); stage by event type."""
    ev = read_table(spark, sf, "events")
    et = F.col("event_type")
    stage = (
        F.when(et == "error", F.lit("plan_failed")).when(et == "view", F.lit("spec_failed"))
        .when(et == "click", F.lit("validate_ok")).when(et == "signup", F.lit("init_ok"))
        .otherwise(F.lit("applied"))
    )
    return ev.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("iteration"), stage.alias("stage"),
        (et == "purchase").alias("success"), F.col("value").alias("gen_s"),
        et.isin("error", "view").alias("is_error"),
    )


def chain_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive events in threes form chains; even chains run
    (c1.3, u1.2, d1.2), odd chains (c2.3, r1.2, d2.2); a step succeeds unless
    its event is an error."""
    from ..operators.chains import CHAINS

    ev = read_table(spark, sf, "events")
    chain = F.floor(F.col("event_id") / 3).cast("long")
    step = (F.col("event_id") % 3).cast("int")
    kind = chain % 2
    task = F.element_at(
        F.when(kind == 0, F.array(*[F.lit(t) for t in CHAINS[0]])).otherwise(F.array(*[F.lit(t) for t in CHAINS[1]])),
        step + 1,
    )
    cat = (
        F.when(F.startswith(task, F.lit("c")), F.lit("CREATE")).when(F.startswith(task, F.lit("u")), F.lit("UPDATE"))
        .when(F.startswith(task, F.lit("r")), F.lit("READ")).otherwise(F.lit("DELETE"))
    )
    return ev.select(chain.alias("chain_id"), step.alias("step"), task.alias("task_id"), cat.alias("category"),
                     (F.col("event_type") != "error").alias("ok"), F.col("event_id").alias("pos"))


# ---------------------------------------------------------------- B12 matrix
def bench_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as tasks; category from item_id % 5 (4 -> unknown category)."""
    b = read_table(spark, sf, "benchmark")
    i = F.col("item_id")
    letter = F.substring(F.lit("CRUDM"), (i % 5 + 1).cast("int"), 1)
    cat = (
        F.when(letter == "C", F.lit("CREATE")).when(letter == "R", F.lit("READ"))
        .when(letter == "U", F.lit("UPDATE")).when(letter == "D", F.lit("DELETE")).otherwise(F.lit("MIGRATE"))
    )
    return b.select(
        "item_id",
        F.concat(letter, (i % 5 + 1).cast("string"), F.lit("."), (i % 3 + 1).cast("string")).alias("task_id"),
        cat.alias("category"),
        F.col("text").alias("prompt"),
        F.concat(F.lit("model"), (i % 2).cast("string")).alias("folder"),
        F.concat(F.lit("m"), (i % 2).cast("string")).alias("model_short"),
        F.when(i % 3 != 0, i % 7).alias("base_seed"),
    )


def ragged_task_lines(spark: SparkSession, sf: str, parts: int = 4) -> DataFrame:
    """B12 as CSV text, (part, value) in ``parts`` files that each begin with their header: every
    third row has a fifth cell and every sixth a sixth one, beyond the four that the header names."""
    t, i = bench_tasks(spark, sf), F.col("item_id")
    row = [F.concat(F.lit("T"), i.cast("string")), F.col("category"), F.regexp_replace("prompt", r"[\r\n]+", " "), F.lit("2")]
    row = [F.coalesce(c, F.lit("")).alias(f"c{k}") for k, c in enumerate(row)]
    level, more = (i % 6 + 1).cast("string").alias("c4"), F.lit("more").alias("c5")
    csv = lambda *cells: F.to_csv(F.struct(*cells), {"quoteAll": "true", "escape": '"'})
    line = F.when(i % 6 == 0, csv(*row, level, more)).when(i % 3 == 0, csv(*row, level)).otherwise(csv(*row))
    lines = t.select((i % parts).cast("int").alias("part"), F.lit(1).alias("at"), line.alias("value"))
    header = spark.range(parts).select(F.col("id").cast("int").alias("part"), F.lit(0).alias("at"),
                                       F.lit("task_id,category,prompt,complexity_level").alias("value"))
    return header.unionByName(lines).repartition(parts, "part").sortWithinPartitions("part", "at").drop("at")


def worked_examples(spark: SparkSession, sf: str) -> DataFrame:
    """The worked example per category: its lowest item's text as prompt, its highest as code."""
    t = bench_tasks(spark, sf).filter(F.col("category") != "MIGRATE")
    return t.groupBy("category").agg(
        F.min_by("prompt", "item_id").alias("prompt"),
        F.concat(F.lit("Plan the "), F.min("category"), F.lit(".")).alias("thought"),
        F.max_by("prompt", "item_id").alias("hcl"))


# ---------------------------------------------------------------- B4b results
def result_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Results table for the entry builder: one evaluated sample per conversation turn.

    Prompt, requirements, code and stage outcomes are all derived from the
    conversation row; code is an HCL block for two turns in three, else the
    code extracted from the fenced response (prose, so mostly empty).
    """
    from ..functions.text import extract_code

    f = fenced(spark, sf)
    cv = read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    c, t = F.col("conv_id"), F.col("turn")
    vms = (c % 3 + 1)
    gb = (c % 4 + 1)
    prompt = F.concat(
        F.lit("Create "), vms.cast("string"), F.lit(" VMs with "), gb.cast("string"), F.lit(" GB RAM"),
        F.when(t % 2 == 0, F.lit(" and 2 cpu")).otherwise(F.lit("")),
        F.when(c % 5 == 0, F.lit(" on network xenbr0")).otherwise(F.lit("")),
        F.when(c % 3 == 0, F.lit(" with a 20 GB disk")).otherwise(F.lit("")),
    )
    reqs = F.concat(
        F.lit('{"count": '), vms.cast("string"),
        F.lit(', "memory_max_bytes": '), (vms * gb * F.lit(1 << 30)).cast("string"),
        F.when(t % 2 == 0, F.concat(F.lit(', "per_vm_cpus": 2'))).otherwise(F.lit("")),
        F.when(c % 11 == 0, F.lit(', "expected_error": "resource_exhaustion"')).otherwise(F.lit("")),
        F.when(c % 4 == 2, F.concat(F.lit(', "target_vm": "vm-'), c.cast("string"), F.lit('"'))).otherwise(F.lit("")),
        F.lit("}"),
    )
    hcl = F.concat(
        F.lit('resource "xenorchestra_vm" "vm" {\n  cpus = '), (c % 4 + 1).cast("string"),
        F.lit("\n  memory_max = "), gb.cast("string"), F.lit(" * 1024 * 1024 * 1024\n  network {\n"
                                                         "    network_id = data.xenorchestra_network.net.id\n  }\n}"),
    )
    plan_exit = F.when((c + t) % 5 == 0, F.lit(1)).otherwise(F.lit(0))
    apply_status = F.when(t % 4 == 3, F.lit("skipped_plan_only")).when((plan_exit == 0) & (t % 2 == 0), F.lit("success")).otherwise(F.lit("failed"))
    return f.join(cv, ["conv_id", "turn"]).select(
        "conv_id", "turn",
        F.timestamp_seconds(F.lit(1_700_000_000) + c * 60 + t).alias("evaluated_at"),
        (c % 7 * 0.5).cast("double").alias("plan_seconds"),
        F.when(c % 2 == 0, F.concat(F.lit('{"z": 1, "model": {"b": [2, "x"], "a": '), (c % 4).cast("string"), F.lit("}}"))).alias("config"),
        F.when(t % 2 == 0, F.lit("http://host/v1")).alias("base_url"),
        F.concat(F.substring(F.lit("CRUD"), (c % 4 + 1).cast("int"), 1), F.lit("1."), (t % 3 + 1).cast("string")).alias("task_id"),
        F.when(c % 4 == 0, F.lit("CREATE")).when(c % 4 == 1, F.lit("READ")).when(c % 4 == 2, F.lit("UPDATE")).otherwise(F.lit("DELETE")).alias("category"),
        F.when(c % 2 == 0, F.lit("detailed")).otherwise(F.lit("brief")).alias("prompt_type"),
        prompt.alias("prompt"),
        reqs.alias("resource_requirements"),
        F.when(t % 3 != 0, hcl).otherwise(extract_code("response")).alias("code"),
        F.concat(F.col("text"), F.when(c % 11 == 0, F.lit("\nTry 2 VMs with 4 GB instead. password: hunter2")).otherwise(F.lit(""))).alias("raw_response"),
        F.lit("m0").alias("model_short"),
        (t + 1).alias("sample_num"),
        F.when(c % 3 == 0, F.lit("COT")).otherwise(F.lit("")).alias("strategy"),
        F.lit(0).alias("init_exit"),
        F.when(c % 7 == 0, F.lit(1)).otherwise(F.lit(0)).alias("validate_exit"),
        plan_exit.alias("plan_exit"),
        F.concat(F.lit("Plan: "), vms.cast("string"), F.lit(" to add, 0 to change, "), (t % 2).cast("string"), F.lit(" to destroy.")).alias("plan_stdout"),
        F.when(plan_exit != 0, F.lit("Error: plan failed")).alias("plan_stderr"),
        F.when(apply_status == "success", F.lit(0)).otherwise(F.lit(1)).alias("apply_exit"),
        apply_status.alias("apply_status"),
        F.when(apply_status == "failed", F.lit("Error: insufficient memory")).alias("apply_stderr"),
        F.when(t % 3 == 0, F.lit(None).cast("boolean")).otherwise(c % 2 == 0).alias("spec_passed"),
        (t % 3 + 1).cast("int").alias("iterations"),
        (F.length("text") / F.lit(100.0)).alias("generation_time"),
        (c % 11 == 0).alias("expected_failure_matched"),
        F.when(F.substring(F.lit("CRUD"), (c % 4 + 1).cast("int"), 1).isin("U", "D"), c % 3 != 0).alias("post_passed"),
        F.array(F.struct(
            F.concat(F.lit("vm-"), c.cast("string")).alias("name"), F.concat(F.lit("u-"), c.cast("string")).alias("uuid"),
            F.when(t % 2 == 0, F.lit("10.0.0.1")).otherwise(F.lit("unknown")).alias("ip"),
            F.lit("Running").alias("status"), (c % 4 + 1).cast("int").alias("cpus"),
            gb.cast("double").alias("ram_gb"), F.lit(20.0).alias("disk_gb"),
        )).alias("vm_details"),
        F.when(c % 8 == 2, F.array(F.struct(
            F.concat(F.lit("vm-"), c.cast("string")).alias("name"), F.concat(F.lit("u-"), c.cast("string")).alias("uuid"),
            F.lit("10.0.0.9").alias("ip"), F.lit("Running").alias("status"), F.lit(1).alias("cpus"),
            F.lit(1.0).alias("ram_gb"), F.lit(20.0).alias("disk_gb"),
        ))).otherwise(F.array().cast(
            "array<struct<name:string,uuid:string,ip:string,status:string,cpus:int,ram_gb:double,disk_gb:double>>"
        )).alias("pre_vm_details"),
        F.lit(None).cast("double").alias("usable_ram_gb"),
    )


def samples_stream(spark: SparkSession, sf: str) -> DataFrame:
    """B1 as a stream: the events table (a file or a folder of files) read by the file-stream source."""
    schema = read_table(spark, sf, "events").schema
    # a pattern, since the source takes a plain path for a folder
    ev = spark.readStream.schema(schema).parquet(f"{sf.rstrip('/')}/events.parque[t]")
    et = F.col("event_type")
    return ev.select(
        F.concat(F.col("user_id").cast("string"), F.lit("_"), F.to_date("ts").cast("string")).alias("task_id"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        (et != F.lit("error")).alias("plan_ok"),
        et.isin("purchase", "click", "signup").alias("apply_ok"),
        F.when(et == "purchase", F.lit(True)).when(et == "view", F.lit(None).cast("boolean"))
        .otherwise(F.lit(False)).alias("spec_ok"),
    )


def deliveries(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """B1 in two deliveries with a ``run_no``: first every sample, those of every third event under
    another task and with other outcomes; then these once more as a second run with B1's own values,
    and the next third's rows again without a run number."""
    s = samples(spark, sf).select("event_id", "task_id", "plan_ok", "apply_ok", "spec_ok")
    third, rerun = F.col("event_id") % 3, F.col("event_id") % 3 == 0
    first = s.select(
        "event_id", F.when(rerun, F.concat(F.lit("old_"), "task_id")).otherwise(F.col("task_id")).alias("task_id"),
        *[F.when(rerun, ~F.coalesce(c, F.lit(False))).otherwise(F.col(c)).alias(c) for c in ("plan_ok", "apply_ok", "spec_ok")],
        F.lit(1).alias("run_no"),
    )
    stale = s.where(third == 1).select("event_id", F.lit("stale").alias("task_id"), *[F.lit(True).alias(c) for c in ("plan_ok", "apply_ok", "spec_ok")],
                                       F.lit(None).cast("int").alias("run_no"))
    return {"first": first, "second": s.where(rerun).withColumn("run_no", F.lit(2)).unionByName(stale)}


# ---------------------------------------------------------------- state documents
def state_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One state document per customer, shaped like a state file: a pool data
    source (nation), a template data source with no identifier fields, the
    customer as a managed VM, and a managed network. Attributes are JSON text."""
    c = read_table(spark, sf, "customer")
    n = read_table(spark, sf, "nation")
    k = F.col("c_custkey")
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    pool = F.to_json(F.struct(
        F.concat(F.lit("pool-"), F.col("n_regionkey").cast("string")).alias("id"),
        F.col("n_name").alias("name_label"),
        F.struct(((F.col("c_nationkey") % 8) + 1).cast("string").alias("cores")).alias("cpus"),
        F.when(k % 2 == 0, F.concat(F.lit("host-"), F.col("n_nationkey").cast("string"))).alias("master"),
        F.lit("x").alias("other"),
    ))
    template = F.to_json(F.struct(F.lit("Ubuntu template").alias("description")))
    vm = F.to_json(F.struct(
        F.concat(F.lit("vm-"), k.cast("string")).alias("id"),
        F.col("c_name").alias("name_label"),
        (k % 8 + 1).alias("cpus"),
        F.when(F.col("c_acctbal") > 0, (k % 16 + 1) * F.lit(1 << 28)).alias("memory_max"),
        F.lit("Running").alias("power_state"),
        F.array(F.concat(F.lit("seg-"), F.col("c_mktsegment"))).alias("tags"),
        F.lit("ignored").alias("extra"),
    ))
    net = F.to_json(F.struct(F.lit("net-1").alias("id")))

    def res(mode, typ, attrs):
        return F.struct(F.lit(mode).alias("mode"), F.lit(typ).alias("type"), F.lit("r").alias("name"),
                        F.array(F.struct(F.lit(0).cast("long").alias("schema_version"), attrs.alias("attributes"))).alias("instances"))

    return j.select(
        k.alias("state_id"),
        F.array(res("data", "xenorchestra_pool", pool), res("data", "xenorchestra_template", template),
                res("managed", "xenorchestra_vm", vm), res("managed", "xenorchestra_network", net)).alias("resources"),
    )


# ---------------------------------------------------------------- references
def task_references(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Task rows with a CSV reference column and a reference-file table.

    Tasks are the benchmark items; the CSV column holds the item's text for
    even items, 'nan' for items % 3 = 1 and is empty otherwise; reference files
    exist for items % 4 != 3 and hold the HCL block of the part with the same key.
    """
    t = bench_tasks(spark, sf)
    i = F.col("item_id")
    tasks = t.select(
        "item_id", "task_id", "category",
        F.when(i % 2 == 0, F.col("prompt")).when(i % 3 == 1, F.lit("nan")).otherwise(F.lit("")).alias("reference_hcl"),
    )
    frags = hcl_fragments(spark, sf)
    files = frags.join(t.select("item_id", "task_id"), F.col("frag_pos") == F.col("item_id")).filter(
        F.col("item_id") % 4 != 3).select("item_id", F.col("hcl"))
    return tasks, files


def state_json(spark: SparkSession, sf: str) -> DataFrame:
    """The per-customer state documents as JSON text (attributes nested as objects), each
    wrapped in ``key % 4`` times four further levels, so depths differ between documents."""
    c = read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    pool = F.to_json(F.struct(
        F.struct(((F.col("c_nationkey") % 8) + 1).cast("string").alias("cores")).alias("cpus"),
        F.concat(F.lit("pool-"), F.col("c_nationkey").cast("string")).alias("id"),
    ))
    vm = F.to_json(F.struct((k % 8 + 1).alias("cpus"), F.col("c_name").alias("name_label")))
    doc = F.concat(
        F.lit('{"version": 4, "resources": [{"mode": "data", "type": "xenorchestra_pool", "instances": [{"attributes": '),
        pool,
        F.lit('}]}, {"mode": "managed", "type": "xenorchestra_vm", "instances": [{"attributes": '),
        vm,
        F.lit("}]}]}"),
    )
    deep = (k % 4 * 4).cast("int")
    doc = F.concat(F.repeat(F.lit('{"n":'), deep), doc, F.repeat(F.lit("}"), deep))
    return c.select(k.alias("state_id"), doc.alias("doc"))


# ---------------------------------------------------------------- B16 report inputs
def report_samples(spark: SparkSession, sf: str):
    """Samples, references and token vectors of a metrics report: every conversation
    turn is a sample of one of seven tasks; tasks 0-5 have a reference (their first
    turn's text). A group is four vectors with consecutive ids: the candidate vectors of
    a conversation's samples are the group with its number, the reference vectors of a task
    the group with the task's number. A conversation beyond the vectors has none."""
    c, t = F.col("conv_id"), F.col("turn")
    task = F.concat(F.lit("T"), (c % 7).cast("string"))
    s = read_table(spark, sf, "conversations").select(
        F.concat(c.cast("string"), F.lit("_"), t.cast("string")).alias("file"), task.alias("task_id"),
        F.coalesce("text", F.lit("")).alias("code"),
        (t % 2 == 0).alias("plan_ok"), (t % 3 == 0).alias("apply_ok"), F.when(c % 3 != 0, t % 3 == 0).alias("spec_ok"),
        (t % 3 + 1).alias("iterations"), t.cast("double").alias("gen_s"),
        c.alias("_cand"), (c % 7).alias("_ref"), F.struct(c, t).alias("_at"),
    )
    refs = s.filter("task_id <> 'T6'").groupBy("task_id").agg(F.min_by("code", "_at").alias("reference"))
    e = read_table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("g"), F.col("vec_id").alias("tok_id"), F.col("embedding").alias("vec"))
    side = lambda name, col: s.join(e, F.col(col) == F.col("g")).select("file", F.lit(name).alias("side"), "tok_id", "vec")
    return s.drop("_cand", "_ref", "_at"), refs, side("cand", "_cand").unionByName(side("ref", "_ref"))
