"""VM inventory from an object graph.

Objects come as three typed tables (VMs, block devices, disk images) linked
by id; the graph has fixed depth 2, so two equi-joins and one aggregate do
what the reference does with dict lookups. Dangling links are dropped by the
left join; control domains are excluded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.outcome import bytes_to_gb, first_address
from ..session import scratch_dir


def cpu_count(cpus_json: Column | str) -> Column:
    """``CPUs`` is either ``{"number": n}`` or a bare number."""
    v = F.try_parse_json(F.col(cpus_json) if isinstance(cpus_json, str) else cpus_json)
    return F.coalesce(F.try_variant_get(v, "$.number", "int"), F.try_variant_get(v, "$", "int"), F.lit(0))


def memory_bytes(memory_json: Column | str) -> Column:
    """``memory.static[1]``, else ``memory.size``, else a bare number, else 0."""
    v = F.try_parse_json(F.col(memory_json) if isinstance(memory_json, str) else memory_json)
    return F.coalesce(
        F.try_variant_get(v, "$.static[1]", "long"),
        F.try_variant_get(v, "$.size", "long"),
        F.try_variant_get(v, "$", "long"),
        F.lit(0).cast("long"),
    )


def vm_inventory(vms: DataFrame, vbds: DataFrame, vdis: DataFrame) -> DataFrame:
    """One row per (non control-domain) VM with disk bytes summed over its links.

    vms:  vm_id, host_id, name_label, power_state, is_control_domain, cpus_json, memory_json, addresses
    vbds: vbd_id, vm_id, vdi_id      (the VM's VBD list, already exploded)
    vdis: vdi_id, size
    """
    disks = (
        vbds.join(vdis, "vdi_id", "inner")  # dangling VDI links contribute nothing
        .groupBy("vm_id")
        .agg(F.sum("size").alias("disk_bytes"))
    )
    v = vms.filter(~F.coalesce(F.col("is_control_domain"), F.lit(False)))
    j = v.join(disks, "vm_id", "left")
    ram = memory_bytes("memory_json")
    disk = F.coalesce(F.col("disk_bytes"), F.lit(0).cast("long"))
    return j.select(
        "host_id",
        "vm_id",
        F.col("name_label").alias("name"),
        F.col("vm_id").alias("uuid"),
        first_address("addresses").alias("ip"),
        F.coalesce(F.col("power_state"), F.lit("unknown")).alias("status"),
        cpu_count("cpus_json").alias("cpus"),
        ram.alias("ram_bytes"),
        disk.alias("disk_bytes"),
        bytes_to_gb(ram).alias("ram_gb"),
        bytes_to_gb(disk).alias("disk_gb"),
    )


def host_snapshot(inventory: DataFrame, host_col: str = "host_id") -> DataFrame:
    """Per host VM count, presence, all running (true for an empty host), totals."""
    return inventory.groupBy(host_col).agg(
        F.count(F.lit(1)).alias("actual_vm_count"),
        (F.count(F.lit(1)) > 0).alias("vms_exist"),
        F.coalesce(F.bool_and(F.coalesce(F.col("status") == "Running", F.lit(False))), F.lit(True)).alias("all_vms_running"),
        F.sum("disk_bytes").alias("total_disk_bytes"),
        F.sum("ram_bytes").alias("total_ram_bytes"),
        F.sum("cpus").alias("total_cpus"),
    )


#: Levels that one chain of lateral joins goes down; a deeper document goes on from a written table.
CHAIN = 32


def json_depth(doc: Column) -> Column:
    """How many objects and arrays a JSON text opens inside one another."""
    unescaped = F.regexp_replace(doc, r"\\\\.", "")
    brackets = F.regexp_replace(F.regexp_replace(unescaped, '"[^"]*"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.split(brackets, ""), start, step)["most"]


def _descended(rows: DataFrame, key: str) -> DataFrame:
    """One level down: hits stay as they are, an open value gives its hits and its nested values."""
    spark = rows.sparkSession
    ex = rows.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()))
    # the columns of the function are named pos, key and value
    kind = F.schema_of_variant("value")
    nested = F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
    below = F.concat("path", F.array(F.col("pos").cast("int")))
    nothing, no_hit = F.lit(None).cast("variant"), F.lit(None).cast("string")
    out = F.array_compact(F.array(
        F.when(F.col("hit").isNotNull(), F.struct("path", "hit", nothing.alias("v"))),
        F.when(F.col("value").isNotNull() & (F.col("key") == key), F.struct(below.alias("path"), F.to_json("value").alias("hit"), nothing.alias("v"))),
        F.when(F.col("value").isNotNull() & nested, F.struct(below.alias("path"), no_hit.alias("hit"), F.col("value").alias("v"))),
    ))
    return ex.select("_id", F.inline(out))


def find_key_values(docs: DataFrame, id_col: str, json_col: str, key: str) -> DataFrame:
    """every value stored under ``key`` at any depth of a JSON document.

    Documents are parsed to variant and unnested one level per step with
    ``variant_explode_outer`` (a lateral table function). The steps form one chain, as
    many as the deepest document needs (one aggregate over the texts tells): finished
    hits travel on beside the subtrees that are still open, so a document is read once,
    in one job, however deep it is. The documents are first dealt evenly over all tasks. Only documents deeper than ``CHAIN`` levels go on
    from a table written after that many levels. Rows: (id, path of positions, value as
    JSON). No document is gathered anywhere; an unreadable document has no rows.
    """
    spark = docs.sparkSession
    # a document is many times more work than its bytes tell: small files would be one task
    docs = docs.select(id_col, json_col).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).alias("_id"), F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("hit"),
                       F.try_parse_json(json_col).alias("v")).filter(F.col("v").isNotNull())
    levels = docs.where(F.try_parse_json(json_col).isNotNull()).agg(F.max(json_depth(F.col(json_col)))).first()[0] or 0
    for level in range(1, levels + 1):
        rows = _descended(rows, key)
        if level % CHAIN == 0 and level < levels:
            path = scratch_dir(spark, "key-search")
            rows.write.parquet(path)
            rows = spark.read.schema(rows.schema).parquet(path)
    return rows.where("hit IS NOT NULL").select(F.col("_id").alias(id_col), "path", F.col("hit").alias("value"))
