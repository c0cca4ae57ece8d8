"""Sinks (S8-S13). Writers never overwrite their own input: a table is written as
a new version, which readers switch to once it is complete (S9). Re-running an
entry replaces only that entry (S8).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dataset import folder_name


VERSION = re.compile(r"version=(\d+)")


def _listed(spark, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, ([s.getPath() for s in fs.listStatus(where)] if fs.exists(where) else [])


def latest_version(spark, path: str) -> int | None:
    """Number of the newest complete version of a table; a version counts once
    its writer has committed (``_SUCCESS``), which is the switch-over."""
    fs, found = _listed(spark, path)
    done = [int(m[1]) for p in found
            if (m := VERSION.fullmatch(p.getName())) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(done, default=None)


def new_version(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> str:
    """Write a table as a new version beside the old ones, so it may read the
    version it replaces; readers see it when it is complete. Returns its folder."""
    spark = df.sparkSession
    number = max([int(m[1]) for p in _listed(spark, path)[1] if (m := VERSION.fullmatch(p.getName()))], default=0) + 1
    target = f"{path.rstrip('/')}/version={number}"
    df.write.partitionBy(*partition_by).format(fmt).save(target)
    return target


def read_version(spark, path: str, fmt: str = "parquet", schema=None, number: int | None = None) -> DataFrame:
    """The newest complete version, or the one named."""
    number = latest_version(spark, path) if number is None else number
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(f"{path.rstrip('/')}/version={number}")


def write_entries(entries: DataFrame, root: str, folder_col: str = "model_folder",
                  strategy_col: str = "strategy", key: str = "entry_id") -> str:
    """``dataset/version=n/experiment={folder}[_{strategy}]/`` of JSON entries.

    Old and new entries are merged by ``key`` (new wins; the rows of one write stay as
    given) into a new version: re-running one entry replaces that entry and leaves its
    neighbours."""
    spark = entries.sparkSession
    path = f"{root.rstrip('/')}/dataset"
    out = entries.withColumn("experiment", folder_name(folder_col, strategy_col)).drop(folder_col, strategy_col)
    number = latest_version(spark, path)
    if number is not None:
        schema = T.StructType([f for f in out.schema.fields if f.name != "experiment"] + [T.StructField("experiment", T.StringType())])
        old = read_version(spark, path, "json", schema, number)
        new_keys = out.select("experiment", key).distinct()
        out = old.join(new_keys, ["experiment", key], "left_anti").unionByName(out)
    return new_version(out, path, "json", ("experiment",))


def distribution_document(per_type: DataFrame, summary: DataFrame) -> DataFrame:
    """``{total_tasks_scored, resource_type_counts{}}`` as one row. The
    per-type rows and the total are stacked and folded by one aggregate; the map
    is bounded by the resource-type vocabulary."""
    stacked = per_type.select(F.lit(False).alias("_total"), "resource_type", F.col("n_tasks").cast("long").alias("n")).unionByName(
        summary.select(F.lit(True).alias("_total"), F.lit(None).cast("string").alias("resource_type"),
                       F.col("total_tasks_scored").cast("long").alias("n")))
    return stacked.agg(
        F.max(F.when(F.col("_total"), F.col("n"))).alias("total_tasks_scored"),
        F.map_from_entries(F.filter(F.collect_list(F.when(~F.col("_total"), F.struct("resource_type", "n"))),
                                    lambda e: e.isNotNull())).alias("resource_type_counts"),
    )


def with_verdicts(entries: DataFrame, verdicts: DataFrame, key: str = "entry_id") -> DataFrame:
    """Add or replace ``judge_verdict`` from a verdict table (left join, new wins; of
    several verdicts for one entry the greatest by verdict, model and text)."""
    v = verdicts.groupBy(key).agg(F.max(F.struct("verdict", "judge_model", "raw_response")).alias("_new"))
    j = entries.join(v, key, "left")
    old = F.col("judge_verdict") if "judge_verdict" in entries.columns else F.lit(None)
    return j.withColumn("judge_verdict", F.coalesce(F.col("_new"), old)).drop("_new")


ARTIFACT_BUCKETS = 32


def artifact_bucket(task: Column, buckets: int = ARTIFACT_BUCKETS) -> Column:
    """The hash folder that holds a task's artifacts."""
    return F.pmod(F.xxhash64(task), F.lit(buckets)).cast("int")


def write_artifacts(artifacts: DataFrame, path: str, buckets: int = ARTIFACT_BUCKETS, row_group_bytes: int = 16 << 20) -> None:
    """Long table (task_id, sample, iteration, kind, content) in ``buckets``
    hash folders, sorted by task inside a file, so a task is found by its bucket, and in
    it by the bounds and Bloom filters of row groups of about ``row_group_bytes``
    (``readers.read_artifacts``, ``readers.lookup_artifacts``).

    The rebalance sizes the writing tasks by data: a bucket with a hot task is
    split over several writers, small ones are merged. An existing table is replaced."""
    out = artifacts.withColumn("bucket", artifact_bucket(F.col("task_id"), buckets))
    (out.hint("rebalance", "bucket").sortWithinPartitions("bucket", "task_id", "sample", "iteration")
     .write.mode("overwrite").partitionBy("bucket")
     .option("parquet.bloom.filter.enabled#task_id", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
     .option("parquet.block.size", str(row_group_bytes)).parquet(path))


def snapshot_rows(states: DataFrame, label_col: str, content_col: str = "content", key_col: str = "doc_id") -> DataFrame:
    """Keep non-empty snapshots; clean labels (F26); when a label is
    taken, later snapshots get a unique suffix.

    Per label, the snapshot with the smallest (content digest, key) keeps the plain
    name; every other one is suffixed with its whole digest and its key, so names
    don't repeat. This needs only a partial aggregate per label (no window over a
    label, so a label shared by a third of all snapshots is still spread over tasks)."""
    from ..functions.text import clean_label

    s = states.filter(F.coalesce(F.length(content_col), F.lit(0)) > 0).withColumn("label", clean_label(label_col))
    s = s.withColumn("_own", F.struct(F.sha2(F.col(content_col), 256).alias("d"), F.col(key_col).cast("string").alias("k")))
    first = s.groupBy("label").agg(F.min("_own").alias("_first"))
    j = s.join(first, "label")
    suffix = F.when(F.col("_own") != F.col("_first"), F.concat(F.lit("_"), F.col("_own.d"), F.lit("_"), F.col("_own.k"))).otherwise(F.lit(""))
    return j.withColumn(
        "snapshot_name",
        F.concat(F.lit("terraform_tfstate_pre_destroy_"), F.col("label"), suffix, F.lit(".json")),
    ).drop("_own", "_first")


def write_conversations(turns: DataFrame, path: str, key: str = "file") -> None:
    """S7 sink: one conversation per row as an ordered array of role/content
    (a conversation is one document, so its turns are bounded by it)."""
    conv = turns.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))),
                    lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
    conv.write.mode("overwrite").json(path)
