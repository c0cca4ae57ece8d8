"""Complexity scoring of reference HCL (V11: F8-F11, F14, F15, A11, A18, U4, T2, P14).

Two entry points:
* ``score_texts`` - one row per whole text (a task table with an HCL column).
* ``score_fragments`` - a document stored as rows of blocks (joined by newline
  in block order). Every metric is a sum or a distinct set over blocks, so the
  document is scored without ever being assembled into one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.outcome import code_flags

SETTING_KEYS = ("cpus", "memory_max", "size")


def _metrics(text_col: str, mode: str = "reference") -> list:
    t = F.col(text_col)
    return [
        T.nonblank_lines(t).alias("loc"),
        T.resource_count(t).alias("resources"),
        T.interconnections(t).alias("interconnections"),
        T.block_types(t).alias("resource_types"),
        *[T.setting_total(t, k, mode).alias(f"total_{k}") for k in SETTING_KEYS],
    ]


def score_texts(df: DataFrame, text_col: str, mode: str = "reference") -> DataFrame:
    """Per row: loc, resources, interconnections, level, types, setting totals.

    Rows with a blank text pass through with null metrics (unscored).
    """
    blank = F.coalesce(T.strip_ws(F.col(text_col)), F.lit("")) == ""
    m = df.select("*", *_metrics(text_col, mode))
    level = T.difficulty("loc", "resources", "interconnections")
    out = m.withColumn("level", level)
    for c in ("loc", "resources", "interconnections", "level", "resource_types",
              *[f"total_{k}" for k in SETTING_KEYS]):
        out = out.withColumn(c, F.when(~blank, F.col(c)))
    return out


def score_fragments(frags: DataFrame, doc_col: str, text_col: str, mode: str = "reference") -> DataFrame:
    """Per document: the same metrics, aggregated over its block rows."""
    m = frags.select(doc_col, *_metrics(text_col, mode), code_flags(text_col).alias("_flags"))
    agg = m.groupBy(doc_col).agg(
        F.sum("loc").alias("loc"),
        F.sum("resources").alias("resources"),
        F.sum("interconnections").alias("interconnections"),
        *[F.sum(f"total_{k}").alias(f"total_{k}") for k in SETTING_KEYS],
        F.max("_flags.provider_config_included").alias("provider_config_included"),
        F.max("_flags.vm_resource_defined").alias("vm_resource_defined"),
    )
    # types are exploded and de-duplicated map-side; a document's set is bounded by the type vocabulary
    types = m.select(doc_col, F.explode("resource_types").alias("t")).groupBy(doc_col).agg(
        F.array_sort(F.collect_set("t")).alias("resource_types"))
    joined = agg.join(types, doc_col, "left")
    none = F.array().cast("array<string>")
    joined = joined.withColumn("resource_types", F.coalesce("resource_types", none))
    return joined.withColumn("level", T.difficulty("loc", "resources", "interconnections"))


def type_distribution(scored: DataFrame, doc_col: str) -> DataFrame:
    """A11 + T2: number of scored documents per resource type (sort by n_tasks
    descending, then type, for the report order)."""
    return (
        scored.filter(F.col("level").isNotNull())
        .select(doc_col, F.explode("resource_types").alias("resource_type"))
        .groupBy("resource_type")
        .agg(F.count_distinct(doc_col).alias("n_tasks"))
        .select("resource_type", "n_tasks", T.text_bar("n_tasks").alias("bar"))
    )


def scoring_summary(scored: DataFrame) -> DataFrame:
    """S10 header: documents with a level (``total_tasks_scored``) and level mix."""
    return scored.agg(
        F.count_if(F.col("level").isNotNull()).alias("total_tasks_scored"),
        F.count(F.lit(1)).alias("total_tasks"),
        *[F.count_if(F.col("level") == str(i)).alias(f"n_level_{i}") for i in range(1, 7)],
    )
