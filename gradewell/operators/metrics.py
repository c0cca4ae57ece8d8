"""Result analytics: per-task counts, pass@k, macro averages, breakdowns.

Input contract ("samples" table): one row per evaluated sample with
``task_id``, ``plan_ok``, ``apply_ok``, ``spec_ok`` (nullable booleans),
``iterations``, ``gen_s`` and optional score columns ``bleu`` / ``f1``.

Scale: every aggregate is a plain hash aggregate, so Spark runs a map-side
partial aggregation before the shuffle. A task holding a third of all rows
collapses to one partial row per map task, so hot tasks need no salting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.passk import K_VALUES, pass_at_k

METRICS = ("plan", "apply", "spec")


def truthy(c: Column | str) -> Column:
    """Reference truthiness for counting: null counts as a failure."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(False))


def with_defaults(samples: DataFrame) -> DataFrame:
    """P1 defaults: iterations 1 and generation time 0 when absent."""
    return samples.withColumn("iterations", F.coalesce(F.col("iterations"), F.lit(1))).withColumn(
        "gen_s", F.coalesce(F.col("gen_s").cast("double"), F.lit(0.0))
    )


def task_counts(samples: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """A1: n and number of truthy plan/apply/spec per group."""
    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(truthy(f"{m}_ok")).alias(f"c_{m}") for m in METRICS],
    )


def pass_at_k_table(
    samples: DataFrame, keys: Sequence[str] = ("task_id",), ks: Sequence[int] = K_VALUES
) -> DataFrame:
    """A1 + A2: counts and pass@k for every metric and k, one row per group."""
    counts = task_counts(samples, keys)
    cols = [
        pass_at_k("n", f"c_{m}", k).alias(f"pass{k}_{m}") for m in METRICS for k in ks
    ]
    return counts.select(*keys, "n", *[f"c_{m}" for m in METRICS], *cols)


def macro_average(
    per_task: DataFrame, group_keys: Sequence[str] = (), ks: Sequence[int] = K_VALUES
) -> DataFrame:
    """A3: average pass@k over groups that have at least k samples; null (N/A) if none."""
    aggs = [
        F.avg(F.when(F.col("n") >= k, F.col(f"pass{k}_{m}"))).alias(f"pass{k}_{m}")
        for m in METRICS
        for k in ks
    ]
    aggs.append(F.count(F.lit(1)).alias("unique_tasks"))
    if group_keys:
        return per_task.groupBy(*group_keys).agg(*aggs)
    return per_task.agg(*aggs)


def global_summary(
    samples: DataFrame, ks: Sequence[int] = K_VALUES, group_keys: Sequence[str] = ()
) -> DataFrame:
    """A3 + A4 + A5: one summary row over all samples (or per ``group_keys``).

    Per-task partial sums are computed once; the summary is a single aggregate
    over the per-task rows (totals are sums of per-task sums), so the whole
    report is two hash aggregates and no join.
    """
    s = with_defaults(samples)
    extra = [c for c in ("bleu", "f1") if c in s.columns]
    keys = list(group_keys)
    per_task = s.groupBy(*keys, "task_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(truthy(f"{m}_ok")).alias(f"c_{m}") for m in METRICS],
        F.sum("iterations").alias("_it"),
        F.sum("gen_s").alias("_gs"),
        *[F.sum(c).alias(f"_s_{c}") for c in extra],
        *[F.count(c).alias(f"_n_{c}") for c in extra],
    )
    per_task = per_task.select(
        "*", *[pass_at_k("n", f"c_{m}", k).alias(f"pass{k}_{m}") for m in METRICS for k in ks]
    )
    final = per_task.groupBy(*keys) if keys else per_task
    return final.agg(
        F.sum("n").alias("total_samples"),
        (F.sum("_it") / F.sum("n")).alias("avg_iterations"),
        (F.sum("_gs") / F.sum("n")).alias("avg_gen_s"),
        *[(F.sum(f"_s_{c}") / F.sum(f"_n_{c}")).alias(f"avg_{c}") for c in extra],
        *[
            F.avg(F.when(F.col("n") >= k, F.col(f"pass{k}_{m}"))).alias(f"pass{k}_{m}")
            for m in METRICS
            for k in ks
        ],
        F.count(F.lit(1)).alias("unique_tasks"),
    )


def per_task_breakdown(samples: DataFrame) -> DataFrame:
    """Per task n, plan %, spec % (spec counted only when exactly true), averages."""
    s = with_defaults(samples)
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg(truthy("plan_ok").cast("double")).alias("plan_pct"),
        F.avg(F.coalesce(F.col("spec_ok") == F.lit(True), F.lit(False)).cast("double")).alias(
            "spec_pct"
        ),
        F.avg("iterations").alias("avg_iterations"),
    ]
    if "bleu" in s.columns:
        aggs.append(F.avg("bleu").alias("avg_bleu"))
    if "f1" in s.columns:
        aggs.append(F.avg("f1").alias("avg_f1"))
    return s.groupBy("task_id").agg(*aggs)


def per_experiment(samples: DataFrame, experiment_keys: Sequence[str]) -> DataFrame:
    """The summary metrics per experiment (model folder x strategy)."""
    return global_summary(samples, K_VALUES, experiment_keys)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their multiplicity."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
