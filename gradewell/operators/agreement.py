"""Agreement analytics: judge vs rule checker (A8-A10, P19, P20, J8) and
results vs ground truth (J5, W6, A12, P20).

All outputs are tables. The reference prints lists of disagreeing tasks; here
they stay rows (kind, id), so no list ever grows inside one row or task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parse_verdict, strip_ws

VALID_VERDICTS = ("Correct", "Incorrect")


def with_verdict(
    df: DataFrame, text_col: str = "judge_text", code_col: str | None = None
) -> DataFrame:
    """F16 per row; with ``code_col``, blank code gets verdict ``Skip``."""
    v = parse_verdict(F.col(text_col))
    if code_col is not None:
        v = F.when(F.coalesce(strip_ws(F.col(code_col)), F.lit("")) == "", F.lit("Skip")).otherwise(v)
    return df.withColumn("verdict", v)


def is_valid(verdict: Column | str = "verdict", spec: Column | str = "spec_passed") -> Column:
    """Verdict is Correct/Incorrect and the spec result is known."""
    verdict = F.col(verdict) if isinstance(verdict, str) else verdict
    spec = F.col(spec) if isinstance(spec, str) else spec
    return verdict.isin(*VALID_VERDICTS) & spec.isNotNull()


def judge_agrees(verdict: Column | str = "verdict", spec: Column | str = "spec_passed") -> Column:
    """P20: judge (Correct = true) equals the rule result; null when not valid."""
    verdict = F.col(verdict) if isinstance(verdict, str) else verdict
    spec = F.col(spec) if isinstance(spec, str) else spec
    return F.when(is_valid(verdict, spec), (verdict == F.lit("Correct")) == spec)


def confusion(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A8 + A9: TP/FP/FN/TN with judge = truth and rule = prediction; ratios 0 on 0/0."""
    v = df.filter(is_valid())
    judge_ok = F.col("verdict") == "Correct"
    spec = F.col("spec_passed")
    aggs = [
        F.count_if(judge_ok & spec).alias("tp"),
        F.count_if(~judge_ok & spec).alias("fp"),
        F.count_if(judge_ok & ~spec).alias("fn"),
        F.count_if(~judge_ok & ~spec).alias("tn"),
        F.count(F.lit(1)).alias("n_valid"),
    ]
    counts = v.groupBy(*keys).agg(*aggs) if keys else v.agg(*aggs)

    def ratio(num, den):
        return F.when(den > 0, num / den).otherwise(F.lit(0.0))

    p = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    acc = ratio(F.col("tp") + F.col("tn"), F.col("n_valid"))
    out = counts.select(*keys, "tp", "fp", "fn", "tn", "n_valid", p.alias("precision"),
                        r.alias("recall"), acc.alias("accuracy"))
    f1 = ratio(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", f1)


def disagreements(df: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """A10: too lenient (FP: spec passed, judge says wrong) and too strict (FN) rows."""
    v = df.filter(is_valid())
    judge_ok = F.col("verdict") == "Correct"
    kind = (
        F.when(~judge_ok & F.col("spec_passed"), F.lit("too_lenient"))
        .when(judge_ok & ~F.col("spec_passed"), F.lit("too_strict"))
    )
    return v.select(kind.alias("kind"), *id_cols).filter(F.col("kind").isNotNull())


def skip_existing(
    candidates: DataFrame, existing: DataFrame, key: str, judge
) -> DataFrame:
    """Judge only rows without a stored verdict; keep stored verdicts in the result.

    ``judge`` maps the work list to rows with a ``verdict`` column.
    """
    work = candidates.join(existing.select(key), key, "left_anti")
    fresh = judge(work).withColumn("source", F.lit("judged"))
    old = existing.withColumn("source", F.lit("existing"))
    return fresh.unionByName(old, allowMissingColumns=True)


# ------------------------------------------------------------- ground truth
def first_per_group(df: DataFrame, key: str, order_cols: Sequence[str]) -> DataFrame:
    """The first row per key by a total order (min_by keeps it one aggregate)."""
    others = [c for c in df.columns if c != key]
    order = F.struct(*[F.col(c) for c in order_cols])
    return df.groupBy(key).agg(
        F.min_by(F.struct(*[F.col(c) for c in others]), order).alias("_first")
    ).select(key, "_first.*")


def compare_with_ground_truth(results: DataFrame, truth: DataFrame, key: str = "task_id") -> DataFrame:
    """J5 + P20: each result against the ground-truth row of its task.

    Flags compare plan/apply/spec; spec compares null-safely (None == None).
    """
    gt = truth.select(
        key,
        F.col("plan_ok").alias("gt_plan"),
        F.col("apply_ok").alias("gt_apply"),
        F.col("spec_ok").alias("gt_spec"),
        F.col("iterations").alias("gt_iterations"),
    )
    j = results.join(gt, key)
    return j.select(
        *results.columns,
        "gt_plan",
        "gt_apply",
        "gt_spec",
        "gt_iterations",
        (F.col("plan_ok") == F.col("gt_plan")).alias("plan_match"),
        (F.col("apply_ok") == F.col("gt_apply")).alias("apply_match"),
        F.col("spec_ok").eqNullSafe(F.col("gt_spec")).alias("spec_match"),
    )


def ground_truth_summary(compared: DataFrame) -> DataFrame:
    """Agreement totals and percentages; average BLEU is 0 when none."""
    aggs = [
        F.count(F.lit(1)).alias("total"),
        F.count_if("plan_match").alias("plan_matches"),
        F.count_if("apply_match").alias("apply_matches"),
        F.count_if("spec_match").alias("spec_matches"),
    ]
    if "bleu" in compared.columns:
        aggs.append(F.coalesce(F.avg("bleu"), F.lit(0.0)).alias("avg_bleu"))
    if "f1" in compared.columns:
        aggs.append(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("avg_f1"))
    s = compared.agg(*aggs)
    pct = lambda c: (F.lit(100.0) * F.col(c) / F.col("total"))
    return s.select(
        "*",
        pct("plan_matches").alias("plan_pct"),
        pct("apply_matches").alias("apply_pct"),
        pct("spec_matches").alias("spec_pct"),
    )


def agreement_band(pct: Column | str) -> Column:
    """interpretation band for an agreement percentage."""
    p = F.col(pct) if isinstance(pct, str) else pct
    return F.when(p > 80, F.lit("high")).when(p >= 50, F.lit("moderate")).otherwise(F.lit("low"))


def bleu_band(score: Column | str) -> Column:
    """interpretation band for a BLEU score."""
    s = F.col(score) if isinstance(score, str) else score
    return (
        F.when(s >= 0.9, F.lit("excellent"))
        .when(s >= 0.7, F.lit("good"))
        .when(s >= 0.5, F.lit("fair"))
        .otherwise(F.lit("poor"))
    )
