"""Command line: run a report as a Spark job and write its tables.

    python -m gradewell.cli metrics  --entries DIR --tasks CSV [--references DIR] --out DIR
    python -m gradewell.cli complexity --tasks CSV [--references DIR] --out DIR
    python -m gradewell.cli check-plans --plans DIR --specs YAML --out DIR
    python -m gradewell.cli sync-references --tasks CSV --references DIR --out DIR

Every output is a directory of Parquet tables (one per report part); nothing
is printed row by row and nothing is collected to the driver.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import report as RP
from .operators import rules as RU
from .session import get_session
from .sources import readers as R


def _write(tables: dict[str, DataFrame], out: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{name}")


def _refs(spark, tasks_df, references):
    if references:
        return RP.references_for_metrics(tasks_df, R.read_references(spark, references))
    return tasks_df.select("task_id", F.coalesce("reference_hcl", F.lit("")).alias("reference"))


def run(argv: list[str] | None = None) -> dict[str, DataFrame]:
    p = argparse.ArgumentParser(prog="gradewell")
    sub = p.add_subparsers(dest="cmd", required=True)
    m = sub.add_parser("metrics")
    m.add_argument("--entries", required=True)
    m.add_argument("--tasks", required=True)
    m.add_argument("--references")
    m.add_argument("--jsonl", action="store_true", help="entries are JSON Lines, not one document per file")
    c = sub.add_parser("complexity")
    c.add_argument("--tasks", required=True)
    c.add_argument("--references")
    k = sub.add_parser("check-plans")
    k.add_argument("--plans", required=True)
    k.add_argument("--specs", required=True)
    k.add_argument("--sample-suffix", default=r"_(?:sample|pass)\d+$",
                   help="pattern cut from a plan file's stem to get its task id (several samples per task)")
    s = sub.add_parser("sync-references")
    s.add_argument("--tasks", required=True)
    s.add_argument("--references", required=True)
    for sp in (m, c, k, s):
        sp.add_argument("--out", required=True)
    a = p.parse_args(argv)

    spark = get_session()
    if a.cmd == "metrics":
        tasks = R.read_tasks(spark, a.tasks)
        samples = R.entry_samples(R.read_entries(spark, a.entries, one_per_file=not a.jsonl))
        summary, per_task, scored = RP.metrics_report(samples, _refs(spark, tasks, a.references))
        tables = {"summary": summary, "per_task": per_task, "samples": scored}
    elif a.cmd == "complexity":
        tasks = R.read_tasks(spark, a.tasks)
        refs = R.read_references(spark, a.references) if a.references else \
            spark.createDataFrame([], "task_id string, hcl string")
        scored, dist, summ = RP.complexity_report(tasks, refs)
        tables = {"tasks": scored, "resource_type_distribution": dist, "summary": summ}
    elif a.cmd == "check-plans":
        plans = R.plan_documents_of(R.read_plans(spark, a.plans))
        stem = F.regexp_extract("plan_id", r"^(.*?)(?:\.json)?$", 1)
        plans = plans.withColumn("plan_id", stem).withColumn("task_id", F.regexp_replace(stem, a.sample_suffix, ""))
        tables = {"spec_accuracy": RU.check_plans(plans, R.read_specs(spark, a.specs), task_col="task_id")}
    else:
        tables = {"tasks": RP.sync_references(R.read_tasks(spark, a.tasks), R.read_references(spark, a.references))}
    _write(tables, a.out)
    return tables


if __name__ == "__main__":
    run(sys.argv[1:])
