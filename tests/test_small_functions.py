"""Small column functions and report helpers not covered elsewhere."""

from pyspark.sql import functions as F

from gradewell.functions import outcome as O
from gradewell.operators import dataset as DS
from gradewell.operators import report as RP
from conftest import one


def test_exhaustion_min_content_dependent_context(spark):
    df = spark.createDataFrame(
        [(1, "Error: Insufficient memory on host", "x" * 11, 1, True, "U1.2", ""),
         (0, "out of memory", "{}", 0, True, "u1.2", ""),
         (2, "disk full", None, 2, True, "C1.1", "dataset")],
        "code int, err string, st string, idx int, shared boolean, tid string, strat string")
    r = df.select(O.expected_exhaustion("code", "err").alias("e"), O.min_content("st", 11).alias("m"),
                  O.needs_dependent_context("idx", "shared", "tid", "strat").alias("d")).collect()
    assert [x.e for x in r] == [True, False, False]
    assert [x.m for x in r] == [True, False, False]
    assert [x.d for x in r] == [True, False, False]


def test_action_normalisation_and_plan_counts(spark):
    df = spark.createDataFrame([(["delete", "create"],), (["no-op"],), (["read"],), ([],)], "a array<string>")
    assert [r[0] for r in df.select(O.normalize_action("a")).collect()] == ["replace", "no-op", "read", "unknown"]
    r = one(spark, O.plan_counts(F.col("x")), "Plan: 2 to add, 1 to change, 0 to destroy.")
    assert (r.resources_to_create, r.resources_to_modify, r.resources_to_destroy) == (2, 1, 0)
    r = one(spark, O.plan_counts(F.col("x")), None)
    assert (r.resources_to_create, r.resources_to_destroy) == (0, 0)


def test_resource_normalisation(spark):
    schema = "r struct<count:bigint,memory_max_bytes:bigint,cpus:bigint,size_bytes:bigint,total_memory_max_bytes:bigint,total_cpus:bigint,total_size_bytes:bigint,per_vm_memory_max_bytes:bigint,per_vm_cpus:bigint,per_vm_size_bytes:bigint>, n bigint"
    df = spark.createDataFrame([((3, 6, 5, None, None, None, None, None, None, None), 3),
                                ((1, 4, 2, None, None, None, None, None, None, None), 0)], schema)
    a, b = [r[0] for r in df.select(O.normalized_resources("r", "n")).collect()]
    assert a.total_memory_max_bytes == 6 and a.per_vm_memory_max_bytes == 2 and a.per_vm_cpus == 2  # round(5/3)
    assert b.per_vm_memory_max_bytes == 4 and b.total_memory_max_bytes is None and b.per_vm_cpus == 2


def test_requested_order_last_duplicate_wins(spark):
    df = spark.createDataFrame([("C1.1", 0, "a"), ("c1.3", 1, "b"), ("C1.1", 2, "c"), ("X", 3, "d")],
                               "task_id string, pos int, v string")
    r = RP.in_requested_order(df, ["c1.3", "c1.1"], "pos").collect()
    assert [(x.task_id, x.v) for x in r] == [("c1.3", "b"), ("C1.1", "c")]


def test_prompts(spark):
    df = spark.createDataFrame([("Make a VM", "old code", "SPEC ACCURACY ERRORS: x", ["e1", "e2", "e3"])],
                               "p string, code string, err string, errs array<string>")
    r = df.select(DS.repair_prompt("p", "code", "err").alias("a"), DS.multi_error_prompt("p", "errs").alias("b"),
                  DS.dataset_repair_prompt("p", "errs").alias("c"),
                  DS.build_prompt("p", F.lit("")).alias("d"), DS.build_prompt("p", F.lit("dataset")).alias("e"),
                  DS.system_prompt(F.lit(None), F.lit("base"), F.lit("gen"), F.lit("ds"), F.lit(""), F.lit("ctx")).alias("f"),
                  DS.system_prompt(F.lit("m ctx"), F.lit("base"), F.lit(None), F.lit("ds"), F.lit(""), F.lit("ctx")).alias("g"),
                  ).first()
    assert r.a.endswith("without these below errors:\n\nSPEC ACCURACY ERRORS: x")
    assert "\nError 1:\ne2\n\nError 2:\ne3\n" in r.b and "e1" not in r.b
    assert "ERROR 1:\ne2\n\nERROR 2:\ne3\n\n" in r.c
    assert r.d == "Here is the actual prompt: Make a VM"
    assert r.e.startswith("TASK:\nGenerate the definitive") and "REQUIREMENT:\nMake a VM\n" in r.e
    assert r.f == "base\n\nctx" and r.g == "m ctx"


def test_matrix_and_ids(spark):
    t = spark.createDataFrame([("C1.1", "m", 5)], "task_id string, model_short string, base int")
    m = DS.run_matrix(t, [1, 2], ["", "COT"]).select(
        DS.entry_id("task_id", "model_short", "pass_no", "strategy").alias("e"),
        DS.sample_seed("base", F.col("pass_no") - 1).alias("s")).collect()
    assert sorted(x.e for x in m) == ["c1_1_m_pass1", "c1_1_m_pass1_COT", "c1_1_m_pass2", "c1_1_m_pass2_COT"]
    assert sorted({x.s for x in m}) == [5, 6]


def test_config_hash_is_key_order_independent(spark):
    df = spark.createDataFrame([("m", "v1")], "a string, b string")
    r = df.select(DS.config_hash(model=F.col("a"), version=F.col("b")).alias("x"),
                  DS.config_hash(version=F.col("b"), model=F.col("a")).alias("y")).first()
    assert r.x == r.y and len(r.x) == 16
