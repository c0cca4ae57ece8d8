"""Physical-plan properties the design relies on (AQE off, so the static plan
is inspected)."""

import re

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL


@pytest.fixture()
def static_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


def test_bleu_shuffles_pair_texts_once(spark, static_plans):
    p = plan(spark, "bleu_pairs")
    ex = re.findall(r"Exchange (\w+)\(([^)]*)\)", p)
    # the self-join of conversations (sort-merge, both sides) and one repartition of pair texts
    assert sum(1 for kind, _ in ex if kind == "hashpartitioning") == 3
    assert "REPARTITION_BY_COL" in p
    assert not re.search(r"Exchange hashpartitioning\([^)]*\bg#", p)  # grams are never shuffled


def test_spec_check_one_shuffle_for_window_and_documents(spark, static_plans):
    p = plan(spark, "spec_check")
    # plan rows once (window, document assembly and the spec join reuse it) + the specs side
    assert len(re.findall(r"Exchange hashpartitioning\((?:plan_id|_spec_key)#\d+L", p)) == 2
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 2


def test_error_tail_uses_group_limit(spark, static_plans):
    assert "WindowGroupLimit" in plan(spark, "error_tail")


def test_running_progress_windows_are_per_block(spark, static_plans):
    p = plan(spark, "running_progress")
    assert re.search(r"windowspecdefinition\(folder#\d+L, _blk#\d+L", p)


def test_scans_are_pruned(spark):
    df = E.queries()["pass_at_k_by_task"](spark, SF_SMALL)
    txt = df._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", txt).group(1)
    assert "props" not in schema and "value" not in schema and "event_type" in schema


def test_post_state_and_extraction_shuffles(spark, static_plans):
    # all joins as sort-merge here (broadcast off): 7; with broadcasts allowed the digest shows 5
    assert len(re.findall(r"Exchange hashpartitioning", plan(spark, "post_state_check"))) <= 7
    assert "Exchange" not in plan(spark, "code_extraction")


def test_nested_plans_are_checked_without_a_shuffle_before_the_spec_join(spark, static_plans):
    p = plan(spark, "plan_samples_spec_check")
    # plans by task id and specs by key; the distinct of the spec binding
    assert len(re.findall(r"Exchange hashpartitioning", p)) <= 3
    assert "Window" not in p and "Generate" not in p and "collect_list" not in p


def test_streams_keep_no_table_on_the_driver(spark):
    import inspect

    from gradewell.streaming import progress

    assert 'format("memory")' not in inspect.getsource(progress)


def test_bleu_by_conversation_partitions_on_the_pair(spark, static_plans):
    p = plan(spark, "bleu_by_conversation")
    assert re.search(r"Exchange hashpartitioning\(conv_id#\d+L, turn#\d+L, \d+\), REPARTITION_BY_COL", p)


def plan_tables(spark, path, orders, lines):
    """orders and lineitem with the columns that the plan samples read; a line is (order, number, flag, part)."""
    spark.createDataFrame([(k,) for k in orders], "o_orderkey bigint").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(
        [(k, p, 3, n, 2.0, 1.0, flag, "F") for k, n, flag, p in lines],
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_returnflag string, l_linestatus string",
    ).selectExpr("*", "timestamp'2020-01-01' AS l_shipdate").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_plan_samples_are_compressed_and_meet_a_small_spec_table_without_a_shuffle(spark, tmp_path):
    import os

    n = 20_000
    sf = plan_tables(spark, tmp_path, range(n), [(k, 1 + k % 5, "ANR"[k % 3], k % 50) for k in range(n)])
    key = "spark.sql.execution.useObjectHashAggregateExec"
    before = spark.conf.get(key)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")  # the specs' table is smaller, orders are not
    try:
        df = E.queries()["plan_samples_spec_check"](spark, sf)
        p = df._jdf.queryExecution().executedPlan().toString()
        rows = sorted(map(str, df.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in p and "Exchange hashpartitioning" not in p
    files = [f.removeprefix("file://") for f in df.inputFiles() if "plan-samples" in f]
    assert files and all(f.endswith(".lz4") for f in files)
    text = spark.read.text(files).selectExpr("sum(length(value) + 1)").first()[0]
    assert sum(map(os.path.getsize, files)) < text / 3
    assert spark.conf.get(key) == before
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(rows) == n and rows == sorted(map(str, E.queries()["plan_samples_spec_check"](spark, sf).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_plan_samples_keep_every_order_and_line(spark, tmp_path):
    import json

    from gradewell.plans import bindings as B

    lines = [(201, 2, "A", 7), (201, 1, "N", 9), (201, 2, None, 8), (202, 7, "R", None), (203, 5, "A", 1), (900, 1, "A", 1), (None, 1, "A", 1)]
    sf = plan_tables(spark, tmp_path, [201, 202, 202, 204, 97, None], lines)
    docs = [r.value for r in B.plan_sample_json(spark, sf).collect()]
    assert len(docs) == 6 and docs.count('{"plan_k') == docs.count("{}") == 1  # cut off; without a key
    read = [json.loads(d) for d in docs if d != '{"plan_k']
    assert sorted(d.get("plan_key", "") for d in read) == ["", "201", "202", "202", "204"]
    of = {d.get("plan_key"): d for d in read}
    assert of["204"]["task_id"] == " T4 " and len(of["204"]["pre_vms"]) == 3 and "resource_changes" not in of["204"]
    changes = of["201"]["resource_changes"]  # in order of line number, then part
    assert [c["address"] for c in changes] == [f"xenorchestra_vm.r_{i}" for i in (1, 2, 3)]
    assert [c["change"]["actions"] for c in changes] == [["create"], ["delete"], ["delete", "create"]]
    assert changes[0]["change"]["after"] == {"name_label": "vm-3", "memory_max": 2 << 26, "cpus": 2, "disk": [{"size": 9 << 24}]}
    assert changes[1]["change"] == {"actions": ["delete"], "before": {"name_label": "vm-3"}}
    # an order that is listed twice has its lines twice, in both of its documents
    assert [[c["address"] for c in d["resource_changes"]] for d in read if d.get("plan_key") == "202"] == [["xenorchestra_vm.r_1"] * 2] * 2
    assert of["202"]["resource_changes"][0]["change"]["after"] == {"memory_max": 2 << 26, "cpus": 2, "disk": [{}]}


def test_plan_samples_collect_finished_lines(spark, static_plans):
    from gradewell.plans import bindings as B

    p = B.plan_sample_json(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    # the lines are shuffled once and made before the aggregate, which would interpret the expression
    assert "collect_list(line#" in p and "collect_list(struct(" not in p
    assert len(re.findall(r"Exchange hashpartitioning\(l_orderkey", p)) == 1
