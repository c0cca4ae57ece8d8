"""After-state verification on hand-made snapshots."""

from gradewell.operators.post_state import verify_post_state

VM = "task_id int, name string, uuid string, cpus int, ram_gb double, seq int"
SPEC = "task_id int, category string, target_vm string, target_vms array<string>, updated_field string, new_value bigint"


def run(spark, pre, post, specs):
    r = verify_post_state(spark.createDataFrame(pre, VM), spark.createDataFrame(post, VM),
                          spark.createDataFrame(specs, SPEC), order_col="seq")
    return {x.task_id: x for x in r.collect()}


def test_update_checks(spark):
    pre = [(1, "app", "u1", 2, 2.0, 0), (1, "db", "u2", 2, 2.0, 1), (2, "app", "u3", 2, 2.0, 0)]
    post = [(1, "app", "u1", 2, 2.0, 0), (1, "app", "u1", 4, 4.0, 1), (1, "db", "u2", 2, 2.0, 2),  # last 'app' wins
            (2, "app", "r3", 2, 2.0, 0)]
    specs = [(1, "UPDATE", "app", None, "cpus", 4), (2, "UPDATE", "app", None, "memory_max", 4 << 30)]
    r = run(spark, pre, post, specs)
    assert r[1].errors == ["POST-STATE ERROR: VM count changed during UPDATE."]  # 2 before, 3 after
    assert r[2].errors == [
        "POST-STATE ERROR: VM 'app' memory_max is 2147483648, expected 4294967296.",
        "POST-STATE ERROR: VM 'app' UUID changed (replace instead of in-place update).",
    ]


def test_update_target_missing_and_delete(spark):
    pre = [(1, "app", "u1", 2, 2.0, 0), (2, "a", "u", 1, 1.0, 0), (2, "b", "v", 1, 1.0, 1)]
    post = [(1, "web", "u9", 2, 2.0, 0), (2, "b", "v", 1, 1.0, 0)]
    specs = [(1, "UPDATE", "app", None, "cpus", 4), (2, "DELETE", "b", [], None, None), (3, "READ", None, None, None, None)]
    r = run(spark, pre, post, specs)
    assert r[1].errors == ["POST-STATE ERROR: Target VM 'app' not found after UPDATE."]
    # an empty target list falls back to the single target
    assert r[2].errors == ["POST-STATE ERROR: VM 'b' still exists."] and r[3].passed is True
