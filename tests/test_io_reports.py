"""Readers, sinks and report compositions on small temp folders (the
reference's end-to-end tests use temp folders the same way)."""

import json
import os

from pyspark.sql import functions as F

from gradewell.operators import report as RP
from gradewell.sources import readers as R
from gradewell.sources import sinks as SK

CSV = 'task_id,category,prompt_type,prompt,reference_hcl\nC1.1,CREATE,detailed,"Create a VM\nwith 2 cpu","resource ""x"" ""y"" {}"\n  ,READ,brief,skip,\nU1.2,UPDATE,brief,"Update ram",\n'


def test_tasks_csv_multiline_and_blank_key(spark, tmp_path):
    p = tmp_path / "tasks.csv"
    p.write_text(CSV, encoding="utf-8")
    rows = {r.task_id: r for r in R.read_tasks(spark, str(p)).collect()}
    assert set(rows) == {"C1.1", "U1.2"}
    assert rows["C1.1"].prompt == "Create a VM\nwith 2 cpu"
    assert rows["C1.1"].reference_hcl == 'resource "x" "y" {}'
    assert R.filter_task(R.read_tasks(spark, str(p)), "c1.1").count() == 1


def _entries(tmp_path):
    d = tmp_path / "dataset"
    d.mkdir()
    docs = {
        "a.json": {"task_id": "C1.1", "llm_response": {"generated_code": 'resource "x" "y" {}', "time_to_generate_seconds": 0},
                   "final_outcome": {"execution_successful": True, "total_iterations": 1}, "spec_accuracy": {"passed": True},
                   "entry_id": "c1_1_m_pass1"},
        "b.json": {"task_id": "U1.2", "execution_results": {"terraform_plan": {"status": "success"},
                                                            "terraform_apply": {"status": "success"}},
                   "final_outcome": {"execution_successful": True}, "spec_accuracy": {"passed": None,
                   "checks_performed": ["vm_count", {"check": "x", "passed": True}]}, "entry_id": "u1_2_m_pass1"},
    }
    for name, doc in docs.items():
        (d / name).write_text(json.dumps(doc, indent=2))
    return d


def test_entries_metrics_report(spark, tmp_path):
    d = _entries(tmp_path)
    e = R.read_entries(spark, str(d))
    s = R.entry_samples(e)
    rows = {r.task_id: r for r in s.collect()}
    assert rows["C1.1"].plan_ok is False and rows["C1.1"].apply_ok is False
    assert rows["U1.2"].plan_ok is True and rows["U1.2"].apply_ok is True and rows["U1.2"].spec_ok is None
    assert rows["C1.1"].file == "a.json"
    refs = spark.createDataFrame([("C1.1", 'resource "x" "y" {}')], "task_id string, reference string")
    summary, per_task, scored = RP.metrics_report(s, refs)
    sm = summary.first()
    assert sm.total_samples == 2 and sm.pass3_plan is None
    assert sm.avg_bleu == 1.0  # identical 8-token texts; U1.2 has no reference (null, skipped)
    checks = e.filter(F.col("task_id") == "U1.2").select("spec_accuracy.checks_performed").first()[0]
    assert checks[0] == "vm_count" and json.loads(checks[1]) == {"check": "x", "passed": True}


def test_references_specs_plans(spark, tmp_path):
    refs = tmp_path / "references"
    refs.mkdir()
    (refs / "C1.1.tf").write_text('data "a" "b" {}\n\nresource "c" "d" {}\n')
    r = R.read_references(spark, str(refs)).first()
    assert r.task_id == "C1.1" and r.hcl.startswith("data")
    y = tmp_path / "specs.yaml"
    y.write_text("C1.1:\n  category: CREATE\n  vm_count: 1\n  max_total_ram_gb: 8\n  vm_names: [a, b]\n")
    sp = R.read_specs(spark, str(y)).first()
    assert sp.task_id == "C1.1" and sp.vm_count == 1 and sp.max_total_ram_gb == "8" and sp.vm_names == ["a", "b"]
    plan = {"resource_changes": [{"type": "xenorchestra_vm", "address": "xenorchestra_vm.vm",
                                  "change": {"actions": ["delete"], "before": {"name_label": "legacy-vm"}, "after": None}}]}
    pd = tmp_path / "plans"
    pd.mkdir()
    (pd / "p1.json").write_text(json.dumps(plan))
    (pd / "bad.json").write_text("{not json")
    plans = R.read_plans(spark, str(pd))
    bad = plans.select("plan_id", "resource_changes", "_corrupt_record").collect()
    assert sum(1 for r in bad if r._corrupt_record is not None) == 1
    rows = R.plan_change_rows(plans.filter(F.col("_corrupt_record").isNull())).collect()
    assert rows[0].name_label == "legacy-vm"


def test_states_context(spark, tmp_path):
    state = {"version": 4, "resources": [
        {"mode": "data", "type": "xenorchestra_pool", "name": "p",
         "instances": [{"attributes": {"id": "pool-1", "cpus": {"cores": "8"}, "other": 1}}]},
        {"mode": "managed", "type": "xenorchestra_vm", "name": "vm",
         "instances": [{"attributes": {"id": "vm-1", "cpus": 2, "memory_max": None, "name_label": "web"}}]},
        {"mode": "data", "type": "empty", "name": "e", "instances": [{"attributes": {"zzz": 1}}]},
    ]}
    sd = tmp_path / "states"
    sd.mkdir()
    (sd / "s.json").write_text(json.dumps(state))
    ctx = {r.kind: r.fields for r in R.infra_context(R.read_states(spark, str(sd))).collect()}
    assert set(ctx) == {"data_resources", "managed_vms"}
    assert json.loads(ctx["data_resources"]["cpus"]) == {"cores": "8"}
    assert "memory_max" not in ctx["managed_vms"] and ctx["managed_vms"]["cpus"] == "2"


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([("c1_1_m_pass1", "m", "", "x"), ("c1_1_m_pass1_COT", "m", "COT", "y")],
                              "entry_id string, model_folder string, strategy string, v string")
    root = str(tmp_path / "out")
    SK.write_entries(e, root)
    # of two entries in one folder, one is run again: its neighbours stay
    more = e.union(spark.createDataFrame([("c1_2_m_pass1", "m", "", "n")], e.schema))
    SK.write_entries(more, root)
    folder = SK.write_entries(e.filter("strategy = ''").withColumn("v", F.lit("z")), root)
    assert folder.endswith("version=3") and SK.latest_version(spark, os.path.join(root, "dataset")) == 3
    assert {"experiment=m", "experiment=m_COT"} <= set(os.listdir(folder))
    back = {r.entry_id: r.v for r in spark.read.json(folder).collect()}
    assert back == {"c1_1_m_pass1": "z", "c1_1_m_pass1_COT": "y", "c1_2_m_pass1": "n"}
    v = spark.createDataFrame([("c1_1_m_pass1", "Correct", "j", "Rating: Correct")],
                              "entry_id string, verdict string, judge_model string, raw_response string")
    w = {r.entry_id: r.judge_verdict for r in SK.with_verdicts(e, v.union(v)).collect()}
    assert SK.with_verdicts(e, v.union(v)).count() == 2
    assert w["c1_1_m_pass1"].verdict == "Correct" and w["c1_1_m_pass1_COT"] is None
    snaps = spark.createDataFrame([("C1.3 / u1.2", "{}", 1), ("C1.3 / u1.2", '{"a":1}', 2), ("C1.3 / u1.2", "{}", 3), ("x", "", 4)],
                                  "label string, content string, doc_id long")
    names = sorted(r.snapshot_name for r in SK.snapshot_rows(snaps, "label").collect())
    assert len(names) == 3 and len(set(names)) == 3
    assert "terraform_tfstate_pre_destroy_C1_3_u1_2.json" in names
    assert all(n.startswith("terraform_tfstate_pre_destroy_C1_3_u1_2") for n in names)


def _scanned(df):
    """Rows that the scan of a one-stage query handed on."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_artifacts_are_found_by_key(spark, tmp_path):
    path = str(tmp_path / "artifacts")
    ids = spark.range(60000).select(F.concat(F.lit("t"), F.xxhash64("id").cast("string")).alias("task_id"), (F.col("id") % 3).cast("int").alias("sample"))
    rows = ids.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("iteration"), F.lit("plan").alias("kind"),
                      F.sha2(F.concat("task_id", F.lit("x")), 512).alias("content"))
    SK.write_artifacts(rows, path, buckets=4, row_group_bytes=1 << 18)
    task = ids.first()["task_id"]
    own = R.read_artifacts(spark, path, task, buckets=4)
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, rows.filter(F.col("task_id") == task).collect()))
    assert own.columns == ["task_id", "sample", "iteration", "kind", "content"]
    # 30,000 rows lie in the folder; row groups that can't hold the task are not read
    assert _scanned(own) <= 120000 // 4 // 2
    one = R.read_artifacts(spark, path, task, ids.first()["sample"], 2, buckets=4)
    assert [(r.task_id, r.iteration) for r in one.collect()] == [(task, 2)]
    assert R.read_artifacts(spark, path, "unknown", buckets=4).count() == 0
    assert R.read_artifacts(spark, path).count() == 120000
    keys = rows.filter("iteration = 2").limit(50).select("task_id", "sample", "iteration")
    wanted = keys.union(keys).union(spark.createDataFrame([(None, 0, 1), ("unknown", 0, 1)], "task_id string, sample int, iteration int"))
    assert R.lookup_artifacts(spark, path, wanted, buckets=4).count() == keys.distinct().count()


def test_sync_and_complexity_report(spark, tmp_path):
    tasks = spark.createDataFrame([("C1.1", "CREATE", ""), ("X9", "OTHER", "keep")],
                                  "task_id string, category string, reference_hcl string")
    refs = spark.createDataFrame([("C1.1", 'resource "xenorchestra_vm" "a" {\n  name_label = "a"\n}\n')], "task_id string, hcl string")
    synced = {r.task_id: r for r in RP.sync_references(tasks, refs).collect()}
    assert synced["C1.1"].reference_hcl.startswith("resource") and synced["C1.1"].violations == []
    assert set(synced["X9"].violations) == {"task_id_format", "category_invalid"}
    scored, dist, summ = RP.complexity_report(tasks, refs)
    s = {r.task_id: r for r in scored.collect()}
    assert s["C1.1"].level == "1" and s["C1.1"].interconnections == -1
    assert summ.first().total_tasks_scored == 2
    missing = RP.missing_ids(spark.createDataFrame([("c1.1",), ("d9.9",)], "task_id string"), tasks).collect()
    assert [m.task_id for m in missing] == ["d9.9"]


def test_judge_messages_and_rollup_quirk(spark, tmp_path):
    from gradewell.operators import chains as CH
    from gradewell.operators import dataset as DS
    df = spark.createDataFrame([("Create a VM", "CREATE", "x" * 9000)], "p string, c string, code string")
    m = df.select(DS.judge_messages("p", "c", "code").alias("m")).first().m
    assert m[0].role == "system" and m[0].content.endswith("Rating: Incorrect")
    assert "Task Category: CREATE" in m[1].content and "x" * 8000 + "\n```" in m[1].content
    log = spark.createDataFrame([(1, 1, "plan_failed", False, 1.0)], "run int, it int, stage string, success boolean, gen_s double")
    assert CH.attempt_rollup(log, "run", "it", max_iterations=1).first().recorded_iterations == 2
    turns = spark.createDataFrame([("a", 1, "user", "hi"), ("a", 0, "system", "s")], "file string, turn int, role string, content string")
    SK.write_conversations(turns, str(tmp_path / "conv"))
    back = spark.read.json(str(tmp_path / "conv")).first()
    assert [x.role for x in back.messages] == ["system", "user"]


def test_ground_truth_report(spark):
    code = 'resource "xenorchestra_vm" "vm" { name_label = "a" }'
    res = spark.createDataFrame(
        [("C1.1", "r1.json", True, True, True, 1, code), ("C1.1", "r2.json", False, True, None, 2, ""),
         ("D1.2", "r3.json", True, False, False, 1, code)],
        "task_id string, file string, plan_ok boolean, apply_ok boolean, spec_ok boolean, iterations int, code string")
    gt = spark.createDataFrame(
        [("C1.1", "b.json", True, True, None, 1, code), ("C1.1", "a.json", True, False, True, 1, code)],
        "task_id string, file string, plan_ok boolean, apply_ok boolean, spec_ok boolean, iterations int, code string")
    cmp, summary, unmatched = RP.ground_truth_report(res, gt)
    rows = {r.file: r for r in cmp.collect()}
    # the truth row is the first by file name (a.json)
    assert rows["r1.json"].apply_match is False and rows["r1.json"].spec_match is True
    assert rows["r1.json"].bleu == 1.0 and rows["r2.json"].bleu is None
    s = summary.first()
    assert s.total == 2 and s.plan_matches == 1 and s.avg_bleu == 1.0
    assert [u.task_id for u in unmatched.collect()] == ["D1.2"]


def test_yaml_specs_and_plan_files_end_to_end(spark, tmp_path):
    from gradewell.operators import rules as RU

    y = tmp_path / "specs.yaml"
    y.write_text("C1.1:\n  category: CREATE\n  vm_count: 1\n  per_vm_cpus: 2\n  vm_names: [web-01]\n"
                 "D1.2:\n  category: DELETE\n  target_vm: web-01\n")
    pd = tmp_path / "plans"
    pd.mkdir()
    vm = {"type": "xenorchestra_vm", "address": "xenorchestra_vm.web", "name": "web"}
    (pd / "C1.1.json").write_text(json.dumps({"resource_changes": [
        {**vm, "change": {"actions": ["create"], "before": None,
                          "after": {"name_label": "web-01", "cpus": 2, "memory_max": 1 << 30, "disk": [{"size": 1 << 34}]}}}]}))
    (pd / "D1.2.json").write_text(json.dumps({"resource_changes": [
        {**vm, "change": {"actions": ["delete"], "before": {"name_label": "web-01"}, "after": None}}]}))
    (pd / "R1.1.json").write_text(json.dumps({"resource_changes": []}))
    (pd / "D2.2.json").write_text(json.dumps({}))
    (pd / "X.json").write_text('{"resource_changes": [')
    with open(y, "a") as f:
        f.write("R1.1:\n  category: READ\nD2.2:\n  category: DELETE\n  delete_count: 1\n")
    plans = R.plan_documents_of(R.read_plans(spark, str(pd)))
    plans = plans.withColumn("plan_id", F.regexp_extract("plan_id", r"^(.*)\.json$", 1))
    specs = R.read_specs(spark, str(y)).withColumnRenamed("task_id", "plan_id")
    got = {r.plan_id: r for r in RU.check_plans(plans, specs).collect()}
    assert got["C1.1"].passed is True and got["D1.2"].passed is True
    # plans without changes and unreadable ones have a row
    assert got["R1.1"].passed is True
    assert got["D2.2"].errors == ["SPEC ERROR: Expected 1 deletions, found 0."]
    assert got["X"].status == "skipped" and got["X"].passed is None and len(got["X"].errors) == 1
    assert {c.check for c in got["C1.1"].checks} >= {"vm_count", "cpus", "vm_names", "host_resource_quotas"}


def test_cli_metrics_and_complexity(spark, tmp_path):
    from gradewell import cli

    d = _entries(tmp_path)
    p = tmp_path / "tasks.csv"
    p.write_text(CSV, encoding="utf-8")
    out = tmp_path / "out"
    cli.run(["metrics", "--entries", str(d), "--tasks", str(p), "--out", str(out)])
    s = spark.read.parquet(str(out / "summary")).first()
    assert s.total_samples == 2 and s.unique_tasks == 2
    cli.run(["complexity", "--tasks", str(p), "--out", str(tmp_path / "cx")])
    assert spark.read.parquet(str(tmp_path / "cx" / "summary")).first().total_tasks_scored == 1


def test_cli_check_plans_and_sync(spark, tmp_path):
    from gradewell import cli

    y = tmp_path / "specs.yaml"
    y.write_text("C1.1:\n  category: CREATE\n  vm_count: 2\n")
    pd = tmp_path / "plans"
    pd.mkdir()
    vm = {"type": "xenorchestra_vm", "address": "xenorchestra_vm.web", "name": "web"}
    (pd / "C1.1.json").write_text(json.dumps({"resource_changes": [
        {**vm, "change": {"actions": ["create"], "before": None, "after": {"name_label": "web-01", "cpus": 2}}}]}))
    (pd / "C1.1_sample2.json").write_text((pd / "C1.1.json").read_text())
    cli.run(["check-plans", "--plans", str(pd), "--specs", str(y), "--out", str(tmp_path / "spec")])
    rows = spark.read.parquet(str(tmp_path / "spec" / "spec_accuracy")).collect()
    assert {(r.plan_id, r.task_id) for r in rows} == {("C1.1", "C1.1"), ("C1.1_sample2", "C1.1")}
    assert all(r.passed is False and r.errors == ["SPEC ERROR: Expected 2 VMs, found 1."] for r in rows)
    p = tmp_path / "tasks.csv"
    p.write_text(CSV, encoding="utf-8")
    refs = tmp_path / "references"
    refs.mkdir()
    (refs / "U1.2.tf").write_text('resource "xenorchestra_vm" "a" {}\n')
    cli.run(["sync-references", "--tasks", str(p), "--references", str(refs), "--out", str(tmp_path / "sync")])
    got = {x.task_id: x for x in spark.read.parquet(str(tmp_path / "sync" / "tasks")).collect()}
    assert got["U1.2"].reference_hcl.startswith("resource") and got["U1.2"].violations == []
    assert got["C1.1"].reference_hcl == 'resource "x" "y" {}'


def test_checkpoint_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    import pytest

    from gradewell import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Cluster())


def test_states_without_resources_and_unreadable_ones_are_listed(spark, tmp_path):
    sd = tmp_path / "states"
    sd.mkdir()
    (sd / "empty.json").write_text("{}")
    (sd / "broken.json").write_text('{"resources": [')
    got = {r.state_id: r for r in R.infra_summary(R.read_states(spark, str(sd))).collect()}
    assert (got["empty.json"].n_managed_vms, got["empty.json"].error) == (0, None)
    assert got["broken.json"].n_managed_vms is None and got["broken.json"].error


def test_quota_counts_the_vms_already_on_the_host(spark):
    from gradewell.operators import rules as RU

    change = "struct<pos:int,type:string,action:string,address:string,name_label:string,memory_max:bigint,cpus:bigint,disk_sizes:array<bigint>>"
    pre = "array<struct<name:string,ram_bytes:bigint,cpus:bigint,disk_bytes:bigint>>"
    big = [("db", 10 << 30, 20, 0), (None, 1 << 50, 999, 0), ("old", 9 << 30, 5, 0)]
    vm = lambda pos, action, name, ram: (pos, "xenorchestra_vm", action, "a", name, ram, 2, [1])
    rows = [("grow", "T ", [vm(1, "update", "db", 12 << 30)], big), ("swap", " T", [vm(1, "delete", "old", None), vm(2, "create", "new", 8 << 30)], big),
            ("none", "T", [], None)]
    plans = spark.createDataFrame(rows, f"plan_id string, task_id string, resource_changes array<{change}>, pre_vms {pre}")
    totals = plans.select("plan_id", RU.projected_totals(F.col("resource_changes"), F.col("pre_vms")).alias("t"))
    got = {r.plan_id: tuple(r.t) for r in totals.collect()}
    assert got == {"grow": (21 << 30, 7, 1), "swap": (18 << 30, 22, 1), "none": (0, 0, 0)}
    specs = spark.createDataFrame([("T", "READ")], "task_id string, category string")
    checked = {r.plan_id: r for r in RU.check_plans(plans, specs, task_col="task_id").collect()}
    assert set(checked) == {"grow", "swap", "none"} and checked["none"].passed is True


def test_reference_sync_uses_every_document(spark, tmp_path):
    """Documents whose ids leave a remainder of 15 or more by 30 are references too."""
    from gradewell.plans.queries import REGISTRY

    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.range(15, 30).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    told = {r["reference_md5"] for r in REGISTRY["reference_sync"](spark, str(tmp_path)).collect()}
    assert told & {r["m"] for r in docs.selectExpr("md5(text) AS m").collect()}


def test_cells_beyond_the_header(spark, tmp_path):
    """The first cell too many is the row's level; rows with too few cells have none."""
    f = tmp_path / "tasks.csv"
    f.write_text('task_id,category,prompt,complexity_level\nC1.1,CREATE,"a, b",2\nR1.1,READ,x,2,5\nU1.1,UPDATE,"y\ny",2,"6",z\nD1.1,DELETE\n')
    got = {r.task_id: (r.category, r.prompt, r.complexity_level) for r in R.read_tasks(spark, str(f)).collect()}
    assert got == {"C1.1": ("CREATE", "a, b", "2"), "R1.1": ("READ", "x", "5"), "U1.1": ("UPDATE", "y\ny", "6"), "D1.1": ("DELETE", None, None)}
    (tmp_path / "short.csv").write_text("task_id,category\nC1.1,CREATE,4\n")
    assert R.read_tasks(spark, str(tmp_path / "short.csv")).first().complexity_level == "4"


def test_the_guard_counts_and_stops_in_the_job_itself(spark):
    import pytest
    from pyspark.sql import Observation

    from gradewell.operators import report as RP

    tasks = spark.createDataFrame([("C1.1", " create ", "x"), ("bad", "READ", "y"), ("D1.1", "MIGRATE", " "), ("U1.1", "", None)],
                                  "task_id string, category string, reference_hcl string")
    rows = RP.sync_references(tasks, spark.createDataFrame([], "task_id string, hcl string"))
    seen = Observation("quality")
    RP.guarded(rows, seen).write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 4, "task_id_format": 1, "reference_blank": 2, "category_invalid": 3}
    with pytest.raises(Exception, match="Unsupported task category 'MIGRATE' for task D1.1"):
        RP.guarded(rows, strict=True).collect()
    known = RP.guarded(rows.where("category <> 'MIGRATE'"), strict=True)
    assert sorted(r.category for r in known.collect()) == ["", "CREATE", "READ"]


def test_specs_of_a_folder(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("C1.1:\n  category: CREATE\n  vm_count: 1\n")
    (tmp_path / "b.yaml").write_text("D1.1:\n  category: DELETE\n  target_vms: [x, y]\nR1.1:\n")
    (tmp_path / "c.yaml").write_text("")
    got = {r.task_id: (r.category, r.vm_count, r.target_vms) for r in R.read_specs(spark, str(tmp_path)).collect()}
    assert got == {"C1.1": ("CREATE", 1, None), "D1.1": ("DELETE", None, ["x", "y"]), "R1.1": (None, None, None)}
