"""ST1: incremental counts equal the batch result, re-delivered rows dropped."""

from pyspark.sql import functions as F

from gradewell.operators import metrics as M
from gradewell.streaming import progress as ST

SCHEMA = "entry_id string, task_id string, ts timestamp, plan_ok boolean, apply_ok boolean, spec_ok boolean"


def test_stream_equals_batch_with_redelivery(spark, tmp_path):
    rows = [(f"e{i}", f"T{i % 3}", None, i % 2 == 0, i % 3 == 0, None if i % 5 == 0 else i % 4 == 0) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    src = tmp_path / "results"
    df.limit(20).write.parquet(str(src / "batch1"))
    df.write.parquet(str(src / "batch2"))  # re-delivers the first 20
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(str(src))
    counts = ST.task_counts_stream(stream, key="entry_id")
    got = ST.pass_at_k_from_counts(ST.run_to_completion(spark, counts))
    want = M.pass_at_k_table(df)
    g = sorted(tuple(r) for r in got.collect())
    w = sorted(tuple(r) for r in want.select(*got.columns).collect())
    assert g == w and len(g) == 3


def test_foreach_batch_sink_without_watermark(spark, tmp_path):
    rows = [(f"e{i}", f"T{i % 4}", None, i % 3 != 0, i % 2 == 0, i % 5 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    src = tmp_path / "results"
    df.write.parquet(str(src / "a"))
    df.limit(10).write.parquet(str(src / "b"))  # re-delivery
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(str(src))
    counts = ST.task_counts_stream(stream, key="entry_id")
    out = str(tmp_path / "sink")
    ST.run_with_sink(spark, counts, out)
    got = sorted(tuple(r) for r in spark.read.parquet(out + "/per_task").collect())
    want = sorted(tuple(r) for r in M.pass_at_k_table(df).select(*spark.read.parquet(out + "/per_task").columns).collect())
    assert got == want
    s = spark.read.parquet(out + "/summary").first()
    assert s.unique_tasks == 4 and s.pass1_plan is not None


def test_late_and_out_of_order_files_all_count(spark, tmp_path):
    """Files delivered newest first, over two runs of one stream: equal to the batch result."""
    rows = [(f"e{i}", f"T{i % 3}", None, i % 2 == 0, i % 3 == 0, i % 4 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn(
        "ts", F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_interval(days=F.substring("entry_id", 2, 9).cast("int")))
    src, counts, ckpt = tmp_path / "results", str(tmp_path / "counts"), str(tmp_path / "ckpt")
    for run, part in (("new", "ts >= '2024-02-01'"), ("old", "ts < '2024-02-10'")):
        df.filter(part).write.parquet(str(src / run))
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 2).parquet(str(src))
        got = ST.run_to_completion(spark, ST.task_counts_stream(stream, key="entry_id"), counts, ckpt)
    want = M.pass_at_k_table(df)
    got = ST.pass_at_k_from_counts(got)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_stream_reads_a_table_that_is_a_folder(spark, tmp_path):
    from gradewell.plans import bindings as B

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = ST.run_to_completion(spark, ST.task_counts_stream(B.samples_stream(spark, str(tmp_path)), key="event_id"))
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(str(tmp_path / "events.parquet")).count()


def changed(spark, tmp_path, deliveries, **options):
    """Counts after each delivery, over one checkpoint."""
    src, sink, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    out = []
    for i, rows in enumerate(deliveries):
        df = spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "v long")).repartition(2)
        df = df.withColumn("at", F.timestamp_seconds("v"))
        df.write.parquet(f"{src}/{i}")
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src)
        counts = ST.run_changes(spark, ST.changes_stream(stream, "entry_id", options.get("version", "v"), options.get("pages", 2), options.get("forget")), sink, checkpoint)
        out.append({r.task_id: (r.n, r.c_plan, r.c_apply, r.c_spec) for r in counts.collect()})
    return out


def test_a_newer_version_takes_the_old_outcome_back(spark, tmp_path):
    got = changed(spark, tmp_path, [
        [("a", "T1", 1, True, True, None), ("b", "T1", 1, True, False, False), ("c", "T2", 5, False, False, False), ("c", "T2", 3, True, True, True)],
        [("a", "T1", 2, True, False, True), ("c", "T2", 4, True, True, True), ("b", "T1", 1, True, False, False)],  # newer, older, repeated
        [("c", "T1", 6, True, True, True), ("b", None, 7, True, None, None), ("a", "T1", None, False, False, False)],  # moved, without task, unversioned
        [],
    ])
    assert got[0] == {"T1": (2, 2, 1, 0), "T2": (1, 0, 0, 0)}
    assert got[1] == {"T1": (2, 2, 0, 1), "T2": (1, 0, 0, 0)}
    assert got[2] == got[3] == {"T1": (2, 2, 1, 2), None: (1, 1, 0, 0)}


def test_equal_versions_do_not_depend_on_the_order(spark, tmp_path):
    x, y = [("a", "T1", 1, True, None, False)], [("a", "T1", 1, False, True, True)]
    assert changed(spark, tmp_path / "xy", [x, y])[-1] == changed(spark, tmp_path / "yx", [y, x])[-1] == {"T1": (1, 1, 0, 0)}


def test_forgotten_entries_leave_the_state_and_keep_their_counts(spark, tmp_path):
    day = 86_400
    got = changed(spark, tmp_path, [
        [("a", "T1", day, True, True, True), ("b", "T1", 2 * day, True, False, True)],
        [("c", "T2", 50 * day, True, True, True)],
        [("a", "T1", day + 5, False, False, False), ("c", "T2", 51 * day, False, True, True)],  # too old; replaced
    ], version="at", forget="10 days")
    assert got[-1] == {"T1": (2, 2, 1, 2), "T2": (1, 0, 1, 1)}


def test_small_files_are_packed_once(spark, tmp_path):
    """Two runs, nested folders, an empty and an unreadable document, a replayed batch."""
    import json

    from gradewell.sources import readers as R
    from gradewell.streaming import compaction as C

    folder, target, checkpoint = (str(tmp_path / n) for n in ("in", "packed", "checkpoint"))
    (tmp_path / "in" / "deep").mkdir(parents=True)
    doc = lambda k: json.dumps({"task_id": f"C1.{k}", "entry_id": f"e{k}", "final_outcome": {"total_iterations": k}, "spec_accuracy": {
        "passed": k % 2 == 0, "checks_performed": ["vm_count", {"check": "x", "passed": True}]}}, indent=2)
    for k in range(7):
        (tmp_path / "in" / ("deep" if k % 3 == 0 else ".") / f"{k}.json").write_text(doc(k))
    (tmp_path / "in" / "bad.json").write_text('{"task_id": ')
    (tmp_path / "in" / "notes.txt").write_text("not a document")
    C.pack_files(spark, folder, target, checkpoint, files_per_batch=3)
    batches = sorted(p.name for p in (tmp_path / "packed").iterdir())
    assert len(batches) == 3
    C.pack_files(spark, folder, target, checkpoint)  # nothing new
    assert sorted(p.name for p in (tmp_path / "packed").iterdir()) == batches
    (tmp_path / "in" / "late.json").write_text(doc(9))
    C.pack_files(spark, folder, target, checkpoint)
    got = C.packed_entries(spark, target)
    direct = R.read_entries(spark.newSession(), f"{folder}/*.json").union(R.read_entries(spark.newSession(), f"{folder}/deep"))
    assert got.columns == direct.columns

    def key(rows):
        out = sorted((r.asDict(True) for r in rows), key=lambda r: r["path"])
        for r in out:  # objects as texts: as written in one, closed up in the other
            if r["spec_accuracy"]:
                r["spec_accuracy"]["checks_performed"] = [json.loads(c) if c[0] == "{" else c for c in r["spec_accuracy"]["checks_performed"]]
        return out

    assert key(got.collect()) == key(direct.collect())
    assert {r.file for r in got.collect()} == {f"{k}.json" for k in range(7)} | {"bad.json", "late.json"}
    # the last batch again, as after a crash between the write and its commit
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    C.pack_files(spark, folder, target, checkpoint)
    assert C.packed_entries(spark, target).count() == 9


def test_a_page_is_replaced_without_work_on_frames(monkeypatch):
    """Null keys and tasks, numbers as they come; no frame is converted or masked for each page."""
    import pandas as pd

    class State:
        exists, hasTimedOut = False, False

        def update(self, page):
            self.page = page

    part = pd.DataFrame({"key": ["a", None, "a"], "version": [1, 1, 2], "task_id": ["T1", None, "T2"],
                         **{c: [1, 0, -1] for c in ST.OKS}, "seen_ms": [0, 0, 0]})
    monkeypatch.setattr(pd.DataFrame, "where", None)
    monkeypatch.setattr(pd.DataFrame, "astype", None)
    state = State()
    (out,) = ST._replace((0,), iter([part]), state)
    assert {r.task_id if isinstance(r.task_id, str) else None: tuple(r)[2:] for r in out.itertuples()} == {"T2": (1, 0, 0, 0), None: (1, 0, 0, 0)}
    assert state.page[0] == ["a", None] and state.page[1] == [2, 1] and state.page[2] == ["T2", None]
