"""Chains, pass@k and compliance replaying the reference's fixtures."""

from pyspark.sql import functions as F

from gradewell.functions import outcome as O
from gradewell.functions.passk import pass_at_k
from gradewell.operators import chains as CH
from gradewell.operators import metrics as M
from gradewell.operators import running
from conftest import one


def nxt(spark, tasks, oks):
    rows = [(1, i, t, "CREATE", ok, i) for i, (t, ok) in enumerate(zip(tasks, oks))]
    df = spark.createDataFrame(rows, "chain_id int, step int, task_id string, category string, ok boolean, pos int")
    return {r.step: (r.executed, r.next_step) for r in CH.chain_progress(df, "chain_id").collect()}


def test_chain_one(spark):
    c = ["C1.3", "U1.2", "D1.2"]
    assert nxt(spark, c, [True, True, True])[0] == (True, 1)
    r = nxt(spark, c, [False, True, False])
    assert r[0] == (True, 2) and r[1] == (False, None) and r[2] == (True, None)
    assert nxt(spark, c, [True, False, False])[1] == (True, 2)


def test_chain_two(spark):
    c = ["C2.3", "R1.2", "D2.2"]
    assert nxt(spark, c, [False, False, True])[0] == (True, 2)
    assert nxt(spark, c, [True, False, True])[1] == (True, 2)


def test_pass_at_k_cases(spark):
    df = spark.createDataFrame([(5, 4), (1, 1), (10, 0), (10, 3)], "n int, c int")
    got = [r[0] for r in df.select(pass_at_k("n", "c", 3)).collect()]
    assert got[0] == 1.0 and got[1] == 0.0 and got[2] == 0.0
    assert abs(got[3] - (1 - (7 * 6 * 5) / (10 * 9 * 8))) < 1e-12


def test_summary_na_for_unavailable_k(spark):
    df = spark.createDataFrame([("C1.1", True, True, True, 1, 0.0)],
                               "task_id string, plan_ok boolean, apply_ok boolean, spec_ok boolean, iterations int, gen_s double")
    r = M.global_summary(df).first()
    assert r.pass1_plan == 1.0 and r.pass3_plan is None and r.pass5_spec is None and r.pass3_apply is None


def test_compliance_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "a int, e int")
    assert [r[0] for r in df.select(O.compliance("a", "e", 1)).collect()] == [True, False]


def test_running_progress_blocks(spark):
    rows = [(i % 2, i, i) for i in range(50)]
    df = spark.createDataFrame(rows, "run int, id int, v long")
    r = running.running_progress(df, "run", "id", "v", block_width=4).orderBy("id").collect()
    acc = {0: 0, 1: 0}
    for x in r:
        acc[x.run] += x.id
        assert x.elapsed_s == acc[x.run]
        assert x.seq == x.id // 2 + 1 and x.run_rows == 25


def test_error_tail_numbering(spark):
    rows = [(1, i, i % 2 == 0) for i in range(10)]
    df = spark.createDataFrame(rows, "run int, it int, is_error boolean")
    t = {r.it: (r.tail_rank, r.prompt_no) for r in CH.error_tail(df, "run", "it").collect()}
    assert t == {8: (1, 2), 6: (2, 1), 4: (3, None), 2: (4, None), 0: (5, None)}


def test_execution_units_fixed_benchmark(spark):
    rows = [(t, i) for i, t in enumerate(CH.BENCHMARK_ORDER)]
    u = CH.execution_units(spark.createDataFrame(rows, "task_id string, pos int")).orderBy("start").collect()
    assert len(u) == 6
    assert [x.members for x in u if len(x.members) > 1] == [["c1.3", "u1.2", "d1.2"], ["c2.3", "r1.2", "d2.2"]]


def test_chain_slug_hash(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(["C1.3", "U1.2", "D1.2"],), (["C1.%d" % i for i in range(20)],)], "ids array<string>")
    got = [r[0] for r in df.select(CH.chain_slug(F.col("ids"))).collect()]
    assert got[0] == "C1_3_U1_2_D1_2" and len(got[1]) == 16


def test_find_key_values(spark):
    from gradewell.operators.graph import find_key_values
    docs = spark.createDataFrame([(1, '{"a": {"k": 3, "b": [{"c": 1}, {"k": {"x": 2}}]}, "k": "top"}')], "id int, j string")
    got = sorted(r.value for r in find_key_values(docs, "id", "j", "k").collect())
    assert got == ['"top"', "3", '{"x":2}']


def test_running_sum_of_sparse_keys_uses_few_blocks(spark):
    from gradewell.operators.running import running_sum

    rows = [("r", 1000 + i * 10**12, i + 1) for i in range(500)] + [("q", 5, 7)]
    df = spark.createDataFrame(rows, "run string, k long, v long")
    got = sorted((r.k, r.seq, r.running_value, r.run_rows) for r in running_sum(df, "run", "k", "v", rows_per_block=50).collect() if r.run == "r")
    assert got == [(1000 + i * 10**12, i + 1, (i + 1) * (i + 2) // 2, 500) for i in range(500)]
    assert running_sum(df.limit(0), "run", "k", "v").count() == 0


def test_blocks_are_bounded_by_rows_whatever_the_keys(spark):
    """One outlier, clustered times and a run with nine tenths of the rows."""
    from gradewell.operators.running import ordered_blocks, running_sum

    keys = [1 << 60, -(1 << 60)] + [t * 10**12 + i for t in range(4) for i in range(500)]
    rows = [("r", k, 1) for k in keys] + [(f"s{i % 3}", i, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "run string, k long, v long").repartition(5)
    sizes = sorted(r["count"] for r in ordered_blocks(df, "run", "k", 200).groupBy("_blk").count().collect())
    assert len(sizes) >= 9 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    got = [(r.k, r.seq, r.running_value) for r in running_sum(df, "run", "k", "v", rows_per_block=200).where("run = 'r'").collect()]
    assert sorted(got) == [(k, i, i) for i, k in enumerate(sorted(keys), 1)]


def test_key_search_below_the_chain_and_in_odd_documents(spark, monkeypatch):
    import json

    from gradewell.operators import graph

    def plain(v, path=()):
        items = enumerate(v) if isinstance(v, list) else enumerate(v[k] for k in sorted(v)) if isinstance(v, dict) else ()
        keys = sorted(v) if isinstance(v, dict) else None
        for i, x in items:
            if keys and keys[i] == "k":
                yield path + (i,), x
            yield from plain(x, path + (i,))

    deep = {"k": [1]}
    for i in range(9):
        deep = [deep, {"k": {"k": "[{" * i}}] if i % 2 else {"a": deep, "k": i}
    docs = [(1, deep), (2, {"k": {"k": {"k": 3}}}), (3, []), (4, 5), (5, {"x": 'a"k":{[\\'}), (6, {"k": []})]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs] + [(7, "{"), (8, None), (9, "[[[[[[[[[[[[[")], "id int, j string")
    want = sorted((i, p, json.dumps(x, sort_keys=True)) for i, d in docs for p, x in plain(d))
    for chain in (32, 2):
        monkeypatch.setattr(graph, "CHAIN", chain)
        got = graph.find_key_values(df, "id", "j", "k")
        assert sorted((r.id, tuple(r.path), json.dumps(json.loads(r.value), sort_keys=True)) for r in got.collect()) == want


def test_key_search_deals_the_documents_of_one_small_file(spark, tmp_path):
    from gradewell.operators.graph import find_key_values

    spark.range(40).selectExpr("id", """concat('{"a":{"k":', id, '}}') AS j""").coalesce(1).write.parquet(str(tmp_path / "docs"))
    got = find_key_values(spark.read.parquet(str(tmp_path / "docs")), "id", "j", "k")
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(r.id, r.value) for r in got.collect()} == {(i, str(i)) for i in range(40)}
