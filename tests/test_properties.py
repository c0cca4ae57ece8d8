"""Property tests: each hypothesis example is a batch of rows
evaluated in one Spark job."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradewell.functions import text as T
from gradewell.functions.passk import pass_at_k
from gradewell.operators import agreement as AG
from gradewell.operators import bleu as BL
from gradewell.operators import rules as RU

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(0, 40)), min_size=1, max_size=30))
def test_pass_at_k_monotone(spark, nc):
    rows = [(n, min(c, n)) for n, c in nc]
    df = spark.createDataFrame(rows, "n int, c int")
    cols = [pass_at_k("n", "c", k).alias(f"k{k}") for k in (1, 3, 5)]
    cols += [pass_at_k("n", F.least(F.col("c") + 1, F.col("n")), 3).alias("c_up")]
    for r in df.select("n", "c", *cols).collect():
        assert 0.0 <= r.k1 <= 1.0
        if r.n >= 5:
            assert r.k1 <= r.k3 + 1e-12 <= r.k5 + 2e-12  # monotone in k while n >= k
        assert r.k3 <= r.c_up + 1e-12  # monotone in c


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["Rating: Correct", "rating: incorrect", "it is correct", "?", ""]),
                          st.sampled_from([True, False, None])), min_size=1, max_size=40))
def test_confusion_sums_to_valid_rows(spark, rows):
    df = AG.with_verdict(spark.createDataFrame(rows, "judge_text string, spec_passed boolean"))
    c = AG.confusion(df).first()
    valid = df.filter(AG.is_valid()).count()
    assert c.tp + c.fp + c.fn + c.tn == c.n_valid == valid


SECRET = st.tuples(st.sampled_from(["token", "Password", "api_key", "API-KEY", "username", "user"]),
                   st.sampled_from([" = ", ":", "=", " : "]),
                   st.sampled_from(['"abc def"', "'x'", "sk-123", "v,", "{}"]))


@SETTINGS
@given(st.lists(st.lists(SECRET, max_size=4).map(lambda xs: " ; ".join("".join(x) for x in xs)), min_size=1, max_size=20))
def test_redaction_idempotent(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    r = df.select(T.redact("x").alias("a")).select("a", T.redact("a").alias("b")).collect()
    assert all(x.a == x.b for x in r)


WORDS = st.lists(st.sampled_from(["vm", "cpu", "=", "{", "}", "ram", "disk", "é", "2"]), min_size=4, max_size=30)


@SETTINGS
@given(st.lists(WORDS, min_size=1, max_size=15))
def test_bleu_identity(spark, docs):
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "id int, t string")
    got = BL.bleu(df, ["id"], "t", "t").collect()
    assert all(abs(r.bleu - 1.0) < 1e-12 for r in got)


CHANGE = ("struct<pos:int,type:string,action:string,address:string,name_label:string,"
          "memory_max:bigint,cpus:bigint,disk_sizes:array<bigint>>")


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", ""]), st.sampled_from(["create", "update", "delete", "no-op", "replace"]),
                          st.integers(0, 16), st.integers(0, 40)), min_size=1, max_size=12),
       st.randoms(use_true_random=False))
def test_quota_independent_of_row_order(spark, events, rnd):
    changes = [(i + 1, "xenorchestra_vm", a, f"vm.{i}", n or None, m << 30, c, [1 << 30]) for i, (n, a, m, c) in enumerate(events)]
    shuffled = changes[:]
    rnd.shuffle(shuffled)
    df = spark.createDataFrame([("p", changes), ("q", shuffled)], f"plan_id string, resource_changes array<{CHANGE}>")
    t = RU.projected_totals(F.col("resource_changes"))
    a, b = [r.t for r in df.select(t.alias("t")).orderBy(F.lit(1)).collect()]
    assert a == b


@SETTINGS
@given(st.lists(st.lists(st.tuples(st.sampled_from(["a", "b", ""]), st.sampled_from(["create", "update", "delete", "no-op", "replace"]),
                                   st.integers(0, 30), st.integers(0, 40)), min_size=0, max_size=10), min_size=1, max_size=6))
def test_quota_equals_a_plain_overlay(spark, plans):
    rows, want = [], {}
    for p, evs in enumerate(plans):
        changes = [(i + 1, "xenorchestra_vm", a, f"vm.{i}", n or None, m << 30, c, [1 << 35]) for i, (n, a, m, c) in enumerate(evs)]
        rows.append((f"p{p}", changes))
        vms = {"host": (1, 2, 3), "a": (4, 5, 6)}
        for n, a, m, c in evs:
            if n and a == "delete":
                vms.pop(n, None)
            elif n and a != "no-op":
                vms[n] = (m << 30, c, 1 << 35)
        want[f"p{p}"] = tuple(sum(v[k] for v in vms.values()) for k in range(3))
    docs = spark.createDataFrame(rows, f"plan_id string, resource_changes array<{CHANGE}>")
    host = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(r).cast("long").alias("ram_bytes"), F.lit(c).cast("long").alias("cpus"),
                              F.lit(d).cast("long").alias("disk_bytes")) for n, r, c, d in (("host", 1, 2, 3), ("a", 4, 5, 6))])
    got = docs.select("plan_id", RU.projected_totals(F.col("resource_changes"), host).alias("t")).collect()
    assert {r.plan_id: tuple(r.t) for r in got} == want


CODE = st.text(alphabet=st.sampled_from(list('abc{}= "\n\t.éx_1')), min_size=0, max_size=40)


@SETTINGS
@given(st.lists(st.tuples(CODE, CODE, st.sampled_from(["hcl", "HCL", "tf", "terraform", ""])), min_size=1, max_size=20))
def test_extract_code_fenced_blocks(spark, cases):
    rows = []
    for first, last, tag in cases:
        # a tag word at the start of a body would be read as a language tag; keep bodies unambiguous
        first, last = (" x" + b if b.strip().lower().startswith(("hcl", "terraform", "tf")) else b for b in (first, last))
        # a block is stripped, then the tag and its line breaks go; the last block with content wins
        kept = [b.rstrip().lstrip("\r\n") if t else b.strip() for b, t in ((last, tag), (first, "hcl"))]
        rows.append((f"```hcl\n{first}\n```\nthen:\n```{tag}\n{last}\n```", kept[0] or kept[1]))
    df = spark.createDataFrame(rows, "r string, want string")
    for got, want in df.select(T.extract_code("r"), "want").collect():
        assert got == want
