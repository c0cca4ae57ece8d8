"""BLEU-4 (smoothing method 3) against a direct Python implementation of the formula."""

import math
from collections import Counter

import regex

from gradewell.operators.bleu import bleu, bleu_against, reference_index
from gradewell.plans import bindings as B
from conftest import SF_SMALL

TOKEN = regex.compile(r"\w+|[^\w\s]")


def py_bleu(ref, cand):
    r, c = TOKEN.findall(ref), TOKEN.findall(cand)
    if len(r) < 4 or len(c) < 4:
        return 0.0
    nums, dens = [], []
    for n in range(1, 5):
        cg = Counter(tuple(c[i:i + n]) for i in range(len(c) - n + 1))
        rg = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
        nums.append(sum(min(v, rg[g]) for g, v in cg.items()))
        dens.append(max(1, sum(cg.values())))
    if nums[0] == 0:
        return 0.0
    inc, ps = 1, []
    for num, den in zip(nums, dens):
        if num == 0:
            ps.append(1 / (2**inc * den))
            inc += 1
        else:
            ps.append(num / den)
    bp = 1.0 if len(c) > len(r) else math.exp(1 - len(r) / len(c))
    return bp * math.exp(math.fsum(0.25 * math.log(p) for p in ps))


def test_bleu_matches_python(spark):
    p = B.pairs(spark, SF_SMALL)
    got = {(r.conv_id, r.turn): r.bleu for r in bleu(p, ["conv_id", "turn"], "reference", "candidate").collect()}
    rows = p.collect()
    assert len(got) == len(rows) > 0
    for r in rows:
        assert abs(got[(r.conv_id, r.turn)] - py_bleu(r.reference, r.candidate)) < 1e-9


def test_bleu_identity_and_short(spark):
    df = spark.createDataFrame(
        [(1, "resource a b c d e", "resource a b c d e"), (2, "a b", "a b c d"), (3, "", "x y z w")],
        "id int, r string, c string",
    )
    got = {r.id: r.bleu for r in bleu(df, ["id"], "r", "c").collect()}
    assert abs(got[1] - 1.0) < 1e-12
    assert got[2] == 0.0
    assert got[3] is None


def test_bleu_against_equals_pairs(spark):
    """A hot task, grams that repeat in one side only, short, empty, null and missing texts."""
    refs = [("hot", "a b c d e a b c d a a a"), ("short", "a b"), ("empty", ""), ("none", None), ("odd", "x (y) { z } = 1, 2; ümlaut 漢字")]
    texts = ["a b c d e", "a a a a a a a a", "x (y) { z } = 1", "q r s t u v", "a b", "", None, "a b c d e a b c d a a a", "ümlaut 漢字 x ( y"]
    rows = [(f"hot-{k}", "hot", texts[k % len(texts)]) for k in range(60)]
    rows += [(f"{task}-{k}", task, t) for task in ("short", "empty", "none", "odd", "unknown", None) for k, t in enumerate(texts)]
    samples = spark.createDataFrame(rows, "file string, task string, code string")
    r = spark.createDataFrame(refs, "task string, reference string")
    got = {x.file: (x.ref_tokens, x.cand_tokens, x.bleu) for x in bleu_against(samples, r, ["file"], "task", "reference", "code").collect()}
    assert len(got) == len(rows)
    known = dict(refs)
    for file, task, text in rows:
        ref, cand = known.get(task) or "", text or ""
        assert got[file][:2] == (len(TOKEN.findall(ref)), len(TOKEN.findall(cand))), file
        if not ref:
            assert got[file][2] is None, file
        else:
            assert abs(got[file][2] - py_bleu(ref, cand)) < 1e-9, file
    joined = samples.join(r, "task", "left")
    want = {x.file: (x.ref_tokens, x.cand_tokens, x.bleu) for x in bleu(joined, ["file"], "reference", "code").collect()}
    assert got == want


def test_reference_grams_are_listed_once(spark):
    r = spark.createDataFrame([("t", "a b a b a b")], "task string, reference string")
    index = {(x.n, x.g): x.r for x in reference_index(r, "task", "reference").collect()}
    assert index[1, "a"] == 3 and index[2, "a\u0001b"] == 3 and index[4, "b\u0001a\u0001b\u0001a"] == 1
    assert index[0, ""] == 6 and len(index) == 9


def test_rows_of_one_key_are_scored_as_one(spark):
    """Keys may repeat or be null; the rows of a key then add up, a short one makes the key's score 0."""
    a, b = "a b c d e", "a b c x d e"
    rows = [(None, a, b), (1, a, b), (1, a, b), (1, a, b), (2, a, b), (2, "x", b), (3, None, a), (3, a, a), (4, a, a)]
    got = {r.id: (r.ref_tokens, r.cand_tokens, r.bleu) for r in bleu(spark.createDataFrame(rows, "id int, r string, c string"), ["id"], "r", "c").collect()}
    assert got.keys() == {None, 1, 2, 3, 4}
    assert abs(got[None][2] - py_bleu(a, b)) < 1e-9 and got[1][:2] == (5, 6) and got[1][2] > 2 * py_bleu(a, b) > 0
    assert got[2] == (5, 6, 0.0) and got[3] == (5, 5, None) and abs(got[4][2] - 1) < 1e-12


def test_ngrams_are_never_shuffled(spark):
    """What is exchanged and sorted are texts: each exchange has a text or one row per sample."""
    pairs = spark.createDataFrame([(1, "a b c d e", "a b c d e")], "id int, r string, c string")
    samples = spark.createDataFrame([("f", "t", "a b c d")], "file string, task string, code string")
    refs = spark.createDataFrame([("t", "a b c d")], "task string, reference string")
    for df in (bleu(pairs, ["id"], "r", "c"), bleu_against(samples, refs, ["file"], "task", "reference", "code")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate posexplode" not in plan and plan.count("MapInArrow") == 1


def test_a_hot_task_is_dealt_in_shares(spark, monkeypatch):
    from gradewell.operators import bleu as BL

    monkeypatch.setattr(BL, "SHARE", 7)
    texts = ["a b c d e f", "b c d e f g h", "x y z", "a a a a a", None]
    rows = [(f"{t}-{k}" if k % 50 else None, t, texts[k % 5]) for t in ("hot", "bare", None) for k in range(200)]
    samples = spark.createDataFrame(rows, "file string, task string, code string").where("file IS NOT NULL")
    refs = spark.createDataFrame([("hot", "a b c d e f g"), ("cold", "a b c d")], "task string, reference string")
    got = {x.file: x.bleu for x in bleu_against(samples, refs, ["file"], "task", "reference", "code").collect()}
    assert len(got) == samples.count()
    for file, task, text in rows:
        if file and task != "hot":
            assert got[file] is None
        elif file:
            assert abs(got[file] - py_bleu("a b c d e f g", text or "")) < 1e-9
