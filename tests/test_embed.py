"""Blocked embedding match against a brute-force numpy computation."""

import numpy as np

from gradewell.operators.embed import embedding_match, encode_tokens
from gradewell.plans import bindings as B
from conftest import SF_SMALL


def unit(vectors):
    """Vectors of length one; a zero vector stays, so its similarity is 0."""
    v = np.stack(vectors)
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, length, out=np.zeros_like(v), where=length > 0)


def brute(tokens):
    by = {}
    for r in tokens:
        by.setdefault(r.pair_id, {"ref": [], "cand": []})[r.side].append(np.array(r.vec, dtype=float))
    out = {}
    for k, s in by.items():
        if not s["ref"] or not s["cand"]:
            continue
        c, r = unit(s["cand"]), unit(s["ref"])
        sim = c @ r.T
        p, rr = sim.max(axis=1).mean(), sim.max(axis=0).mean()
        out[k] = (p, rr, 2 * p * rr / (p + rr), 10 * p * rr / (9 * p + rr))
    return out


def test_blocked_equals_brute_force(spark):
    t = B.vec_tokens(spark, SF_SMALL)
    want = brute(t.collect())
    for block in (4, 256):
        got = {r.pair_id: r for r in embedding_match(t, ["pair_id"], block=block).collect()}
        assert set(got) == set(want)
        for k, (p, r, f1, f3) in want.items():
            g = got[k]
            assert abs(g.precision - round(p, 4)) < 1e-9 and abs(g.recall - round(r, 4)) < 1e-9
            assert abs(g.f1 - round(f1, 4)) < 1e-9 and abs(g.f3 - round(f3, 4)) < 1e-9


def test_encoder_hook(spark):
    texts = spark.createDataFrame([(1, "ref", "a b"), (1, "cand", "a")], "pair_id int, side string, text string")

    def enc(batch):
        return [[[1.0, float(len(w))] for w in t.split()] for t in batch]

    toks = encode_tokens(texts, enc, ["pair_id"], "side", "text")
    r = embedding_match(toks, ["pair_id"]).first()
    assert r.precision == 1.0 and r.recall == 1.0
