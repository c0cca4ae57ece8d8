"""Phrase mining against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewell.llm import phrase_mining as M

SCHEMA = "doc_id long, text string, lang string, n string, phrase string, h string, id string, a long, score long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, g, "a", "b", "c", "d", 1, 2) for i, t, g in rows], SCHEMA)


def plain(rows, min_count, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang, text = "und" if lang is None else lang, "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        kept = {p: a for p, a in own.items() if a >= min_count and len(p) > 1}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        found = []
        for p, a in kept.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and inside(p, q) for q, b in kept.items()):
                continue
            cuts = [(1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), a, left, right, score))
        for rank, x in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, x[2].decode(), x[3], x[4], x[5], n[lang], x[6]))
    return sorted(out)


def corpus(seed, docs=120):
    draw = random.Random(seed)
    words = ["a", "B", "c", "d'", "é", "漢字", "x-y", "(z)", "\x00", "w" * 50]
    stock = ["the quick b fox runs", "a a a a a a a", "É é, a\tb  c", "one two three four five six"]
    rows = []
    for i in range(docs):
        parts = [draw.choice(stock) if draw.random() < 0.3 else draw.choice(words) for _ in range(draw.randint(0, 40))]
        text = "".join(p + draw.choice([" ", " ", " ", "\t", ". ", "\n", "!"]) for p in parts)
        rows.append((draw.choice([i, 1, None]), text, draw.choice(["en", "en", "de", None, "und"])))
    return rows + [(900, None, "en"), (901, "", "de"), (902, "   ", None)]


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"one_in": 50}), (3, {"one_in": 1}), (4, {"min_count": 12, "top": 5})])
def test_equals_the_plain_count(spark, seed, options):
    rows = corpus(seed)
    options = {"min_count": 5, "top": 50, "one_in": 3} | options
    got = M.collocations(spark, docs_of(spark, rows), **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == plain(rows, options["min_count"], options["top"])


def test_a_sample_that_proposes_nothing_is_mended_by_expansion(spark):
    rows = [(i, "five words that occur often, and more of it", "en") for i in range(30)]
    docs = docs_of(spark, rows).select("lang", "text", F.col("doc_id").alias("id"))
    tables, passes = M.frequent_hashes(spark, docs, docs.where("false"), 10, 1)
    assert passes == 2  # single words, then all that they open
    tables, passes = M.frequent_hashes(spark, docs, docs, 10, 1)
    assert passes == 1
    assert sorted(map(tuple, M.collocations(spark, docs_of(spark, rows), 10, 50, one_in=10**9).collect())) == plain(rows, 10, 50)


def test_empty(spark):
    assert M.collocations(spark, docs_of(spark, [])).count() == 0
    assert M.collocations(spark, docs_of(spark, [(None, None, None), (1, "a b", "en")])).count() == 0


def test_chunks_cut_anywhere_give_the_same_words(monkeypatch):
    draw = random.Random(8)
    data = "".join(draw.choice("abC éñ.\n\t!  ") for _ in range(4000)).encode() + b"x" * 300 + b" end of it"
    want = next(iter(M.chunks(data)))
    for size in (1, 2, 7, 64, 1000):
        monkeypatch.setattr(M, "CHUNK", size)
        got = list(M.chunks(data))
        for name in ("first", "stop", "piece", "hash"):
            assert np.concatenate([getattr(t, name)[t.new :] for t in got]).tolist() == getattr(want, name).tolist()
        for k in range(1, 6):
            at = [t.first[i] for t in got for i in t.windows(k)]
            assert sorted(at) == want.first[want.windows(k)].tolist()


def test_windows_across_chunks_are_counted(spark):
    draw = random.Random(11)
    rows = [(i, " ".join(draw.choice("abcd") * draw.choice([1, 3, 90]) for _ in range(40_000)), "en") for i in range(2)]
    assert sum(len(t) for _, t, _ in rows) > 4 * M.CHUNK
    assert sorted(map(tuple, M.collocations(spark, docs_of(spark, rows), 5, 10**6, one_in=1).collect())) == plain(rows, 5, 10**6)


@pytest.mark.parametrize("before", [False, True])
def test_chunks_cut_anywhere_open_the_same_windows(monkeypatch, before):
    import pyarrow as pa

    rows = corpus(6, 60)
    stream = M.Batch(pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows]), pa.array([r[2] or "und" for r in rows])], names=["text", "lang"]))
    draw = np.random.default_rng(3)
    now = draw.integers(0, 1 << 63, M.FILTER_BITS // 64, dtype=np.uint64) | draw.integers(0, 1 << 63, M.FILTER_BITS // 64, dtype=np.uint64)
    old = now & draw.integers(0, 1 << 63, M.FILTER_BITS // 64, dtype=np.uint64) if before else None

    def found():
        out = [Counter() for _ in range(5)]
        for tokens in M.chunks(stream.data):
            keys = stream.keys(tokens, 5)
            for size, begin in enumerate(M.opened(tokens, keys, now, old)):
                out[size].update(keys[size][begin].tolist())
        return out

    want = found()
    assert all(want[1:4])
    for size in (1, 2, 7, 64, 1000):
        monkeypatch.setattr(M, "CHUNK", size)
        assert found() == want


def test_words_with_one_hash_are_told_apart(spark, monkeypatch):
    rows = corpus(5, 40)
    import pyarrow as pa

    stream = M.Batch(pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows]), pa.array(["en"] * len(rows))], names=["text", "lang"]))
    for tokens in M.chunks(stream.data):
        text = [bytes(M._LOWER[list(stream.data[a:b])]) for a, b in zip(tokens.first, tokens.stop)]
        for hashes in (tokens.hash, tokens.hash & M.U(3), tokens.hash * M.U(0)):
            tokens.hash = hashes
            number = M.same_words(stream, tokens)
            assert len(set(zip(number.tolist(), text))) == len(set(text)) == len(set(number.tolist()))


def test_scores_beyond_64_bits(spark):
    a, n, left, right = 10**12, 9 * 10**14 + 7, 3 * 10**13 + 1, 2 * 10**12 + 3
    rows = [("en", 0, "", n), ("en", 1, "x", left), ("en", 1, "y", right), ("en", 2, "x y", a)]
    got = M.scored(spark.createDataFrame(rows, "lang string, size int, phrase string, f long")).first()
    assert got.score == 1000 * a * n // (left * right)


def test_rows_of_the_text_pass_do_not_grow_with_the_partitions(spark):
    rows = [(i, "one two three four five", "en") for i in range(200)]
    share = M.shared(spark, np.full(M.FILTER_BITS // 64, ~M.U(0)))
    got = M.counted_by_text(docs_of(spark, rows).select("lang", "text").repartition(64), share).cache()
    assert got.count() <= 16 * spark.sparkContext.defaultParallelism  # 15 phrases and the number of words
    total = {(r["size"], r["phrase"]): r["f"] for r in got.groupBy("size", "phrase").agg(F.sum("f").alias("f")).collect()}
    words = rows[0][1].split()
    assert total == {(0, ""): 1000} | {(k, " ".join(words[i : i + k])): 200 for k in range(1, 6) for i in range(6 - k)}
    got.unpersist()


def test_the_rarer_half_is_handed_on():
    found = {"en": {"": 90, "a": 40, "b": 1, "a b": 1}, "de": {"c": 1}}
    assert M.rarer(found) == {"en": {"b": 1, "a b": 1}, "de": {"c": 1}}
    assert found == {"en": {"": 90, "a": 40}}
    assert M.rarer({"en": {"a": 3, "b": 3}}) == {"en": {"a": 3, "b": 3}}


def test_phrases_handed_on_early_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(M, "HELD", 40)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, "4")
    try:
        rows = corpus(9)
        assert sorted(map(tuple, M.collocations(spark, docs_of(spark, rows), 5, 50, one_in=3).collect())) == plain(rows, 5, 50)
    finally:
        spark.conf.set(name, old)
