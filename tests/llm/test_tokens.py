"""Token counts and packing against the tokenizers library and a plain best fit."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradewell.llm import bpe_transducer, packing, token_counts
from gradewell.llm.common import prepared

PATH = public_tokenizers.path("word_bpe_49k.json")
COUNTER = bpe_transducer.Counter(PATH)
HARD = [
    "", " ", "\n\t", "plain words here", "'s's''s don't we'll I'D 'tis 're''re 'street x'", "İstanbul ΣΑΣ ß ẞ ﬁ ½ ² ٣",
    "<|endoftext|>hi <|startoftext|>", "a" * 3000, "ab" * 5000, "漢字かな 🙂🙂 \x1c\x85  x\x00y​", "été É",
]


def ids(text):
    return COUNTER.library.encode(text, add_special_tokens=False).ids


def test_hard_texts():
    assert [list(x) for x in COUNTER.encode(HARD)] == [ids(t) for t in HARD]
    assert COUNTER.count(HARD).tolist() == [len(ids(t)) for t in HARD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abcdeorstthingé'ÉßΣςİı \n.,!-_09漢🙂́ |<>", max_size=400), max_size=4))
def test_any_texts(texts):
    assert [list(x) for x in COUNTER.encode(texts)] == [ids(t) for t in texts]
    assert COUNTER.count(texts).tolist() == [len(ids(t)) for t in texts]


@pytest.mark.parametrize("chunk", [1, 2, 7, 64, 100_000])
def test_chunk_maps_compose(chunk):
    stream, begin = COUNTER.symbols(["the thinking " * 50, "x" * 500, "one"])
    weights = COUNTER.transducer.run(stream, "weight", chunk)
    assert np.add.reduceat(weights.astype(int), begin[:-1]).tolist() == [len(ids(t)) for t in ["the thinking " * 50, "x" * 500, "one"]]


def test_tables_may_be_built_again():
    small = bpe_transducer.Counter(PATH)
    small.transducer.max_states = 10
    texts = ["the thinking of things", "other words entirely", "more"]
    for _ in range(3):
        assert small.count(texts).tolist() == [len(ids(t)) for t in texts]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, length string, part string")


ROWS = [(1, "Hello world, hello", "x", "y", "z"), (2, None, None, None, None), (3, "", "", "", ""), (1, "Hello world, hello", "x", "y", "z"),
        (None, "null id", "", "", ""), (9, "long word " * 6000, "", "", "")]


def test_counts_table(spark):
    got = token_counts.token_counts(docs_of(prepared(spark), ROWS), PATH, limit=2048)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(r[0], len((r[1] or "").encode()), len(ids(r[1] or "")), len(ids(r[1] or "")) > 2048) for r in ROWS]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert token_counts.token_counts(docs_of(spark, []), PATH).count() == 0


def plain_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [(g, k) for k, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits)[1]] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def plain_round(pieces, gaps):
    """One piece at a time, longest first, into the smallest gap not used in this round, or used by its own length."""
    used, left = {}, []
    for n in sorted(pieces, reverse=True):
        fits = [(g, k) for k, g in enumerate(gaps) if g >= n and used.get(k, n) == n]
        if fits:
            k = min(fits)[1]
            used[k], gaps[k] = n, gaps[k] - n
        else:
            left.append(n)
    return left, sorted(g for g in gaps if g)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80), st.lists(st.integers(1, 40), max_size=40), st.integers(1, 40))
def test_sweeps_over_ranges_are_one_round_of_best_fit(lengths, gaps, width):
    runs = [(packing.PIECE, n, 0, lengths.count(n)) for n in set(lengths)]
    runs += [(packing.GAP, n, k, 1) for k, n in enumerate(gaps)]
    ranges = {}
    for run in runs:
        ranges.setdefault((run[1] - 1) // width, []).append(run)
    near = [x for own in ranges.values() for x in packing.swept(own)]
    rest = packing.swept([x[:4] for x in near if x[0] < packing.MATCH])
    found = [x for x in near if x[0] >= packing.MATCH] + rest
    sizes = lambda kinds: sorted(x[1] for x in found if x[0] in kinds for _ in range(x[3]))
    left, after = plain_round(lengths, list(gaps))
    assert sizes((packing.PIECE,)) == sorted(left)
    assert sizes((packing.GAP, packing.UPDATED)) == after
    assert sizes((packing.PIECE, packing.MATCH)) == sorted(lengths)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_placements_fill_sequences_like_best_fit_decreasing(spark, seed):
    rng, capacity = np.random.default_rng(seed), 64
    lengths = np.concatenate([rng.integers(1, 65, 400), np.clip(rng.exponential(6, 3000), 1, 64).astype(int), np.full(500, 1 + 30 * seed)])
    classes = spark.createDataFrame([(int(n), int(c)) for n, c in zip(*np.unique(lengths, return_counts=True))], "size long, count long")
    plan = packing.placements(prepared(spark), classes, capacity).orderBy("size", "first").collect()
    filled, placed = {}, {}
    for r in plan:
        assert r["first"] == placed.get(r["size"], 0)
        placed[r["size"]] = r["first"] + r["count"]
        for i in range(r["count"]):
            place = filled.setdefault(r["sequence"] + i // r["each"], [])
            place.append((capacity - r["gap"] + i % r["each"] * r["size"], r["size"]))
    assert placed == {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(filled) <= plain_best_fit(lengths.tolist(), capacity) * 1.01


def test_rounds_have_no_more_tasks_than_ranges(spark, monkeypatch):
    tasks, plain = [], packing.written

    def counted(spark, df, name):
        tasks.append((name, df.rdd.getNumPartitions()))
        return plain(spark, df, name)

    monkeypatch.setattr(packing, "written", counted)
    classes = spark.createDataFrame([(n, 3) for n in range(1, 65)], "size long, count long")
    own = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        plan = packing.placements(prepared(spark), classes, 64).groupBy("size").sum("count").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, plan)) == [(n, 3) for n in range(1, 65)]
    assert max(n for name, n in tasks if name == "pack-near") <= packing.RANGES
    assert max(n for name, n in tasks if name == "pack-round") <= packing.RANGES + 1


def test_a_sweep_drops_what_the_worker_has_compiled():
    """Else each worker keeps some 200 MB of tokenizer through all rounds."""
    bpe_transducer.counter(PATH)
    runs = {"kind": pa.array([packing.PIECE, packing.GAP], pa.int32()), "size": [3, 8], "first": [0, 5], "count": [4, 1]}
    found = packing.swept_table(pa.table(runs)).to_pylist()
    assert not bpe_transducer.compiled()
    assert [tuple(r.values()) for r in found] == [(packing.MATCH, 3, 0, 2, 5, 2, 8), (packing.UPDATED, 2, 5, 1, 0, 0, 0), (packing.PIECE, 3, 2, 2, 0, 0, 0)]


def packed(spark, rows, capacity):
    got = packing.pack(prepared(spark), docs_of(spark, rows), PATH, capacity)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return [r.asDict() for r in got.collect()]


def test_pack(spark):
    got = packed(spark, ROWS, 64)
    want = []
    for doc_id, text, *_ in ROWS:
        own = np.array([*ids(text or ""), 1], dtype="<u4")
        want += [(doc_id, k // 64, k, len(own[k : k + 64]), zlib.crc32(own[k : k + 64].tobytes())) for k in range(0, len(own), 64)]
    keys = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted((tuple(r[k] for k in keys) for r in got), key=repr) == sorted(want, key=repr)
    for s in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    total = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) == -(-total // 64)


def test_pack_empty(spark):
    assert packed(spark, [], 64) == []


def test_long_words_equal_the_library_in_comparable_time():
    """A million characters without a word end: periodic, random and base64."""
    import base64
    import random
    import time

    import public_tokenizers

    from gradewell.llm.bpe_transducer import Counter

    draw = random.Random(1)
    own = Counter(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["a" * 1_000_000, "ab" * 300_000, "donaudampfschifffahrt" * 30_000, "x" * 63 + " " + "y" * 129 + " z",
             "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000)), base64.b64encode(draw.randbytes(300_000)).decode()]
    for t in texts:
        began = time.time()
        count, ids = int(own.count([t])[0]), own.encode([t])[0].tolist()
        mine, began = time.time() - began, time.time()
        want = own.library.encode(t, add_special_tokens=False).ids
        assert count == len(want) and ids == want
        assert mine < 2 + 15 * (time.time() - began)


def test_too_many_states_go_to_the_library(monkeypatch):
    import public_tokenizers

    from gradewell.llm import bpe_transducer as B

    monkeypatch.setattr(B, "FEW_STATES", 1)
    monkeypatch.setattr(B, "SYMBOLS_PER_STATE", 1 << 30)
    own = B.Counter(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["plain words of a text", "", "naïve Ünïcödé", "more words of a text"]
    want = [own.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert own.count(texts).tolist() == [len(w) for w in want]
    assert [x.tolist() for x in own.encode(texts)] == want
