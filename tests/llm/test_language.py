"""Language identification: every labelling tried on short texts, held-out accuracy on the test tables."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from gradewell.llm import language_id as L
from gradewell.llm.common import prepared

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, held_out string, score string, h string, l string, n string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, g, "a", "b", "c", "d", "e") for i, t, g in rows], SCHEMA)


def best_by_trial(scores, penalty):
    """The greatest sum over all labellings."""
    n, k = scores.shape
    value = lambda p: sum(scores[i, c] for i, c in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))
    return max(value(p) for p in itertools.product(range(k), repeat=n)), value


def test_path_equals_trying_every_labelling():
    draw = np.random.default_rng(2)
    for n in (1, 2, 5, 7):
        scores = draw.normal(0, 2, (n, 3))
        best, value = best_by_trial(scores, 2.5)
        assert abs(value(L.viterbi(scores, np.array([0, n]), 2.5)) - best) < 1e-9


def plain_path(scores, penalty):
    value, came = scores[0].copy(), []
    for s in scores[1:]:
        top = int(value.argmax())
        stay = value >= value[top] - penalty
        came.append(np.where(stay, np.arange(len(value)), top))
        value = np.where(stay, value, value[top] - penalty) + s
    path = [int(value.argmax())]
    for back in reversed(came):
        path.append(int(back[path[-1]]))
    return path[::-1]


def test_blocks_of_many_texts_equal_the_plain_recursion():
    draw = np.random.default_rng(3)
    sizes = [0, 1, 63, 64, 65, 128, 0, 700, 5]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    scores = np.round(draw.normal(0, 3, (begin[-1], 4)) + np.repeat(draw.normal(0, 1, (-(-begin[-1] // 20), 4)), 20, axis=0)[: begin[-1]], 2)
    scores[draw.random(begin[-1]) < 0.1, 2] = L.NEVER
    got = L.viterbi(scores, begin, 6.0)
    for a, z in zip(begin, begin[1:]):
        if z > a:
            value = lambda p: sum(s[c] for s, c in zip(scores[a:z], p)) - 6.0 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: B023, E731
            assert abs(value(got[a:z].tolist()) - value(plain_path(scores[a:z], 6.0))) < 1e-4


def test_words_scripts_and_slices():
    text = "Ab cd1éÉ Привет-мир 日本語テスト x́y ٣ \U0001d400z"
    w = L.words_of(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32))
    assert [text[a:b] for a, b in zip(w.first, w.stop)][:7] == ["Ab", "cd", "éÉ", "Привет", "мир", "日本語", "テスト"]
    assert [L.SCRIPT_NAMES[s] for s in w.script][:7] == ["latin"] * 3 + ["cyrillic"] * 2 + ["han", "kana"]
    long = "word " * 60_000 + "é" * 300_000 + " end"
    parts = list(L.slices(long))
    assert sum(len(p) for _, p in parts) == len(long)
    assert all(a == sum(len(p) for _, p in parts[:i]) for i, (a, _) in enumerate(parts))
    assert all(long[a - 1 : a + 1] in ("d ", " w", "é" * 2, " é", "é ") for a, _ in parts[1:])


TRAIN = [(i, f"the cat and the dog {w} with this thing", "en") for i, w in enumerate("abcdefgh")] + [
    (100 + i, f"der hund und die katze {w} mit dem ding ist schön", "de") for i, w in enumerate("abcdefgh")] + [
    (200 + i, "кошка и собака были вместе", "ru") for i in range(6)]


def test_spans_of_a_mixed_text(spark):
    model = L.learn(spark, docs_of(spark, TRAIN))
    assert model.languages == ["de", "en", "ru"]
    text = "The dog and the cat with this. Der hund und die katze mit dem ding! собака и кошка 12"
    got = L.spans(text, model, penalty=4.0)
    assert [text[a:b] for a, b, _ in got] == ["The dog and the cat with this", "Der hund und die katze mit dem ding", "собака и кошка"]
    assert [g for _, _, g in got] == ["en", "de", "ru"]
    rows = L.language_spans(spark, docs_of(spark, [(5, text, None), (6, None, None), (7, "123", "en")]), model, 4.0).collect()
    assert [(r.doc_id, r.span, r.first, r.stop, r.language) for r in rows] == [(5, k, *s) for k, s in enumerate(got)]


def test_odd_rows_have_defined_results(spark):
    model = L.learn(spark, docs_of(spark, TRAIN + [(None, "und so ist der hund", "de"), (900, None, "fr"), (901, "sans langue", None)]))
    assert model.languages == ["de", "en", "ru"]
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !?", "de"), (None, "the cat", None), (4, "the cat", "ru"), (4, "the cat", "ru"),
            (5, "Ωμέγα", None), (6, "кот", "de"), (7, "the cat and the dog " * 40_000, None), (8, "\ud7ff\U0010ffff \u0301", None)]
    got = L.languages(spark, docs_of(spark, rows), model)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    by = Counter((r.doc_id, r.lang_pred, r.score) for r in got.collect())
    assert by == Counter({(1, "und", 0.0): 1, (2, "und", 0.0): 1, (3, "und", 0.0): 1, (None, "en", 1.0): 1, (4, "en", 1.0): 2, (5, "de", 1.0): 1,
                          (6, "ru", 1.0): 1, (7, "en", 1.0): 1, (8, "und", 0.0): 1})
    assert {r.doc_id: r.held_out for r in got.collect()} == {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}


@pytest.mark.parametrize("rows", [[], [(1, "text without language", None)]])
def test_nothing_learnt(spark, rows):
    model = L.learn(spark, docs_of(spark, rows))
    assert model.languages == []
    got = L.languages(spark, docs_of(spark, rows), model)
    assert [(r.lang_pred, r.score) for r in got.collect()] == [("und", 0.0)] * len(rows)
    assert L.language_spans(spark, docs_of(spark, rows), model).count() == 0


def test_sample_is_bounded_by_ids_and_the_rest_not_read(spark):
    draw = random.Random(4)
    rows = [(i, "ab cd " * draw.randint(1, 3), f"l{i % 7}") for i in range(300)]
    model = L.learn(spark, docs_of(spark, rows), max_labelled=40, max_languages=3)
    assert len(model.languages) == 3


def test_held_out_accuracy(spark):
    docs = prepared(spark).read.parquet(f"{SF}/documents.parquet")
    got = L.languages(spark, docs, L.learn(spark, docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r.lang_pred == r.lang for r in got)
    assert len(got) > 200 and right / len(got) > 0.97
