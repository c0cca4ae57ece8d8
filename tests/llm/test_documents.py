"""Deduplication, decontamination, sharding and quality on small tables, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewell.llm import decontaminate, exact_dedup, jaccard_join, quality, sharding
from gradewell.llm.common import prepared
from gradewell.llm.wordscan import Words

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, k string, digest string, rep string, root string, kept string, id string"


def docs_of(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "d", "r", "x", "k", "h") for i, t in pairs], SCHEMA)


def table(spark, name):
    return prepared(spark).read.parquet(f"{SF}/{name}.parquet")


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def test_words_match_the_pattern():
    draw = random.Random(3)
    texts = ["".join(draw.choice("aZ09 _-éÉß漢\n\x00~") for _ in range(draw.randint(0, 60))) for _ in range(200)] + ["", "é", "a"]
    found = Words([t.encode() for t in texts])
    for k, t in enumerate(texts):
        own = found.words(int(found.begin[k]), int(found.begin[k + 1] - found.begin[k]))
        assert [w.decode() for w in own] == words_of(t)
    by_word = defaultdict(set)
    for a in range(len(found.hash)):
        by_word[found.words(a, 1)[0]].add(int(found.hash[a]))
    assert all(len(v) == 1 for v in by_word.values())
    assert len({next(iter(v)) for v in by_word.values()}) == len(by_word)


# exact deduplication

PAIRS = [(1, "a"), (2, "a"), (3, "b"), (3, "b"), (4, None), (5, ""), (None, "a"), (6, "x" * 100_000), (7, "x" * 100_000), (None, "only"), (8, "A")]


def dedup_truth(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t or ""].append(i)
    out = []
    for i, t in pairs:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_report(spark, weak):
    options = {"digest": lambda text: F.substring(exact_dedup.sha256(text), 1, 1)} if weak else {}
    got = exact_dedup.duplicate_report(spark, docs_of(spark, PAIRS), **options)
    assert sorted(map(tuple, got.collect()), key=repr) == dedup_truth(PAIRS)


def test_exact_state_over_several_batches(spark):
    docs = docs_of(spark, PAIRS).repartition(4)
    got = exact_dedup.duplicate_report(spark, docs, maxFilesPerTrigger="1")
    assert sorted(map(tuple, got.collect()), key=repr) == dedup_truth(PAIRS)


def test_deduplicated_keeps_one_row_of_each_text(spark):
    got = exact_dedup.deduplicated(spark, docs_of(spark, PAIRS))
    assert got.columns == docs_of(spark, PAIRS).columns
    want = [(2, "a"), (3, "b"), (5, ""), (7, "x" * 100_000), (None, "only"), (8, "A")]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_exact_empty(spark):
    assert exact_dedup.duplicate_report(spark, docs_of(spark, [])).count() == 0
    assert exact_dedup.deduplicated(spark, docs_of(spark, [])).count() == 0


# decontamination

ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item"), (2, "Short item"), (3, None), (4, "..."),
         (None, "lone phrase here"), (11, "one two three four five six seven eight nine ten zzz")]
CASES = [
    (1, "x ONE two, three four five six seven eight nine ten eleven y"), (2, None), (3, ""), (4, "one two three four five six seven eight nine"),
    (5, "short\nitem short item"), (6, "a lone phrase here b"), (5, "short\nitem short item"), (None, "ends with short item"), (7, "é " * 40_000 + "short item"),
]


def contamination_truth(cases, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words_of(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add("" if i is None else str(i))
    out = []
    for i, t in cases:
        w, hit, ids = words_of(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def items_of(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, lang string")


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_contamination(spark, block_bytes):
    got = decontaminate.contamination(prepared(spark), docs_of(spark, CASES), items_of(spark, ITEMS), block_bytes=block_bytes)
    assert sorted(map(tuple, got.collect()), key=repr) == contamination_truth(CASES, ITEMS)


def test_decontaminated(spark):
    docs, items = docs_of(prepared(spark), CASES[:6]), items_of(spark, ITEMS)
    whole = decontaminate.decontaminate(spark, docs, items)
    assert whole.columns == docs.columns and sorted(r["doc_id"] for r in whole.collect()) == [2, 3, 4]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(spark, docs, items, remove="spans").collect()}
    assert cut == {1: "x  y", 2: None, 3: "", 4: CASES[3][1], 5: " ".join([""]), 6: "a  b"}
    assert decontaminate.decontaminate(spark, docs_of(spark, []), items).count() == 0
    assert decontaminate.decontaminate(spark, docs, items_of(spark, [])).count() == 6
    with pytest.raises(ValueError):
        decontaminate.decontaminate(spark, docs, items, remove="lines")


# near duplicates


def jaccard_truth(pairs):
    sets = []
    for _, t in pairs:
        w = words_of(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(pairs)))
    links = Counter()

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i in range(len(pairs)):
        least.setdefault(root(i), []).append(pairs[i][0])
    out = []
    for i, (doc_id, _) in enumerate(pairs):
        ids = [x for x in least[root(i)] if x is not None]
        out.append((doc_id, min(ids) if ids and sets[i] else doc_id, links[i]))
    return sorted(out, key=repr)


def near_pairs():
    draw = random.Random(5)
    vocabulary = [f"w{k}" for k in range(2000)]
    pairs, n = [], 0
    for _ in range(12):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(60, 200))]
        for _ in range(draw.randint(1, 9)):
            own = list(base)
            for _ in range(draw.randint(0, 3)):
                own[draw.randrange(len(own))] = draw.choice(vocabulary)
            pairs.append((n, " ".join(own)))
            n += 1
    return pairs + [(900, None), (901, ""), (902, "..."), (903, "few words"), (904, "Few, words"), (905, "other few"), (0, pairs[0][1]),
                    (None, pairs[3][1]), (906, " ".join(vocabulary * 20)), (907, " ".join(vocabulary * 20) + " end")]


@pytest.mark.parametrize("block", [2, 256])
def test_near_duplicates(spark, block):
    pairs = near_pairs()
    got = jaccard_join.near_duplicates(prepared(spark), docs_of(spark, pairs), block=block)
    assert sorted((tuple(r)[:3] for r in got.collect()), key=repr) == jaccard_truth(pairs)


def test_near_duplicates_shorten_prefixes():
    assert jaccard_join.shortened(0.8, 9, 32, 0.999) == 7
    assert jaccard_join.shortened(0.8, 9, 32, 0.9999999) < 7
    assert jaccard_join.shortened(0.1, 3, 1, 0.999) == 1


def test_one_of_each(spark):
    pairs = near_pairs()
    got = jaccard_join.one_of_each(prepared(spark), docs_of(spark, pairs))
    assert got.columns == docs_of(spark, []).columns
    classes = defaultdict(list)
    for doc_id, class_id, links in jaccard_truth(pairs):
        classes[class_id if links else ("own", doc_id)].append(doc_id)
    want = [min(x for x in v if x is not None) if any(x is not None for x in v) else None for v in classes.values()]
    assert sorted((r["doc_id"] for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_one_of_each_with_repeated_and_null_ids(spark):
    """Classes that share their smallest id, or have no id at all, each keep a row."""
    base = {c: " ".join(f"{c}{k}" for k in range(60)) for c in "abcd"}
    ids = {"a": (1, 2), "b": (1, 3), "c": (None, None), "d": (None, None)}
    pairs = [(i, base[c] + tail) for c in base for i, tail in zip(ids[c], ("", " end"))]
    got = jaccard_join.one_of_each(prepared(spark), docs_of(spark, pairs)).collect()
    assert sorted(((r["doc_id"], r["text"][0]) for r in got), key=repr) == [(1, "a"), (1, "b"), (None, "c"), (None, "d")]


def test_near_duplicates_empty(spark):
    assert jaccard_join.near_duplicates(prepared(spark), docs_of(spark, [])).count() == 0
    assert jaccard_join.one_of_each(spark, docs_of(spark, [])).count() == 0


# sharding


def check_shards(pairs, rows, shards):
    assert len(rows) == len(pairs)
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    facts = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in pairs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == facts


def test_shards_keep_groups_whole(spark):
    pairs = [(k, f"text {k}") for k in range(300)] + [(1000 + k, f"group {k % 30}") for k in range(120)] + [(None, None), (None, ""), (5, "text 5")]
    rows = sharding.label_propagation_shards(prepared(spark), docs_of(spark, pairs), shards=8).collect()
    check_shards(pairs, rows, 8)
    groups = defaultdict(set)
    for r in rows:
        groups[r["text_crc32"]].add(r["shard"])
    assert sum(len(v) > 1 for v in groups.values()) <= 1


def test_shards_gather_every_group_that_fits(spark):
    """All rows linked in pairs, and groups of half a shard: neither is left spread by a full quota."""
    for pairs, shards in (
        ([(k, f"text {k // 2}") for k in range(1600)], 8),
        ([(k, f"group {k // 50}" if k < 500 else f"text {k}") for k in range(800)], 8),
    ):
        rows = sharding.label_propagation_shards(prepared(spark), docs_of(spark, pairs), shards=shards).collect()
        check_shards(pairs, rows, shards)
        groups = defaultdict(set)
        for r in rows:
            groups[r["text_crc32"]].add(r["shard"])
        assert sum(len(v) > 1 for v in groups.values()) == 0


def test_shards_split_a_hot_group(spark):
    pairs = [(k, "hot" if k % 3 else f"text {k}") for k in range(300)]
    check_shards(pairs, sharding.label_propagation_shards(prepared(spark), docs_of(spark, pairs), shards=8).collect(), 8)


def test_shards_empty_and_few(spark):
    assert sharding.label_propagation_shards(prepared(spark), docs_of(spark, []), shards=4).count() == 0
    pairs = [(1, "a"), (2, "a")]
    check_shards(pairs, sharding.label_propagation_shards(spark, docs_of(spark, pairs), shards=4).collect(), 4)


# quality


def test_quality_on_held_out_labels(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    rows = quality.scores(spark, docs, quality.learn(docs, labels)).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    told = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([a == b for a, b in told]) > 0.97


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (99, 0)], "doc_id long, quality int")
    docs = docs_of(prepared(spark), PAIRS)
    ranking = quality.learn(docs, labels)
    rows = quality.scores(spark, docs, ranking).collect()
    assert len(rows) == len(PAIRS) and {r["score"] for r in rows} == {0.5}
    assert quality.scores(spark, docs_of(spark, []), ranking).count() == 0
    assert quality.accepted(docs, ranking).columns == docs.columns
    assert quality.learn(docs, labels.limit(0)).threshold == 0
    assert quality.features([b"", b"a" * 1_000_000]).shape[0] == 2


def test_columns_named_as_helpers_once_were(spark):
    """Every column comes through, whatever its name."""
    names = ["__k", "__key", "__hits", "own_key", "other_key", "hits", "Own_Key2"]
    docs = spark.createDataFrame([(1, "one two three four five six", *names), (2, "one two three four five six", *names), (3, "other", *names)],
                                 "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    items = spark.createDataFrame([(1, "other")], "item_id long, text string")
    for got, kept in ((exact_dedup.deduplicated(prepared(spark), docs), [2, 3]), (jaccard_join.one_of_each(prepared(spark), docs), [1, 3]),
                      (decontaminate.decontaminate(prepared(spark), docs, items), [1, 2])):
        assert got.columns == docs.columns
        rows = got.collect()
        assert sorted(r.doc_id for r in rows) == kept and all(list(r)[2:] == names for r in rows)


def test_a_third_of_all_rows_under_one_digest(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i // 2}") for i in range(600)]
    got = exact_dedup.duplicate_report(spark, docs_of(spark, rows).repartition(8), digest=lambda text: F.substring(exact_dedup.sha256(text), 1, 2))
    assert sorted(map(tuple, got.collect()), key=repr) == dedup_truth(rows)


def test_label_comparison_loses_next_to_nothing_and_is_counted():
    assert 1 - 1e-6 < float(jaccard_join.passing(0.8, 0.8, 288)) <= 1
    assert float(jaccard_join.passing(0.5, 0.8, 288)) < 0.01
