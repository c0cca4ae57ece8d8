"""The pipeline against brute force over the smallest tables, and its edges."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from test_documents import contamination_truth, jaccard_truth

import __spark_entry__ as E
import corpus_pipeline
from gradewell.llm import bpe_transducer, quality
from gradewell.llm.common import prepared

SF = "/root/testdata/sf0.001"


def test_run_matches_brute_force(spark):
    docs, labels, items = (prepared(spark).read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    ranking = quality.learn(docs, labels)
    pairs = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    pairs = [p for p in pairs if ranking.score(quality.features([p[1].encode()]))[0] >= 0.5]
    best = {}
    for i, t in pairs:
        best[t] = max(i, best.get(t, i))
    pairs = sorted((i, t) for t, i in best.items())
    text = dict(pairs)
    groups = defaultdict(list)
    for i, own, links in jaccard_truth(pairs):
        groups[own if links else ("alone", i)].append(i)
    pairs = [(min(v), text[min(v)]) for v in groups.values()]
    bench = [(r["item_id"], r["text"]) for r in items.collect()]
    clean = {r[0] for r in contamination_truth(pairs, bench) if not r[5]}
    counter = bpe_transducer.counter(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in pairs:
        if i in clean:
            own = np.array([*counter.library.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
            for k in range(0, len(own), 4096):
                want[i, k // 4096, k, len(own[k : k + 4096]), zlib.crc32(own[k : k + 4096].tobytes())] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    total = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= -(-total // 4096) + 1


def test_stages_keep_columns_and_take_nulls(spark):
    docs = prepared(spark).read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (3, None, "en", "s", 0)], docs.schema)
    for start in (docs.limit(0), odd):
        rows = start
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF)
            if name != "packing":
                assert rows.columns == docs.columns, name
                rows.collect()


def test_one_query_for_each_operator():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in E.queries() and corpus_pipeline.ORACLE_SQL is None and "pipeline" not in E.oracle_sql()
