"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Words are as in ``wordscan``. A window is ``size`` consecutive words of a benchmark item; an item
with fewer words is one window. The windows' hashes are broadcast, at most ``block_bytes`` of
benchmark text at a time; larger benchmarks are taken in blocks, whose hits are joined per
document. Each document's windows are looked up, every hit is verified word by word, and hit
words are marked.

Null texts have no words. Items with a null id keep their windows under the id "". Repeated items
count once per id; repeated documents are scanned each. An empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE, bytes_of, give_back, runs, text_or_empty, unused, written
from .wordscan import Words

@dataclass
class Windows:
    """Windows of one length, sorted by hash: where each is, and a table of the hashes' low bits."""

    n: int
    hashes: np.ndarray
    item: np.ndarray
    first: np.ndarray
    bits: np.ndarray


@dataclass
class HashSet:
    ids: list[str]
    words: list[list[bytes]]
    by_size: list[Windows]


def hash_set(items: list[tuple[str, bytes]], size: int) -> HashSet:
    """The windows of some benchmark items."""
    found = Words([t for _, t in items])
    lengths = np.diff(found.begin)
    words = [found.words(a, n) for a, n in zip(found.begin, lengths)]
    by_size = []
    for n in sorted({min(size, int(x)) for x in lengths if x}):
        at, hashes = found.windows(n)
        own = found.doc[at]
        used = np.minimum(lengths[own], size) == n
        at, hashes, own = at[used], hashes[used], own[used]
        order = np.argsort(hashes, kind="stable")
        hashes, own, at = hashes[order], own[order], at[order]
        bits = np.zeros(1 << max(10, int(len(hashes) * 16).bit_length()), dtype=bool)
        bits[hashes & np.uint64(len(bits) - 1)] = True
        by_size.append(Windows(n, hashes, own, at - found.begin[own], bits))
    return HashSet([i for i, _ in items], words, by_size)


def scan(texts: list[bytes], known: HashSet) -> list[tuple[int, list[tuple[int, int]], set[str], Words, int]]:
    """Per text: its number of words, runs of hit words, ids of items with a window in it, and where its words are."""
    found = Words(texts)
    hit_runs: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    for w in known.by_size:
        at, hashes = found.windows(w.n)
        maybe = np.flatnonzero(w.bits[hashes & np.uint64(len(w.bits) - 1)])
        lo = np.searchsorted(w.hashes, hashes[maybe], side="left")
        hi = np.searchsorted(w.hashes, hashes[maybe], side="right")
        for k in np.flatnonzero(lo < hi):
            a = int(at[maybe[k]])
            doc = int(found.doc[a])
            own, hit = found.words(a, w.n), False
            for j in range(lo[k], hi[k]):
                item, first = int(w.item[j]), int(w.first[j])
                if known.words[item][first : first + w.n] == own:
                    items[doc].add(known.ids[item])
                    hit = True
            if hit:
                hit_runs[doc].append((a - int(found.begin[doc]), a - int(found.begin[doc]) + w.n))
    counts = np.diff(found.begin)
    return [(int(counts[i]), joined(hit_runs[i]), items[i], found, i) for i in range(len(texts))]


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans' union as ascending runs that don't touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: bytes, found: Words, doc: int, spans: list[tuple[int, int]]) -> bytes:
    """The text with the bytes of hit words, and what lies between the words of a run, cut out."""
    out, at, base = [], 0, int(found.at[doc])
    for a, b in spans:
        out.append(text[at : int(found.first[found.begin[doc] + a]) - base])
        at = int(found.stop[found.begin[doc] + b - 1]) - base
    return b"".join([*out, text[at:]])


def blocks(spark: SparkSession, benchmark: DataFrame, size: int, block_bytes: int, id_col: str, text_col: str):
    """Hash sets that together hold the benchmark, each of about ``block_bytes`` of text."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_or_empty(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield hash_set([(r["id"], r["text"].encode()) for r in own.distinct().collect()], size)


def with_hits(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int, block_bytes: int,
    hits: str, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The documents, all their columns, and a struct named ``hits``: n_words, runs of hit words, ids."""
    spark_type = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(T.LongType())),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )
    arrow_type = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
    rows, more = docs, False
    for known in blocks(spark, benchmark, size, block_bytes, item_col, item_text):
        if more:  # one block at a time in memory
            rows = written(spark, rows, "hits")
        schema = T.StructType([f for f in rows.schema.fields if f.name != hits] + [T.StructField(hits, spark_type)])
        rows = rows.mapInArrow(_marker(spark.sparkContext.broadcast(known), hits, text_col, arrow_type, more), schema)
        more = True
    return rows


def _marker(shared, name: str, text_col: str, arrow_type, more: bool):
    def mark(batches):
        give_back()
        for batch in batches:
            texts, got = bytes_of(batch, text_col), []
            for a, b in runs([len(t) for t in texts], SLICE):
                got += scan(texts[a:b], shared.value)
            old = batch.column(batch.num_columns - 1).to_pylist() if more else [None] * len(got)
            hits = []
            for (n, spans, items, _, _), before in zip(got, old):
                if before:
                    spans = joined([*spans, *zip(before["runs"][::2], before["runs"][1::2])])
                    items = items | set(before["items"])
                hits.append({"n_words": n, "runs": [x for s in spans for x in s], "items": sorted(items)})
            kept = batch.columns[:-1] if more else batch.columns
            names = batch.schema.names[: len(kept)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(hits, type=arrow_type)], names=[*names, name])

    return mark


def contamination(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = 8 << 20,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(text_col))
    marked = with_hits(spark, rows, benchmark, size, block_bytes, unused(rows, "hits"), text_col, item_col, item_text)
    hits = F.col(marked.columns[-1])
    n_hit = F.aggregate(
        F.sequence(F.lit(0), F.size(hits["runs"]) - 1),
        F.lit(0).cast("long"),
        lambda total, i: total + F.when(i % 2 == 1, F.get(hits["runs"], i)).otherwise(-F.get(hits["runs"], i)),
    )
    return marked.select(
        id_col,
        hits["n_words"].alias("n_words"),
        F.when(F.size(hits["runs"]) > 0, n_hit).otherwise(F.lit(0).cast("long")).alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", hits["items"]).cast("binary"), 256).alias("items_sha256"),
        (F.size(hits["runs"]) > 0).alias("contaminated"),
    )


def decontaminate(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, remove: str = "documents", size: int = 10,
    block_bytes: int = 8 << 20, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The documents without the benchmark's passages: hit documents go ("documents"), or the runs
    of hit words are cut from their texts ("spans"). All columns stay; other texts are unchanged."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    name = unused(docs, "hits")
    marked = with_hits(spark, docs, benchmark, size, block_bytes, name, text_col, item_col, item_text)
    if remove == "documents":
        return marked.where(F.size(F.col(name)["runs"]) == 0).drop(name)
    place = docs.columns.index(text_col)

    def cut(batches):
        for batch in batches:
            texts, hits = bytes_of(batch, text_col), batch.column(batch.num_columns - 1).to_pylist()
            column = batch.column(place).to_pylist()
            for i, (text, hit) in enumerate(zip(texts, hits)):
                if hit["runs"]:
                    spans = list(zip(hit["runs"][::2], hit["runs"][1::2]))
                    column[i] = without(text, Words([text]), 0, spans).decode()
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(column, type=columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return marked.mapInArrow(cut, docs.schema)
