"""N-gram Jaccard self-join by a MinHash LSH forest, verified exactly.

Documents are sets of five-word shingles (words as in ``wordscan``; a shorter document is one
shingle of all its words). Every document has a signature label of ``depth`` bytes in each of
``trees`` prefix tries. Two documents are candidates if their labels share a prefix in some trie.
The prefix is shortened from the full depth until a pair at the threshold is found with the target
recall; after verification the recall of the links found is estimated from their exact
similarities, and the prefix is shortened again while that falls short.

* Rows with the same words in the same order are one class of copies, verified once.
* Trie nodes are counted before the shuffle. In a node of at most ``node_limit`` members, pairs
  whose whole labels agree too little to be at the threshold (five standard deviations below it) are
  dropped, and the rest are given by a spanning forest; a larger node gives an edge from every member
  to its smallest, without that filter. Edges join candidates into groups (connected components), so
  chance collisions don't chain unlike documents into large groups.
* Exact verification compares the shingle sets of all pairs of a group, in blocks of about
  ``block`` documents; a group of n documents is dealt to (n / block)^2 / 2 tasks, each of which
  returns sums per document and a spanning forest of its links, never the pairs.

A document without words has no links. Null texts have no words; null ids are kept; repeated rows
are copies of each other.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE, bytes_of, give_back, runs, text_or_empty, trim, unused, written
from .components import components
from .exact_dedup import settings
from .wordscan import U, Words, mix

ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def chance(similarity, depth: int, trees: int):
    """Probability that a pair shares a prefix of ``depth`` in one of ``trees`` tries."""
    return 1 - (1 - similarity**depth) ** trees


def label_bound(threshold: float, values: int) -> float:
    """Equal labels, of ``values``, that a pair at the threshold has but for five standard deviations."""
    equal = threshold + (1 - threshold) / 256
    return values * (equal - 5 * (equal * (1 - equal) / values) ** 0.5)


@lru_cache
def _tails(threshold: float, values: int) -> tuple[np.ndarray, np.ndarray]:
    grid = np.linspace(0, 1, 1001)
    equal = np.minimum(grid + (1 - grid) / 256, 1 - 1e-9)
    z = (values * equal - label_bound(threshold, values)) / np.sqrt(values * equal * (1 - equal))
    return grid, np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in z])


def passing(similarity, threshold: float, values: int):
    """Probability that a pair has at least ``label_bound`` equal labels (normal tail)."""
    return np.interp(similarity, *_tails(threshold, values))


def shortened(threshold: float, depth: int, trees: int, target: float) -> int:
    """The longest prefix that finds pairs at the threshold with the target recall."""
    while depth > 1 and chance(threshold, depth, trees) < target:
        depth -= 1
    return depth


def shingles(texts: list[bytes], size: int = 5) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, document of each shingle, its hash), in document order; repeated shingles stay."""
    found = Words(texts)
    counts = np.diff(found.begin)
    doc, hashes = [], []
    for n in range(1, size + 1):
        at, h = found.windows(n)
        own = found.doc[at]
        used = counts[own] == n if n < size else counts[own] >= n
        doc.append(own[used])
        hashes.append(h[used])
    doc, hashes = np.concatenate(doc), np.concatenate(hashes)
    order = np.argsort(doc, kind="stable")
    return found, doc[order], hashes[order]


def labels(doc: np.ndarray, hashes: np.ndarray, n: int, values: int) -> np.ndarray:
    """One byte of each of ``values`` min-hashes per document; documents without shingles have zeros."""
    out = np.zeros((n, values), dtype=np.uint8)
    if not len(doc):
        return out
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    own = (hashes >> U(32)).astype(np.uint32)
    factors = np.random.default_rng(7).integers(0, 1 << 31, values, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    for k, factor in enumerate(factors):
        least = np.minimum.reduceat(own * factor, starts)
        out[doc[starts], k] = ((least * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8)
    return out


def order_hashes(found: Words, n: int) -> np.ndarray:
    """Two 64-bit hashes of each document's words in order."""
    out = np.zeros((n, 2), dtype=U)
    place = (np.arange(len(found.hash)) - found.begin[found.doc]).astype(U)
    some = np.flatnonzero(np.diff(found.begin))
    if len(some):
        for k, odd in enumerate(ODD):
            parts = mix(found.hash + mix(place * U(odd) + U(k + 1)))
            out[some, k] = np.add.reduceat(parts, found.begin[some])
    return out


def signatures(rows: DataFrame, trees: int, depth: int, size: int) -> DataFrame:
    """(id, th, n_words, w0, w1, label) per row."""
    schema = T.StructType(
        [rows.schema["id"], rows.schema["th"]]
        + [T.StructField(n, T.LongType()) for n in ("n_words", "w0", "w1")]
        + [T.StructField("label", T.BinaryType())]
    )

    def sign(batches):
        give_back()
        for batch in batches:
            texts = bytes_of(batch)
            for a, b in runs([len(t) for t in texts], SLICE):
                found, doc, hashes = shingles(texts[a:b], size)
                order = order_hashes(found, b - a).view(np.int64)
                label = labels(doc, hashes, b - a, trees * depth)
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column(0), own.column(1), pa.array(np.diff(found.begin).astype(np.int64)),
                        pa.array(np.ascontiguousarray(order[:, 0])), pa.array(np.ascontiguousarray(order[:, 1])),
                        pa.array([x.tobytes() for x in label], type=pa.binary()),
                    ],
                    names=schema.names,
                )
        batch = texts = own = None
        trim()

    return rows.mapInArrow(sign, schema)


def sets_of(rows: DataFrame, size: int) -> DataFrame:
    """(root, rep, copies, blocks, set): the sorted shingle hashes of each text, as bytes."""

    def take(batches):
        give_back()
        for batch in batches:
            texts = bytes_of(batch)
            for a, b in runs([len(t) for t in texts], SLICE):
                _, doc, hashes = shingles(texts[a:b], size)
                ends = np.searchsorted(doc, np.arange(b - a + 1))
                sets = [np.unique(hashes[ends[k] : ends[k + 1]]).tobytes() for k in range(b - a)]
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(c) for c in ("root", "rep", "copies", "blocks")), pa.array(sets, type=pa.binary())],
                    names=["root", "rep", "copies", "blocks", "set"],
                )
        batch = texts = own = sets = None
        trim()

    return rows.mapInArrow(take, "root bigint, rep bigint, copies bigint, blocks bigint, set binary")


def compare(left: list, right: list | None, threshold: float, depth: int, trees: int, n_labels: int):
    """Links between the members of one block (right is None) or of two.

    A member is (rep, copies, set). Returns {rep: documents linked}, spanning links, number of
    links, and the sum of their inverse chances of being candidates: of sharing a prefix, and of
passing the comparison of ``n_labels`` labels.
    """
    other = left if right is None else right
    sizes = np.array([len(s) for _, _, s in other])
    copies = np.array([c for _, c, _ in other])
    reps = [r for r, _, _ in other]
    owner = np.repeat(np.arange(len(other)), sizes)
    values = np.concatenate([s for _, _, s in other])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    linked: dict[int, int] = {}
    spanning, found, weight = [], 0, 0.0
    for i, (rep, own_copies, own) in enumerate(left):
        lo, hi = np.searchsorted(values, own, side="left"), np.searchsorted(values, own, side="right")
        n = hi - lo
        total = int(n.sum())
        if not total:
            continue
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        common = np.bincount(owner[at], minlength=len(other))
        similar = common / (len(own) + sizes - common)
        hit = np.flatnonzero(similar >= threshold)
        hit = hit[hit > i] if right is None else hit
        if not len(hit):
            continue
        found += len(hit)
        weight += float((1 / (chance(similar[hit], depth, trees) * passing(similar[hit], threshold, n_labels))).sum())
        linked[rep] = linked.get(rep, 0) + int(copies[hit].sum())
        for j in hit.tolist():
            linked[reps[j]] = linked.get(reps[j], 0) + own_copies
            a, b = root(rep), root(reps[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                spanning.append((rep, reps[j]))
    return linked, spanning, found, weight


def agreeing(members: DataFrame, threshold: float, values: int) -> DataFrame:
    """Spanning edges (a, b) of the pairs in each node whose labels agree enough.

    ``members`` are rows (tree, prefix, rep, label) of nodes with few members."""
    least = label_bound(threshold, values)

    def close(reps, found):
        marks = np.frombuffer(b"".join(found), dtype=np.uint8).reshape(len(reps), -1)
        left = np.arange(len(reps))
        edges = []
        while len(left):  # grow one tree at a time
            tree, left = [int(left[0])], left[1:]
            for x in tree:
                near = (marks[left] == marks[x]).sum(axis=1) >= least if len(left) else np.zeros(0, dtype=bool)
                edges += [(reps[y], reps[x]) for y in left[near]]
                tree += left[near].tolist()
                left = left[~near]
        return edges

    def pick(batches):
        give_back()
        key, reps, found, out = None, [], [], []
        for batch in batches:
            for tree, prefix, rep, label in zip(*(c.to_pylist() for c in batch.columns)):
                if (tree, prefix) != key:
                    out += close(reps, found) if reps else []
                    key, reps, found = (tree, prefix), [], []
                reps.append(rep)
                found.append(label)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out)], names=["a", "b"])
                out = []
        out += close(reps, found) if reps else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out)], names=["a", "b"])

    dealt = members.select("tree", "prefix", "rep", "label").repartition("tree", "prefix").sortWithinPartitions("tree", "prefix")
    return dealt.mapInArrow(pick, "a bigint, b bigint")


def verified(sets: DataFrame, threshold: float, depth: int, trees: int, values: int) -> DataFrame:
    """(a, b, links, found, weight): sums per document (b null) and spanning links of every task."""
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    dealt = sets.withColumn("own", own).withColumn("peer", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("own", "peer").alias("lo"), F.greatest("own", "peer").alias("hi"), "own", "rep", "copies", "set")
    schema = "a bigint, b bigint, links bigint, found bigint, weight double"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]

    def close(key, members):
        sides: dict[int, list] = {}
        for (own, rep), (copies, data) in sorted(members.items()):
            sides.setdefault(own, []).append((rep, copies, np.frombuffer(data, dtype=U)))
        if key[1] == key[2]:
            got = compare(sides[key[1]], None, threshold, depth, trees, values)
        elif len(sides) == 2:
            got = compare(sides[key[1]], sides[key[2]], threshold, depth, trees, values)
        else:
            return []
        linked, spanning, found, weight = got
        rows = [(rep, None, n, 0, 0.0) for rep, n in linked.items()] + [(a, b, 0, 0, 0.0) for a, b in spanning]
        return rows + ([(None, None, 0, found, weight)] if found else [])

    def check(batches):
        give_back()
        key, members, out = None, {}, []
        for batch in batches:
            for root, lo, hi, own, rep, copies, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (root, lo, hi) != key:
                    if key:
                        out += close(key, members)
                    key, members = (root, lo, hi), {}
                members[own, rep] = (copies, data)  # a repeated row is the same set
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], names=["a", "b", "links", "found", "weight"])
                out = []
        if key:
            out += close(key, members)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], names=["a", "b", "links", "found", "weight"])

    return dealt.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi").mapInArrow(check, schema)


def near_duplicates(
    spark: SparkSession, docs: DataFrame, threshold: float = 0.8, size: int = 5, trees: int = 32, depth: int = 9,
    target_recall: float = 0.999, block: int = 64, node_limit: int = 256, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: id, class_id (smallest id linked to it through links), n_links (other
    documents with a similarity of at least ``threshold``), n_copies (rows with the same words), th
    (a hash of the text, which tells rows with the same id apart), root (a number of its own for each
    class; class_id isn't, as ids repeat and may be null)."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    signed = written(spark, signatures(rows, trees, depth, size).withColumn("key", F.monotonically_increasing_id()), "join-signatures")
    # rows with the same words: one representative, of the smallest id (nulls last)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th", "key")).alias("first")
    classes = written(
        spark,
        signed.groupBy("n_words", "w0", "w1").agg(first, F.count("*").alias("copies"), F.min_by("label", "key").alias("label"))
        .select("n_words", "w0", "w1", "copies", "label", F.col("first.id").alias("id"), F.col("first.th").alias("th"), F.col("first.key").alias("rep")),
        "join-classes",
    )
    worded = classes.where("n_words > 0")
    prefix = shortened(threshold, depth, trees, target_recall)
    while True:
        nodes = worded.select("rep", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "label").select(
            "rep", "tree", F.substring("label", F.col("tree") * depth + 1, F.lit(prefix)).alias("prefix")
        )
        shared = nodes.groupBy("tree", "prefix").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1")
        shared = written(spark, shared, "join-nodes")
        found = written(spark, nodes.join(shared, ["tree", "prefix"]).select("tree", "prefix", "hub", "n", "rep"), "join-node-members")
        few = found.where(F.col("n") <= node_limit).join(worded.select("rep", "label"), "rep")
        edges = agreeing(few, threshold, trees * depth).unionByName(
            found.where((F.col("n") > node_limit) & (F.col("rep") != F.col("hub"))).select(F.col("rep").alias("a"), F.col("hub").alias("b"))
        )
        groups = written(spark, components(spark, edges, "join-candidates"), "join-groups")
        sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
        members = groups.join(sizes, "root").withColumnRenamed("vertex", "rep")
        known = worded.select("rep", "id", "th", "copies").join(members, "rep")
        known = written(spark, known.withColumnsRenamed({"id": "own_id", "th": "own_th"}), "join-members")
        with settings(spark, spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0"):
            match = (F.col("th") == F.col("own_th")) & F.col("id").eqNullSafe(F.col("own_id"))
            wanted = rows.join(known.where("blocks > 0"), match).select("root", "rep", "copies", "blocks", "text")
            sets = written(spark, sets_of(wanted, size), "join-sets")
        links = written(spark, verified(sets, threshold, prefix, trees, trees * depth), "join-links")
        seen = links.agg(F.sum("found"), F.sum("weight")).first()
        if prefix == 1 or not seen[0] or seen[0] / seen[1] >= target_recall:
            break
        prefix -= 1
    roots = written(spark, components(spark, links.where("b is not null").select("a", "b"), "join-classes-of-links"), "join-roots")
    counts = links.where("a is not null and b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    named = classes.join(roots.withColumnRenamed("vertex", "rep"), "rep", "left").join(counts, "rep", "left")
    named = written(spark, named.withColumn("root", F.coalesce("root", "rep")).drop("label"), "join-named")
    smallest = named.groupBy("root").agg(F.min("id").alias("class_id"))
    told = written(
        spark,
        named.join(smallest, "root").select("n_words", "w0", "w1", "copies", "class_id", "root", F.coalesce("links", F.lit(0)).alias("links")),
        "join-told",
    )
    linked = F.when(F.col("n_words") > 0, F.col("copies") - 1 + F.col("links")).otherwise(0).cast("long")
    return signed.drop("label").join(told, ["n_words", "w0", "w1"]).select(
        F.col("id").alias(id_col),
        F.when(F.col("n_words") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        linked.alias("n_links"),
        F.when(F.col("n_words") > 0, F.col("copies")).otherwise(1).cast("long").alias("n_copies"),
        "th",
        "root",
    )


def one_of_each(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, with all its columns: the one with the smallest id. Documents
    without words all stay."""
    told = written(spark, near_duplicates(spark, docs, id_col=id_col, text_col=text_col, **options), "join-report")
    own, other = unused(docs, "own_key"), unused(docs, "other_key")
    key = F.struct(F.col(id_col).alias("id"), F.col("th")).alias(other)
    # of a class, the smallest (id, text hash) stays; classes are aggregated before the shuffle
    worded = told.where("n_links > 0")
    best = worded.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), id_col, "th")).alias("best"))
    best = written(spark, best, "join-best")
    stays = F.col(id_col).eqNullSafe(F.col(f"best.{id_col}")) & (F.col("th") == F.col("best.th"))
    judged = worded.join(best, "root").withColumn("stays", stays)
    judged = written(spark, judged.select(key, "stays"), "join-judged")
    gone = judged.where(~F.col("stays")).select(other).distinct()
    twice = judged.where("stays").groupBy(other).agg(F.count("*").alias("n")).where("n > 1").select(other)
    keyed = docs.withColumn(own, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("th")))
    match = F.col(own).eqNullSafe(F.col(other))
    left = keyed.join(gone, match, "left_anti")
    if twice.isEmpty():
        return left.drop(own)
    one = left.join(twice, match, "left_semi").dropDuplicates([own])
    return left.join(twice, match, "left_anti").unionByName(one).drop(own)
