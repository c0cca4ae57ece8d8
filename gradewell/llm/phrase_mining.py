"""Collocation mining: frequent phrases by Toivonen's sampling method, scored by their weakest cut.

Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and pieces into words at
spaces and tabs. Everything is counted per language (null: ``und``).

1. Proposal. A sample (one document in ``one_in``, by a hash of its id) is mined level by level with
   a lowered threshold; what is frequent there is the proposed set.
2. Full pass. All documents count every phrase that is proposed or lies on the negative border: all
   single words, and each longer phrase whose first and last words less one are both proposed. The
   border isn't written out: a window is counted if its two parts pass the filter.
3. Expansion. A phrase that proves frequent but wasn't proposed is a border failure: it joins the
   proposed set, and another full pass counts the windows that this opens. A window that no pass has
   counted yet is taken as frequent there, so the longer windows above it are counted in the same
   pass. That closes the set: every frequent phrase has been counted, whatever the sample was.
4. Texts. A last pass counts the frequent windows again by their text, so counts are exact.

Up to step 3 a phrase is a 64-bit hash of its language and words. Equal hashes of different phrases
only raise a count, so nothing frequent is lost, and step 4 takes out what was raised. The filter is
a bit table of a fixed size (``FILTER_BITS``), broadcast; a bit that two phrases share lets more windows
be counted, never fewer. Tasks add up equal phrases before the shuffle. Step 4 has as many tasks as
cores, and a task that holds too many phrases hands the rarer half on: its rows follow the phrases, not
the partitions. A batch is read as one stream in chunks of ``CHUNK`` bytes, cut anywhere: an open word
and the last words go over into the next chunk, so memory doesn't grow with a text or a word.

Null texts are empty. Ids only choose the sample; null or repeated ones change no result. Empty
tables and tables without a frequent phrase give no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bytes_of, give_back, prepared, text_or_empty, written
from .wordscan import U, mix

LONGEST = 5
CHUNK = 1 << 19
FILTER_BITS = 1 << 27
#: Distinct hashes that a task holds before it hands them on.
HELD = 1 << 20
#: Words up to this length are compared all at once.
SHORT = 1 << 10

WORD, SPACE, BREAK = 0, 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = SPACE
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = 0x5851F42D4C957F2D
with np.errstate(over="ignore"):
    _VALUE = np.where(_KIND == WORD, mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))[_LOWER], U(0))
    _POWER, _INVERSE = (
        np.cumprod(np.concatenate([np.ones(1, dtype=U), np.full(CHUNK, b, dtype=U)]), dtype=U) for b in (_BASE, pow(_BASE, -1, 1 << 64))
    )


class Tokens:
    """A chunk's words, after the last words of the chunk before: first and stop byte, piece, hash.

    ``new``: index of the first word that ends in this chunk.
    """

    def __init__(self, first, stop, piece, hashes, new):
        self.first, self.stop, self.piece, self.hash, self.new = first, stop, piece, hashes, new

    def windows(self, size: int, older: int = 0) -> np.ndarray:
        """First words of the windows of ``size`` words that end with a new word, or one of the ``older`` before."""
        begin = np.arange(max(0, self.new - older - size + 1), len(self.hash) - size + 1)
        return begin[self.piece[begin] == self.piece[begin + size - 1]]


def chunks(data: bytes):
    """The words of a stream of bytes, chunk by chunk; line ends part the texts in it."""
    whole = np.frombuffer(data, dtype=np.uint8)
    first, stop, piece, raw = (np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, U))
    open_at, open_raw, open_piece, pieces = -1, 0, 0, 0
    for begin in range(0, len(whole), CHUNK):
        part = whole[begin : begin + CHUNK]
        kind = _KIND[part]
        # words lie between separators; those before a word tell its piece
        edge = np.concatenate([[-1], np.flatnonzero(kind), [len(part)]])
        breaks = np.cumsum(kind[edge[:-1]] == BREAK) - (kind[-1] == BREAK)
        filled = np.flatnonzero(np.diff(edge) > 1)
        a, z, own = edge[filled] + 1, edge[filled + 1], breaks[filled] + pieces
        # each word's hash: its bytes' values times the powers of their places in the word; separators count 0
        value = np.zeros(0, dtype=U)
        if len(a):
            value = np.add.reduceat(np.take(_VALUE, part) * _POWER[: len(part)], a, dtype=U) * _INVERSE[a]
        a, z = a + begin, z + begin
        pieces += int((kind == BREAK).sum())
        if open_at >= 0:
            if len(a) and a[0] == begin:  # the open word goes on
                value[0] = (open_raw + int(value[0]) * pow(_BASE, begin - open_at, 1 << 64)) % (1 << 64)
                a[0] = open_at
            else:  # it ended with the last chunk
                a, z = np.concatenate([[open_at], a]), np.concatenate([[begin], z])
                value, own = np.concatenate([np.array([open_raw], dtype=U), value]), np.concatenate([[open_piece], own])
            open_at = -1
        if len(z) and z[-1] == begin + len(part) and z[-1] < len(whole):
            open_at, open_raw, open_piece = int(a[-1]), int(value[-1]), int(own[-1])
            a, z, value, own = a[:-1], z[:-1], value[:-1], own[:-1]
        keep = LONGEST - 1
        new = len(first[-keep:])
        first, stop = np.concatenate([first[-keep:], a]), np.concatenate([stop[-keep:], z])
        piece, raw = np.concatenate([piece[-keep:], own]), np.concatenate([raw[-keep:], value])
        yield Tokens(first, stop, piece, mix(raw), new)


def seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Batch:
    """A batch's texts as one stream, and the language of every place in it."""

    def __init__(self, batch: pa.RecordBatch):
        texts = bytes_of(batch)
        self.langs = batch.column("lang").to_pylist()
        self.seeds = np.array([seed(g) for g in self.langs], dtype=U)
        self.at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.data = b"\n".join([*texts, b""])

    def keys(self, tokens: Tokens, sizes: int) -> list[np.ndarray]:
        """For each size from 1 on, the hash of the window from each word on."""
        own = self.seeds[np.searchsorted(self.at, tokens.first, side="right") - 1]
        total, factor, out = np.zeros(len(tokens.hash), dtype=U), 1, []
        for size in range(1, sizes + 1):
            m = max(0, len(total) - size + 1)
            total[:m] += tokens.hash[size - 1 :] * U(factor)
            factor = factor * 0x2545F4914F6CDD1D % (1 << 64)
            out.append(mix(total + own * U(2 * size + 1)))
        return out


def shared(spark: SparkSession, bits: np.ndarray):
    """A filter as a broadcast of its non-zero words, never more than the whole table."""
    at = np.flatnonzero(bits)
    return spark.sparkContext.broadcast((at.astype(np.uint32), bits[at]))


def unfolded(share) -> np.ndarray:
    at, words = share.value
    bits = np.zeros(FILTER_BITS // 64, dtype=U)
    bits[at] = words
    return bits


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & U(FILTER_BITS - 1)
    return (bits[at >> U(6)] >> (at & U(63))) & U(1) > 0


def opened(tokens: Tokens, keys: list[np.ndarray], now: np.ndarray, before: np.ndarray | None) -> list[np.ndarray]:
    """For each size, the first words of the windows to count: on or above the border of the filter ``now``.

    With ``before``, the filter of an earlier pass, only those that it hadn't let be counted. What
    isn't known yet of such a window is taken as frequent, so windows above it are counted as well.
    """
    out, part, part_before = [], None, None
    for size, h in enumerate(keys, 1):
        # of shorter windows, also those that end with older words: windows across a chunk's edge build on them
        begin = tokens.windows(size, older=LONGEST - size)
        known = None
        if size > 1:
            begin = begin[part[begin] & part[begin + 1]]
            if before is not None:
                known = part_before[begin] & part_before[begin + 1]
        elif before is not None:
            known = np.ones(len(begin), dtype=bool)
        part, part_before = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
        part[begin] = has(now, h[begin])
        if before is not None:
            part_before[begin] = known & has(before, h[begin])
            part[begin] |= ~known
            begin = begin[~known]
        out.append(begin[begin >= tokens.new - size + 1])
    return out


def counted(docs: DataFrame, sizes: list[int], proposed, before=None) -> DataFrame:
    """(h, n) of the windows of these sizes on or above the border of a filter, less those of ``before``."""

    def count(batches):
        give_back()
        now, earlier = unfolded(proposed), unfolded(before) if before else None
        held, size_held = [], 0

        def added():
            h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            total = np.zeros(len(h), dtype=np.int64)
            np.add.at(total, at, np.concatenate([x for _, x in held]))
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(total)], names=["h", "n"])

        for batch in batches:
            stream = Batch(batch)
            for tokens in chunks(stream.data):
                keys = stream.keys(tokens, max(sizes))
                found = opened(tokens, keys, now, earlier)
                found = [keys[size - 1][found[size - 1]] for size in sizes]
                h, n = np.unique(np.concatenate(found), return_counts=True)
                held.append((h, n))
                size_held += len(h)
                if size_held > HELD:
                    yield added()
                    held, size_held = [], 0
        if held:
            yield added()

    return docs.select("lang", "text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def bits_of(keys: DataFrame) -> np.ndarray:
    """The filter of a table's hashes; at most FILTER_BITS / 64 rows come to the driver."""
    at = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = keys.select(F.shiftright(at, 6).alias("w"), F.expr("shiftleft(1L, CAST(h & 63 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    got = words.toArrow()
    bits = np.zeros(FILTER_BITS // 64, dtype=U)
    bits[got["w"].to_numpy()] = got["b"].to_numpy().view(U)
    return bits


def frequent_hashes(spark: SparkSession, docs: DataFrame, sample: DataFrame, min_count: int, lowered: int) -> tuple[list[DataFrame], int]:
    """Tables (h, n) that together hold every frequent phrase, and the number of full passes."""
    proposed = np.zeros(FILTER_BITS // 64, dtype=U)
    for size in range(1, LONGEST + 1):
        share = shared(spark, proposed)
        own = bits_of(counted(sample, [size], share).where(F.col("n") >= lowered))
        share.destroy()
        if not own.any():
            break
        proposed |= own
    tables, before = [], None
    while True:
        share = shared(spark, proposed)
        found = counted(docs, list(range(1, LONGEST + 1)), share, before)
        tables.append(written(spark, found.where(F.col("n") >= min_count), "phrases-counted"))
        grown = proposed | bits_of(tables[-1])
        # the second pass has counted all that its failures can open; it closes the set
        closed = before is not None or (grown == proposed).all()
        if before:
            before.destroy()
        before, proposed = share, grown
        if closed:
            before.destroy()
            return tables, len(tables)


def same_words(stream: Batch, tokens: Tokens) -> np.ndarray:
    """A number for each word; equal numbers for equal words only, compared byte by byte."""
    lower = lambda i: _LOWER[np.frombuffer(stream.data, np.uint8)[tokens.first[i] : tokens.stop[i]]].tobytes()
    _, rep, number = np.unique(tokens.hash, return_index=True, return_inverse=True)
    rep, size = rep[number], tokens.stop - tokens.first
    own = np.flatnonzero(rep != np.arange(len(rep)))
    equal = (size[own] == size[rep[own]]).all()
    short = own[size[own] <= SHORT] if equal else own[:0]
    for a in range(0, len(short), 1 << 16):
        i = short[a : a + (1 << 16)]
        n = size[i]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        data = np.frombuffer(stream.data, np.uint8)
        equal = equal and (_LOWER[data[np.repeat(tokens.first[i], n) + place]] == _LOWER[data[np.repeat(tokens.first[rep[i]], n) + place]]).all()
    equal = equal and all(lower(i) == lower(rep[i]) for i in own[size[own] > SHORT])
    if equal:
        return number
    named: dict[bytes, int] = {}
    return np.array([named.setdefault(lower(i), len(named)) for i in range(len(rep))])


def phrases(stream: Batch, tokens: Tokens):
    """A function that gives the texts of windows: words with one space between them, cut out whole
    where they stand so."""
    begin = int(tokens.first[0]) if len(tokens.first) else 0
    low = stream.data[begin : int(tokens.stop[-1]) if len(tokens.stop) else 0].translate(_LOWER.tobytes())
    first, stop = tokens.first - begin, tokens.stop - begin
    tight = np.zeros(len(first), dtype=bool)
    tight[:-1] = (first[1:] == stop[:-1] + 1) & (np.frombuffer(low + b"\n", np.uint8)[stop[:-1]] == 0x20)

    def name(at: np.ndarray, size: int) -> list[str]:
        whole = np.logical_and.reduce([tight[at + k] for k in range(size - 1)]) if size > 1 else np.ones(len(at), dtype=bool)
        return [
            (low[a:z] if w else b" ".join([low[first[i + k] : stop[i + k]] for k in range(size)])).decode()
            for i, a, z, w in zip(at.tolist(), first[at].tolist(), stop[at + size - 1].tolist(), whole.tolist())
        ]

    return name


def rarer(found: dict) -> dict:
    """Take the rarer half out. Phrases that are met all the time stay until the task's end: one row each."""
    counts = np.fromiter((n for own in found.values() for n in own.values()), dtype=np.int64)
    middle = int(np.partition(counts, len(counts) // 2)[len(counts) // 2])
    out = {lang: {phrase: n for phrase, n in own.items() if n <= middle} for lang, own in found.items()}
    for lang, gone in out.items():
        for phrase in gone:
            del found[lang][phrase]
        if not found[lang]:
            del found[lang]
    return out


def counted_by_text(docs: DataFrame, share) -> DataFrame:
    """(lang, size, phrase, f): a task's counts of the windows that a filter holds; size 0: all words of a language.

    A task makes a row of each phrase that it meets. Both the phrases and the input's partitions grow with the
    input, so rows of each partition would grow with their product. There are as many tasks as cores instead.
    """

    def count(batches):
        give_back()
        kept = unfolded(share)
        found: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for batch in batches:
            stream = Batch(batch)
            distinct = len(set(stream.langs)) == len(set(stream.seeds.tolist()))
            for tokens in chunks(stream.data):
                text = np.searchsorted(stream.at, tokens.first, side="right") - 1
                for i, n in zip(*np.unique(text[tokens.new :], return_counts=True)):
                    found[stream.langs[i]][""] += int(n)
                number, name = same_words(stream, tokens), phrases(stream, tokens)
                keys = stream.keys(tokens, LONGEST)
                for size, begin in enumerate(opened(tokens, keys, kept, None), 1):
                    h = keys[size - 1][begin]
                    begin, h = begin[has(kept, h)], h[has(kept, h)]
                    if not len(begin):
                        continue
                    _, rep, at, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                    same = distinct and all((number[begin + k] == number[begin[rep][at] + k]).all() for k in range(size))
                    if not same:  # two phrases or languages with one hash
                        rep, n = np.arange(len(begin)), np.ones(len(begin), dtype=np.int64)
                    lang = text[begin[rep]].tolist()
                    for i, c, phrase in zip(lang, n.tolist(), name(begin[rep], size)):
                        found[stream.langs[i]][phrase] += c
                if sum(map(len, found.values())) > HELD // 2:
                    yield rows(rarer(found))
        if found:
            yield rows(found)

    def rows(found):
        lang, phrase, f = zip(*((lang, phrase, n) for lang, own in found.items() for phrase, n in own.items()))
        size = [p.count(" ") + 1 if p else 0 for p in phrase]
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(phrase, pa.string()), pa.array(f, pa.int64())],
            names=["lang", "size", "phrase", "f"],
        )

    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.coalesce(cores).mapInArrow(count, "lang string, size int, phrase string, f long")


def frequent_phrases(spark: SparkSession, docs: DataFrame, tables: list[DataFrame], min_count: int) -> DataFrame:
    """(lang, size, phrase, f) of the frequent phrases, counted by their text; size 0: all words of a language."""
    union = tables[0]
    for t in tables[1:]:
        union = union.unionByName(t)
    share = shared(spark, bits_of(union))
    counts = counted_by_text(docs, share).groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    frequent = written(spark, counts.where((F.col("f") >= min_count) | (F.col("size") == 0)), "phrases-frequent")
    share.destroy()
    return frequent


def scored(frequent: DataFrame) -> DataFrame:
    """Candidates with the lowest score of their cuts, less those that a longer phrase always holds."""
    words = F.split("phrase", " ", -1)
    joined = lambda first, n: F.array_join(F.slice("words", first, n), " ")
    candidates = frequent.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), words.alias("words"))
    # a longer phrase holds a candidate as often as it occurs only if one that is a word longer does
    around = candidates.where("size > 2").select(
        "lang", "a", F.explode(F.array(joined(F.lit(1), F.col("size") - 1), joined(F.lit(2), F.col("size") - 1))).alias("phrase")
    )
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = candidates.join(around, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a").drop("longer")
    cuts = free.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("head", joined(F.lit(1), F.col("k"))).withColumn("rest", joined(F.col("k") + 1, F.col("size") - F.col("k")))
    part = lambda phrase, f: frequent.where("size > 0").select("lang", F.col("phrase").alias(phrase), F.col("f").alias(f))
    n = frequent.where("size = 0").select("lang", F.col("f").alias("n"))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"]).join(n, "lang")
    exact = "CAST(CAST(1000 AS DECIMAL(4,0)) * (CAST(a AS DECIMAL(18,0)) * CAST(n AS DECIMAL(18,0))) AS DECIMAL(38,0))"
    cuts = cuts.withColumn("score", F.expr(f"{exact} div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    rows = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), best)
    return rows.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def collocations(
    spark: SparkSession, docs: DataFrame, min_count: int = 100, top: int = 2000, one_in: int = 8,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    prepared(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0)
    tables, _ = frequent_hashes(spark, docs, sample, min_count, max(1, int(0.8 * min_count / one_in)))
    frequent = frequent_phrases(spark, docs.select("lang", "text"), tables, min_count)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(frequent).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
