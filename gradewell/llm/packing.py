"""Best-fit packing of documents into sequences of at most ``capacity`` tokens, bulk-synchronously.

Documents are tokenised once, cut at ``capacity`` and written as a table of pieces without
their ids. Then rounds follow, each over one table of pieces without a place and of gaps:

1. Pieces and gaps are sorted by size, in ranges of sizes. Each range is swept on its own, from its
   largest size down: a gap is laid on a stack, a piece takes the top of it, which is its successor,
   the smallest free gap that holds it. What a range can't match goes on to a sweep over the wider
   range, so the matching is that of one sweep over all sizes.
2. Pieces that want the same gaps are served by rank: longer ones first, then by their rank in
   their length.
3. Gaps are updated: one that took pieces comes back, smaller, in the next round.

Before a round as many sequences are opened as the pieces need for certain: half the volume beyond
the gaps' and, if the longest piece fits no gap, one for every k pieces that only k share a sequence.

Pieces and gaps are rows of runs: a size, and a range of ranks or of sequences. Pieces have at most
``capacity`` runs for any number of documents, and gaps hardly more, as a run of gaps is only split
where a run of pieces ends. The placements (length and range of ranks -> range of sequences) are
broadcast to where the pieces are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe_transducer
from .common import give_back, texts_of, text_or_empty, written


GAP, PIECE, MATCH, UPDATED = range(4)
RUN = "kind int, size long, first long, count long, sequence long, each long, gap long"
#: Ranges of sizes that the first sweep of a round deals to tasks.
RANGES = 16


def swept(runs: Iterable[tuple[int, int, int, int]]) -> list[tuple]:
    """One sweep over runs (kind, size, first, count), from the largest size down, gaps before pieces.

    A piece takes the smallest gap that is free; a gap takes as many pieces of one run as it holds.
    Returns rows of ``RUN``: gaps and pieces left over, matches (``count`` pieces of ``size`` from rank
    ``first`` on, ``each`` to one sequence from ``sequence`` on, in gaps of size ``gap``), updated gaps."""
    stack: list[tuple[int, int, int]] = []
    out = []
    for kind, size, first, count in sorted(runs, key=lambda r: (-r[1], r[0], r[2])):
        if kind == GAP:
            stack.append((size, first, count))
            continue
        while count and stack:
            gap, sequence, room = stack.pop()
            each = gap // size
            taken = min(count, room * each)
            full, rest = divmod(taken, each)
            out.append((MATCH, size, first, taken, sequence, each, gap))
            if full and gap > each * size:
                out.append((UPDATED, gap - each * size, sequence, full, 0, 0, 0))
            if rest:
                out.append((UPDATED, gap - rest * size, sequence + full, 1, 0, 0, 0))
                full += 1
            if full < room:
                stack.append((gap, sequence + full, room - full))
            first, count = first + taken, count - taken
        if count:
            out.append((PIECE, size, first, count, 0, 0, 0))
    return out + [(GAP, *run, 0, 0, 0) for run in stack]


def swept_table(rows: pa.Table) -> pa.Table:
    """``swept`` for Spark. The worker may have tokenised before: what it compiled for that goes first,
    or it would lie in memory through all rounds."""
    if bpe_transducer.compiled():
        give_back()
    found = swept(zip(*(rows[c].to_pylist() for c in ("kind", "size", "first", "count"))))
    types = [pa.int32()] + [pa.int64()] * 6
    names = ["kind", "size", "first", "count", "sequence", "each", "gap"]
    return pa.Table.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*found), types)], names=names)


def sweep_ranges(runs: DataFrame, width: int, capacity: int) -> DataFrame:
    """``swept`` for each range of ``width`` sizes, in no more tasks than there are ranges: with one for
    each shuffle partition, the empty ones would be most of a round's work and memory."""
    part = F.floor((F.col("size") - 1) / width).alias("range")
    ranged = runs.select("kind", "size", "first", "count", part).groupBy("range")
    return ranged.applyInArrow(swept_table, RUN).coalesce(-(-capacity // width))


def opening(runs: DataFrame, capacity: int) -> tuple[int, int]:
    """(pieces left, sequences to open before the next round)."""
    is_piece = F.col("kind") == PIECE
    volume = F.col("size") * F.col("count")
    seen = runs.agg(
        F.max(F.when(is_piece, F.col("size"))).alias("longest"), F.max(F.when(~is_piece, F.col("size"))).alias("widest"),
        F.sum(F.when(is_piece, volume).otherwise(-volume)).alias("beyond"), F.sum(F.when(is_piece, F.col("count"))).alias("left"),
    ).first()
    if not seen["left"]:
        return 0, 0
    new, widest = max(0, -(-seen["beyond"] // (2 * capacity))), seen["widest"] or 0
    if seen["longest"] > widest:
        share = capacity // seen["longest"]
        sharing = is_piece & (F.col("size") > max(widest, capacity // (share + 1)))
        new = max(new, -(-runs.agg(F.sum(F.when(sharing, F.col("count")))).first()[0] // share))
    return seen["left"], new


def placements(spark: SparkSession, classes: DataFrame, capacity: int) -> DataFrame:
    """Rows of ``RUN`` that place all pieces of ``classes`` (size, count); sequences count from 0."""
    zero = F.lit(0).cast("long")
    runs = classes.select(F.lit(PIECE).alias("kind"), "size", zero.alias("first"), "count")
    runs = written(spark, runs, "pack-runs")
    matches, opened = [], 0
    while True:
        left, new = opening(runs, capacity)
        if not left:
            break
        if new:
            # as a row, not as literals: with other literals Spark would compile the round's code anew
            row = {"kind": pa.array([GAP], pa.int32()), "size": [capacity], "first": [opened], "count": [new]}
            runs = runs.unionByName(spark.createDataFrame(pa.table(row)))
            opened += new
        near = written(spark, sweep_ranges(runs, -(-capacity // RANGES), capacity), "pack-near")
        done = F.col("kind").isin(MATCH, UPDATED)
        found = written(spark, near.where(done).unionByName(sweep_ranges(near.where(~done), capacity, capacity)), "pack-round")
        matches.append(found.where(F.col("kind") == MATCH))
        kind = F.when(F.col("kind") == UPDATED, F.lit(GAP)).otherwise(F.col("kind")).alias("kind")
        runs = found.where(F.col("kind") != MATCH).select(kind, "size", "first", "count")
    if not matches:
        return spark.createDataFrame([], RUN)
    return reduce(DataFrame.unionByName, matches)


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of every document, without ids; ``rank`` counts earlier pieces of that length in the same ``part``."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType)]
        + [T.StructField(n, T.LongType()) for n in ("piece", "start", "length", "ids_crc32", "part", "rank")]
    )

    def cut(batches):
        give_back(tokenizer=True)
        counter = bpe_transducer.counter(vocabulary)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            texts, which, rest = texts_of(batch), [], []
            for a, b in bpe_transducer.slices(texts):
                for i, ids in enumerate(counter.encode(texts[a:b]), a):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), capacity):
                        own = ids[start : start + capacity]
                        which.append(i)
                        rest.append((start // capacity, start, len(own), zlib.crc32(own.tobytes()), part, seen[len(own)]))
                        seen[len(own)] += 1
            columns = np.array(rest, dtype=np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which, type=pa.int64())), *(pa.array(np.ascontiguousarray(c)) for c in columns)],
                names=schema.names,
            )

    return rows.mapInArrow(cut, schema)


def pack(
    spark: SparkSession,
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: document, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty: a piece that holds ``end_id`` alone. Repeated rows are packed each; rows
    of equal length are served in the order of their partition, so any run over the same files
    gives the same table. An empty table gives no pieces.
    """
    cut = written(spark, pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces")
    counted = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = counted.select(
        "part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before")
    )
    classes = cut.groupBy(F.col("length").alias("size")).agg(F.count("*").alias("count"))
    # some rows for each length at most, whatever the number of pieces
    plan = placements(spark, classes, capacity).orderBy("size", "first").toArrow()
    plan = {c: plan[c].to_numpy() for c in ("size", "first", "sequence", "each", "gap")}
    columns = ["piece", "start", "length", "ids_crc32"]
    ranked = cut.join(before, ["part", "length"]).select("id", *columns, (F.col("before") + F.col("rank")).alias("rank"))
    shared = spark.sparkContext.broadcast(plan)
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType())]
        + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "sequence_id", "offset")]
    )

    def place(batches):
        plan = shared.value
        stride = np.int64(1) << np.int64(48)
        keys = plan["size"] * stride + plan["first"]
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            k = np.searchsorted(keys, length * stride + rank, side="right") - 1
            sequence, place = np.divmod(rank - plan["first"][k], plan["each"][k])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column("piece").cast(pa.int32()),
                    *(batch.column(n) for n in columns[1:]),
                    pa.array(plan["sequence"][k] + sequence),
                    pa.array(capacity - plan["gap"][k] + place * length),
                ],
                names=schema.names,
            )

    return ranked.mapInArrow(place, schema)
