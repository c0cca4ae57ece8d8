"""Exact integer centroid clustering with a LAESA pivot table.

Every vector's distances to a few fixed pivots are computed once and stored beside it. A distance
is kept as the whole part of its root, so it lies in [stored, stored + 1]. In each round the
centroids' distances to the pivots are computed anew (a handful), and by the triangle inequality

    |distance(vector, pivot) - distance(centroid, pivot)| <= distance(vector, centroid),

so the stored table bounds every centroid from below. A vector tries its centroids in the order of
these bounds and computes an exact integer distance only while the bound is not above the best
distance found. Results don't depend on the pivots; they only save work.

A round is one narrow pass over the stored table: each task adds up its vectors by centroid (as
many rows as centroids and components, whatever the table holds), one aggregate adds the tasks' rows and
their sums, bounded by centroids x components, come to the driver as exact integers. Nothing is
kept between rounds but the centroids, so a lost executor costs only its tasks.

Kept are vectors with exactly ``dimensions`` components, none of them null, NaN or infinite; other
rows are left out. Components become floor(``scale`` * x). A null id is hashed as the empty text
and kept like others; rows with equal ids are separate vectors. The first centroids are the kept
vectors with the smallest hashes (equal hashes: the smaller components first); with fewer vectors
than ``k`` there are as many centroids, and an empty table gives an empty result. Components beyond
2^27 raise an error, as their squared distances don't fit a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepared, written

LIMIT = 1 << 27
#: Vectors handled at once inside a task.
ROWS = 1 << 12


def id_hash(id_col: str, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)


def kept_vectors(df: DataFrame, vector_col: str, dimensions: int) -> Column:
    """Whether a row's vector takes part."""
    x = F.col(vector_col)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce((F.size(x) == dimensions) & whole, F.lit(False))


def whole_roots(squares: np.ndarray) -> np.ndarray:
    """The whole part of each square root, exactly."""
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    root -= root * root > squares
    return root + ((root + 1) * (root + 1) <= squares)


def squared(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances, one row per vector and one column per point."""
    out = np.empty((len(vectors), len(points)), dtype=np.int64)
    for j, p in enumerate(points):
        d = vectors - p
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def choose_pivots(vectors: np.ndarray, count: int) -> np.ndarray:
    """Greedily the vectors that lie farthest from those chosen before, by the sum of distances."""
    if not len(vectors):
        return vectors
    chosen, total = [0], np.zeros(len(vectors))
    while len(chosen) < min(count, len(vectors)):
        total += np.sqrt(squared(vectors, vectors[chosen[-1:]])[:, 0])
        total[chosen] = -1
        chosen.append(int(np.argmax(total)))
    return vectors[chosen]


def nearest(vectors: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, its squared distance, exact distances computed); of equally
    near centroids the smaller number."""
    low = whole_roots(squared(centroids, pivots))
    # both roots are off by less than one, so their true difference is above the stored one less 1
    bound = np.zeros((len(vectors), len(centroids)), dtype=np.int64)
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(to_pivots[:, p, None] - low[None, :, p]) - 1, out=bound)
    bound *= bound
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full(len(vectors), np.iinfo(np.int64).max)
    number = np.full(len(vectors), len(centroids))
    every, computed = np.arange(len(vectors)), 0
    for rank in range(len(centroids)):
        c = order[:, rank]
        # bounds ascend along the order: a vector past its best distance is done
        every = every[bound[every, c[every]] <= best[every]]
        if not len(every):
            break
        own = c[every]
        d = vectors[every] - centroids[own]
        exact = np.einsum("ij,ij->i", d, d)
        computed += len(every)
        better = (exact < best[every]) | ((exact == best[every]) & (own < number[every]))
        best[every[better]], number[every[better]] = exact[better], own[better]
    return number, best, computed


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def pivot_table(
    spark: SparkSession, df: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int, k: int, salt: str, pivots: int, candidates: int
) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(id, v, to_pivots) rows written once, the starting centroids and the pivots."""
    rows = df.where(kept_vectors(df, vector_col, dimensions)).select(
        F.col(id_col).alias("id"), id_hash(id_col, salt).alias("hash"), F.col(vector_col).cast("array<double>").alias("x")
    )

    def whole(x: np.ndarray) -> np.ndarray:
        v = np.floor(x * scale)
        if len(v) and np.abs(v).max() > LIMIT:
            raise ValueError(f"a component times {scale} is beyond {LIMIT}: squared distances would not fit a long")
        return v.astype(np.int64)

    first = rows.orderBy("hash", "x").limit(max(k, candidates)).select("x").toArrow().combine_chunks()
    known = whole(np.array(first["x"].to_pylist(), dtype=np.float64).reshape(-1, dimensions))
    centroids, chosen = known[:k], choose_pivots(known, pivots)

    def measure(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                v = whole(_matrix(part.column("x"), dimensions))
                near = whole_roots(squared(v, chosen))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), dimensions).cast(pa.list_(pa.int64())),
                     pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), len(chosen)).cast(pa.list_(pa.int64()))],
                    names=["id", "v", "near"])

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("v", "near"))])
    return written(spark, rows.select("id", "x").mapInArrow(measure, schema), "pivot-table"), centroids, chosen


def next_centroids(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, int]:
    """Centroids after one round, and how many exact distances it took."""
    dimensions = centroids.shape[1]

    def sums(batches):
        n, total, computed = np.zeros(len(centroids), dtype=np.int64), np.zeros(centroids.shape, dtype=object), 0
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                v = _matrix(part.column("v"), dimensions)
                number, _, exact = nearest(v, _matrix(part.column("near"), len(pivots)), centroids, pivots)
                computed += exact
                n += np.bincount(number, minlength=len(centroids))
                for c in np.unique(number):
                    total[c] += v[number == c].sum(axis=0)  # ROWS * LIMIT is far below 2^63
        own = [(int(c), -1, int(n[c])) for c in np.flatnonzero(n)] + [(-1, -1, computed)]
        own += [(int(c), i, int(x)) for c in np.flatnonzero(n) for i, x in enumerate(total[c])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in own], pa.int32()), pa.array([r[1] for r in own], pa.int32()), pa.array([r[2] for r in own], pa.int64())],
            names=["c", "i", "x"])

    got = table.select("v", "near").mapInArrow(sums, "c int, i int, x long").groupBy("c", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    value = {(r.c, r.i): int(r.x) for r in got.collect()}  # at most centroids x (components + 1) + 1 rows
    moved = [
        [value[c, i] // value[c, -1] for i in range(dimensions)] if (c, -1) in value else list(old) for c, old in enumerate(centroids.tolist())
    ]
    return np.array(moved, dtype=np.int64).reshape(-1, dimensions), value.get((-1, -1), 0)


def assign(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""

    def place(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                number, best, _ = nearest(_matrix(part.column("v"), centroids.shape[1]), _matrix(part.column("near"), len(pivots)), centroids, pivots)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(number.astype(np.int32)), pa.array(best)], names=["id", "cluster", "distance"])

    schema = T.StructType([table.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return table.mapInArrow(place, schema)


def clusters(
    spark: SparkSession, df: DataFrame, k: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024, salt: str = "3:",
    pivots: int = 8, candidates: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Pivots are chosen among the ``candidates`` vectors with the smallest hashes.
    """
    prepared(spark)
    table, centroids, chosen = pivot_table(spark, df, id_col, vector_col, dimensions, scale, k, salt, pivots, candidates)
    if len(centroids):
        for _ in range(rounds):
            centroids, _ = next_centroids(table, centroids, chosen)
        placed = written(spark, assign(table, centroids, chosen), "pivot-assigned")
        inertia = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    else:
        placed, inertia = table.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), {}
    digest = {c: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for c, x in enumerate(centroids.tolist())}

    def by_cluster(values: dict, kind: str) -> Column:
        """The value of a row's cluster, from a list with one entry per centroid."""
        listed = F.array(*(F.lit(values.get(c, 0)).cast(kind) for c in range(len(centroids)))) if len(centroids) else F.array().cast(f"array<{kind}>")
        return F.try_element_at(listed, F.col("cluster") + 1)

    return placed.select(
        F.col("id").alias(id_col),
        "cluster",
        "distance",
        by_cluster(inertia, "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        by_cluster(digest, "string").alias("centroid_sha256"),
    )
