"""Pivot-table clustering against plain integer k-means."""

import hashlib
import math
import random

import numpy as np
import pytest

from gradewell.llm import pivot_clusters as P


def plain(rows, k, rounds, dimensions):
    """(id, cluster, distance, cluster inertia, inertia, digest) by Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[n]) for x in zip(*members[n])] if n in members else c for n, c in enumerate(centroids)]
    placed = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, n, d in placed:
        inertia[n] = inertia.get(n, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), digest[n]) for i, n, d in placed), key=repr)


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, id int, v string, cluster int")


def result(spark, rows, **options):
    got = P.clusters(spark, table_of(spark, rows), **options)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    return sorted(map(tuple, got.collect()), key=repr)


def test_equals_plain_integer_clustering(spark):
    draw = random.Random(5)
    rows = [(i, [draw.gauss(c % 3, 0.4) for c in range(4)] if i % 2 else [draw.choice([-1.0, 0.0, 0.5]) for _ in range(4)]) for i in range(400)]
    rows += [(7, [1.0] * 4), (7, [1.0] * 4), (None, [0.1] * 4), (None, [0.2] * 4)] + [(1000 + i, [0.25, -0.25, 0.5, 0.0]) for i in range(150)]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 3), (2003, [1.0, None, 1.0, 1.0]), (2004, [1.0, math.nan, 1.0, 1.0]),
             (2005, [1.0, math.inf, 1.0, 1.0]), (2006, [1.0] * 5), (2007, [-100_000.0, 100_000.0, 0.0, 3.0])]
    assert result(spark, rows, k=8, rounds=4, dimensions=4) == plain(rows, 8, 4, 4)
    assert result(spark, rows, k=3, rounds=2, dimensions=4, pivots=1) == plain(rows, 3, 2, 4)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_fewer_vectors_than_centroids(spark, rows):
    assert result(spark, rows, k=8, rounds=2, dimensions=2) == plain(rows, 8, 2, 2)


def test_components_beyond_the_limit_are_an_error(spark):
    with pytest.raises(Exception, match="would not fit a long"):
        P.clusters(spark, table_of(spark, [(1, [1e30, 0.0])]), k=1, rounds=1, dimensions=2)


def test_bounds_save_distances_and_keep_the_result():
    draw = np.random.default_rng(1)
    centres = draw.integers(-4000, 4000, (16, 6))
    vectors = centres[draw.integers(0, 16, 5000)] + draw.integers(-50, 50, (5000, 6))
    pivots = P.choose_pivots(vectors[:100], 8)
    number, best, computed = P.nearest(vectors, P.whole_roots(P.squared(vectors, pivots)), centres, pivots)
    every = P.squared(vectors, centres)
    assert (best == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()
    assert computed < 5000 * 16 / 5


def test_whole_roots_are_exact():
    x = np.array([0, 1, 2, 3, 4, (1 << 31) ** 2 - 1, (1 << 31) ** 2, (1 << 31) ** 2 + 1, (1 << 62) - 1])
    assert P.whole_roots(x).tolist() == [math.isqrt(int(v)) for v in x]
