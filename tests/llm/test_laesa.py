"""Clustering against plain Python: bounds, exact distances, ties, edges."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.llm import laesa

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=laesa.CLUSTERS, rounds=laesa.ROUNDS, dims=laesa.DIMENSIONS):
    """(id, cluster, distance) and centroids, number by number."""
    whole = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows
             if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(whole, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in whole:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [tuple(sum(x) // len(groups[n]) for x in zip(*groups[n])) if n in groups else c for n, c in enumerate(centroids)]
    return sorted(((i, *reversed(near(v))) for i, v in whole), key=repr), centroids


def as_float32(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def check(spark, rows, **more):
    rows = as_float32(rows)
    found, centroids = laesa.clusters(spark.createDataFrame(rows, SCHEMA).repartition(3), **more)
    got = found.collect()
    want, finals = brute(rows, more.get("k", laesa.CLUSTERS), more.get("rounds", laesa.ROUNDS), more.get("dimensions", laesa.DIMENSIONS))
    assert sorted(((r.id, r.cluster, r.distance) for r in got), key=repr) == want
    assert centroids.tolist() == [list(c) for c in finals]
    total = sum(d for *_, d in want)
    for r in got:
        assert r.inertia == total and r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, finals[r.cluster])).encode()).hexdigest()
    return got


def test_clusters_equal_brute_force(spark):
    rng = random.Random(3)
    middles = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in middles[i % 12]]) for i in range(300)]
    check(spark, rows)


def test_ties_repeats_and_hot_vectors(spark):
    """Few whole numbers, so that many distances are equal; a third of the rows is one vector."""
    rng = random.Random(4)
    rows = [(rng.randrange(60), [rng.choice((0, 1 / 256, 2 / 256, -1 / 512)) for _ in range(3)]) for _ in range(200)]
    rows += [(1000 + i, [0.5, 0.5, 0.5]) for i in range(100)] + [(7, [0.5, 0.5, 0.5])] * 3 + [(None, [1.0, 2.0, 3.0])] * 2
    check(spark, rows, k=9, dimensions=3)


def test_rows_that_do_not_count(spark):
    good = [(i, [float(i), -float(i)]) for i in range(5)]
    bad = [(10, None), (11, []), (12, [1.0]), (13, [1.0, None]), (14, [1.0, math.nan]), (15, [math.inf, 1.0]), (16, [1.0, 2.0, 3.0])]
    got = check(spark, good + bad, dimensions=2)
    assert sorted(r.id for r in got) == [0, 1, 2, 3, 4] and {r.distance for r in got} == {0}


def test_no_vectors_and_other_columns(spark):
    none = spark.createDataFrame([(1, None), (2, [1.0])], SCHEMA)
    assert laesa.clusters(none)[0].count() == 0
    assert laesa.clusters(none.limit(0))[0].count() == 0
    rows = [(i, [float(i % 4)] * 4) for i in range(20)]
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "v", "d", "cluster", "distance", "inertia")})
    assert laesa.clusters(clash, dimensions=4, k=4)[0].count() == 20
    doubles = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert laesa.clusters(doubles, dimensions=4, k=4)[0].filter("inertia <> 0").count() == laesa.clusters(clash, dimensions=4, k=4)[0].filter("inertia <> 0").count()


def test_numbers_too_large_are_an_error():
    with pytest.raises(ValueError):
        laesa.whole_vectors(pa.array([[1e9, 0.0]]), 2, 256)
    assert laesa.whole_vectors(pa.array([[float(2**18), -1e-9]]), 2, 256)[1].tolist() == [[2**26, -1]]


def test_bounds_leave_out_only_what_is_farther():
    rng = np.random.default_rng(8)
    middles = rng.integers(-200, 200, (40, 64))
    x = (middles[rng.integers(0, 40, 5000)] + rng.integers(-12, 13, (5000, 64))).astype(np.int64)
    pivots = laesa.choose_pivots(middles, laesa.PIVOTS)
    assert len(pivots) == laesa.PIVOTS
    centroids = np.concatenate([middles[:20], middles[:20] + 1])
    cluster, distance, measured = laesa.nearest(x, np.sqrt(laesa.squares(x, pivots)), centroids, np.sqrt(laesa.squares(centroids, pivots)))
    table = laesa.squares(x, centroids)
    assert (distance == table.min(axis=1)).all() and (cluster == table.argmin(axis=1)).all()
    assert measured < 0.5 * table.size


def test_pivots_are_distinct():
    same = np.ones((5, 3), np.int64)
    assert len(laesa.choose_pivots(same, 4)) == 1
    assert len(laesa.choose_pivots(same[:0], 4)) == 0
    assert laesa.choose_pivots(np.array([[0], [1], [10], [4]]), 3).ravel().tolist() == [0, 10, 4]
