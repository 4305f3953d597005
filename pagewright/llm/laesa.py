"""Centroid clustering with a pivot table: k-means over exact whole numbers.

Every vector's distances to a few fixed pivots are computed once and stored
beside it.  A round knows its centroids' distances to the same pivots, and by the
triangle inequality no centroid is nearer than the largest difference of two
such distances.  The centroid of the least bound is measured first; only
centroids whose bound does not exceed that distance are measured besides, in
whole numbers.  So all results are exact, whatever the bounds leave out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

DIMENSIONS = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
PIVOTS = 24
SEED = 2
LARGEST = 2**27  # components of this size and more could overflow a distance
SLACK = 1e-4  # above the rounding of any difference of two distances
ROWS = 4096  # vectors worked on at a time


def whole_vectors(column: pa.Array, dimensions: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are vectors of finite numbers, and their floor(scale * x) as whole numbers."""
    column = column.cast(pa.large_list(pa.float64()))
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    good = np.flatnonzero(length == dimensions)
    flat = column.take(pa.array(good)).flatten()
    x = np.floor(pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).reshape(-1, dimensions) * scale)
    finite = np.isfinite(x).all(axis=1)
    if np.abs(x[finite]).max(initial=0) >= LARGEST:
        raise ValueError(f"a component times {scale} is {LARGEST} or more, its distances need not fit a long")
    return good[finite], x[finite].astype(np.int64)


def quantised(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(id, v): the vectors that count, as whole numbers.

    Null vectors, those of another length and those with a null, infinite or
    undefined component are left out; rows with one id or one vector stay apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = whole_vectors(batch.column("v"), dimensions, scale)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * dimensions)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32).ravel()))], ["id", "v"])

    held = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{column}`").alias("v"))
    return held.mapInArrow(run, "id long, v array<int>")


def first_centroids(whole: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors of the smallest sha256 of "seed:id", in that order; equal ids by their vectors, a null id as an empty one."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = whole.select("v", order.alias("h")).orderBy("h", "v").limit(clusters).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), len(rows[0].v) if rows else 0)


def choose_pivots(candidates: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Of the candidates, ``n`` that lie far from one another: each next one is the farthest from those before."""
    if not len(candidates):
        return candidates
    chosen = [0]
    near = squares(candidates, candidates[:1])[:, 0]
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, squares(candidates, candidates[chosen[-1:]])[:, 0])
    return candidates[chosen]


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to the few rows of ``b``."""
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, centroid_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (the smaller number on ties), squared distance, and how many distances were computed."""
    bound = np.zeros((len(x), len(centroids)))
    for p in range(to_pivots.shape[1]):
        np.maximum(bound, np.abs(to_pivots[:, p, None] - centroid_pivots[None, :, p]), out=bound)
    cluster = bound.argmin(axis=1) if len(centroids) else np.zeros(len(x), np.int64)
    distance = ((x - centroids[cluster]) ** 2).sum(axis=1)
    reach = np.sqrt(distance) + SLACK
    n = len(x)
    for c, centroid in enumerate(centroids):
        rows = np.flatnonzero((bound[:, c] <= reach) & (cluster != c))
        found = ((x[rows] - centroid) ** 2).sum(axis=1)
        n += len(rows)
        better = (found < distance[rows]) | (found == distance[rows]) & (c < cluster[rows])
        rows, found = rows[better], found[better]
        cluster[rows], distance[rows], reach[rows] = c, found, np.sqrt(found) + SLACK
    return cluster, distance, n


def _table(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, vectors and pivot distances of a batch, some thousand rows at a time."""
    for low in range(0, batch.num_rows, ROWS):
        part = batch.slice(low, ROWS)
        v, d = (part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) for c in ("v", "d"))
        yield part.column("id"), v.astype(np.int64), d


def with_pivots(whole: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, v, d): d are the distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int64)
            d = np.sqrt(squares(x, pivots))
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(pivots))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.ListArray.from_arrays(ends, pa.array(d.ravel()))], ["id", "v", "d"])

    return whole.mapInArrow(run, "id long, v array<int>, d array<double>")


def moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor of the mean of each one's vectors, its old place if it has none.

    Each task sums its own vectors by centroid, so clusters of any size are summed
    by all tasks; the driver gets one sum per centroid and component.
    """
    at_pivots = np.sqrt(squares(centroids, pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(centroids.shape, np.int64)
        counts = np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, x, d in _table(batch):
                cluster, _, _ = nearest(x, d, centroids, at_pivots)
                order = np.argsort(cluster, kind="stable")
                met, begin = np.unique(cluster[order], return_index=True)
                sums[met] += np.add.reduceat(x[order], begin, axis=0)
                counts[met] += np.diff(np.append(begin, len(x)))
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(counts[full]), pa.array(sums[full].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = table.mapInArrow(run, "cluster int, n long, sums array<long>")
    flat = parts.select("cluster", "n", F.posexplode("sums").alias("place", "part"))
    out = centroids.copy()
    for r in flat.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("part").alias("total")).collect():
        out[r.cluster, r.place] = r.total // r.n
    return out


def assigned(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(id, cluster, distance): the nearest centroid of every vector."""
    at_pivots = np.sqrt(squares(centroids, pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, d in _table(batch):
                cluster, distance, _ = nearest(x, d, centroids, at_pivots)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return table.mapInArrow(run, "id long, cluster int, distance long")


def clusters(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS,
             dimensions: int = DIMENSIONS, scale: int = SCALE, pivots: int = PIVOTS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per vector that counts, final centroids).

    The inertias are the distances summed over the vector's cluster and over all.
    Fewer vectors than ``k`` make fewer clusters; no vectors give no rows.  Of equal
    first centroids the later one stays empty and where it is.  Rows with one id
    are clustered each for itself; see ``quantised`` for what is left out.  Other
    columns are not read.  Tasks and driver hold k x dimensions numbers, whatever
    the number of vectors; a component of 2**27 and more after scaling is an error.
    """
    whole = stage(quantised(vectors, key, column, dimensions, scale), "vectors")
    centroids = first_centroids(whole, k, seed)
    fixed = choose_pivots(centroids, pivots)
    table = stage(with_pivots(whole, fixed), "pivot-table")
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(table, centroids, fixed)
    found = stage(assigned(table, centroids, fixed), "clusters")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()
    inertia = sum(r.n for r in sums)
    digests = centroid_digests(centroids)
    # One row per cluster, so all tasks can have them.
    facts = vectors.sparkSession.createDataFrame([(r.cluster, r.n, inertia, digests[r.cluster]) for r in sums],
                                                 "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster"), centroids


def centroid_digests(centroids: np.ndarray) -> list[str]:
    """sha256 of each centroid's components, as decimal numbers joined by commas."""
    return [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
