"""Centroid clustering of integer vectors with a LAESA pivot table.

Vectors become integers floor(1024 * x). The distances of every vector to fixed pivots
(the first centroids) are computed once and stored beside it. In each round the
distances of the moved centroids to the pivots are known, and for every pivot p
|d(x, p) - d(c, p)| <= d(x, c): the largest difference bounds a centroid's distance
from below. The centroid of the least bound is measured exactly; only centroids whose
bound does not exceed that distance survive and receive exact integer distances. The
bounds are lowered by a slack far above their rounding error, so no centroid that could
win or tie is lost.

Every round is one pass over the written pivot table without a shuffle of vectors; a
task returns counts and sums of its centroids, and the driver holds centroids only.

Defined cases: vectors that are null, hold null or non-finite components or have
another number of components are dropped; fewer kept vectors than centroids give fewer
centroids; the first centroids go by the hash of the id (null ids last), then by the
vector, and repeated rows each count; vectors too large for exact doubles have no
pivot distances and are compared with every centroid in Python integers; distances and
their sums stay at the largest long beyond it; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidetrace.llm.common import drop_table, long_lists, write_table
from tidetrace.llm.int_vectors import (LARGEST, SUMS, Sums, as_ints, as_long, capped_sum, compact, distances, exact, finite, matrix,
                                       means, pair_distances, scaled)

CENTROIDS, ROUNDS, COMPONENTS = 8, 10, 64
SLACK = 1e-9  # relative; square roots of integers below 2**53 are right to 2**-52


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors of least sha256('<seed>:<id>'), in that order."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.select("vector", drawn.alias("draw")).orderBy(F.asc_nulls_last("draw"), "vector").limit(k).collect()
    found = [exact(np.array(r.vector, np.float64).reshape(1, -1)) for r in first]
    return compact(np.concatenate(found)) if found else np.zeros((0, 0))


def _pivot_table(pivots: np.ndarray):
    """Rows (id, vector, far): far holds the distances to the pivots, or nothing for large vectors."""
    def run(batches):
        for batch in batches:
            x = matrix(batch.column("vector"))
            v, small = scaled(x) if len(x) else (x, np.zeros(0, bool))
            far = np.zeros((len(x), len(pivots)))
            if pivots.dtype == object:
                small[:] = False
            elif small.any():
                far[small] = np.sqrt(distances(v[small], pivots))
            ptr = np.concatenate([[0], np.cumsum(np.where(small, len(pivots), 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vector"),
                 pa.ListArray.from_arrays(pa.array(ptr), pa.array(far[small].ravel()))], names=["id", "vector", "far"])
    return run


def survivors(far: np.ndarray, centre_far: np.ndarray) -> np.ndarray:
    """Lower bounds of the distances of rows to centroids (rows x centroids)."""
    bound = np.zeros((len(far), len(centre_far)))
    for p in range(far.shape[1]):
        gap = np.abs(far[:, p:p + 1] - centre_far[None, :, p])
        gap -= SLACK * (1.0 + far[:, p:p + 1] + centre_far[None, :, p])
        np.maximum(bound, gap, out=bound)
    return bound


def assign(v: np.ndarray, far: np.ndarray, centres: np.ndarray, centre_far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties to the smaller number) and exact squared distance."""
    bound = survivors(far, centre_far)
    cluster = bound.argmin(axis=1)
    best = pair_distances(v, centres[cluster])
    first = cluster.copy()
    square = bound * bound
    for c in range(len(centres)):
        rows = np.flatnonzero((square[:, c] <= best) & (first != c))
        if len(rows):
            d = pair_distances(v[rows], centres[c][None, :])
            wins = (d < best[rows]) | ((d == best[rows]) & (c < cluster[rows]))
            cluster[rows[wins]], best[rows[wins]] = c, d[wins]
    return cluster, best


def _nearest(batch: pa.RecordBatch, centres: np.ndarray, centre_far: np.ndarray | None):
    """(rows within exact doubles?, their integers, cluster, distance) of a batch, in two groups."""
    x = matrix(batch.column("vector"))
    v, small = scaled(x)
    if centre_far is None:
        small = np.zeros(len(x), bool)
    rows = np.flatnonzero(small)
    if len(rows):
        far = matrix(batch.column("far").take(pa.array(rows)))
        cluster, best = assign(v[rows], far, centres, centre_far)
        yield rows, v[rows], cluster, as_long(best)
    rows = np.flatnonzero(~small)
    if len(rows):
        big = exact(x[rows])
        d = distances(big, as_ints(centres))
        cluster = np.array([min(range(len(centres)), key=lambda c, r=r: (r[c], c)) for r in d.tolist()], np.int64)
        yield rows, big, cluster, as_long(d[np.arange(len(rows)), cluster])


def _sums(centres: np.ndarray, centre_far: np.ndarray | None):
    def run(batches):
        sums = Sums()
        for batch in batches:
            if batch.num_rows:
                for _, v, cluster, _ in _nearest(batch, centres, centre_far):
                    sums.add(0, 0, v, cluster, len(centres))
        yield sums.batch()
    return run


def _final(centres: np.ndarray, centre_far: np.ndarray | None):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cluster, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
                for rows, _, c, d in _nearest(batch, centres, centre_far):
                    cluster[rows], distance[rows] = c, d
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster), pa.array(distance)],
                                                 names=["id", "cluster", "distance"])
    return run


def cluster_vectors(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
                    centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: str = "3") -> tuple[DataFrame, np.ndarray]:
    """(rows, centroids): one row per kept vector with key, cluster, distance, cluster_inertia,
    inertia and centroid_sha256; the final centroids as integers."""
    if centroids < 1 or rounds < 0 or components < 1:
        raise ValueError("centroids and components must be at least 1, rounds at least 0")
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("vector")).filter(
        finite("vector") & (F.size("vector") == components))
    kind = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
    centres = first_centroids(rows, centroids, seed)
    pivots = centres
    _, staged = write_table(rows.mapInArrow(
        _pivot_table(pivots), f"id {kind['id']}, vector {kind['vector']}, far array<double>"),
        f"pivots-{uuid.uuid4().hex}")

    def centre_far() -> np.ndarray | None:
        return None if object in (centres.dtype, pivots.dtype) else np.sqrt(distances(centres, pivots))

    for _ in range(rounds if len(centres) else 0):
        new = means(staged.select("vector", "far").mapInArrow(_sums(centres, centre_far()), SUMS)).get((0, 0), {})
        moved = as_ints(centres)
        for c, centre in new.items():
            moved[c] = centre
        centres = compact(moved)
    found_path, found = write_table(staged.mapInArrow(
        _final(centres, centre_far()), f"id {kind['id']}, cluster int, distance bigint"), f"clusters-{uuid.uuid4().hex}")
    sums = {r.cluster: r.total for r in found.groupBy("cluster").agg(capped_sum("distance").alias("total")).collect()}
    hashes = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centres.tolist()]
    total = min(sum(sums.values()), LARGEST)
    per = F.array(*[F.lit(sums.get(c, 0)).cast("long") for c in range(len(centres))]) if len(centres) else F.array().cast(
        "array<bigint>")
    sha = F.array(*map(F.lit, hashes)) if hashes else F.array().cast("array<string>")
    return found.select(F.col("id").alias(key), "cluster", "distance",
                        F.get(per, F.col("cluster")).alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"),
                        F.get(sha, F.col("cluster")).alias("centroid_sha256")), centres
