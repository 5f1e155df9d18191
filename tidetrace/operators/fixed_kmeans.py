"""Spherical k-means whose result does not depend on partitioning (CLU1, CLU2).

Posts' vectors become unit vectors in fixed point (2**20 steps). A round assigns every
post to the centre of the largest integer dot product, ties to the lower number; the new
centre is the direction of its posts' sum, again in fixed point. Sums are integers, so any
order of adding gives the same bits. The first centres are the posts of the least
sha256('<seed>:<post_id>'). A centre without posts stays.

A round is one pass over the staged unit vectors; a task returns its sums, and the driver
holds centres only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidetrace.functions.vectors import norm
from tidetrace.session import ensure_checkpoint_dir

STEPS = 1 << 20


def unit_vectors(posts: DataFrame, *, vec_col: str = "embedding") -> DataFrame:
    """(post_id, u): fixed-point unit vectors of the posts whose vector has a direction."""
    length = norm(F.col(vec_col))
    usable = posts.where(F.coalesce(length > 0, F.lit(False)) & ~F.isnan(length) & (length < float("inf")))
    u = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") / F.col("_length") * STEPS + 0.5).cast("int"))
    return usable.withColumn("_length", length).select("post_id", u.alias("u"))


def fixed_direction(total: list[int]) -> list[int]:
    """The direction of an integer vector in fixed point; zeros have none."""
    length = math.sqrt(float(sum(x * x for x in total)))
    return [math.floor(x / length * STEPS + 0.5) if length else 0 for x in total]


def _nearest(batch: pa.RecordBatch, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = batch.column("u").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
    if u.shape[1] != centres.shape[1]:
        raise ValueError(f"vectors of {u.shape[1]} and {centres.shape[1]} components")
    return u, (u @ centres.T).argmax(axis=1)  # the first of equal products


def _sums(shared):
    def run(batches):
        centres = shared.value
        total = np.zeros((len(centres), centres.shape[1] + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                u, cluster = _nearest(batch, centres)
                np.add.at(total, cluster, np.hstack([u, np.ones((len(u), 1), np.int64)]))
        c, pos = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(pos), pa.array(total[c, pos])], names=["c", "pos", "n"])
    return run


def _labels(shared):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("post_id"), pa.array(_nearest(batch, shared.value)[1])],
                                                 names=["post_id", "cluster_id"])
    return run


def spherical_kmeans(posts: DataFrame, k: int, *, seed: int = 42, vec_col: str = "embedding",
                     max_iter: int = 20) -> tuple[DataFrame, list[list[int]]]:
    """(post_id, cluster_id) of posts with a direction, and the centres in fixed point."""
    ensure_checkpoint_dir(posts.sparkSession)
    units = unit_vectors(posts, vec_col=vec_col).checkpoint(eager=True)
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("post_id").cast("string")), 256)
    first = units.orderBy(draw, "post_id").limit(k).collect()
    if len(first) < k:
        raise ValueError(f"{len(first)} posts cannot form {k} clusters")
    centres = [list(r["u"]) for r in first]
    sc = posts.sparkSession.sparkContext
    for _ in range(max_iter):
        shared = sc.broadcast(np.array(centres, np.int64))
        rows = units.select("u").mapInArrow(_sums(shared), "c bigint, pos bigint, n bigint").groupBy("c", "pos").agg(
            F.sum("n").alias("n")).collect()  # k x (components + 1) rows
        shared.unpersist()
        dims = len(centres[0])
        total = [[0] * (dims + 1) for _ in range(k)]
        for r in rows:
            total[r["c"]][r["pos"]] = r["n"]
        new = [fixed_direction(t[:dims]) if t[dims] and any(t[:dims]) else c for t, c in zip(total, centres)]
        if new == centres:
            break
        centres = new
    kind = units.schema["post_id"].dataType.simpleString()
    labels = units.mapInArrow(_labels(sc.broadcast(np.array(centres, np.int64))), f"post_id {kind}, cluster_id bigint")
    return labels, centres
