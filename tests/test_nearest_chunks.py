"""Targets beyond one chunk are scored chunk by chunk, with one chunk's broadcast at a time."""

import numpy as np
from pyspark.core.broadcast import Broadcast
from pyspark.core.context import SparkContext
from pyspark.sql import functions as F

from tidetrace.operators import similarity as sim


def test_one_chunk_is_held_at_a_time(spark, monkeypatch):
    m = np.random.default_rng(3).normal(size=(40, 6))
    posts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(99, None)], "post_id long, embedding array<float>")
    targets = posts.filter("embedding is not null").select((F.col("post_id") + 100).alias("cluster_id"), "embedding")
    base = sorted(tuple(r) for r in sim.nearest_target(posts.filter("post_id < 99"), targets, keep=["post_id"]).collect())
    assert [b[:2] for b in base] == [(i, i + 100) for i in range(40)]
    live, most = set(), []
    make, drop = SparkContext.broadcast, Broadcast.unpersist

    def broadcast(self, value):
        b = make(self, value)
        live.add(id(b))
        most.append(len(live))
        return b

    def unpersist(self, blocking=False):
        live.discard(id(self))
        return drop(self, blocking)

    monkeypatch.setattr(SparkContext, "broadcast", broadcast)
    monkeypatch.setattr(Broadcast, "unpersist", unpersist)
    monkeypatch.setattr(sim, "MAX_PACKED_VALUES", 60)  # 10 targets of 6 dims a chunk
    got = {r.post_id: (r.post_id, r.cluster_id, r.similarity) for r in sim.nearest_target(posts, targets, keep=["post_id"]).collect()}
    assert len(most) > 1 and max(most) == 1
    assert got[99] == (99, 100, 0.0) and [got[i] for i in range(40)] == base
