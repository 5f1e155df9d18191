"""Scores against many targets: one chunk's broadcast at a time, bounded tiles, streams."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.core.broadcast import Broadcast
from pyspark.core.context import SparkContext
from pyspark.sql import functions as F

from tidetrace.operators import similarity as sim


@pytest.fixture
def posts(spark):
    m = np.random.default_rng(5).normal(size=(40, 6))
    rows = [(i, None if i % 7 == 0 else i, v.tolist()) for i, v in enumerate(m)]
    return spark.createDataFrame(rows + [(98, 1, [0.0] * 6), (99, None, None)],
                                 "post_id long, likes long, embedding array<float>")


def _targets(posts):
    return posts.filter("post_id < 40").select((F.col("post_id") + 100).alias("narrative_id"), "embedding")


def _rows(df):
    return sorted(df.collect(), key=lambda r: (r.post_id, r.narrative_id))


@pytest.mark.parametrize("threshold", [None, 0.1])
def test_one_chunk_is_held_at_a_time(spark, posts, monkeypatch, threshold):
    base = _rows(sim.score_vectors(posts, _targets(posts), threshold=threshold, method="expr"))
    assert len(base) == (42 * 40 if threshold is None else len(base)) and base
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
    got = _rows(sim.score_vectors(posts, _targets(posts), threshold=threshold))
    assert got == base
    assert len(most) > 2 and max(most) == 1


def test_tiles_are_bounded(monkeypatch):
    class Shared:
        value = (np.arange(3), np.eye(3))

    monkeypatch.setattr(sim, "TILE_SCORES", 7)  # two posts a tile
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([[1.0, 0, 0], None, [0.0, 2, 0], [0.0] * 3, [0.0, 0, 3]])],
                                       names=["post_id", "_v"])
    out = list(sim._score_pass(Shared, None)([batch.slice(0, 2), batch.slice(2)]))
    assert [b.num_rows for b in out] == [6, 6, 3]
    best = {(r["post_id"], r["narrative_id"]): r["_raw"] for b in out for r in b.to_pylist()}
    assert {k for k, v in best.items() if v == 1.0} == {(0, 0), (2, 1), (4, 2)} and sum(best.values()) == 3


def test_no_targets(posts):
    assert sim.score_vectors(posts, _targets(posts).limit(0), method="arrow").count() == 0


def test_matrix_path_on_a_stream(spark, posts, tmp_path):
    posts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(posts.schema).parquet(str(tmp_path / "in"))
    scored = sim.score_vectors(stream, _targets(posts), threshold=0.1, method="arrow")
    (scored.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ckpt"))
     .trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120))
    got = _rows(spark.read.parquet(str(tmp_path / "out")))
    assert [tuple(r) for r in got] == [tuple(r) for r in _rows(sim.score_vectors(posts, _targets(posts), threshold=0.1))]
