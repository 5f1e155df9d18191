"""The paths taken beyond each size bound give the same results."""

import numpy as np
from pyspark.sql import functions as F

from tidetrace.functions import ranking
from tidetrace.operators import similarity as sim


def _posts(spark, n=40, d=6):
    m = np.random.default_rng(11).normal(size=(n, d))
    return spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(n)], "post_id long, embedding array<float>")


def test_chunked_targets_equal_single_chunk(spark, monkeypatch):
    p = _posts(spark)
    t = p.select(F.col("post_id").alias("narrative_id"), "embedding")
    base = sorted(tuple(r) for r in sim.score_vectors(p, t, threshold=0.1, keep=["post_id"], method="expr").collect())
    monkeypatch.setattr(sim, "MAX_PACKED_VALUES", 30)  # 5 targets of 6 dims per chunk -> many chunks
    chunks, _ = sim._target_chunks(t, "narrative_id", "embedding")
    assert len(chunks) > 1
    again = sorted(tuple(r) for r in sim.score_vectors(p, t, threshold=0.1, keep=["post_id"]).collect())
    assert again == base


def test_lexical_shuffle_join_equals_broadcast(spark, monkeypatch):
    posts = spark.createDataFrame([(1, "a b c a"), (2, "b b d"), (3, "e")], "post_id long, Tweet string")
    narrs = spark.createDataFrame([(7, "a b"), (8, "d e e")], "narrative_id long, text string")
    base = sorted(tuple(r) for r in sim.score_lexical(posts, narrs).collect())
    monkeypatch.setattr(sim, "MAX_BROADCAST_TOKEN_ROWS", 0)
    again = sorted(tuple(r) for r in sim.score_lexical(posts, narrs).collect())
    assert again == base and len(base) == 4


def test_positions_without_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, "hot" if i % 2 else f"g{i % 5}") for i in range(200)], "id long, g string")
    base = sorted(tuple(r) for r in ranking.group_positions(df, ["g"], ["id"]).collect())
    monkeypatch.setattr(ranking, "MAX_BROADCAST_OFFSET_ROWS", 0)
    again = sorted(tuple(r) for r in ranking.group_positions(df, ["g"], ["id"]).collect())
    assert again == base


def test_lexical_co_partition_equal(spark):
    posts = spark.createDataFrame([(1, "a b c a"), (2, "b b d"), (3, "e"), (4, None)], "post_id long, Tweet string")
    narrs = spark.createDataFrame([(7, "a b"), (8, "d e e")], "narrative_id long, text string")
    a = sorted(tuple(r) for r in sim.score_lexical(posts, narrs).collect())
    b = sorted(tuple(r) for r in sim.score_lexical(posts, narrs, co_partition=True).collect())
    assert a == b and len(a) == 4
