"""Cluster means are summed in batches; sides with a row per cluster are broadcast only when small."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidetrace.operators import cluster as cl


def _assigned(spark):
    m = np.random.default_rng(9).normal(size=(60, 5)).astype(np.float32)
    t = dt.datetime(2024, 1, 1)
    rows = [(i, 7 if i % 3 else i % 2, f"ch{i % 4}", v.tolist(), t + dt.timedelta(hours=i)) for i, v in enumerate(m)]
    return spark.createDataFrame([*rows, (60, 7, "ch0", None, t), (61, None, "ch0", [1.0] * 5, t), (62, 9, "ch1", None, t),
                                  (63, 8, "ch1", [], t)],
                                 "post_id long, cluster_id long, ChannelName string, embedding array<float>, Datetime timestamp_ntz")


def test_means_equal_numpy(spark):
    assigned = _assigned(spark).repartition(3)
    got = {r.cluster_id: r.embedding for r in cl.mean_vectors(assigned).collect()}
    own = {}
    for r in assigned.where("cluster_id is not null and size(embedding) > 0").collect():
        own.setdefault(r.cluster_id, []).append(r.embedding)
    assert got.keys() == own.keys() == {0, 1, 7}
    for c, vectors in own.items():
        assert np.allclose(got[c], np.mean(vectors, axis=0), atol=1e-12)


def test_vectors_of_two_lengths_and_null_components(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("a", [3.0]), ("a", [None, 4.0]), ("b", [5.0])],
                               "cluster_id string, embedding array<double>").coalesce(1)
    got = {r.cluster_id: list(r.embedding) for r in cl.mean_vectors(df).collect()}
    assert got == {"a": [2.0, 3.0, 3.0], "b": [5.0]}


def test_large_sides_are_joined_by_a_shuffle(spark, monkeypatch):
    assigned = _assigned(spark)
    texts = assigned.withColumn("Tweet", F.concat_ws(" ", F.lit("word"), "ChannelName"))
    base = [sorted(map(tuple, f.collect())) for f in (cl.cluster_profile(assigned), cl.cluster_terms(texts))]
    monkeypatch.setattr(cl, "MAX_SIDE_VALUES", 0)
    again = [sorted(map(tuple, f.collect())) for f in (cl.cluster_profile(assigned), cl.cluster_terms(texts))]
    assert base == again and [r[0] for r in base[0]] == [0, 1, 7]
