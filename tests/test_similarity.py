import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidetrace.operators import similarity as sim
from tidetrace.operators.trace import date_range, trace_summary


def _vec_posts(spark, n=60, d=8, seed=3):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d))
    m[5] = 0.0  # a zero vector scores 0
    return m, spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(n)], "post_id long, embedding array<float>")


@pytest.mark.parametrize("method", ["expr", "arrow"])
def test_score_vectors_brute_force(spark, method):
    m, posts = _vec_posts(spark)
    targets = posts.where(F.col("post_id").isin(0, 1, 2)).select(F.col("post_id").alias("narrative_id"), "embedding")
    got = sim.score_vectors(posts, targets, threshold=0.2, keep=["post_id"], method=method).toPandas()
    m32 = m.astype(np.float32).astype(np.float64)
    exp = set()
    for i in range(len(m32)):
        for t in (0, 1, 2):
            den = np.linalg.norm(m32[i]) * np.linalg.norm(m32[t])
            c = round(float(m32[i] @ m32[t] / den), 6) if den else 0.0
            if c >= 0.2:
                exp.add((i, t, c))
    assert {(int(a), int(b), round(float(c), 6)) for a, b, c in got.itertuples(index=False)} == exp


def test_nearest_target_ties_to_lowest_id(spark):
    posts = spark.createDataFrame([(1, [1.0, 0.0])], "post_id long, embedding array<float>")
    cents = spark.createDataFrame([(7, [1.0, 0.0]), (3, [2.0, 0.0])], "cluster_id long, embedding array<float>")
    r = sim.nearest_target(posts, cents, keep=["post_id"]).first()
    assert r["cluster_id"] == 3 and r["similarity"] == 1.0


def test_lexical_brute_force(spark):
    posts = [(1, "the cat sat on the mat"), (2, "Dogs bark\nloudly"), (3, "   "), (4, "cat cat cat")]
    narrs = [(10, "the cat"), (11, "dogs and cats bark")]
    p = spark.createDataFrame(posts, "post_id long, Tweet string")
    n = spark.createDataFrame(narrs, "narrative_id long, text string")
    got = {(r["post_id"], r["narrative_id"]): r["similarity"]
           for r in sim.score_lexical(p, n).collect()}

    def vec(s):
        return Counter(t for t in s.lower().split() if t)
    exp = {}
    for pid, pt in posts:
        for nid, nt in narrs:
            a, b = vec(pt), vec(nt)
            d = sum(a[k] * b[k] for k in a)
            if d:
                exp[(pid, nid)] = round(d / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())), 6)
    assert got == exp


def test_top_k_and_partition_invariance(spark):
    _, posts = _vec_posts(spark)
    targets = posts.where(F.col("post_id") < 3).select(F.col("post_id").alias("narrative_id"), "embedding")
    scores = sim.score_vectors(posts, targets, keep=["post_id"])
    base = sorted(tuple(r) for r in sim.top_k_per_narrative(scores, 5).collect())
    assert len(base) == 15
    for parts in (1, 16):
        again = sorted(tuple(r) for r in sim.top_k_per_narrative(scores.repartition(parts), 5).collect())
        assert again == base


def test_date_range_inclusive_and_summary(spark):
    import datetime as dt
    df = spark.createDataFrame([(1, dt.datetime(2020, 11, 30, 23, 0)), (2, dt.datetime(2020, 12, 1, 0, 0)),
                                (3, dt.datetime(2020, 12, 1, 10, 0))], "post_id long, Datetime timestamp_ntz")
    assert sorted(r[0] for r in date_range(df, "2020-11-30", "2020-12-01").select("post_id").collect()) == [1, 2]
    assert sorted(r[0] for r in date_range(df, "2020-11-30", "2020-12-01", end_inclusive_day=True)
                  .select("post_id").collect()) == [1, 2, 3]
    s = trace_summary(df.withColumn("similarity", F.lit(0.5)).withColumn("narrative_id", F.lit(1)),
                      ["narrative_id"]).first()
    assert s["total_posts"] == 3 and s["sum_similarity"] == 1.5
