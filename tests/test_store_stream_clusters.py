"""Embedding store, streaming log, write width, deterministic k-means and dominant narratives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidetrace.operators import cluster as cl
from tidetrace.operators import embed as em
from tidetrace.operators import similarity as sim
from tidetrace.operators import stance as st
from tidetrace.operators.fixed_kmeans import STEPS, spherical_kmeans, unit_vectors
from tidetrace.sinks import writers as wr
from tidetrace.sources import pairs as pa
from tidetrace.streaming import trace_stream as ts


def test_upsert_is_idempotent_and_replaces(spark, tmp_path):
    path = str(tmp_path / "store")
    def table(rows):
        return spark.createDataFrame(rows, "text_key string, model string, embedding array<float>")

    one = table([(f"k{i}", "m", [float(i)]) for i in range(500)])
    for _ in range(2):  # a retry adds no row
        em.upsert_embeddings(one, path)
    before = {f.file: f.at for f in spark.read.parquet(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("at")).distinct().collect()}
    em.upsert_embeddings(table([("k7", "m", [70.0]), ("k7", "other", [7.5]), ("new", "m", [9.0]), ("new", "m", [9.0])]), path)
    got = {(r.text_key, r.model): r.embedding[0] for r in em.read_embedding_table(spark, path).collect()}
    assert len(got) == 502 and got["k7", "m"] == 70.0 and got["k7", "other"] == 7.5 and got["new", "m"] == 9.0 and got["k8", "m"] == 8.0
    assert em.read_embedding_table(spark, path).count() == 502
    after = {f.file for f in spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file")).distinct().collect()}
    assert len(after & set(before)) >= len(before) - 3 * 4  # untouched buckets keep their files


def test_missing_path_is_an_empty_table_and_a_broken_one_an_error(spark, tmp_path):
    assert em.read_embedding_table(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        em.read_embedding_table(spark, str(tmp_path / "broken")).count()


def test_attach_keeps_posts_without_a_vector(spark):
    posts = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "post_id long, Tweet string")
    table = spark.createDataFrame([("a", "m", [1.0]), ("a", "m", [1.0]), ("b", "x", [2.0])], "t string, model string, embedding array<float>") \
        .select(F.sha2("t", 256).alias("text_key"), "model", "embedding")
    got = {r.post_id: r.embedding for r in em.attach_embeddings(posts, table, model="m").collect()}
    assert got == {1: [1.0], 2: None, 3: None, 4: [1.0]}


def test_late_rows_are_kept_apart_and_together_equal_the_batch(spark, tmp_path):
    days = [5, 3, 9, 1, 9, 2, 12, 4]  # one file, one trigger each
    rows = [(i, f"2024-01-{d:02d} 10:00:00", "c", 0.25 + d / 1000) for i, d in enumerate(days)]
    schema = "post_id long, at string, ChannelName string, similarity double"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ts.read_parquet_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, max_files=1)
    scored = stream.withColumn("Datetime", F.col("at").cast("timestamp_ntz"))
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        ts.run_to_completion(ts.start_timeline_log(scored, out, str(tmp_path / "ckpt"), by=["ChannelName"], lateness="1 day"))
    log = spark.read.parquet(f"{out}/sums")
    assert log.select("batch_id").distinct().count() == len(days)

    def table(df):
        return {str(r.bucket_start)[:10]: (r.n_posts, r.sum_similarity, r.max_similarity) for r in df.collect()}

    want = {}
    for d in days:
        n, s, m = want.get(f"2024-01-{d:02d}", (0, 0.0, 0.0))
        want[f"2024-01-{d:02d}"] = (n + 1, round(s + 0.25 + d / 1000, 6), max(m, 0.25 + d / 1000))
    assert table(ts.timeline_of(log, ["ChannelName"])) == want
    late, on_time = (table(ts.timeline_of(log, ["ChannelName"], late=x)) for x in (True, False))
    assert sum(v[0] for v in late.values()) + sum(v[0] for v in on_time.values()) == len(days)
    assert 1 <= sum(v[0] for v in late.values()) <= 6 and "2024-01-12" in on_time
    ts.compact_timeline(spark, out, ["ChannelName"], str(tmp_path / "small"))
    assert table(ts.timeline_of(spark.read.parquet(str(tmp_path / "small")), ["ChannelName"])) == want


def test_kmeans_has_the_same_bits_for_any_partitioning(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.2, (40, 6)) for m in (-1, 0.5, 2)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 6), (901, None)],
                               "post_id long, embedding array<double>")
    runs = []
    for n in (1, 3, 7):
        labels, centres = spherical_kmeans(df.repartition(n), 3, seed=1)
        runs.append((sorted(map(tuple, labels.collect())), centres))
    assert runs[0] == runs[1] == runs[2] and len(runs[0][0]) == 120
    u = {r.post_id: np.array(r.u, object) for r in unit_vectors(df).collect()}
    c = np.array(runs[0][1], object)
    for post, label in runs[0][0]:  # every label is the nearest centre
        d = c @ u[post]
        assert d[label] == d.max() and (d[:label] < d.max()).all()
    for k in range(3):  # and every centre the direction of its posts
        own = sum(u[p] for p, label in runs[0][0] if label == k)
        assert np.abs(own.astype(float) / np.linalg.norm(own.astype(float)) * STEPS - c[k].astype(float)).max() <= 1


def test_near_copies_do_not_fill_both_narratives(spark):
    rng = np.random.default_rng(6)
    big, small = np.array([1.0, 0, 0, 0.2]), np.array([0.2, 1.0, 0, 0])
    x = [(big + rng.normal(0, 0.01, 4)).tolist() for _ in range(30)] + [(small + rng.normal(0, 0.01, 4)).tolist() for _ in range(10)]
    rows = [(0, i, v, float(np.dot(v, big) / np.linalg.norm(v) / np.linalg.norm(big))) for i, v in enumerate(x)]
    rows += [(0, 100 + i, x[0], rows[0][3]) for i in range(5)] + [(1, 200, [0.0, 0.0, 1.0, 0.0], 1.0), (None, 300, [1.0] * 4, 0.0)]
    df = spark.createDataFrame(rows, "cluster_id long, post_id long, embedding array<double>, similarity double")
    got = {r.cluster_id: r for r in cl.dominant_narratives(df, candidates=40).collect()}
    assert got[0].narrative_1 < 30 and 30 <= got[0].narrative_2 < 40 and got[0].n_posts == 45
    assert got[0].cover_2 > got[0].cover_1 + 0.1
    assert (got[1].narrative_1, got[1].narrative_2, got[1].cover_1) == (200, None, 1.0)
    assert set(got) == {0, 1}


def test_a_channel_is_written_by_as_many_tasks_as_its_bytes_need(spark, tmp_path):
    rows = [(i, "hot" if i % 3 else f"c{i % 9}", "x" * 200) for i in range(3000)]
    df = spark.createDataFrame(rows, "post_id long, ChannelName string, Tweet string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        wr.write_by_channel(df, str(tmp_path / "w"), task_bytes=20_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(str(tmp_path / "w")).count() == 3000
    salts = spark.read.parquet(str(tmp_path / "w")).where("channel_key = 'hot'").select(F.col("_metadata.file_path")).distinct().count()
    assert salts > 1


def test_small_items(spark, tmp_path):
    # stance by post and narrative
    posts = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.5)], "post_id long, narrative_id long, similarity double")
    answers = spark.createDataFrame([(1, 10, '{"support":1}'), (1, 11, '{"opposition":1}')], "post_id long, narrative_id long, response string")
    got = {r.narrative_id: r.polarity for r in st.attach_stance(posts, st.parse_stance(answers)).collect()}
    assert got == {10: "support", 11: "opposition"}
    # pair ids come from the pairs
    (tmp_path / "p.csv").write_text('sentence1,sentence2,label\n"a, b",c,5\nx,"y\nz",bad\n')
    ids = [{r.sentence1: (r.pair_id, r.gold_score) for r in pa.read_pairs(spark, str(tmp_path / "p.csv"), "csv").repartition(n).collect()} for n in (1, 3)]
    assert ids[0] == ids[1] and ids[0]["a, b"][1] == 1.0 and ids[0]["x"][1] is None
    # an unknown narrative falls back to the first
    scores = spark.createDataFrame([(1, 3, 0.5), (2, 3, 0.1), (1, 4, 0.9)], "post_id long, narrative_id long, similarity double")
    narratives = spark.createDataFrame([(4,), (3,)], "narrative_id long")
    assert [r.post_id for r in sim.sort_by_narrative(scores, 77, narratives=narratives).collect()] == [2, 1]
    assert [r.post_id for r in sim.sort_by_narrative(scores, 4, narratives=narratives).collect()] == [1]
