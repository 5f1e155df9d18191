"""Sources, sinks, embedding table and streaming: each query writes into the
shared checkpoint folder and reads back, so the round trip itself is checked."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidetrace.operators import embed as em
from tidetrace.operators import evaluate as ev
from tidetrace.operators import similarity as sim
from tidetrace.operators import trace as tr
from tidetrace.plans import cluster_queries as cq
from tidetrace.plans import eval_queries as eq
from tidetrace.plans import trace_queries as tq
from tidetrace.plans.registry import ORACLE_SQL, register
from tidetrace.plans.sqlviews import T, V, cos
from tidetrace.session import scratch_path
from tidetrace.sinks import writers as wr
from tidetrace.sources import catalog as ca
from tidetrace.sources import pairs as pa
from tidetrace.sources import posts as ps
from tidetrace.sources import saved as sv
from tidetrace.sources import tables as tb
from tidetrace.streaming import trace_stream as ts


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:10]}")


@register("run_roundtrip", sql=ORACLE_SQL["trace_vectors"])
def q_run_roundtrip(spark, sf_dir):
    """SNK2 + SRC7 + SRC8: save a trace as a run, list runs, load it back."""
    base = _scratch(spark, "runs")
    result = tq.q_trace_vectors(spark, sf_dir)
    run = wr.save_run(result, base, target="post 0", start=tq.RANGE_START, end=tq.RANGE_END,
                      threshold=tq.VECTOR_THRESHOLD, datasets=["V"])
    run_id = sv.list_runs(spark, base).select("run_id").first()["run_id"]
    assert run_id == run.first()["run_id"]
    return sv.load_run(spark, base, run_id).select(*result.columns)


@register("csv_roundtrip", sql=f"""
WITH {T}
SELECT post_id, Tweet, ChannelName, datasetName, Datetime, 'Author: ' || ChannelName || chr(10) || 'Tweet: ' || Tweet AS AuthorTweet
FROM T
""")
def q_csv_roundtrip(spark, sf_dir):
    """SNK3 + SRC1: whole texts (with newlines and quotes) through quoted CSV."""
    path = _scratch(spark, "csv")
    t = tb.text_posts(spark, sf_dir)
    (t.write.option("header", True).option("quoteAll", True).option("escape", '"')
      .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))
    back = ps.read_csv_posts(spark, path, null_words=None, strip_invalid=False)
    return back.select(F.col("post_id").cast("bigint").alias("post_id"), "Tweet", "ChannelName", "datasetName",
                       F.col("Datetime").try_cast("timestamp_ntz").alias("Datetime"), "AuthorTweet")


@register("json_roundtrip", sql=f"""
WITH {T}
SELECT post_id, Tweet, ChannelName, Datetime FROM T
""")
def q_json_roundtrip(spark, sf_dir):
    """SRC5: uploaded JSON records with a typed Datetime."""
    path = _scratch(spark, "json")
    t = tb.text_posts(spark, sf_dir).select(F.col("post_id").cast("string").alias("post_id"), "Tweet",
                                            "ChannelName", F.col("Datetime").cast("string").alias("Datetime"))
    t.write.json(path)
    back = ps.read_json_posts(spark, path)
    return back.select(F.col("post_id").cast("bigint").alias("post_id"), "Tweet", "ChannelName", "Datetime")


@register("channel_split", sql=f"""
WITH {T}
SELECT regexp_replace(ChannelName, '[^\\p{{L}}\\p{{N}}]', '_', 'g') AS channel_key, count(*) AS n_posts,
       min(post_id) AS first_post_id
FROM T GROUP BY 1
""")
def q_channel_split(spark, sf_dir):
    """SNK1 + FLT3: per-channel directory layout, read back per key."""
    path = _scratch(spark, "channels")
    wr.write_by_channel(tb.text_posts(spark, sf_dir), path)
    back = spark.read.parquet(path)
    return back.groupBy("channel_key").agg(F.count(F.lit(1)).alias("n_posts"), F.min("post_id").alias("first_post_id"))


@register("narratives_json", sql=ORACLE_SQL["cluster_narratives"])
def q_narratives_json(spark, sf_dir):
    """SNK6: cluster narratives written as JSON and read back."""
    path = _scratch(spark, "narratives")
    wr.write_narratives_json(cq.q_cluster_narratives(spark, sf_dir), path)
    return spark.read.schema("cluster_id long, n_posts long, narrative_1 string, narrative_2 string, "
                             "top_post_ids array<long>").json(path)


@register("eval_outputs", sql=ORACLE_SQL["eval_global"])
def q_eval_outputs(spark, sf_dir):
    """SNK5: evaluation pairs and metrics written, metrics read back."""
    path = _scratch(spark, "eval")
    scored = eq.scored(spark, sf_dir)
    wr.write_eval(scored.drop("e1", "e2"), ev.global_metrics(scored), path)
    return spark.read.schema(ev.global_metrics(scored).schema).json(f"{path}/metrics")


@register("dataset_catalog", sql="""
SELECT 'events.csv' AS dataset, count(*) AS rows, min(ts) AS first_post, max(ts) AS last_post FROM events
""")
def q_dataset_catalog(spark, sf_dir):
    """SRC4: the events as one uploaded CSV, listed with rows and date span."""
    base = _scratch(spark, "catalog up loads")
    ev_ = tb.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("string").alias("Datetime"))
    ev_.write.option("header", True).option("quoteAll", True).csv(f"{base}/events.csv")
    files = ca.dataset_summary(spark, base, "part-*.csv").withColumn("dataset", F.substring_index("dataset", "/", 1))
    return files.groupBy("dataset").agg(F.sum("rows").alias("rows"), F.min("first_post").alias("first_post"),
                                        F.max("last_post").alias("last_post"))


@register("new_posts_to_embed", sql=f"""
WITH {T}, {V},
K AS (SELECT DISTINCT sha256(T.Tweet) AS text_key FROM T JOIN V ON T.post_id = V.post_id)
SELECT post_id, sha256(Tweet) AS text_key FROM T WHERE NOT EXISTS (SELECT 1 FROM K WHERE K.text_key = sha256(T.Tweet))
""")
def q_new_posts_to_embed(spark, sf_dir):
    """EMB3/JN7: texts without a stored vector (the table holds the vectors
    of posts that have one), by content key."""
    t = tb.text_posts(spark, sf_dir)
    known = tb.text_keys_and_vectors(spark, sf_dir).select("text_key", F.lit("given").alias("model"), "embedding")
    return em.missing_embeddings(t, known, model="given").select("post_id", "text_key")


@register("trace_hashed_tfidf")
def q_trace_hashed_tfidf(spark, sf_dir):
    """EMB1(a)/EMB2: hashed TF-IDF vectors for posts and narratives, then the
    vector trace (rows only: the hashed encoder has no SQL twin)."""
    t = tb.text_posts(spark, sf_dir)
    model = em.fit_hashed_tfidf(t)
    posts = em.embed_hashed(t, model).select("post_id", "ChannelName", "Datetime", "embedding")
    narratives = em.embed_hashed(tq.benchmark_narratives(spark, sf_dir).withColumnRenamed("text", "Tweet"), model) \
                   .select("narrative_id", "embedding")
    return tr.trace_vectors(posts, narratives, threshold=tq.TEXT_THRESHOLD,
                            keep=["post_id", "ChannelName", "Datetime"])


@register("stream_trace", sql=ORACLE_SQL["trace_vectors"])
def q_stream_trace(spark, sf_dir):
    """STR1: the flagship trace as a stream over the embeddings files; drained
    with availableNow and read back, it must equal the batch result."""
    out, ckpt = _scratch(spark, "stream-out"), _scratch(spark, "stream-ckpt")
    stream = tb.derive_vector_posts(ts.read_table_stream(spark, tb.table_path(sf_dir, "embeddings"),
                                                         tb.table(spark, sf_dir, "embeddings").schema))
    v = tb.vector_posts(spark, sf_dir)
    q = ts.start_trace_stream(stream, tq.vector_targets(v, tq.ONE_TARGET), out, ckpt,
                              start=tq.RANGE_START, end=tq.RANGE_END, threshold=tq.VECTOR_THRESHOLD,
                              keep=["post_id", "ChannelName", "Datetime"])
    ts.run_to_completion(q)
    return spark.read.parquet(out).drop("batch_id")


@register("stream_timeline", sql=ORACLE_SQL["timeline_daily"])
def q_stream_timeline(spark, sf_dir):
    """STR1 second half: the daily timeline as a stateful streaming aggregation
    with a watermark, in update mode; the latest version of each window equals
    the batch timeline."""
    out, ckpt = _scratch(spark, "timeline-out"), _scratch(spark, "timeline-ckpt")
    stream = tb.derive_vector_posts(ts.read_table_stream(spark, tb.table_path(sf_dir, "embeddings"),
                                                         tb.table(spark, sf_dir, "embeddings").schema))
    v = tb.vector_posts(spark, sf_dir)
    scored = sim.score_vectors(stream, tq.vector_targets(v, tq.ONE_TARGET), keep=["post_id", "ChannelName", "Datetime"],
                               method="expr")
    q = ts.start_update_log(ts.stream_timeline(scored, by=["ChannelName"]), out, ckpt)
    ts.run_to_completion(q)
    return ts.latest_versions(spark, out, ["bucket_start", "ChannelName"])


EXPORT_TEXT = """CASE WHEN post_id % 5 = 0 THEN '#tag ' || Tweet WHEN post_id % 7 = 0 THEN '# Target: a line of a post' || chr(10) || Tweet
            WHEN post_id % 11 = 0 THEN '' WHEN post_id % 13 = 0 THEN NULL WHEN post_id % 17 = 0 THEN '"' || Tweet || '",' || chr(13) || chr(10)
            ELSE Tweet END"""


@register("export_files", sql=f"""
WITH {T}
SELECT {EXPORT_TEXT} AS Tweet, post_id, Datetime, 'all posts of ' || datasetName AS targetNarrative, datasetName,
       0.0 AS threshold, CAST(count(*) OVER (PARTITION BY datasetName) AS BIGINT) AS n_posts, TRUE AS count_matches
FROM T
""")
def q_export_files(spark, sf_dir):
    """SNK3 + SRC6 + JN5: every dataset exported as CSV files with their metadata lines on top, all read
    back together. The texts hold posts that begin with '#', cells with a line like '# Target: ...',
    line breaks, quotes, empty and null texts."""
    base = _scratch(spark, "export files")
    t = tb.text_posts(spark, sf_dir).withColumn("Tweet", F.expr(EXPORT_TEXT.replace("chr(", "char(")))
    names = sorted(r[0] for r in t.select("datasetName").distinct().collect())
    for name in names:
        rows = t.where(F.col("datasetName") == name).select("Tweet", "post_id", "Datetime")
        run = spark.createDataFrame([(name, "2024-01-01", "2024-01-30", f"all posts of {name}", 0.0, [name], rows.count())],
                                    "run_id string, startDate string, endDate string, targetNarrative string, threshold double, "
                                    "selectedDatasets array<string>, totalRecords bigint").withColumn(
            "generatedAt", F.current_timestamp())
        wr.export_files(rows, run, f"{base}/{name}", max_file_bytes=1 << 20)
    back = sv.read_exported(spark, [f"{base}/{name}" for name in names])
    n = back.groupBy(F.col("selectedDatasets")[0].alias("datasetName")).agg(F.count(F.lit(1)).alias("n_posts"))
    return back.withColumn("datasetName", F.col("selectedDatasets")[0]).join(F.broadcast(n), "datasetName").select(
        "Tweet", F.col("post_id").cast("bigint").alias("post_id"), F.col("Datetime").cast("timestamp_ntz").alias("Datetime"),
        "targetNarrative", "datasetName", "threshold", "n_posts", "count_matches")


@register("export_roundtrip", sql=f"""
WITH {V},
Tg AS (SELECT post_id AS narrative_id, embedding AS tv FROM V WHERE post_id = 0),
S AS (SELECT V.post_id, V.ChannelName, V.Datetime, Tg.narrative_id, round({cos('V.embedding', 'Tg.tv')}, 6) AS similarity
      FROM V, Tg
      WHERE V.Datetime >= TIMESTAMP '2024-01-05 00:00:00' AND V.Datetime <= TIMESTAMP '2024-01-20 00:00:00')
SELECT *, 'post 0' AS targetNarrative, 0.2 AS threshold, CAST(count(*) OVER () AS BIGINT) AS totalRecords
FROM S WHERE similarity >= 0.2
""")
def q_export_roundtrip(spark, sf_dir):
    """SNK3 + SRC6 + JN5: a saved run exported as quoted CSV with its metadata
    header, read back with the metadata attached to every row."""
    base, out = _scratch(spark, "export-runs"), _scratch(spark, "export")
    result = tq.q_trace_vectors(spark, sf_dir)
    run = wr.save_run(result, base, target="post 0", start=tq.RANGE_START, end=tq.RANGE_END,
                      threshold=tq.VECTOR_THRESHOLD, datasets=["V"])
    wr.export_with_header(result, run, out)
    back = sv.read_own_export(spark, out)
    return back.select(F.col("post_id").cast("bigint").alias("post_id"), "ChannelName",
                       F.col("Datetime").try_cast("timestamp_ntz").alias("Datetime"),
                       F.col("narrative_id").cast("bigint").alias("narrative_id"),
                       F.col("similarity").cast("double").alias("similarity"),
                       "targetNarrative", "threshold", "totalRecords")


@register("stream_timeline_late", sql=ORACLE_SQL["timeline_daily"])
def q_stream_timeline_late(spark, sf_dir):
    """STR1: a stream of several files, one a trigger, whose days are shuffled: on-time and late
    sums together are the batch timeline."""
    src, out, ckpt = (_scratch(spark, f"late-{x}") for x in ("in", "out", "ckpt"))
    tb.table(spark, sf_dir, "embeddings").repartition(6, F.xxhash64("vec_id")).write.parquet(src)
    v = tb.vector_posts(spark, sf_dir)
    stream = tb.derive_vector_posts(ts.read_parquet_stream(spark, src, tb.table(spark, sf_dir, "embeddings").schema, max_files=1))
    scored = sim.score_vectors(stream, tq.vector_targets(v, tq.ONE_TARGET), keep=["post_id", "ChannelName", "Datetime"],
                               method="expr")
    ts.run_to_completion(ts.start_timeline_log(scored, out, ckpt, by=["ChannelName"], lateness="2 days"))
    return ts.timeline_of(spark.read.parquet(f"{out}/sums"), ["ChannelName"])


@register("embedding_store", sql=f"""
WITH {T}, {V},
K AS (SELECT sha256(Tweet) AS text_key, arg_min(V.embedding, V.post_id) AS embedding FROM T JOIN V ON T.post_id = V.post_id
      WHERE Tweet IS NOT NULL GROUP BY 1)
SELECT T.post_id, K.embedding IS NOT NULL AS has_vector, K.embedding[1] AS first_component
FROM T LEFT JOIN K ON K.text_key = sha256(T.Tweet)
""")
def q_embedding_store(spark, sf_dir):
    """EMB3/JN7: vectors stored by content key, the same rows twice and some replaced, then attached to
    every post; posts without a stored vector keep their rows."""
    path = _scratch(spark, "embedding-store")  # sets the checkpoint folder
    known = tb.text_keys_and_vectors(spark, sf_dir).where(F.col("text_key").isNotNull()).groupBy("text_key").agg(
        F.min_by("embedding", "post_id").alias("embedding"))
    rows = known.select("text_key", F.lit("given").alias("model"), "embedding").checkpoint(eager=True)  # stored three times
    em.upsert_embeddings(rows.withColumn("embedding", F.transform("embedding", lambda x: x * 0)), path)
    for _ in range(2):
        em.upsert_embeddings(rows, path)
    table = em.read_embedding_table(spark, path)
    out = em.attach_embeddings(tb.text_posts(spark, sf_dir), table, model="given")
    return out.select("post_id", F.col("embedding").isNotNull().alias("has_vector"), F.get("embedding", F.lit(0)).alias("first_component"))


@register("eval_pairs_reread", sql=ORACLE_SQL["eval_pairs"])
def q_eval_pairs_reread(spark, sf_dir):
    """SNK5: the written pair table read back."""
    path = _scratch(spark, "eval-pairs")
    scored = eq.scored(spark, sf_dir)
    wr.write_eval(scored.drop("e1", "e2"), ev.global_metrics(scored), path)
    return wr.read_eval(spark, path)[0].select(*eq.q_eval_pairs(spark, sf_dir).columns)


@register("labelled_pairs", sql="""
SELECT a.text AS sentence1, b.text AS sentence2, CAST(a.item_id % 6 AS DOUBLE) / 5.0 AS gold_score
FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1
""")
def q_labelled_pairs(spark, sf_dir):
    """SRC9: labelled sentence pairs as CSV, read with a gold score in [0, 1]."""
    path = _scratch(spark, "pairs")
    b = tb.table(spark, sf_dir, "benchmark")
    pairs = b.alias("a").join(b.alias("b"), F.col("b.item_id") == F.col("a.item_id") + 1).select(
        F.col("a.text").alias("sentence1"), F.col("b.text").alias("sentence2"), (F.col("a.item_id") % 6).alias("label"))
    pairs.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return pa.read_pairs(spark, path, "csv").select("sentence1", "sentence2", "gold_score")


@register("channel_filter", sql=f"""
WITH {T}
SELECT post_id, ChannelName, Tweet FROM T WHERE ChannelName = 'src3'
""")
def q_channel_filter(spark, sf_dir):
    """FLT3: one channel of the per-channel layout; other directories are not read."""
    path = _scratch(spark, "channel-filter")
    wr.write_by_channel(tb.text_posts(spark, sf_dir), path, task_bytes=1 << 16)
    return tr.filter_channel(spark.read.parquet(path), "src3").select("post_id", "ChannelName", "Tweet")


@register("text_files", sql="""
SELECT coalesce(text, '') || chr(10) AS Tweet, 'Tweet: ' || coalesce(text, '') || chr(10) AS AuthorTweet FROM benchmark
""")
def q_text_files(spark, sf_dir):
    """SRC2: a folder of .txt files, each read whole as one post."""
    path = _scratch(spark, "texts")
    items = tb.table(spark, sf_dir, "benchmark").select("item_id", "text")
    items.repartition("item_id").write.partitionBy("item_id").text(path)
    return ps.read_posts(spark, path, fmt="txt").select("Tweet", "AuthorTweet")
