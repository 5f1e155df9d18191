"""Base tables and the post-shaped views derived from them.

The test tables hold no social posts, so posts, narratives, raw exports,
scored pairs and model responses are derived from them by fixed rules
(FIXTURES.md §3). Each view is a lazy DataFrame over the parquet scan, so
filters and column pruning still reach the reader.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidetrace.functions.text import text_key

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Fixed values of the derived views (FIXTURES.md §3).
EPOCH = "2024-01-01 00:00:00"
MINUTES_IN_30_DAYS = 43200
VECTOR_TIME_STEP = 7919
TEXT_TIME_STEP = 2591


def table_path(sf_dir: str, name: str) -> str:
    """A table is a parquet file or a folder of parquet files by this name."""
    return os.path.join(sf_dir, f"{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def _spread_time(id_col: Column, step: int) -> Column:
    minutes = ((id_col * F.lit(step)) % F.lit(MINUTES_IN_30_DAYS)).cast("int")
    return F.timestamp_add("MINUTE", minutes, F.lit(EPOCH).cast("timestamp_ntz"))


def vector_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V: posts that carry an embedding (post_id, ChannelName, label, embedding, Datetime)."""
    return derive_vector_posts(table(spark, sf_dir, "embeddings"))


def derive_vector_posts(e: DataFrame) -> DataFrame:
    """V from an embeddings DataFrame (batch or stream)."""
    return e.select(
        F.col("vec_id").alias("post_id"),
        F.concat(F.lit("label_"), F.col("label").cast("string")).alias("ChannelName"),
        "label", "embedding",
        _spread_time(F.col("vec_id"), VECTOR_TIME_STEP).alias("Datetime"))


def text_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T: posts with text (post_id, Tweet, ChannelName, datasetName, Datetime)."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("post_id"), F.col("text").alias("Tweet"),
        F.col("source").alias("ChannelName"), F.col("lang").alias("datasetName"),
        _spread_time(F.col("doc_id"), TEXT_TIME_STEP).alias("Datetime"))


def raw_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R: a raw social-media export with missing and malformed cells."""
    ev = table(spark, sf_dir, "events")
    i = F.col("event_id")
    ts = F.col("ts").cast("string")
    return ev.select(
        i.alias("PostId"),
        F.when(i % 17 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("ChannelName"),
        F.when(i % 5 == 0, F.lit(None)).when(i % 23 == 0, F.lit("  "))
         .otherwise(F.concat(F.col("event_type"), F.lit(" "), F.col("props"))).alias("post_body_text"),
        F.when(i % 10 == 0, F.col("event_type")).alias("EmbeddedContentText"),
        F.when(i % 13 == 0, F.lit("not a date")).when(i % 29 == 0, F.lit(""))
         .otherwise(F.concat(F.substring(ts, 1, 10), F.lit("T"), F.substring(ts, 12, 8), F.lit(".500Z")))
         .alias("published_at"),
        F.when(i % 7 == 0, F.lit("12abc")).when(i % 11 == 0, F.lit(""))
         .otherwise(F.floor("value").cast("bigint").cast("string")).alias("LikesCount"))


def narrative_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N: narrative texts as a user would type them, some invalid."""
    b = table(spark, sf_dir, "benchmark")
    k = F.col("item_id") % 5
    return b.select(
        F.col("item_id").alias("narrative_id"),
        F.when(k == 1, F.lit("ab")).when(k == 2, F.lit("<b></b> x "))
         .when(k == 3, F.concat(F.col("text"), F.repeat(F.lit("x"), 600)))
         .otherwise(F.concat(F.lit("<i>"), F.col("text"), F.lit("</i>"))).alias("text"))


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E: neighbouring embedding pairs with a gold score in [0, 1]."""
    a = table(spark, sf_dir, "embeddings").alias("a")
    b = table(spark, sf_dir, "embeddings").alias("b")
    return a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1).select(
        F.col("a.vec_id").alias("pair_id"), F.col("a.embedding").alias("e1"), F.col("b.embedding").alias("e2"),
        ((F.lit(5) - F.least(F.lit(5), F.abs(F.col("a.label") - F.col("b.label")))) / F.lit(5.0))
        .alias("gold_score"))


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L: one stance answer per vector post; some missing or malformed."""
    e = table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    fence = F.repeat(F.lit("`"), 3)
    nl = F.lit("\n")
    flag = lambda c: F.when(c, F.lit("1")).otherwise(F.lit("0"))
    good = F.concat(fence, F.lit("json"), nl, F.lit('{"support":'), flag(v % 4 == 1),
                    F.lit(',"opposition":'), flag(v % 4 == 2), F.lit(","), nl, F.lit('"neutral":'),
                    flag((v % 4 == 3) | (v % 13 == 0)), F.lit(',"unsure":'), flag(v % 4 == 0),
                    F.lit("}"), nl, fence)
    return e.select(
        v.alias("post_id"),
        F.when(v % 11 == 0, F.lit(None).cast("string")).when(v % 7 == 0, F.lit("no json here"))
         .when(v % 17 == 0, F.lit('{"support":1}'))
         .when(v % 5 == 0, F.lit('{bad} {"unsure":0,"support":0,"opposition":1,"neutral":0}'))
         .otherwise(good).alias("response"))


def posts_with_text_and_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T ⋈ V on post_id: posts that have both a text and an embedding."""
    t = text_posts(spark, sf_dir)
    v = vector_posts(spark, sf_dir).select("post_id", "embedding", F.col("label"))
    return t.join(v, "post_id")


def text_keys_and_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T ⋈ V on post_id as (post_id, text_key, embedding): texts are hashed where they are read."""
    t = text_posts(spark, sf_dir).select("post_id", text_key(F.col("Tweet")).alias("text_key"))
    return t.join(vector_posts(spark, sf_dir).select("post_id", "embedding"), "post_id")
