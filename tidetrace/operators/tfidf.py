"""Sparse TF-IDF by token (EMB1, EMB2 without hashing or dense vectors).

A text's weight for a token is its count times ln((n + 1) / (df + 1)), with n the posts and
df the posts that hold the token, as the dense encoder weighs its buckets. The (post, token)
counts are staged once; document frequencies, norms and dot products are aggregates over
them, so vectors are rows and a text costs as many of them as it has different tokens.
Narratives are weighed by the posts' frequencies; a token that no post holds has df 0.

Tokens are counted, and products added up, by tasks that hold whole posts. How many tasks is
taken from what they get (bytes of text, products of weights), so a task's memory does not
grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidetrace.functions.text import tokens
from tidetrace.functions.vectors import cosine_from_parts, rounded
from tidetrace.session import ensure_checkpoint_dir, partitions_for

TASK_BYTES = 8 << 20  # text of one counting task
TASK_PRODUCTS = 2_000_000  # products that one task adds up
FEW_WEIGHTS = 500_000  # narrative weights that are broadcast; more are joined by token


def token_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token, tf) of each text's tokens."""
    rows = df.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("token"))
    return rows.groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))


def score_tfidf(posts: DataFrame, narratives: DataFrame, *, text_col: str = "Tweet", narrative_text_col: str = "text",
                threshold: float | None = None) -> DataFrame:
    """(post_id, narrative_id, similarity): cosine of TF-IDF vectors of the pairs that share a token.
    ``post_id`` must be unique. A post whose tokens all have weight 0 scores 0."""
    spark = posts.sparkSession
    ensure_checkpoint_dir(spark)
    texts = posts.select("post_id", text_col)
    n, size = texts.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_col).cast("long"))).first()
    whole = texts.repartition(partitions_for(spark, size or 0, TASK_BYTES), "post_id")
    tf = token_counts(whole, "post_id", text_col).checkpoint(eager=True)
    frequency = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")).checkpoint(eager=True)
    weight = F.col("tf") * F.log(F.lit(float(n + 1)) / (F.coalesce("df", F.lit(0)) + 1))

    def norms(w: DataFrame, name: str) -> DataFrame:
        return w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(name))

    wn = token_counts(narratives, "narrative_id", narrative_text_col).join(frequency, "token", "left").select(
        "id", "token", weight.alias("w"), "df").checkpoint(eager=True)
    b = wn.join(norms(wn, "bn"), "id").select(F.col("id").alias("narrative_id"), "token", F.col("w").alias("bw"), "bn")
    weights, products = wn.agg(F.count(F.lit(1)), F.sum("df")).first()
    parts = partitions_for(spark, products or 0, TASK_PRODUCTS)

    # every token of a post has a frequency; the frequencies are the side that a task holds
    wp = tf.join(frequency.hint("shuffle_hash"), "token").select("id", "token", weight.alias("w"))
    if weights <= FEW_WEIGHTS:
        shared = wp.join(F.broadcast(b.select("token").distinct()), "token", "left_semi")
        pairs = shared.repartition(parts, "id").join(F.broadcast(b), "token")
    else:
        pairs = wp.join(b, "token").repartition(parts, "id")
    dots = pairs.groupBy("id", "narrative_id", "bn").agg(F.sum(F.col("w") * F.col("bw")).alias("dot"))
    out = dots.join(norms(wp, "an").hint("shuffle_hash"), "id").select(
        F.col("id").alias("post_id"), "narrative_id",
        rounded(cosine_from_parts(F.col("dot"), F.col("an"), F.col("bn"))).alias("similarity"))
    return out if threshold is None else out.where(F.col("similarity") >= F.lit(float(threshold)))
