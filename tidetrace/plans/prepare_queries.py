"""Preparation and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidetrace.operators import prepare as pr
from tidetrace.operators import validate as va
from tidetrace.plans.registry import register
from tidetrace.plans.sqlviews import N, R, T
from tidetrace.sinks.writers import channel_manifest
from tidetrace.sources import tables as tb

BATCH_SIZE = 10
PARSE_SQL = "try_cast(regexp_replace(trim(published_at), 'Z$', '') AS TIMESTAMP)"


@register("author_context", sql=f"""
WITH {T}
SELECT post_id, 'Author: ' || ChannelName || chr(10) || 'Tweet: ' || Tweet AS AuthorTweet FROM T
""")
def q_author_context(spark, sf_dir):
    return pr.author_context(tb.text_posts(spark, sf_dir)).select("post_id", "AuthorTweet")


@register("raw_export_map", sql=f"""
WITH {R}
SELECT PostId AS post_id, ChannelName, coalesce(post_body_text, 'Embedded content: ') AS Tweet,
       date_trunc('second', {PARSE_SQL}) AS Datetime,
       'Author: ' || ChannelName || chr(10) || 'Tweet: ' || coalesce(post_body_text, 'Embedded content: ') AS AuthorTweet
FROM R
""")
def q_raw_export_map(spark, sf_dir):
    return pr.map_raw_export(tb.raw_export(spark, sf_dir)).select(
        "post_id", "ChannelName", "Tweet", "Datetime", "AuthorTweet")


@register("quality_report", sql=f"""
WITH {R},
G AS (SELECT CASE WHEN NOT regexp_matches(coalesce(post_body_text, 'Embedded content: '), '\\S') THEN 'blank_text'
                  WHEN published_at IS NULL OR trim(published_at) = '' THEN 'empty_datetime'
                  WHEN {PARSE_SQL} IS NULL THEN 'bad_datetime' END AS reason FROM R)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE reason IS NULL) AS n_valid,
       count(*) FILTER (WHERE reason = 'blank_text') AS n_blank_text,
       count(*) FILTER (WHERE reason = 'empty_datetime') AS n_empty_datetime,
       count(*) FILTER (WHERE reason = 'bad_datetime') AS n_bad_datetime,
       (SELECT len(json_keys(to_json(x))) FROM (SELECT *, '' AS Tweet, '' AS Datetime, 0 AS post_id, '' AS AuthorTweet FROM R LIMIT 1) x) AS n_columns
FROM G
""")
def q_quality_report(spark, sf_dir):
    mapped = pr.map_raw_export(tb.raw_export(spark, sf_dir))
    tagged = va.tag_rejects(mapped, text_col="Tweet", datetime_col="published_at")
    return va.quality_report(tagged)


@register("narrative_rules", sql=f"""
WITH {N},
C AS (SELECT narrative_id, text,
             regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS clean FROM N),
D AS (SELECT narrative_id, clean,
             CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN length(text) > 500 THEN 'too_long'
                  WHEN length(text) < 3 THEN 'too_short' WHEN length(clean) < 3 THEN 'too_short_after_cleaning' END AS reason
      FROM C)
SELECT narrative_id, CASE WHEN reason IS NULL THEN clean END AS clean_text, reason AS reject_reason FROM D
""")
def q_narrative_rules(spark, sf_dir):
    return va.validate_narratives(tb.narrative_inputs(spark, sf_dir)).select(
        "narrative_id", "clean_text", "reject_reason")


@register("normalise_counts", sql=f"""
WITH {R}
SELECT PostId AS post_id, coalesce(post_body_text, '') AS Tweet, coalesce(published_at, '') AS Datetime,
       coalesce(try_cast(regexp_extract(LikesCount, '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0) AS LikesCount
FROM R
""")
def q_normalise_counts(spark, sf_dir):
    r = tb.raw_export(spark, sf_dir).select(
        F.col("PostId").alias("post_id"), F.col("post_body_text").alias("Tweet"),
        F.col("published_at").alias("Datetime"), "LikesCount")
    return pr.normalise_types(r)


@register("post_batches", sql=f"""
WITH {T},
C AS (SELECT post_id, ChannelName, row_number() OVER (PARTITION BY ChannelName ORDER BY post_id) - 1 AS r,
             count(*) OVER (PARTITION BY ChannelName) AS n FROM T),
B AS (SELECT *, CAST(ceil(n / 10.0) AS BIGINT) AS nb FROM C),
Q AS (SELECT *, n // nb AS q, n - (n // nb) * nb AS rem FROM B)
SELECT post_id, ChannelName,
       CAST(CASE WHEN r < rem * (q + 1) THEN r // (q + 1) ELSE rem + (r - rem * (q + 1)) // q END + 1 AS BIGINT) AS batch_id,
       nb AS n_batches
FROM Q
""")
def q_post_batches(spark, sf_dir):
    t = tb.text_posts(spark, sf_dir).select("post_id", "ChannelName")
    return pr.chunk_posts(t, BATCH_SIZE).select("post_id", "ChannelName", "batch_id", "n_batches")


@register("channel_manifest", sql=f"""
WITH {R},
K AS (SELECT ChannelName, CASE WHEN ChannelName IS NULL THEN '__null__'
                              ELSE regexp_replace(ChannelName, '[^\\p{{L}}\\p{{N}}]', '_', 'g') END AS channel_key FROM R),
G AS (SELECT ChannelName, channel_key, count(*) AS n_posts FROM K GROUP BY ChannelName, channel_key)
SELECT *, count(*) OVER (PARTITION BY channel_key) > 1 AS key_collision FROM G
""")
def q_channel_manifest(spark, sf_dir):
    return channel_manifest(tb.raw_export(spark, sf_dir))


@register("posts_by_date", sql="""
SELECT event_id AS post_id, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 3 = 0 THEN date_trunc('second', ts)
                                 ELSE date_trunc('second', ts) - INTERVAL 2 HOUR END AS Datetime,
       'One Author' AS ChannelName, 'Author: One Author' || chr(10) || 'Tweet: ' || props AS AuthorTweet
FROM events
""")
def q_posts_by_date(spark, sf_dir):
    """PRJ4 + PRJ5: a single author's file with a zoned Date text and no Datetime column."""
    i, second = F.col("event_id"), F.substring(F.col("ts").cast("string"), 1, 19)
    export = tb.table(spark, sf_dir, "events").select(
        i.alias("post_id"), F.col("props").alias("Tweet"),
        F.when(i % 13 == 0, F.lit("no date")).when(i % 3 == 0, second).otherwise(F.concat(second, F.lit("+02:00"))).alias("Date"))
    return pr.author_context(pr.constant_channel(pr.datetime_from_date(export), "One Author")).select(
        "post_id", "Datetime", "ChannelName", "AuthorTweet")


@register("nan_scores", sql="""
SELECT event_type, count(*) AS n_posts, count(*) FILTER (WHERE event_id % 9 <> 0 AND value IS NOT NULL) AS n_scored,
       max(value) FILTER (WHERE event_id % 9 <> 0) AS max_score
FROM events GROUP BY event_type
""")
def q_nan_scores(spark, sf_dir):
    """PRJ10: NaN scores become null, so counts and maxima leave them out."""
    scored = tb.table(spark, sf_dir, "events").select(
        "event_type", F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("score"))
    return pr.nan_to_null(scored).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_posts"), F.count("score").alias("n_scored"), F.max("score").alias("max_score"))
