"""Trace narratives over time (SIM5/SIM6) and the reports built on a trace."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from tidetrace.functions.ranking import group_positions
from tidetrace.functions.stats import exact_mean
from tidetrace.operators.similarity import score_lexical, score_vectors


def _bound(x) -> F.Column:
    """A date bound as TIMESTAMP_NTZ; one that is no date is an error, not an empty result."""
    if not isinstance(x, (dt.datetime, dt.date)):
        try:
            x = dt.datetime.fromisoformat(str(x).strip())
        except ValueError:
            raise ValueError(f"not a date or time: {x!r}") from None
    if isinstance(x, dt.datetime) and x.tzinfo is not None:
        x = x.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return F.lit(x.isoformat(sep=" ") if isinstance(x, dt.datetime) else x.isoformat()).cast("timestamp_ntz")


def date_range(df: DataFrame, start=None, end=None, *, col: str = "Datetime",
               end_inclusive_day: bool = False) -> DataFrame:
    """FLT1: start <= Datetime <= end, both inclusive, typed compare (pushed to
    the parquet scan). A date-only end means that day's midnight unless
    ``end_inclusive_day`` extends it to the whole day."""
    c = F.col(col)
    if start is not None:
        df = df.where(c >= _bound(start))
    if end is not None:
        if end_inclusive_day and len(str(end)) == 10:
            df = df.where(c < F.date_add(F.lit(str(end)).cast("date"), 1).cast("timestamp_ntz"))
        else:
            df = df.where(c <= _bound(end))
    return df


def trace_vectors(posts: DataFrame, targets: DataFrame, *, start=None, end=None,
                  threshold: float | None = 0.4, keep: list[str] | None = None,
                  position_order: list[str] | None = None, max_posts: int | None = None) -> DataFrame:
    """SIM5/SIM6 on embedded posts: date filter, score against every target,
    keep scores >= threshold. Long form (post, narrative_id, similarity).

    ``position_order`` adds ``position`` (PRJ9): the 0-based place of the post
    in the date-filtered table under that order, computed without a global
    single-task window. ``max_posts`` (SIM7) scores only the first n posts
    under ``position_order``; there is no cap by default.
    """
    filtered = date_range(posts, start, end)
    if position_order:
        filtered = group_positions(filtered, [], position_order)
        if max_posts is not None:
            filtered = filtered.where(F.col("position") < max_posts)
        keep = (keep or [c for c in filtered.columns if c != "embedding"]) + \
            ([] if keep is None or "position" in keep else ["position"])
    elif max_posts is not None:
        raise ValueError("max_posts needs position_order: the first n posts must be defined by an order")
    return score_vectors(filtered, targets, threshold=threshold, keep=keep)


def trace_text(posts: DataFrame, narratives: DataFrame, *, start=None, end=None,
               threshold: float | None = 0.4, keep: list[str] | None = None,
               text_col: str = "Tweet") -> DataFrame:
    """SIM5/SIM6 with the lexical scorer over a text column (SIM3: text_col)."""
    return score_lexical(date_range(posts, start, end), narratives, threshold=threshold,
                         keep=keep, text_col=text_col)


def trace_summary(trace: DataFrame, by: list[str]) -> DataFrame:
    """AGG1/AGG4: matches, date span and score stats per group.

    Scores are 6-place values, so their sum is exact after rounding, and the
    mean is an exact integer sum of micro-units divided once (not rounded:
    half-way ties are broken differently by engines).
    """
    return trace.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_posts"),
        F.min("Datetime").alias("first_post"),
        F.max("Datetime").alias("last_post"),
        F.round(F.sum("similarity"), 6).alias("sum_similarity"),
        exact_mean(F.col("similarity")).alias("mean_similarity"),
        F.max("similarity").alias("max_similarity"))


def timeline_points(scores: DataFrame, *, id_col: str = "post_id") -> DataFrame:
    """AGG16 as it is drawn: every post a point (narrative_id, Datetime, similarity), in time order."""
    return scores.select("narrative_id", "Datetime", "similarity", id_col).orderBy("narrative_id", "Datetime", id_col)


def timeline(scores: DataFrame, *, by: list[str], every: str = "1 day") -> DataFrame:
    """AGG16 at scale: one point per time bucket and group instead of one per post."""
    return (scores.groupBy(F.window("Datetime", every).alias("w"), *by)
                  .agg(F.count(F.lit(1)).alias("n_posts"),
                       F.round(F.sum("similarity"), 6).alias("sum_similarity"),
                       F.max("similarity").alias("max_similarity"))
                  .select(F.col("w.start").alias("bucket_start"), *by, "n_posts",
                          "sum_similarity", "max_similarity"))


def union_datasets(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """SET1/PRJ7/PRJ8: tag each input with its dataset name and stack them by
    column name (missing columns become null); a null name reads 'unknown'."""
    out = None
    for name, df in datasets.items():
        tagged = df.withColumn("datasetName", F.coalesce(F.lit(name), F.lit("unknown")))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def dataset_names(*frames: DataFrame) -> DataFrame:
    """SET2/AGG3: distinct dataset names across several results."""
    out = None
    for f in frames:
        s = f.select(F.coalesce(F.col("datasetName"), F.lit("unknown")).alias("datasetName"))
        out = s if out is None else out.union(s)
    return out.distinct()


def filter_dataset(df: DataFrame, name: str) -> DataFrame:
    """FLT5: rows of one dataset (missing names read 'unknown')."""
    return df.where(F.coalesce(F.col("datasetName"), F.lit("unknown")) == name)


def filter_channel(df: DataFrame, channel: str) -> DataFrame:
    """FLT3: rows of one channel; on a per-channel layout this prunes directories."""
    if "channel_key" in df.columns:
        from tidetrace.functions.text import channel_key
        return df.where(F.col("channel_key") == channel_key(F.lit(channel))).where(F.col("ChannelName") == channel)
    return df.where(F.col("ChannelName") == channel)


def first_posts(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """RNK9: the first n rows under an explicit order (distributed top-n)."""
    return df.orderBy(*order).limit(n)


def chronological(df: DataFrame, *, id_col: str = "post_id") -> DataFrame:
    """RNK5/RNK6: ascending Datetime with a unique tie-break (range-partitioned sort)."""
    return df.orderBy(F.col("Datetime"), F.col(id_col))
