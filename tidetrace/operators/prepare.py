"""Preparation of post tables (PRJ1-PRJ10, RNK5, RNK8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from tidetrace.functions.parse import floor_to_second, int_prefix, parse_datetime
from tidetrace.functions.ranking import group_positions

# Fixed value: the filler the raw-export mapping puts where the body is missing.
EMBEDDED_PREFIX = "Embedded content: "
COUNT_COLUMNS = ("LikesCount", "SharesCount", "CommentsCount", "ViewsCount")


def author_context(df: DataFrame, *, channel_col: str = "ChannelName", text_col: str = "Tweet",
                   out_col: str = "AuthorTweet") -> DataFrame:
    """PRJ1: 'Author: <channel>\\nTweet: <text>' (null in, null out); without a
    channel column, 'Tweet: <text>'."""
    if channel_col in df.columns:
        v = F.concat(F.lit("Author: "), F.col(channel_col), F.lit("\nTweet: "), F.col(text_col))
    else:
        v = F.concat(F.lit("Tweet: "), F.col(text_col))
    return df.withColumn(out_col, v)


def map_raw_export(df: DataFrame, *, use_embedded: bool = False) -> DataFrame:
    """PRJ2/PRJ3: raw export → post columns.

    Tweet is the body, else the fixed filler (the embedded text is reached
    only with ``use_embedded=True``, which appends it to the filler);
    post_id ← PostId; Datetime ← published_at floored to the second.
    """
    body = F.col("post_body_text")
    if use_embedded and "EmbeddedContentText" in df.columns:
        fallback = F.coalesce(F.concat(F.lit(EMBEDDED_PREFIX), F.col("EmbeddedContentText")), F.lit(EMBEDDED_PREFIX))
    else:
        fallback = F.lit(EMBEDDED_PREFIX)
    out = (df.withColumn("Tweet", F.coalesce(body, fallback))
             .withColumn("Datetime", floor_to_second(parse_datetime(F.col("published_at"))))
             .withColumn("post_id", F.col("PostId")))
    return author_context(out)


def datetime_from_date(df: DataFrame, date_col: str = "Date") -> DataFrame:
    """PRJ4: derive Datetime from a zoned Date text when Datetime is absent."""
    if "Datetime" in df.columns:
        return df
    return df.withColumn("Datetime", parse_datetime(F.col(date_col)))


def constant_channel(df: DataFrame, name: str) -> DataFrame:
    """PRJ5: single-author file."""
    return df.withColumn("ChannelName", F.lit(name))


def normalise_types(df: DataFrame) -> DataFrame:
    """PRJ6: Similarity → double else 0; Datetime → text else ''; Tweet null → '';
    counts → leading integer else 0."""
    out = df
    if "Similarity" in df.columns:
        out = out.withColumn("Similarity", F.coalesce(F.col("Similarity").cast("string").try_cast("double"),
                                                      F.lit(0.0)))
    if "Datetime" in df.columns:
        out = out.withColumn("Datetime", F.coalesce(F.col("Datetime").cast("string"), F.lit("")))
    if "Tweet" in df.columns:
        out = out.withColumn("Tweet", F.coalesce(F.col("Tweet"), F.lit("")))
    for c in COUNT_COLUMNS:
        if c in df.columns:
            out = out.withColumn(c, int_prefix(F.col(c).cast("string")))
    return out


def nan_to_null(df: DataFrame) -> DataFrame:
    """PRJ10: NaN in double/float columns becomes null."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.when(F.isnan(F.col(f.name)), F.lit(None)).otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def dataset_tag(df: DataFrame, name: str | None = None) -> DataFrame:
    """PRJ7/PRJ8: dataset name from a literal or from the source file name."""
    if name is not None:
        return df.withColumn("datasetName", F.lit(name))
    return df.withColumn("datasetName", F.coalesce(F.col("_metadata.file_name"), F.lit("unknown")))


def chunk_posts(df: DataFrame, size: int, *, group_cols: Sequence[str] = ("ChannelName",),
                order_cols: Sequence[str] = ("post_id",)) -> DataFrame:
    """RNK8: split each group, in order, into ceil(n/size) near-equal batches;
    the first n mod b batches get one extra row (as ``numpy.array_split``).

    Positions come from ``group_positions`` so a channel holding a third of
    all posts is still numbered by many tasks.
    """
    if size < 1:
        raise ValueError("batch size must be >= 1")
    pos = group_positions(df, list(group_cols), list(order_cols), position_col="_r", size_col="_n")
    n, r = F.col("_n"), F.col("_r")
    nb = F.ceil(n / F.lit(size)).cast("long")
    q = F.floor(n / nb).cast("long")
    rem = n - q * nb
    big = rem * (q + 1)
    batch = F.when(r < big, F.floor(r / (q + 1))).otherwise(rem + F.floor((r - big) / q)) + 1
    return (pos.withColumn("batch_id", batch.cast("long"))
               .withColumn("n_batches", nb)
               .drop("_r", "_n"))


def chronological(df: DataFrame, id_col: str = "post_id") -> DataFrame:
    """RNK5: ascending Datetime, unique tie-break."""
    return df.orderBy(F.col("Datetime"), F.col(id_col))
