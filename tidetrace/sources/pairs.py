"""SRC9: labelled sentence pairs (sentence1, sentence2, label 0..5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidetrace.operators.evaluate import gold_from_label
from tidetrace.sources.quoted_csv import read_quoted_csv


def read_pairs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Pairs with ``gold_score``. Without an id column ``pair_id`` is a hash of the pair's own values,
    the same in every read and for any partitioning; repeated rows share it."""
    if fmt == "csv":
        df = read_quoted_csv(spark, path).drop("source_path", "source_block", "source_line", "lead")
        df = df.withColumn("label", F.col("label").try_cast("double"))
    else:
        df = spark.read.format(fmt).load(path)
    if "pair_id" not in df.columns:
        df = df.withColumn("pair_id", F.xxhash64("sentence1", "sentence2", "label"))
    return df.withColumn("gold_score", gold_from_label(F.col("label")))
