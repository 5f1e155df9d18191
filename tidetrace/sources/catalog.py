"""SRC4: dataset catalog from file metadata, without reading file contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _below(path: F.Column, root: str) -> F.Column:
    """The part of a file path (URL-encoded or not) below ``root``, whatever the scheme."""
    base = root.rstrip("/").split("://")[-1] + "/"
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.substring(plain, F.locate(base, plain) + F.lit(len(base)), F.length(plain))


def list_datasets(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """All files under ``root`` (recursive) matching ``pattern``: relative
    path, size and modification time. Only metadata columns are selected, so
    the binaryFile source never loads the contents."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                  .option("pathGlobFilter", pattern).load(root))
    return files.select(
        _below(F.regexp_replace(F.col("path"), "%", "%25"), root).alias("dataset"),
        F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def dataset_summary(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """SRC4 with data facts: the file listing joined with rows and Datetime
    span per file, computed in one distributed read of all files."""
    from tidetrace.functions.parse import parse_datetime

    listing = list_datasets(spark, root, pattern)
    if pattern.endswith(".csv"):
        posts = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
                      .option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(root))
    else:
        posts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).parquet(root)
    path = F.col("_metadata.file_path")
    dt = parse_datetime(F.col("Datetime").cast("string")) if "Datetime" in posts.columns else F.lit(None)
    facts = (posts.select(path.alias("_path"), dt.alias("_dt"))
                  .groupBy("_path").agg(F.count(F.lit(1)).alias("rows"), F.min("_dt").alias("first_post"),
                                        F.max("_dt").alias("last_post")))
    facts = facts.withColumn("dataset", _below(F.col("_path"), root))
    return listing.join(facts.drop("_path"), "dataset", "left")
