"""Embeddings (EMB1-EMB3).

Two encoders: a built-in hashed TF-IDF pipeline (pyspark.ml, no download),
and any user callable run in ``mapInPandas`` (loaded once per Python worker,
fed Arrow batches). An embedding table keyed by (text_key, model) lets each
distinct text be encoded once across traces, clusters and plots.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidetrace.functions.text import TOKEN_SPLIT, text_key
from tidetrace.session import ensure_checkpoint_dir

HASHED_MODEL = "hashed-tfidf"
BUCKETS = 256  # directories of the embedding table
FILES_PER_BUCKET = 4


def fit_hashed_tfidf(posts: DataFrame, *, text_col: str = "Tweet", num_features: int = 1024) -> PipelineModel:
    """EMB1(a): tokenise → hash → IDF (one pass to fit) → L2-normalise."""
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=TOKEN_SPLIT, toLowercase=True, minTokenLength=1),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_vec", p=2.0),
    ])
    return pipe.fit(posts.select(F.coalesce(F.col(text_col), F.lit("")).alias(text_col)))


def embed_hashed(df: DataFrame, model: PipelineModel, *, text_col: str = "Tweet",
                 out_col: str = "embedding") -> DataFrame:
    """EMB1/EMB2: apply a fitted hashed TF-IDF model; ARRAY<FLOAT> output."""
    src = df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    out = model.transform(src)
    return out.withColumn(out_col, vector_to_array(F.col("_vec"), "float32")).drop("_tok", "_tf", "_idf", "_vec")


def embed_with(df: DataFrame, encoder: Callable[[list[str]], np.ndarray], *, text_col: str = "Tweet",
               key_col: str = "post_id", out_col: str = "embedding") -> DataFrame:
    """EMB1(b): a user encoder over Arrow batches (texts in, matrix out)."""
    key_type = dict(df.dtypes)[key_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mat = np.asarray(encoder(pdf[text_col].fillna("").tolist()), dtype=np.float32)
            yield pd.DataFrame({key_col: pdf[key_col], out_col: list(mat)})

    return df.select(key_col, text_col).mapInPandas(run, f"{key_col} {key_type}, {out_col} array<float>")


def missing_embeddings(posts: DataFrame, table: DataFrame, *, model: str, text_col: str = "Tweet") -> DataFrame:
    """EMB3/JN7: posts whose text has no vector for ``model`` yet (left anti join
    on the content key), one row per post."""
    known = table.where(F.col("model") == model).select("text_key").distinct()
    return posts.withColumn("text_key", text_key(F.col(text_col))).join(known, "text_key", "left_anti")


EMPTY_TABLE = "text_key string, model string, embedding array<float>"


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def read_embedding_table(spark: SparkSession, table_path: str) -> DataFrame:
    """The stored vectors; a path that does not exist is an empty table, any other failure an error."""
    try:
        table = spark.read.parquet(table_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], EMPTY_TABLE).withColumn("bucket", _bucket(F.col("text_key")))
    if "bucket" not in table.columns:  # a table written without buckets
        table = table.withColumn("bucket", _bucket(F.col("text_key")))
    return table.select("text_key", "model", "embedding", "bucket")


def upsert_embeddings(rows: DataFrame, table_path: str) -> None:
    """Add (text_key, model, embedding) rows to the table, or replace those of the same key and model.

    The table is laid out in BUCKETS directories by the key's hash; only buckets with new rows are
    rewritten, each as a whole. A retry writes the same rows again and adds none. The new content is
    checkpointed before it replaces what it was read from.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    new = rows.select("text_key", "model", "embedding").dropDuplicates(["text_key", "model"]).withColumn(
        "bucket", _bucket(F.col("text_key"))).checkpoint(eager=True)
    touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most BUCKETS numbers
    if not touched:
        return
    kept = read_embedding_table(spark, table_path).where(F.col("bucket").isin(touched)).join(
        new.select("text_key", "model"), ["text_key", "model"], "left_anti")
    full = kept.select("text_key", "model", "embedding", "bucket").unionByName(new).checkpoint(eager=True)
    (full.repartition(F.col("bucket"), F.pmod(F.xxhash64("text_key", F.lit(1)), F.lit(FILES_PER_BUCKET)))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table_path))


def update_embedding_table(posts: DataFrame, table_path: str, *, model: str, encode: Callable[[DataFrame], DataFrame],
                           text_col: str = "Tweet") -> DataFrame:
    """EMB3: encode only the distinct new texts and store them; returns the table."""
    spark = posts.sparkSession
    table = read_embedding_table(spark, table_path)
    new = (missing_embeddings(posts.where(F.col(text_col).isNotNull()), table, model=model, text_col=text_col)
           .groupBy("text_key").agg(F.min(F.col(text_col)).alias(text_col)))
    encoded = encode(new.withColumnRenamed("text_key", "post_id")).withColumnRenamed("post_id", "text_key")
    upsert_embeddings(encoded.select("text_key", F.lit(model).alias("model"), "embedding"), table_path)
    return read_embedding_table(spark, table_path).drop("bucket")


def attach_embeddings(posts: DataFrame, table: DataFrame, *, model: str, text_col: str = "Tweet") -> DataFrame:
    """Posts with their stored vectors by content key; a post without one (a null or new text) keeps
    its row with a null vector. A key stored twice for the model counts once."""
    t = table.where(F.col("model") == model).select("text_key", "embedding").dropDuplicates(["text_key"])
    return posts.withColumn("text_key", text_key(F.col(text_col))).join(t, "text_key", "left")
