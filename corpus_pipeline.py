"""The corpus pipeline: documents to token-id files, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet into the shared checkpoint folder and reads again as the next stage's docs.
All stages but the last return the columns of documents.

1. toxicity: documents that the convolutional classifier marks as toxic go.
2. near_dedup: of each group of near-duplicates (five-word shingles, Jaccard 0.8 or
   more) the document with the smallest doc_id stays. Rows are told apart by doc_id and
   text: one of several with the same doc_id goes only as a near-duplicate of another.
3. decontaminate: documents that hold ten consecutive words of a benchmark item (or
   a whole shorter item) go.
4. mix: documents are repeated by fitted rates so that the label domains' expected
   tokens meet the target weights; every document stays at least once.
5. token_ids: ids are written as Huffman-coded files and read back; one row per document
   copy with doc_id, start, n_tokens, ids_crc32.

In stage 2 a row with a null doc_id stays only if its group has no other; documents
without words are near-duplicates of nothing, but of rows that repeat doc_id and text one
stays, the first by all columns. Null and empty texts pass all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidetrace.llm.common import in_fold, table
from tidetrace.llm.contamination import drop_contaminated
from tidetrace.llm.minhash import near_duplicates
from tidetrace.llm.mixing import resample
from tidetrace.llm.queries import DOMAIN_WEIGHTS, label_domain, tokenizer_path
from tidetrace.llm.token_files import read_ids, write_ids
from tidetrace.llm.toxicity import drop_toxic, fit_toxicity
from tidetrace.session import scratch_path

ORACLE_SQL = None  # fitted models and Huffman files have no SQL form; tests compare with brute force


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.filter(~in_fold(F.col("doc_id"), 5, 0)))
    return drop_toxic(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = next(name for name in ("row", "row_", "row__", "row___") if name not in docs.columns)
    named = docs.withColumn(row, F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id",
                                          F.xxhash64("text").alias("text")))
    stay = near_duplicates(named, key=row, k=5, percent=80).filter("kept").select(row)
    # Rows that repeat doc_id and text: the first one by all columns, chosen within each task first.
    nth = F.row_number().over(Window.partitionBy(row).orderBy(*docs.columns))
    return named.join(stay, row, "left_semi").withColumn("nth of " + row, nth).filter(F.col("nth of " + row) == 1).select(
        *docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resample(docs, table(spark, sf_dir, "labels"), label_domain(), weights=DOMAIN_WEIGHTS,
                    min_rate=1.0)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    directory = scratch_path(spark, f"token-files-{uuid.uuid4().hex}")
    write_ids(docs, directory, tokenizer_path(), end_id=2)
    return read_ids(spark, directory)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix),
          ("token_ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
