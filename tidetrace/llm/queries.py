"""The registered queries of this subpackage: QUERIES by name and ORACLE_SQL where
DuckDB can state the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidetrace.llm import oracles
from tidetrace.llm.common import in_fold, table
from tidetrace.llm.contamination import find_benchmark, hit_words
from tidetrace.llm.embeddings import similar_vectors
from tidetrace.llm.html_text import extract_main_text
from tidetrace.llm.language_id import fit_languages, identify
from tidetrace.llm.minhash import near_duplicates
from tidetrace.llm.mixing import mix_documents
from tidetrace.llm.quality import fit_quality, score_quality
from tidetrace.llm.sharding import shard_rows
from tidetrace.llm.token_files import read_ids, write_ids
from tidetrace.llm.toxicity import fit_toxicity, score_toxicity
from tidetrace.llm.url_filter import host_of, judge_urls, url_key
from tidetrace.llm.vector_clusters import CENTROIDS, COMPONENTS, ROUNDS as CLUSTER_ROUNDS, cluster_vectors
from tidetrace.llm.vector_codes import ENTRIES, PARTS, ROUNDS as CODE_ROUNDS, compress_vectors
from tidetrace.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str):
    def add(f):
        QUERIES[name] = f
        return f
    return add


@query("op3_stratified_shards")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_rows(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_huffman_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = scratch_path(spark, f"token-files-{uuid.uuid4().hex}")
    write_ids(table(spark, sf_dir, "documents"), directory, tokenizer_path(), end_id=2)
    return read_ids(spark, directory)


@query("op6_winnowing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.size("hit_runs") > 0).alias("contaminated"))


@query("op10_circulant_minhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


@query("op9_subspace_pigeonhole")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"), min_cosine=0.9)


@query("op2_site_template_removal")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


@query("op1_script_viterbi")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = in_fold(F.col("doc_id"), 4, 2)
    model = fit_languages(docs.filter(~held_out & F.col("doc_id").isNotNull()))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op7_hashed_cnn")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = in_fold(F.col("doc_id"), 5, 0)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score",
                                              (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op8_ftrl_ngrams")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = in_fold(F.col("doc_id"), 4, 2)
    model = fit_quality(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score",
                                             (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: Target shares of the labelled table's domains.
DOMAIN_WEIGHTS = {"quality0": 0.1, "quality1": 0.9}


def label_domain():
    """The domain that a row of the labelled table names; null labels name none."""
    return F.concat(F.lit("quality"), F.when(F.col("quality").isin(0, 1), F.col("quality")).cast("string"))


@query("op5_soft_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), label_domain(),
                         weights=DOMAIN_WEIGHTS)


#: The rules that the contract fixes: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def listed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for a block list: host and path of the pages on hosts with a hyphenated name."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").filter(F.contains(host_of(url), F.lit("-"))).select(url_key(url).alias("key"))


@query("op11_bloom_cascade")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), listed_urls(spark, sf_dir), URL_RULES)


@query("op12_ball_kmeans_codes")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256")


@query("op13_laesa_clusters")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))[0]


ORACLE_SQL["op11_bloom_cascade"] = oracles.url_filter(URL_RULES)
ORACLE_SQL["op12_ball_kmeans_codes"] = oracles.vector_codes(ENTRIES, PARTS, CODE_ROUNDS)
ORACLE_SQL["op13_laesa_clusters"] = oracles.vector_clusters(COMPONENTS, CENTROIDS, CLUSTER_ROUNDS, "3")
ORACLE_SQL["op6_winnowing"] = oracles.benchmark_hits(10)
ORACLE_SQL["op9_subspace_pigeonhole"] = oracles.similar_vectors(0.9)
ORACLE_SQL["op10_circulant_minhash"] = oracles.near_duplicates(2, 80)
