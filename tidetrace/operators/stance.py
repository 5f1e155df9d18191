"""Stance of posts towards a narrative (STN1-STN5, PRJ14-PRJ18).

The language model is outside Spark's concern: prompts are a table, answers
are a table. Any batch inference can fill the answers; ``answer_with`` runs a
user callable inside ``mapInPandas`` (loaded once per Python worker).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidetrace.functions.parse import first_json_object
from tidetrace.functions.text import tokens

# Answer fields in code order (support=8, opposition=4,
# neutral=2, unsure=1), labels, and the weight each stance gives a score.
STANCE_FIELDS = ("support", "opposition", "neutral", "unsure")
STANCE_WEIGHT = {"support": 1, "opposition": -1, "neutral": 1, "unsure": 0}

STANCE_INSTRUCTIONS = (
    "Decide whether the post below supports, opposes, is neutral to, or is unclear about the narrative. "
    "Answer with one JSON object with the integer fields support, opposition, neutral and unsure, "
    "exactly one of them set to 1.")


def stance_prompts(posts: DataFrame, narrative: Column | str, *, text_col: str = "Tweet") -> DataFrame:
    """PRJ18: (post_id, prompt) ready for any batch inference."""
    n = F.lit(narrative) if isinstance(narrative, str) else narrative
    return posts.select("post_id", F.concat_ws("\n", F.lit(STANCE_INSTRUCTIONS), F.concat(F.lit("Narrative: "), n),
                                               F.concat(F.lit("Post: "), F.col(text_col))).alias("prompt"))


def answer_with(prompts: DataFrame, model: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """STN1: run ``model`` (prompt texts → answer texts) over Arrow batches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"post_id": pdf["post_id"], "response": model(pdf["prompt"]).astype(object)})
    kind = prompts.schema["post_id"].dataType.simpleString()
    return prompts.mapInPandas(run, f"post_id {kind}, response string")


def parse_stance(responses: DataFrame, *, text_col: str = "response") -> DataFrame:
    """PRJ17/PRJ14/PRJ15/STN5: first parsable JSON object of each answer,
    flags read by name, 4-bit code, label (first set bit in field order,
    else unsure), how many flags are set and how many are absent (an absent or
    unreadable flag counts as 0). Answers without any JSON object are dropped
    here; ``attach_stance`` brings their posts back."""
    obj = first_json_object(F.col(text_col))
    given = {k: F.try_variant_get(F.col("_obj"), f"$.{k}", "int") for k in STANCE_FIELDS}
    flags = {k: F.coalesce(v, F.lit(0)) for k, v in given.items()}
    missing = sum((v.isNull().cast("int") for v in given.values()), F.lit(0))
    code = flags["support"] * 8 + flags["opposition"] * 4 + flags["neutral"] * 2 + flags["unsure"]
    c = F.col("response_obj")
    polarity = (F.when(c.bitwiseAND(8) != 0, F.lit("support"))
                 .when(c.bitwiseAND(4) != 0, F.lit("opposition"))
                 .when(c.bitwiseAND(2) != 0, F.lit("neutral"))
                 .otherwise(F.lit("unsure")))
    keys = ["post_id"] + ["narrative_id"] * ("narrative_id" in responses.columns)
    return (responses.select(*keys, obj.alias("_obj")).where(F.col("_obj").isNotNull())
                     .select(*keys, *[v.alias(k) for k, v in flags.items()], code.alias("response_obj"),
                             missing.alias("fields_missing"))
                     .withColumn("polarity", polarity)
                     .withColumn("flags_set", F.col("support") + F.col("opposition") + F.col("neutral")
                                 + F.col("unsure")))


def attach_stance(posts: DataFrame, parsed: DataFrame) -> DataFrame:
    """SET4/STN3: every post keeps its row; no usable answer reads 'unsure'.
    Joined on post_id, so a missing answer never shifts other posts' stances; where
    both tables name the narrative (several were asked about), on narrative_id too."""
    keys = ["post_id"] + ["narrative_id"] * ("narrative_id" in posts.columns and "narrative_id" in parsed.columns)
    p = parsed.select(*keys, "polarity", F.lit(True).alias("_answered"))
    return (posts.join(p, keys, "left")
                 .withColumn("polarity", F.coalesce(F.col("polarity"), F.lit("unsure")))
                 .withColumn("answered", F.coalesce(F.col("_answered"), F.lit(False)))
                 .drop("_answered"))


def stance_weight(polarity: Column) -> Column:
    """JN4 as an expression over a 4-entry fixed map (no join needed)."""
    expr = None
    for k, w in STANCE_WEIGHT.items():
        expr = (F.when(polarity == k, F.lit(w)) if expr is None else expr.when(polarity == k, F.lit(w)))
    return expr.otherwise(F.lit(0))


def signed_similarity(df: DataFrame, *, score_col: str = "similarity") -> DataFrame:
    """STN4/PRJ16: similarity × stance weight (unsure zeroes it; range −1..1)."""
    return df.withColumn("signed_similarity", F.round(F.col(score_col) * stance_weight(F.col("polarity")), 6))


def stance_counts(df: DataFrame) -> DataFrame:
    """AGG5: rows per stance with the summed signed similarity."""
    return df.groupBy("polarity").agg(F.count(F.lit(1)).alias("n_posts"),
                                      F.round(F.sum("signed_similarity"), 6).alias("sum_signed_similarity"))


def stance_by(df: DataFrame, by: str) -> DataFrame:
    """AGG5 as a pivot per channel or day; the value list is fixed, so the
    pivot needs no extra pass to discover it."""
    return (df.groupBy(by).pivot("polarity", list(STANCE_WEIGHT)).count().na.fill(0, list(STANCE_WEIGHT)))


def conflicting_answers(parsed: DataFrame) -> DataFrame:
    """STN5: answers that set no flag or more than one, or leave a flag out."""
    return parsed.where((F.col("flags_set") != 1) | (F.col("fields_missing") > 0))


def keyword_stance(posts: DataFrame, words: list[str], *, text_col: str = "Tweet") -> DataFrame:
    """A rule that needs no model: support when a post repeats one of the words, else
    neutral. Same columns as ``attach_stance`` (polarity, answered)."""
    wanted = F.array(*[F.lit(w.lower()) for w in words]).cast("array<string>")
    hit = F.coalesce(F.arrays_overlap(tokens(F.col(text_col)), wanted), F.lit(False))
    return posts.withColumn("polarity", F.when(hit, "support").otherwise("neutral")).withColumn("answered", F.lit(True))
