"""Stance queries over the model-response table L."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidetrace.functions.text import tokens
from tidetrace.operators import similarity as sim
from tidetrace.operators import stance as st
from tidetrace.plans.registry import register
from tidetrace.plans.sqlviews import L, T, V, cos, toks
from tidetrace.sources import tables as tb

PARSED = f"""{L},
J AS (SELECT post_id, list_filter(regexp_extract_all(response, '(?s)\\{{.*?\\}}'), lambda x: json_valid(x))[1] AS j FROM L),
G4 AS (SELECT post_id, TRY_CAST(json_extract(j, '$.support') AS INTEGER) AS s0,
              TRY_CAST(json_extract(j, '$.opposition') AS INTEGER) AS o0,
              TRY_CAST(json_extract(j, '$.neutral') AS INTEGER) AS n0,
              TRY_CAST(json_extract(j, '$.unsure') AS INTEGER) AS u0 FROM J WHERE j IS NOT NULL),
F AS (SELECT post_id, coalesce(s0, 0) AS support, coalesce(o0, 0) AS opposition, coalesce(n0, 0) AS neutral,
             coalesce(u0, 0) AS unsure, CAST((s0 IS NULL)::INT + (o0 IS NULL)::INT + (n0 IS NULL)::INT
                                             + (u0 IS NULL)::INT AS INTEGER) AS fields_missing FROM G4),
C AS (SELECT *, support * 8 + opposition * 4 + neutral * 2 + unsure AS response_obj FROM F),
P AS (SELECT *, CASE WHEN (response_obj & 8) <> 0 THEN 'support' WHEN (response_obj & 4) <> 0 THEN 'opposition'
                     WHEN (response_obj & 2) <> 0 THEN 'neutral' ELSE 'unsure' END AS polarity,
             support + opposition + neutral + unsure AS flags_set FROM C)"""

SIGNED = f"""{V}, {PARSED},
Tg AS (SELECT embedding AS tv FROM V WHERE post_id = 0),
S AS (SELECT V.post_id, V.ChannelName, round({cos('V.embedding', 'Tg.tv')}, 6) AS similarity FROM V, Tg),
A AS (SELECT S.*, coalesce(P.polarity, 'unsure') AS polarity FROM S LEFT JOIN P ON S.post_id = P.post_id),
G AS (SELECT *, round(similarity * CASE polarity WHEN 'support' THEN 1 WHEN 'opposition' THEN -1
                                                 WHEN 'neutral' THEN 1 ELSE 0 END, 6) AS signed_similarity FROM A)"""


def parsed(spark, sf_dir):
    return st.parse_stance(tb.model_responses(spark, sf_dir))


def signed(spark, sf_dir):
    v = tb.vector_posts(spark, sf_dir)
    targets = v.where(F.col("post_id") == 0).select(F.col("post_id").alias("narrative_id"), "embedding")
    scores = sim.score_vectors(v, targets, keep=["post_id", "ChannelName"]).drop("narrative_id")
    return st.signed_similarity(st.attach_stance(scores, parsed(spark, sf_dir)))


@register("stance_parse", sql=f"""
WITH {PARSED}
SELECT post_id, support, opposition, neutral, unsure, response_obj, polarity, flags_set, fields_missing FROM P
""")
def q_stance_parse(spark, sf_dir):
    return parsed(spark, sf_dir)


@register("stance_missing", sql=f"""
WITH {V}, {PARSED}
SELECT V.post_id, coalesce(P.polarity, 'unsure') AS polarity, P.post_id IS NOT NULL AS answered
FROM V LEFT JOIN P ON V.post_id = P.post_id
""")
def q_stance_missing(spark, sf_dir):
    v = tb.vector_posts(spark, sf_dir).select("post_id")
    return st.attach_stance(v, parsed(spark, sf_dir)).select("post_id", "polarity", "answered")


@register("stance_conflicts", sql=f"""
WITH {PARSED}
SELECT post_id, flags_set, fields_missing, polarity FROM P WHERE flags_set <> 1 OR fields_missing > 0
""")
def q_stance_conflicts(spark, sf_dir):
    return st.conflicting_answers(parsed(spark, sf_dir)).select("post_id", "flags_set", "fields_missing", "polarity")


@register("signed_similarity", sql=f"""
WITH {SIGNED}
SELECT post_id, polarity, similarity, signed_similarity FROM G
""")
def q_signed_similarity(spark, sf_dir):
    return signed(spark, sf_dir).select("post_id", "polarity", "similarity", "signed_similarity")


@register("stance_counts", sql=f"""
WITH {SIGNED}
SELECT polarity, count(*) AS n_posts, round(sum(signed_similarity), 6) AS sum_signed_similarity FROM G GROUP BY polarity
""")
def q_stance_counts(spark, sf_dir):
    return st.stance_counts(signed(spark, sf_dir))


@register("stance_by_channel", sql=f"""
WITH {SIGNED}
SELECT ChannelName, count(*) FILTER (WHERE polarity = 'support') AS support,
       count(*) FILTER (WHERE polarity = 'opposition') AS opposition,
       count(*) FILTER (WHERE polarity = 'neutral') AS neutral,
       count(*) FILTER (WHERE polarity = 'unsure') AS unsure
FROM G GROUP BY ChannelName
""")
def q_stance_by_channel(spark, sf_dir):
    return st.stance_by(signed(spark, sf_dir), "ChannelName")


PROMPT_SQL = ("'Decide whether the post below supports, opposes, is neutral to, or is unclear about the narrative. "
              "Answer with one JSON object with the integer fields support, opposition, neutral and unsure, "
              "exactly one of them set to 1.'")


@register("stance_prompts", sql=f"""
WITH {T}
SELECT post_id, {PROMPT_SQL} || chr(10) || 'Narrative: ' || (SELECT text FROM benchmark WHERE item_id = 0)
       || chr(10) || 'Post: ' || Tweet AS prompt
FROM T
""")
def q_stance_prompts(spark, sf_dir):
    t = tb.text_posts(spark, sf_dir)
    narrative = tb.table(spark, sf_dir, "benchmark").where(F.col("item_id") == 0).select("text").scalar()
    return st.stance_prompts(t, narrative)


@register("stance_model_rule", sql=f"""
WITH {T},
W AS (SELECT {toks('text')} AS words FROM benchmark WHERE item_id = 0),
P AS (SELECT CASE WHEN coalesce(list_has_any({toks('Tweet')}, (SELECT words FROM W)), false) THEN 'support'
                  ELSE 'neutral' END AS polarity FROM T)
SELECT polarity, count(*) AS n_posts, round(CAST(count(*) AS DOUBLE), 6) AS sum_signed_similarity FROM P GROUP BY polarity
""")
def q_stance_model_rule(spark, sf_dir):
    """STN1's table form with a rule in place of a model: built-in expressions only."""
    t = tb.text_posts(spark, sf_dir)
    words = (tb.table(spark, sf_dir, "benchmark").where(F.col("item_id") == 0)
             .select(tokens(F.col("text")).alias("w")).first())
    ruled = st.keyword_stance(t, words["w"] if words else []).withColumn("similarity", F.lit(1.0))
    return st.stance_counts(st.signed_similarity(ruled))


def _exclaims(prompts):
    """A stand-in for a language model: support for posts that exclaim, else neutral, as fenced JSON."""
    post = prompts.str.partition("\nPost: ")[2]
    answer = '```json\n{"support": %d, "opposition": 0, "neutral": %d, "unsure": 0}\n```'
    return post.str.contains("!", regex=False).map(lambda yes: answer % (yes, not yes))


@register("stance_with_model", sql=f"""
WITH {T}
SELECT post_id, CASE WHEN contains(coalesce(Tweet, ''), '!') THEN 'support' ELSE 'neutral' END AS polarity,
       CASE WHEN contains(coalesce(Tweet, ''), '!') THEN 8 ELSE 2 END AS response_obj
FROM T
""")
def q_stance_with_model(spark, sf_dir):
    """STN1: prompts answered by a callable in Arrow batches, answers parsed; the callable is a rule here."""
    t = tb.text_posts(spark, sf_dir)
    narrative = tb.table(spark, sf_dir, "benchmark").where(F.col("item_id") == 0).select("text").scalar()
    answers = st.answer_with(st.stance_prompts(t, narrative), _exclaims)
    return st.parse_stance(answers).select("post_id", "polarity", "response_obj")
