"""Trace queries: vector and lexical traces, top-k, summaries, timelines, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidetrace.operators import similarity as sim
from tidetrace.operators import trace as tr
from tidetrace.operators.embed import embed_with
from tidetrace.operators.prepare import author_context
from tidetrace.operators.tfidf import score_tfidf
from tidetrace.plans.registry import register
from tidetrace.plans.sqlviews import T, V, cos, toks
from tidetrace.sources import tables as tb

# Fixed parameters of the registered queries (FIXTURES.md §3).
VECTOR_THRESHOLD = 0.2
TEXT_THRESHOLD = 0.5
RANGE_START, RANGE_END = "2024-01-05", "2024-01-20"
ONE_TARGET = [0]
THREE_TARGETS = [0, 1, 2]
TOP_K = 10


def vector_targets(posts, ids):
    return posts.where(F.col("post_id").isin(ids)).select(
        F.col("post_id").alias("narrative_id"), "embedding")


def benchmark_narratives(spark, sf_dir):
    return tb.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("narrative_id"), "text")


@register("trace_vectors", sql=f"""
WITH {V},
Tg AS (SELECT post_id AS narrative_id, embedding AS tv FROM V WHERE post_id = 0),
S AS (SELECT V.post_id, V.ChannelName, V.Datetime, Tg.narrative_id, round({cos('V.embedding', 'Tg.tv')}, 6) AS similarity
      FROM V, Tg
      WHERE V.Datetime >= TIMESTAMP '2024-01-05 00:00:00' AND V.Datetime <= TIMESTAMP '2024-01-20 00:00:00')
SELECT * FROM S WHERE similarity >= 0.2
""")
def q_trace_vectors(spark, sf_dir):
    v = tb.vector_posts(spark, sf_dir)
    return tr.trace_vectors(v, vector_targets(v, ONE_TARGET), start=RANGE_START, end=RANGE_END,
                            threshold=VECTOR_THRESHOLD, keep=["post_id", "ChannelName", "Datetime"])


@register("trace_multi", sql=f"""
WITH {V},
Tg AS (SELECT post_id AS narrative_id, embedding AS tv FROM V WHERE post_id IN (0, 1, 2)),
S AS (SELECT V.post_id, V.ChannelName, V.Datetime, Tg.narrative_id, round({cos('V.embedding', 'Tg.tv')}, 6) AS similarity
      FROM V, Tg)
SELECT * FROM S WHERE similarity >= 0.2
""")
def q_trace_multi(spark, sf_dir):
    v = tb.vector_posts(spark, sf_dir)
    return tr.trace_vectors(v, vector_targets(v, THREE_TARGETS), threshold=VECTOR_THRESHOLD,
                            keep=["post_id", "ChannelName", "Datetime"])


LEXICAL_SQL = f"""
PT AS (SELECT post_id, unnest({toks('Tweet')}) AS token FROM T),
PC AS (SELECT post_id, token, count(*) AS c FROM PT GROUP BY post_id, token),
PN AS (SELECT post_id, sum(c * c) AS n2 FROM PC GROUP BY post_id),
NT AS (SELECT item_id AS narrative_id, unnest({toks('text')}) AS token FROM benchmark),
NC AS (SELECT narrative_id, token, count(*) AS c FROM NT GROUP BY narrative_id, token),
NN AS (SELECT narrative_id, sum(c * c) AS n2 FROM NC GROUP BY narrative_id),
D AS (SELECT PC.post_id, NC.narrative_id, sum(PC.c * NC.c) AS dot FROM PC JOIN NC ON PC.token = NC.token
      GROUP BY PC.post_id, NC.narrative_id),
S AS (SELECT D.post_id, D.narrative_id, round(coalesce(D.dot / nullif(sqrt(CAST(PN.n2 AS DOUBLE)) * sqrt(CAST(NN.n2 AS DOUBLE)), 0), 0), 6) AS similarity
      FROM D JOIN PN ON D.post_id = PN.post_id JOIN NN ON D.narrative_id = NN.narrative_id)"""


@register("trace_lexical", sql=f"""
WITH {T}, {LEXICAL_SQL}
SELECT T.post_id, T.ChannelName, T.datasetName, T.Datetime, S.narrative_id, S.similarity
FROM S JOIN T ON S.post_id = T.post_id WHERE S.similarity >= 0.5
""")
def q_trace_lexical(spark, sf_dir):
    t = tb.text_posts(spark, sf_dir)
    return tr.trace_text(t, benchmark_narratives(spark, sf_dir), threshold=TEXT_THRESHOLD,
                         keep=["post_id", "ChannelName", "datasetName", "Datetime"])


@register("topk_per_narrative", sql=f"""
WITH {V},
Tg AS (SELECT post_id AS narrative_id, embedding AS tv FROM V WHERE post_id IN (0, 1, 2)),
S AS (SELECT V.post_id, Tg.narrative_id, round({cos('V.embedding', 'Tg.tv')}, 6) AS similarity FROM V, Tg),
R AS (SELECT *, row_number() OVER (PARTITION BY narrative_id ORDER BY similarity DESC, post_id) AS rank FROM S)
SELECT narrative_id, rank, post_id, similarity FROM R WHERE rank <= 10
""")
def q_topk(spark, sf_dir):
    v = tb.vector_posts(spark, sf_dir)
    scores = sim.score_vectors(v, vector_targets(v, THREE_TARGETS), keep=["post_id"])
    return sim.top_k_per_narrative(scores, TOP_K).select("narrative_id", "rank", "post_id", "similarity")


@register("topk_lexical", sql=f"""
WITH {T}, {LEXICAL_SQL},
R AS (SELECT *, row_number() OVER (PARTITION BY narrative_id ORDER BY similarity DESC, post_id) AS rank FROM S)
SELECT narrative_id, rank, post_id, similarity FROM R WHERE rank <= 10
""")
def q_topk_lexical(spark, sf_dir):
    t = tb.text_posts(spark, sf_dir)
    scores = sim.score_lexical(t, benchmark_narratives(spark, sf_dir), keep=["post_id"])
    return sim.top_k_per_narrative(scores, TOP_K).select("narrative_id", "rank", "post_id", "similarity")


@register("trace_summary", sql=f"""
WITH {V},
Tg AS (SELECT post_id AS narrative_id, embedding AS tv FROM V WHERE post_id IN (0, 1, 2)),
S AS (SELECT V.post_id, V.ChannelName, V.Datetime, Tg.narrative_id, round({cos('V.embedding', 'Tg.tv')}, 6) AS similarity FROM V, Tg)
SELECT narrative_id, ChannelName, count(*) AS total_posts, min(Datetime) AS first_post, max(Datetime) AS last_post,
       round(sum(similarity), 6) AS sum_similarity,
       sum(CAST(round(similarity * 1000000) AS BIGINT)) / count(similarity) / 1000000.0 AS mean_similarity,
       max(similarity) AS max_similarity
FROM S WHERE similarity >= 0.2 GROUP BY narrative_id, ChannelName
""")
def q_trace_summary(spark, sf_dir):
    return tr.trace_summary(q_trace_multi(spark, sf_dir), ["narrative_id", "ChannelName"])


@register("timeline_daily", sql=f"""
WITH {V},
Tg AS (SELECT post_id AS narrative_id, embedding AS tv FROM V WHERE post_id = 0),
S AS (SELECT V.post_id, V.ChannelName, V.Datetime, round({cos('V.embedding', 'Tg.tv')}, 6) AS similarity FROM V, Tg)
SELECT date_trunc('day', Datetime) AS bucket_start, ChannelName, count(*) AS n_posts,
       round(sum(similarity), 6) AS sum_similarity, max(similarity) AS max_similarity
FROM S GROUP BY date_trunc('day', Datetime), ChannelName
""")
def q_timeline(spark, sf_dir):
    v = tb.vector_posts(spark, sf_dir)
    scores = sim.score_vectors(v, vector_targets(v, ONE_TARGET), keep=["post_id", "ChannelName", "Datetime"])
    return tr.timeline(scores, by=["ChannelName"])


@register("dataset_union", sql=f"""
WITH {T}
SELECT datasetName, post_id, ChannelName, Datetime FROM T
""")
def q_dataset_union(spark, sf_dir):
    t = tb.text_posts(spark, sf_dir).select("post_id", "ChannelName", "Datetime", "datasetName")
    langs = ("en", "de", "fr", "es")
    parts = {lang: t.where(F.col("datasetName") == lang).drop("datasetName") for lang in langs}
    rest = t.where(~F.col("datasetName").isin(*langs) | F.col("datasetName").isNull())
    u = tr.union_datasets(parts).unionByName(rest)
    return tr.chronological(u.select("datasetName", "post_id", "ChannelName", "Datetime"))


@register("dataset_names", sql=f"""
WITH {T}, {LEXICAL_SQL}
SELECT coalesce(datasetName, 'unknown') AS datasetName FROM T
UNION SELECT coalesce(T.datasetName, 'unknown') FROM S JOIN T ON S.post_id = T.post_id WHERE S.similarity >= 0.5
""")
def q_dataset_names(spark, sf_dir):
    t = tb.text_posts(spark, sf_dir)
    traced = tr.trace_text(t, benchmark_narratives(spark, sf_dir), threshold=TEXT_THRESHOLD,
                           keep=["post_id", "datasetName"])
    return tr.dataset_names(t, traced)


@register("trace_positions", sql=f"""
WITH {V},
D AS (SELECT *, row_number() OVER (ORDER BY post_id) - 1 AS position FROM V
      WHERE Datetime >= TIMESTAMP '2024-01-05 00:00:00' AND Datetime <= TIMESTAMP '2024-01-20 00:00:00'),
Tg AS (SELECT post_id AS narrative_id, embedding AS tv FROM V WHERE post_id = 0),
S AS (SELECT D.post_id, D.Datetime, D.position, Tg.narrative_id, round({cos('D.embedding', 'Tg.tv')}, 6) AS similarity
      FROM D, Tg)
SELECT * FROM S WHERE similarity >= 0.2
""")
def q_trace_positions(spark, sf_dir):
    """PRJ9: trace with the post's place in the date-filtered input kept."""
    v = tb.vector_posts(spark, sf_dir)
    return tr.trace_vectors(v, vector_targets(v, ONE_TARGET), start=RANGE_START, end=RANGE_END,
                            threshold=VECTOR_THRESHOLD, keep=["post_id", "Datetime"], position_order=["post_id"])


@register("trace_first_posts", sql=f"""
WITH {V},
P AS (SELECT *, row_number() OVER (ORDER BY Datetime, post_id) - 1 AS position FROM V),
Tg AS (SELECT post_id AS narrative_id, embedding AS tv FROM V WHERE post_id IN (0, 1, 2))
SELECT P.post_id, P.position, Tg.narrative_id, round({cos('P.embedding', 'Tg.tv')}, 6) AS similarity
FROM P, Tg WHERE P.position < 200
""")
def q_trace_first_posts(spark, sf_dir):
    """SIM7: only the first 200 posts in time are scored, on demand (no cap otherwise)."""
    v = tb.vector_posts(spark, sf_dir)
    return tr.trace_vectors(v, vector_targets(v, THREE_TARGETS), threshold=None, keep=["post_id"],
                            position_order=["Datetime", "post_id"], max_posts=200)


@register("sort_by_narrative", sql=f"""
WITH {V},
Tg AS (SELECT post_id AS narrative_id, embedding AS tv FROM V WHERE post_id = 1)
SELECT V.post_id, Tg.narrative_id, round({cos('V.embedding', 'Tg.tv')}, 6) AS similarity FROM V, Tg
ORDER BY similarity, post_id
""")
def q_sort_by_narrative(spark, sf_dir):
    """RNK1: every post ascending by similarity to one narrative."""
    v = tb.vector_posts(spark, sf_dir)
    scores = sim.score_vectors(v, vector_targets(v, THREE_TARGETS), keep=["post_id"])
    return sim.sort_by_narrative(scores, 1)


@register("first_posts", sql=f"""
WITH {T}
SELECT post_id, ChannelName, Datetime FROM T ORDER BY Datetime, post_id LIMIT 100
""")
def q_first_posts(spark, sf_dir):
    """RNK9/RNK5: the first 100 posts in time (a top-n feature, not a row cap)."""
    t = tb.text_posts(spark, sf_dir).select("post_id", "ChannelName", "Datetime")
    return tr.first_posts(t, 100, ["Datetime", "post_id"])


@register("dataset_filter", sql=f"""
WITH {T}
SELECT post_id, datasetName, Datetime FROM T WHERE coalesce(datasetName, 'unknown') = 'de'
""")
def q_dataset_filter(spark, sf_dir):
    """FLT5: one dataset's rows."""
    return tr.filter_dataset(tb.text_posts(spark, sf_dir), "de").select("post_id", "datasetName", "Datetime")


@register("trace_author_text", sql=f"""
WITH {T}, {LEXICAL_SQL.replace(toks('Tweet'), toks("('Author: ' || ChannelName || chr(10) || 'Tweet: ' || Tweet)"))}
SELECT post_id, narrative_id, similarity FROM S WHERE similarity >= 0.45
""")
def q_trace_author_text(spark, sf_dir):
    """SIM3: the lexical trace over the text with its author."""
    t = author_context(tb.text_posts(spark, sf_dir))
    return tr.trace_text(t, benchmark_narratives(spark, sf_dir), threshold=0.45, keep=["post_id"], text_col="AuthorTweet")


@register("timeline_points", sql=f"""
WITH {V},
Tg AS (SELECT post_id AS narrative_id, embedding AS tv FROM V WHERE post_id IN (0, 1, 2))
SELECT narrative_id, Datetime, round({cos('V.embedding', 'Tg.tv')}, 6) AS similarity, V.post_id FROM V, Tg
""")
def q_timeline_points(spark, sf_dir):
    """AGG16: all points of the similarity-over-time plot, in time order."""
    v = tb.vector_posts(spark, sf_dir)
    return tr.timeline_points(sim.score_vectors(v, vector_targets(v, THREE_TARGETS), keep=["post_id", "Datetime"]))


@register("sort_by_unknown_narrative", sql=f"""
WITH {V},
Tg AS (SELECT post_id AS narrative_id, embedding AS tv FROM V WHERE post_id = 0)
SELECT V.post_id, Tg.narrative_id, round({cos('V.embedding', 'Tg.tv')}, 6) AS similarity FROM V, Tg
""")
def q_sort_by_unknown_narrative(spark, sf_dir):
    """RNK1: an id that names no narrative falls back to the first one."""
    v = tb.vector_posts(spark, sf_dir)
    targets = vector_targets(v, THREE_TARGETS)
    return sim.sort_by_narrative(sim.score_vectors(v, targets, keep=["post_id"]), 99, narratives=targets)


@register("trace_tfidf", sql=f"""
WITH {T},
PC AS MATERIALIZED (SELECT post_id AS id, token, count(*) AS tf FROM (SELECT post_id, unnest({toks('Tweet')}) AS token FROM T) GROUP BY 1, 2),
NC AS (SELECT item_id AS id, token, count(*) AS tf FROM (SELECT item_id, unnest({toks('text')}) AS token FROM benchmark) GROUP BY 1, 2),
DF AS MATERIALIZED (SELECT token, count(*) AS df FROM PC GROUP BY token),
NP AS (SELECT count(*) AS n FROM T),
WP AS MATERIALIZED (SELECT id, PC.token, tf * ln(CAST(n + 1 AS DOUBLE) / (df + 1)) AS w FROM PC JOIN DF USING (token), NP),
WN AS MATERIALIZED (SELECT id, NC.token, tf * ln(CAST(n + 1 AS DOUBLE) / (coalesce(df, 0) + 1)) AS w FROM NC LEFT JOIN DF USING (token), NP),
AN AS (SELECT id, sqrt(sum(w * w)) AS a FROM WP GROUP BY id), BN AS (SELECT id, sqrt(sum(w * w)) AS b FROM WN GROUP BY id),
D AS (SELECT WP.id AS post_id, WN.id AS narrative_id, sum(WP.w * WN.w) AS dot FROM WP JOIN WN ON WP.token = WN.token GROUP BY 1, 2),
S AS (SELECT post_id, narrative_id, round(coalesce(dot / nullif(a * b, 0), 0), 6) AS similarity
      FROM D JOIN AN ON AN.id = post_id JOIN BN ON BN.id = narrative_id)
SELECT post_id, narrative_id, similarity FROM S WHERE similarity >= 0.3
""")
def q_trace_tfidf(spark, sf_dir):
    """EMB1/EMB2: the trace on sparse TF-IDF vectors by token."""
    return score_tfidf(tb.text_posts(spark, sf_dir), benchmark_narratives(spark, sf_dir), threshold=0.3)


LETTERS = "aeinorstu"
LETTER_SQL = "[" + ", ".join(f"length({{0}}) - length(replace({{0}}, '{c}', ''))" for c in LETTERS) + "]"


def _letter_counts(texts):
    return [[t.count(c) for c in LETTERS] for t in texts]


@register("trace_with_encoder", sql=f"""
WITH {T},
P AS MATERIALIZED (SELECT post_id, {LETTER_SQL.format("coalesce(Tweet, '')")} AS e FROM T),
Q AS MATERIALIZED (SELECT item_id AS narrative_id, {LETTER_SQL.format("coalesce(text, '')")} AS tv FROM benchmark),
S AS (SELECT post_id, narrative_id, round({cos('P.e', 'Q.tv')}, 6) AS similarity FROM P, Q)
SELECT * FROM S WHERE similarity >= 0.99
""")
def q_trace_with_encoder(spark, sf_dir):
    """EMB1(b) + SIM6: posts and narratives encoded by a callable (counts of letters here), then traced."""
    posts = embed_with(tb.text_posts(spark, sf_dir), _letter_counts)
    narratives = embed_with(benchmark_narratives(spark, sf_dir), _letter_counts, text_col="text", key_col="narrative_id")
    return sim.score_vectors(posts, narratives, threshold=0.99)
