"""Cluster queries. Fixed centres (the first post of each label) make the
assignment oracle-checkable; the k-means is restated in SQL round by round."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidetrace.operators import cluster as cl
from tidetrace.plans.registry import register
from tidetrace.plans.sqlviews import T, V, cos, toks
from tidetrace.sources import tables as tb

KMEANS_K = 10
KMEANS_SEED = 42

CENTRES = "Cn AS (SELECT label AS cluster_id, arg_min(embedding, post_id) AS tv FROM V GROUP BY label)"
ASSIGN = f"""S AS (SELECT P.*, Cn.cluster_id, round({cos('P.embedding', 'Cn.tv')}, 6) AS similarity FROM P, Cn),
A AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY similarity DESC, cluster_id) AS rn
                       FROM S) WHERE rn = 1)"""


def label_centres(v):
    """One centre per label: the embedding of its lowest post id."""
    return v.groupBy(F.col("label").cast("long").alias("cluster_id")).agg(
        F.min_by("embedding", "post_id").alias("embedding"))


def text_vector_posts(spark, sf_dir):
    return tb.posts_with_text_and_vectors(spark, sf_dir).select("post_id", "Tweet", "embedding")


@register("nearest_centroid", sql=f"""
WITH {V}, {CENTRES}, P AS (SELECT post_id, embedding FROM V), {ASSIGN}
SELECT post_id, cluster_id, similarity FROM A
""")
def q_nearest_centroid(spark, sf_dir):
    v = tb.vector_posts(spark, sf_dir)
    return cl.assign_nearest(v, label_centres(v), keep=["post_id"])


@register("cluster_profile", sql=f"""
WITH {V},
X AS (SELECT label AS cluster_id, unnest(embedding) AS x, unnest(generate_series(0, len(embedding) - 1)) AS i FROM V),
M AS (SELECT cluster_id, i, avg(x) AS x FROM X GROUP BY cluster_id, i),
C AS (SELECT cluster_id, list(x ORDER BY i) AS c FROM M GROUP BY cluster_id),
J AS (SELECT V.*, round({cos('V.embedding', 'C.c')}, 6) AS s FROM V JOIN C ON V.label = C.cluster_id)
SELECT label AS cluster_id, count(*) AS n_posts, min(Datetime) AS first_post, max(Datetime) AS last_post,
       count(DISTINCT ChannelName) AS n_channels,
       sum(CAST(round(s * 1000000) AS BIGINT)) / count(s) / 1000000.0 AS mean_centre_similarity
FROM J GROUP BY label
""")
def q_cluster_profile(spark, sf_dir):
    v = tb.vector_posts(spark, sf_dir).withColumn("cluster_id", F.col("label").cast("long"))
    return cl.cluster_profile(v)


@register("cluster_terms", sql=f"""
WITH {T},
X AS (SELECT ChannelName AS cluster_id, unnest({toks('Tweet')}) AS term FROM T),
TF AS (SELECT cluster_id, term, count(*) AS tf FROM X GROUP BY cluster_id, term),
SZ AS (SELECT cluster_id, sum(tf) AS size FROM TF GROUP BY cluster_id),
FQ AS (SELECT term, sum(tf) AS f FROM TF GROUP BY term),
AV AS (SELECT avg(size) AS a FROM SZ),
S AS (SELECT TF.cluster_id, TF.term, round(TF.tf / SZ.size * ln(1.0 + AV.a / FQ.f), 6) AS score
      FROM TF JOIN SZ ON TF.cluster_id = SZ.cluster_id JOIN FQ ON TF.term = FQ.term, AV),
R AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, term) AS rank FROM S)
SELECT cluster_id, rank, term, score FROM R WHERE rank <= 5
""")
def q_cluster_terms(spark, sf_dir):
    t = tb.text_posts(spark, sf_dir).select("ChannelName", "Tweet")
    return cl.cluster_terms(t, cluster_col="ChannelName")


@register("cluster_narratives", sql=f"""
WITH {T}, {V}, {CENTRES},
P AS (SELECT T.post_id, T.Tweet, V.embedding FROM T JOIN V ON T.post_id = V.post_id), {ASSIGN},
BT AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, Tweet ORDER BY similarity DESC, post_id) AS r1
                      FROM A) WHERE r1 = 1),
RT AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY similarity DESC, post_id) AS r2 FROM BT),
N2 AS (SELECT cluster_id, max(CASE WHEN r2 = 1 THEN Tweet END) AS narrative_1, max(CASE WHEN r2 = 2 THEN Tweet END) AS narrative_2
       FROM RT WHERE r2 <= 2 GROUP BY cluster_id),
MB AS (SELECT cluster_id, list(post_id ORDER BY rm) AS top_post_ids
       FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY similarity DESC, post_id) AS rm FROM A)
       WHERE rm <= 5 GROUP BY cluster_id),
SZ AS (SELECT cluster_id, count(*) AS n_posts FROM A GROUP BY cluster_id)
SELECT SZ.cluster_id, n_posts, narrative_1, narrative_2, top_post_ids
FROM SZ JOIN N2 ON SZ.cluster_id = N2.cluster_id JOIN MB ON SZ.cluster_id = MB.cluster_id
""")
def q_cluster_narratives(spark, sf_dir):
    p = text_vector_posts(spark, sf_dir)
    centres = label_centres(tb.vector_posts(spark, sf_dir))
    assigned = cl.assign_nearest(p, centres, keep=["post_id", "Tweet"])
    return cl.extractive_narratives(assigned).select("cluster_id", "n_posts", "narrative_1", "narrative_2",
                                                     "top_post_ids")


@register("cluster_prompts", sql=f"""
WITH {T}, {V}, {CENTRES},
P AS (SELECT T.post_id, T.Tweet, V.embedding FROM T JOIN V ON T.post_id = V.post_id), {ASSIGN},
R AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY similarity DESC, post_id) AS rn FROM A)
SELECT cluster_id, CAST((rn - 1) // 50 AS BIGINT) AS prompt_no,
       'Name the two main narratives in these posts as JSON with keys narrative_1 and narrative_2.'
       || chr(10) || string_agg(Tweet, chr(10) || '- ' ORDER BY rn) AS prompt
FROM R GROUP BY 1, 2
""")
def q_cluster_prompts(spark, sf_dir):
    p = text_vector_posts(spark, sf_dir)
    centres = label_centres(tb.vector_posts(spark, sf_dir))
    return cl.narrative_prompts(cl.assign_nearest(p, centres, keep=["post_id", "Tweet"]))


@register("cluster_members", sql=f"""
WITH {T}, {V}, {CENTRES},
P AS (SELECT T.post_id, T.Tweet, V.embedding FROM T JOIN V ON T.post_id = V.post_id), {ASSIGN}
SELECT cluster_id, post_id, similarity,
       row_number() OVER (PARTITION BY cluster_id ORDER BY similarity DESC, post_id) - 1 AS place FROM A
""")
def q_cluster_members(spark, sf_dir):
    p = text_vector_posts(spark, sf_dir)
    centres = label_centres(tb.vector_posts(spark, sf_dir))
    return cl.cluster_members(cl.assign_nearest(p, centres, keep=["post_id"]))


def kmeans_sql(k: int, rounds: int = 20) -> str:
    """CTEs of the k-means on V: KL (post_id, cluster_id) and KC (cluster_id, pos, c)."""
    ctes = [f"""L AS MATERIALIZED (SELECT post_id, embedding, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS l FROM V),
U AS MATERIALIZED (SELECT post_id, generate_subscripts(embedding, 1) - 1 AS pos,
                   CAST(floor(CAST(unnest(embedding) AS DOUBLE) / l * 1048576 + 0.5) AS BIGINT) AS u FROM L),
F0 AS (SELECT post_id, row_number() OVER (ORDER BY sha256('{KMEANS_SEED}:' || post_id), post_id) - 1 AS cluster_id FROM V QUALIFY cluster_id < {k}),
C0 AS MATERIALIZED (SELECT cluster_id, pos, u AS c FROM F0 JOIN U USING (post_id))"""]
    for r in range(rounds + 1):
        ctes.append(f"""A{r} AS MATERIALIZED (SELECT post_id, cluster_id FROM (
  SELECT post_id, cluster_id, sum(u * c) AS d FROM U JOIN C{r} USING (pos) GROUP BY post_id, cluster_id)
  QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY d DESC, cluster_id) = 1)""")
        if r < rounds:
            ctes.append(f"""S{r} AS (SELECT cluster_id, pos, sum(u) AS s FROM A{r} JOIN U USING (post_id) GROUP BY cluster_id, pos),
N{r} AS (SELECT cluster_id, sqrt(CAST(sum(s * s) AS DOUBLE)) AS l FROM S{r} GROUP BY cluster_id HAVING sum(s * s) > 0),
C{r + 1} AS MATERIALIZED (SELECT cluster_id, pos, CASE WHEN l IS NULL THEN c ELSE CAST(floor(CAST(s AS DOUBLE) / l * 1048576 + 0.5) AS BIGINT) END AS c
                          FROM C{r} LEFT JOIN S{r} USING (cluster_id, pos) LEFT JOIN N{r} USING (cluster_id))""")
    ctes += [f"KL AS (SELECT * FROM A{rounds})", f"KC AS (SELECT * FROM C{rounds})"]
    return ",\n".join(ctes)


def dominant_sql(candidates: int = cl.CANDIDATES) -> str:
    """CTEs of the dominant narratives of A (post_id, cluster_id, embedding, similarity): D."""
    cosine = f"greatest(0.0, round({cos('m.embedding', 'c.embedding')}, 6))"
    return f"""
CD AS MATERIALIZED (SELECT cluster_id, post_id AS id, embedding FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY similarity DESC, post_id) AS rn FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster_id, embedding ORDER BY similarity DESC, post_id) AS r1 FROM A) WHERE r1 = 1)
  WHERE rn <= {candidates}),
CS AS MATERIALIZED (SELECT m.cluster_id, m.post_id, c.id, {cosine} AS s FROM A m JOIN CD c ON m.cluster_id = c.cluster_id),
T1 AS (SELECT cluster_id, id, sum(CAST(round(s * 1000000) AS BIGINT)) AS total, count(*) AS n FROM CS GROUP BY cluster_id, id),
G1 AS (SELECT * FROM T1 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY total DESC, id) = 1),
T2 AS (SELECT c.cluster_id, c.id, sum(CAST(round(greatest(c.s, o.s) * 1000000) AS BIGINT)) AS total
       FROM CS c JOIN G1 ON c.cluster_id = G1.cluster_id AND c.id <> G1.id
       JOIN CS o ON o.cluster_id = c.cluster_id AND o.post_id = c.post_id AND o.id = G1.id GROUP BY c.cluster_id, c.id),
G2 AS (SELECT * FROM T2 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY total DESC, id) = 1),
D AS (SELECT G1.cluster_id, G1.n AS n_posts, G1.id AS narrative_1, G1.total / G1.n / 1000000 AS cover_1,
             G2.id AS narrative_2, G2.total / G1.n / 1000000 AS cover_2 FROM G1 LEFT JOIN G2 USING (cluster_id))"""


@register("kmeans_clusters", sql=f"""
WITH {V}, {kmeans_sql(KMEANS_K)}
SELECT post_id, CAST(cluster_id AS BIGINT) AS cluster_id FROM KL
""")
def q_kmeans_clusters(spark, sf_dir):
    """CLU1/CLU2: fixed-point k-means, restated round by round in SQL."""
    v = tb.vector_posts(spark, sf_dir)
    assigned, _ = cl.fit_kmeans(v, KMEANS_K, seed=KMEANS_SEED)
    return assigned


@register("cluster_dominant", sql=f"""
WITH {V}, {CENTRES}, P AS (SELECT post_id, embedding FROM V), {ASSIGN}, {dominant_sql()}
SELECT cluster_id, n_posts, narrative_1, round(cover_1, 9) AS cover_1, narrative_2, round(cover_2, 9) AS cover_2 FROM D
""")
def q_cluster_dominant(spark, sf_dir):
    """CLU5: the two narratives of each cluster that cover its members best."""
    v = tb.vector_posts(spark, sf_dir)
    near = cl.assign_nearest(v, label_centres(v), keep=["post_id", "embedding"])
    return cl.dominant_narratives(near).withColumns({c: F.round(c, 9) for c in ("cover_1", "cover_2")})


@register("narratives_discovered", sql=f"""
WITH {V}, {kmeans_sql(3)},
Cn AS (SELECT cluster_id, list(CAST(c / 1048576.0 AS FLOAT) ORDER BY pos) AS tv FROM KC GROUP BY cluster_id),
P AS (SELECT post_id, embedding FROM V), {ASSIGN}, {dominant_sql()},
NR AS (SELECT cluster_id * 2 AS narrative_id, narrative_1 AS p FROM D UNION ALL
       SELECT cluster_id * 2 + 1, narrative_2 FROM D WHERE narrative_2 IS NOT NULL),
Z AS (SELECT V.post_id, V.ChannelName, V.Datetime, CAST(NR.narrative_id AS BIGINT) AS narrative_id,
             round({cos('V.embedding', 'T2.embedding')}, 6) AS similarity FROM V, NR JOIN V T2 ON T2.post_id = NR.p)
SELECT * FROM Z WHERE similarity >= 0.2
""")
def q_narratives_discovered(spark, sf_dir):
    """CLU8: cluster → both dominant narratives of each → trace every post."""
    v = tb.vector_posts(spark, sf_dir)
    return cl.discover_and_trace(v, 3, seed=KMEANS_SEED, threshold=0.2)
