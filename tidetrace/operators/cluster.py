"""Clusters of posts and their narratives (CLU1-CLU8)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidetrace.functions.ranking import group_positions
from tidetrace.functions.stats import exact_mean
from tidetrace.functions.text import text_key, tokens
from tidetrace.functions.vectors import cosine
from tidetrace.operators.fixed_kmeans import STEPS, spherical_kmeans
from tidetrace.operators.similarity import nearest_target, score_vectors
from tidetrace.session import ensure_checkpoint_dir, spread

TOP_MEMBERS = 5
TOP_TERMS = 5
MAX_SIDE_VALUES = 2_000_000  # of a table with a row per cluster, to be broadcast
CANDIDATE_VALUES = 4_000_000  # of vectors of candidates held at once
CANDIDATES = 32  # posts of a cluster that may be its narratives


def fit_kmeans(posts: DataFrame, k: int = 3, *, seed: int = 42, vec_col: str = "embedding",
               max_iter: int = 20) -> tuple[DataFrame, DataFrame]:
    """CLU1/CLU2: spherical k-means (cosine) on the post vectors, the same bits for any
    partitioning (``fixed_kmeans``).

    Returns (assignments(post_id, cluster_id), centres(cluster_id, embedding)). Fewer
    usable posts than k is an error. Null and zero vectors have no direction: they are left out of
    the fit and keep their rows with a null cluster_id.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    labels, found = spherical_kmeans(posts, k, seed=seed, vec_col=vec_col, max_iter=max_iter)
    rest = posts.select("post_id").join(labels.select("post_id"), "post_id", "left_anti")
    assigned = labels.unionByName(rest.select("post_id", F.lit(None).cast("long").alias("cluster_id")))
    centres = posts.sparkSession.createDataFrame(
        [(i, [x / STEPS for x in c]) for i, c in enumerate(found)],
        T.StructType([T.StructField("cluster_id", T.LongType()),
                      T.StructField("embedding", T.ArrayType(T.FloatType()))]))
    return assigned, centres


def assign_nearest(posts: DataFrame, centres: DataFrame, *, keep: list[str] | None = None) -> DataFrame:
    """CLU3: nearest centre by cosine, ties to the lowest cluster id."""
    return nearest_target(posts, centres, target_id_col="cluster_id", keep=keep)


def _vector_sums(batches):
    """Rows (cluster_id, i, s, n) of each batch: sum and number of the components at each position."""
    for batch in batches:
        vectors, cluster = batch.column("v"), batch.column("cluster_id").dictionary_encode()
        known = vectors.is_valid()
        vectors, cluster = vectors.filter(known), cluster.filter(known)
        if not len(vectors):
            continue
        length = vectors.value_lengths().to_numpy()
        dims = max(1, int(length.max()))
        place = np.arange(length.sum()) - np.repeat(length.cumsum() - length, length)
        key = np.repeat(cluster.indices.to_numpy().astype(np.int64), length) * dims + place
        x = vectors.flatten()
        ok = x.is_valid().to_numpy(zero_copy_only=False)
        x, key = x.to_numpy(zero_copy_only=False).astype(np.float64)[ok], key[ok]
        n = np.bincount(key)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [cluster.dictionary.take(pa.array(at // dims)), pa.array(at % dims),
             pa.array(np.bincount(key, weights=x)[at]), pa.array(n[at])], names=["cluster_id", "i", "s", "n"])


def mean_vectors(assigned: DataFrame, *, vec_col: str = "embedding") -> DataFrame:
    """Element-wise mean vector per cluster (cluster_id, embedding ARRAY<DOUBLE>). A task sums
    each Arrow batch by cluster, so rows are never exploded and a big cluster spans many tasks."""
    rows = assigned.where(F.col("cluster_id").isNotNull()).select("cluster_id", F.col(vec_col).alias("v"))
    kind = rows.schema["cluster_id"].dataType.simpleString()
    sums = rows.mapInArrow(_vector_sums, f"cluster_id {kind}, i bigint, s double, n bigint")
    m = sums.groupBy("cluster_id", "i").agg((F.sum("s") / F.sum("n")).alias("x"))
    return m.groupBy("cluster_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))


def small_side(df: DataFrame, values_per_row: int = 1) -> DataFrame:
    """A staged table marked for broadcast if it holds at most MAX_SIDE_VALUES values; else it is joined by a shuffle."""
    return F.broadcast(df) if df.count() * max(1, values_per_row) <= MAX_SIDE_VALUES else df


def cluster_profile(assigned: DataFrame, *, vec_col: str = "embedding") -> DataFrame:
    """CLU4: size, time span, channels and mean cosine to the cluster mean."""
    ensure_checkpoint_dir(assigned.sparkSession)
    centres = mean_vectors(assigned, vec_col=vec_col).withColumnRenamed("embedding", "_c").checkpoint(eager=True)
    dims = centres.agg(F.max(F.size("_c"))).first()[0] or 0
    j = assigned.join(small_side(centres, dims), "cluster_id")
    s = F.round(cosine(F.col(vec_col), F.col("_c")), 6)
    return j.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_posts"), F.min("Datetime").alias("first_post"),
        F.max("Datetime").alias("last_post"), F.countDistinct("ChannelName").alias("n_channels"),
        exact_mean(s).alias("mean_centre_similarity"))


def cluster_terms(df: DataFrame, *, cluster_col: str = "cluster_id", text_col: str = "Tweet",
                  top: int = TOP_TERMS) -> DataFrame:
    """CLU6: class-based TF-IDF, score = tf(t,c)/|c| · ln(1 + A/f(t)), with A the
    mean token count per cluster and f(t) the count of t over all clusters."""
    ex = spread(df.select(F.col(cluster_col).alias("cluster_id"), F.col(text_col))) \
        .select("cluster_id", F.explode(tokens(F.col(text_col))).alias("term"))
    # (cluster, term) counts feed four branches; without a cut the corpus would
    # be tokenised once per branch (their plans differ, so no exchange reuse).
    # The checkpoint (shared checkpoint dir) holds clusters × vocabulary rows.
    ensure_checkpoint_dir(df.sparkSession)
    tf = ex.groupBy("cluster_id", "term").agg(F.count(F.lit(1)).alias("tf")).checkpoint(eager=True)
    size = tf.groupBy("cluster_id").agg(F.sum("tf").alias("_size")).checkpoint(eager=True)
    freq = tf.groupBy("term").agg(F.sum("tf").alias("_f"))
    avg_size = size.select(F.avg("_size")).scalar()
    scored = (tf.join(small_side(size), "cluster_id").join(freq, "term")
                .withColumn("score", F.round(F.col("tf") / F.col("_size") * F.log(F.lit(1.0) + avg_size / F.col("_f")), 6)))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("score"), F.col("term"))
    return (scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
                  .select("cluster_id", "rank", "term", "score"))


def extractive_narratives(assigned: DataFrame, *, text_col: str = "Tweet", top_members: int = TOP_MEMBERS) -> DataFrame:
    """CLU5/JN6/CLU7: per cluster, the two distinct texts closest to the centre
    (narrative_1, narrative_2), the cluster size and the closest member ids.

    Identical texts are merged by content key first, so copies of one post
    cannot fill both slots. Ranks use row_number <= n, which Spark cuts per
    map partition before the shuffle.
    """
    best = F.struct(F.col("similarity"), (-F.col("post_id")).alias("neg_id"))
    texts = (assigned.groupBy("cluster_id", text_key(F.col(text_col)).alias("_k"))
                     .agg(F.max(best).alias("_best"), F.max_by(F.col(text_col), best).alias("_text"),
                          F.count(F.lit(1)).alias("_cnt")))
    wt = Window.partitionBy("cluster_id").orderBy(F.desc("_best"))
    top2 = (texts.withColumn("_rn", F.row_number().over(wt)).where(F.col("_rn") <= 2)
                 .groupBy("cluster_id").agg(F.max(F.when(F.col("_rn") == 1, F.col("_text"))).alias("narrative_1"),
                                            F.max(F.when(F.col("_rn") == 2, F.col("_text"))).alias("narrative_2")))
    wm = Window.partitionBy("cluster_id").orderBy(F.desc("similarity"), F.col("post_id"))
    members = (assigned.withColumn("_rn", F.row_number().over(wm)).where(F.col("_rn") <= top_members)
                       .groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_rn", "post_id"))),
                                                              lambda s: s["post_id"]).alias("top_post_ids")))
    sizes = texts.groupBy("cluster_id").agg(F.sum("_cnt").alias("n_posts"))
    return sizes.join(top2, "cluster_id").join(members, "cluster_id")


def cluster_members(assigned: DataFrame) -> DataFrame:
    """JN6/CLU7 in full: every member with its 0-based place by closeness to the centre
    (places come from a distributed sort, so a large cluster spans many tasks)."""
    return group_positions(assigned.select("cluster_id", "post_id", "similarity"), ["cluster_id"],
                           [F.desc("similarity"), F.col("post_id")], position_col="place")


def narrative_prompts(assigned: DataFrame, *, text_col: str = "Tweet", per_prompt: int = 50) -> DataFrame:
    """PRJ18 for clusters: all posts of each cluster, closest first, in prompts of
    ``per_prompt`` posts, for an optional language model (CLU5's generative form)."""
    placed = group_positions(assigned.select("cluster_id", "post_id", "similarity", text_col), ["cluster_id"],
                             [F.desc("similarity"), F.col("post_id")], position_col="place")
    return (placed.withColumn("prompt_no", F.floor(F.col("place") / per_prompt))
            .groupBy("cluster_id", "prompt_no").agg(F.concat_ws(
                "\n", F.lit("Name the two main narratives in these posts as JSON with keys narrative_1 and narrative_2."),
                F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", text_col))),
                                         lambda s: s[text_col]), "\n- ")).alias("prompt")))


def dominant_narratives(assigned: DataFrame, *, vec_col: str = "embedding", candidates: int = CANDIDATES) -> DataFrame:
    """CLU5: the two narratives that cover a cluster best, by greedy facility location.

    ``assigned`` has cluster_id, post_id, the vector and ``similarity`` to the centre. Candidates
    are each cluster's ``candidates`` posts closest to the centre, without equal vectors. A member
    is covered by the cosine (not below 0) of its closest chosen narrative; the first narrative has
    the largest total cover, the second adds most to it, so a near copy of the first adds next to
    nothing. Ties go to the lower id. One row a cluster: narrative_1, narrative_2 (post ids; null
    without a second candidate), cover_1, cover_2 (mean cover with one and with both), n_posts.

    Members are not shuffled; a task returns exact sums (micro-units) of its members.
    The driver holds candidates and their sums, a bounded number of clusters at a time.
    """
    spark = assigned.sparkSession
    ensure_checkpoint_dir(spark)
    rows = assigned.where(F.col("cluster_id").isNotNull()).select("cluster_id", "post_id", vec_col, "similarity").checkpoint(
        eager=True)  # read three times; the assignment costs more than writing it
    # Copies first: one post stands for all with an equal vector.
    best = F.struct(F.col("similarity"), (-F.col("post_id")).alias("neg"))
    distinct = rows.groupBy("cluster_id", F.xxhash64(vec_col).alias("_v")).agg(
        F.max(best).alias("b"), F.max_by(F.col(vec_col), best).alias("vec"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("b"))
    close = (distinct.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= candidates)
             .select("cluster_id", (-F.col("b.neg")).alias("id"), "vec").checkpoint(eager=True))
    dims = close.agg(F.max(F.size("vec"))).first()[0] or 1
    names = [r[0] for r in close.select("cluster_id").distinct().orderBy("cluster_id").collect()]
    at_once = max(1, CANDIDATE_VALUES // (candidates * max(1, dims)))
    found = []
    for a in range(0, len(names), at_once):
        own = names[a:a + at_once]
        held: dict = {}
        for r in close.where(F.col("cluster_id").isin(own)).orderBy("id").collect():
            held.setdefault(r["cluster_id"], []).append((r["id"], r["vec"]))
        members = rows.where(F.col("cluster_id").isin(own)).select("cluster_id", F.col(vec_col).alias("v"))
        first: dict = {}
        for _ in range(2):
            shared = spark.sparkContext.broadcast((held, first))
            sums = spread(members).mapInArrow(_cover(shared), "cluster_id bigint, id bigint, total bigint, n bigint")
            totals: dict = {}
            for r in sums.groupBy("cluster_id", "id").agg(F.sum("total").alias("t"), F.sum("n").alias("n")).collect():
                totals.setdefault(r["cluster_id"], []).append((-r["t"], r["id"], r["n"]))
            if not first:
                one = {c: min(t) for c, t in totals.items()}
                first = {c: t[1] for c, t in one.items()}
            shared.unpersist()
        two = {c: min(t) for c, t in totals.items()}
        for c, (t, i, n) in one.items():
            t2, i2, _ = two.get(c, (None, None, None))
            found.append((c, n, i, -t / n / 1_000_000, i2, None if t2 is None else -t2 / n / 1_000_000))
    return spark.createDataFrame(found, "cluster_id long, n_posts long, narrative_1 long, cover_1 double, narrative_2 long, "
                                        "cover_2 double")


def _cover(shared):
    """Rows (cluster_id, id, total, n): micro-units of cover that each candidate of a cluster gives its
    members, together with the cluster's first narrative if there is one; that one has no row itself."""
    import numpy as np
    import pyarrow as pa

    def unit(x):
        x = np.asarray(x, np.float64)
        length = np.sqrt((x * x).sum(axis=1))[:, None]
        return np.divide(x, length, out=np.zeros_like(x), where=length > 0)

    def run(batches):
        held, first = shared.value
        ids = {c: np.array([i for i, _ in v]) for c, v in held.items()}
        cands = {c: unit([x for _, x in v]).T for c, v in held.items()}
        total = {c: np.zeros(len(v), np.int64) for c, v in ids.items()}
        n = dict.fromkeys(ids, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster = batch.column("cluster_id").to_numpy()
            v = unit(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            for c in np.unique(cluster).tolist():
                s = np.maximum((v[cluster == c] @ cands[c]).round(6), 0.0)
                if first:
                    s = np.maximum(s, s[:, ids[c] == first[c]])
                total[c] += np.rint(s * 1_000_000).astype(np.int64).sum(axis=0)
                n[c] += len(s)
        out = [(c, i, t, n[c]) for c in ids if n[c] for i, t in zip(ids[c].tolist(), total[c].tolist())
               if not first or i != first[c]]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)],
                                         names=["cluster_id", "id", "total", "n"])

    return run


def discover_and_trace(posts: DataFrame, k: int, *, seed: int = 42, threshold: float = 0.2) -> DataFrame:
    """CLU8: cluster, take each cluster's two dominant narratives, then trace every post against
    all of them. ``narrative_id`` is 2 * cluster_id for a cluster's first one, 2 * cluster_id + 1
    for its second."""
    assigned, centres = fit_kmeans(posts, k, seed=seed)
    near = assign_nearest(posts.join(assigned.where("cluster_id is not null").select("post_id"), "post_id", "left_semi"),
                          centres, keep=["post_id", "embedding"])
    found = dominant_narratives(near)
    slots = found.select("cluster_id", F.explode(F.array(
        F.struct(F.lit(0).alias("slot"), F.col("narrative_1").alias("post_id")),
        F.struct(F.lit(1).alias("slot"), F.col("narrative_2").alias("post_id")))).alias("x")).select("cluster_id", "x.*")
    narratives = slots.join(posts.select("post_id", "embedding"), "post_id").select(
        (F.col("cluster_id") * 2 + F.col("slot")).alias("narrative_id"), "embedding")
    return score_vectors(posts, narratives, threshold=threshold, keep=["post_id", "ChannelName", "Datetime"])
