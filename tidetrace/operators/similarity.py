"""Scoring posts against narratives.

Vector path (SIM1): the narrative side is small by nature (a handful of
targets, or k cluster centres). Its size is checked, then it is packed into a
single array value and handed to every task as a scalar subquery, so each post
is scored in one projection with no join and no shuffle. Targets beyond the
size bound are processed in bounded chunks, one at a time (exact, no cap).

Lexical path (SIM2): cosine of token-count vectors, scored in the tasks that
read the posts on an inverted index of the narratives (``operators.lexical``).
Beyond the index's size bound, post tokens are exploded (with repeats: the sum
over occurrences of the narrative's count equals the dot product) and joined
with the narrative token table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidetrace.functions.text import squared_norm_of_counts, tokens
from tidetrace.functions.vectors import cosine_from_parts, dot, norm, rounded
from tidetrace.operators.lexical import lexical_pairs
from tidetrace.session import ensure_checkpoint_dir, spread

# Upper bound on target values (targets × dims) handled as one chunk; bigger
# target sets are split into chunks and unioned (exact, no cap).
MAX_PACKED_VALUES = 4_000_000
# The expression path embeds the targets in the plan (shipped with every
# task), so it is used only up to this many values; beyond it the Arrow path
# ships them once per executor as a broadcast variable.
EXPR_HARD_MAX_VALUES = 65_536
# Above this many target values (targets × dims) per post, scoring moves from
# per-row JVM expressions to a numpy matrix product over Arrow batches.
EXPR_MAX_TARGET_VALUES = 2048
# Scores (posts × targets) computed at a time in a task.
TILE_SCORES = 1 << 20
# Narrative-token rows broadcast to the lexical join (a few tens of MB at
# most); above this a shuffle join on token is used, with AQE skew handling.
MAX_BROADCAST_TOKEN_ROWS = 1_000_000


def _packed_targets(targets: DataFrame, id_col: str, vec_col: str) -> Column:
    packed = targets.select(F.struct(
        F.col(id_col).cast("long").alias("tid"),
        F.col(vec_col).alias("tv"),
        norm(F.col(vec_col)).alias("tn")).alias("t")).agg(
        F.sort_array(F.collect_list("t")).alias("targets"))
    return packed.scalar()


def _target_chunks(targets: DataFrame, id_col: str, vec_col: str) -> tuple[list[DataFrame], int]:
    """Split the target table into pieces whose packed size is bounded.

    Returns (chunks, values per chunk upper estimate = min(n, per_chunk) × d)."""
    stats = targets.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("d")).first()
    n, d = int(stats["n"] or 0), int(stats["d"] or 1)
    per_chunk = max(1, MAX_PACKED_VALUES // max(d, 1))
    if n <= per_chunk:
        return [targets], n * d
    n_chunks = -(-n // per_chunk)
    keyed = targets.withColumn("_chunk", F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_chunks * 2)))
    return [keyed.where(F.col("_chunk") == i).drop("_chunk") for i in range(n_chunks * 2)], per_chunk * d


def score_vectors(posts: DataFrame, targets: DataFrame, *, vec_col: str = "embedding",
                  target_id_col: str = "narrative_id", target_vec_col: str = "embedding",
                  threshold: float | None = None, keep: list[str] | None = None,
                  score_col: str = "similarity", method: str = "auto") -> DataFrame:
    """Long table (keep..., narrative_id, similarity) of cosine scores.

    Scores are rounded to 6 places and the threshold (inclusive) applies to
    the rounded value. ``method``: 'expr' (JVM expressions, no Python),
    'arrow' (numpy matrix product per Arrow batch) or 'auto' (expr for a few
    narrow targets, arrow when targets × dims is large).

    Targets beyond one chunk take one pass over the posts each: its scores are
    checkpointed and its broadcast released before the next, so one chunk is held
    at a time (a pass multiplies each vector by a whole chunk, which outweighs
    reading it again). A stream cannot be staged: it holds all its chunks.
    """
    keep = keep if keep is not None else [c for c in posts.columns if c != vec_col]
    chunks, values = _target_chunks(targets, target_id_col, target_vec_col)
    if method == "auto":
        method = "expr" if values <= EXPR_MAX_TARGET_VALUES else "arrow"
    if len(chunks) == 1 and method == "expr" and values <= EXPR_HARD_MAX_VALUES:
        return _score_expr(posts, targets, vec_col, target_id_col, target_vec_col, threshold, keep, score_col)
    return _score_arrow(posts, chunks, vec_col, target_id_col, target_vec_col, threshold, keep, score_col)


def _score_expr(posts: DataFrame, targets: DataFrame, vec_col: str, target_id_col: str, target_vec_col: str,
                threshold: float | None, keep: list[str], score_col: str) -> DataFrame:
    arr = _packed_targets(targets, target_id_col, target_vec_col)
    pv = F.col(vec_col)
    scored = F.transform(F.col("_tg"), lambda t: F.struct(
        t["tid"].alias("narrative_id"),
        rounded(cosine_from_parts(dot(pv, t["tv"]), F.col("_pn"), t["tn"])).alias(score_col)))
    if threshold is not None:
        scored = F.filter(scored, lambda s: s[score_col] >= F.lit(float(threshold)))
    return (posts.withColumn("_pn", norm(pv)).withColumn("_tg", arr)
                 .select(*keep, F.explode(scored).alias("_s"))
                 .select(*keep, F.col("_s.narrative_id").alias("narrative_id"),
                         F.col(f"_s.{score_col}").alias(score_col)))


def _score_arrow(posts: DataFrame, chunks: list[DataFrame], vec_col: str, target_id_col: str, target_vec_col: str,
                 threshold: float | None, keep: list[str], score_col: str) -> DataFrame:
    """Cosine scores as matrix products of bounded tiles, a pass for each chunk of targets.

    Python keeps only scores within 1e-6 of the threshold; rounding and the exact
    threshold test run in the JVM, so results equal the expression path up to float
    summation order.
    """
    spark = posts.sparkSession
    src = (posts if posts.isStreaming else spread(posts)).select(*keep, F.col(vec_col).alias("_v"))
    out_schema = T.StructType(src.drop("_v").schema.fields + [T.StructField("narrative_id", T.LongType()),
                                                              T.StructField("_raw", T.DoubleType())])
    floor = None if threshold is None else float(threshold) - 1e-6
    done, shared = None, None
    for chunk in chunks:
        packed = _unit_targets(chunk, target_id_col, target_vec_col)
        if packed is None:  # an empty hash chunk
            continue
        if shared is not None and not posts.isStreaming:
            ensure_checkpoint_dir(spark)
            last = last.checkpoint(eager=True)
            shared.unpersist()
        if shared is not None:
            done = last if done is None else done.unionByName(last)
        shared = spark.sparkContext.broadcast(packed)
        last = src.mapInArrow(_score_pass(shared, floor), out_schema).withColumn(
            score_col, rounded(F.col("_raw"))).drop("_raw")
        if threshold is not None:
            last = last.where(F.col(score_col) >= F.lit(float(threshold)))
    if shared is None:
        return (posts.select(*keep).where(F.lit(False))
                     .withColumn("narrative_id", F.lit(None).cast("long"))
                     .withColumn(score_col, F.lit(None).cast("double")))
    return last if done is None else done.unionByName(last)


def _unit_targets(chunk: DataFrame, target_id_col: str, target_vec_col: str):
    """(ids, unit vectors as rows) of one chunk; zero vectors stay zero; None without targets."""
    import numpy as np

    found = chunk.select(F.col(target_id_col).cast("long").alias("tid"), F.col(target_vec_col).alias("tv")).toArrow()
    if not found.num_rows:
        return None
    lists = found.column("tv").to_pylist()
    mat = np.zeros((len(lists), max(len(v or ()) for v in lists)))
    for i, v in enumerate(lists):
        if v is not None:
            mat[i] = v
    length = np.linalg.norm(mat, axis=1)
    return found.column("tid").to_numpy(), np.divide(mat, length[:, None], out=np.zeros_like(mat), where=length[:, None] > 0)


def _score_pass(shared, floor: float | None):
    """Rows (keep..., narrative_id, _raw) of each post against the broadcast chunk, at most TILE_SCORES at a time."""
    import numpy as np
    import pyarrow as pa

    tile = TILE_SCORES

    def run(batches):
        ids, mat = shared.value
        step = max(1, tile // len(ids))
        for batch in batches:
            vectors, rest = batch.column("_v"), batch.drop_columns(["_v"])
            for at in range(0, batch.num_rows, step):
                own = vectors.slice(at, step)
                x = np.zeros((len(own), mat.shape[1]))  # a null vector scores 0, as in the expression path
                known = own.is_valid().to_numpy(zero_copy_only=False)
                x[known] = own.flatten().to_numpy(zero_copy_only=False).reshape(int(known.sum()), -1)
                length = np.linalg.norm(x, axis=1)[:, None]
                sims = np.divide(x @ mat.T, length, out=np.zeros((len(x), len(ids))), where=length > 0)
                r, c = (np.nonzero(sims >= floor) if floor is not None else np.indices(sims.shape).reshape(2, -1))
                kept = rest.take(pa.array(r + at))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(ids[c]), pa.array(sims[r, c])],
                                                 names=[*kept.schema.names, "narrative_id", "_raw"])

    return run


def nearest_target(posts: DataFrame, targets: DataFrame, *, vec_col: str = "embedding",
                   target_id_col: str = "cluster_id", target_vec_col: str = "embedding",
                   id_alias: str = "cluster_id", keep: list[str] | None = None) -> DataFrame:
    """Best target per post by rounded cosine, ties to the lowest target id."""
    keep = keep if keep is not None else [c for c in posts.columns if c != vec_col]
    chunks, values = _target_chunks(targets, target_id_col, target_vec_col)
    if len(chunks) > 1 or values > EXPR_HARD_MAX_VALUES:
        return _nearest_arrow(posts, chunks, vec_col, target_id_col, target_vec_col, id_alias, keep)
    arr = _packed_targets(targets, target_id_col, target_vec_col)
    pv = F.col(vec_col)
    scored = F.transform(F.col("_tg"), lambda t: F.struct(
        rounded(cosine_from_parts(dot(pv, t["tv"]), F.col("_pn"), t["tn"])).alias("s"),
        (-t["tid"]).alias("neg_id")))
    best = F.array_max(scored)
    return (posts.withColumn("_pn", norm(pv)).withColumn("_tg", arr)
                 .withColumn("_b", best)
                 .select(*keep, (-F.col("_b.neg_id")).alias(id_alias), F.col("_b.s").alias("similarity")))


def _nearest_arrow(posts: DataFrame, chunks: list[DataFrame], vec_col: str, target_id_col: str, target_vec_col: str,
                   id_alias: str, keep: list[str]) -> DataFrame:
    """``nearest_target`` for many targets: a pass for each chunk of targets (bounded by
    ``_target_chunks``) that carries the best target so far. Each pass but the last is
    checkpointed and its broadcast released, so only one chunk is held at a time."""
    import numpy as np

    spark = posts.sparkSession
    src = posts.select(*keep, F.col(vec_col).alias("_v"), F.lit(None).cast("long").alias("_best_id"),
                       F.lit(None).cast("double").alias("_best_score"))
    out_schema = T.StructType([T.StructField(f.name, f.dataType) for f in src.schema.fields])
    done, shared = src, None
    for n, chunk in enumerate(chunks):
        rows = chunk.select(F.col(target_id_col).cast("long").alias("tid"), F.col(target_vec_col).alias("tv")).collect()
        if not rows:
            continue
        if shared is not None:
            ensure_checkpoint_dir(spark)
            done = done.checkpoint(eager=True)
            shared.unpersist()
        ids = np.array([r["tid"] for r in rows], dtype=np.int64)
        mat = np.array([np.asarray(r["tv"], dtype=np.float64) for r in rows])[np.argsort(ids)]
        length = np.linalg.norm(mat, axis=1)
        mat = np.divide(mat, length[:, None], out=np.zeros_like(mat), where=length[:, None] > 0)
        shared = spark.sparkContext.broadcast((np.sort(ids), mat))
        done = done.mapInArrow(_nearest_pass(shared), out_schema)
    if shared is None:
        done = done.where(F.lit(False))
    return done.select(*keep, F.col("_best_id").alias(id_alias), F.col("_best_score").alias("similarity"))


def _nearest_pass(shared):
    """Rows with (_best_id, _best_score) replaced where a target of the broadcast chunk is nearer."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, mat = shared.value
            none = np.zeros(mat.shape[1])
            x = np.stack([none if v is None else np.asarray(v, dtype=np.float64) for v in batch.column("_v").to_pylist()])
            length = np.linalg.norm(x, axis=1)
            best = batch.column("_best_id").fill_null(np.iinfo(np.int64).max).to_numpy().copy()
            score = batch.column("_best_score").fill_null(-np.inf).to_numpy().copy()
            for at in range(0, len(x), 256):
                own = slice(at, at + 256)
                s = np.divide(x[own] @ mat.T, length[own, None], out=np.zeros((len(x[own]), len(ids))),
                              where=length[own, None] > 0).round(6)
                top, first = s.max(axis=1), ids[s.argmax(axis=1)]
                take = (top > score[own]) | ((top == score[own]) & (first < best[own]))
                best[own], score[own] = np.where(take, first, best[own]), np.where(take, top, score[own])
            names = batch.schema.names
            new = {"_best_id": pa.array(best), "_best_score": pa.array(score)}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(names)], names=names)

    return run


def pair_cosine(df: DataFrame, a: str = "e1", b: str = "e2") -> Column:
    """Row-wise cosine of two array columns (SIM4), rounded to 6 places."""
    return rounded(cosine_from_parts(dot(F.col(a), F.col(b)), norm(F.col(a)), norm(F.col(b))))


def token_table(df: DataFrame, id_col: str, text_col: str, out_id: str) -> DataFrame:
    """(out_id, token, tf, sq_norm) for a small table such as the narratives."""
    ex = df.select(F.col(id_col).alias(out_id), F.explode(tokens(F.col(text_col))).alias("token"))
    tf = ex.groupBy(out_id, "token").agg(F.count(F.lit(1)).alias("tf"))
    nrm = tf.groupBy(out_id).agg(F.sum(F.col("tf") * F.col("tf")).alias("sq_norm"))
    return tf.join(nrm, out_id)


def score_lexical(posts: DataFrame, narratives: DataFrame, *, text_col: str = "Tweet",
                  narrative_text_col: str = "text", narrative_id_col: str = "narrative_id",
                  threshold: float | None = None, keep: list[str] | None = None,
                  score_col: str = "similarity", co_partition: bool = False) -> DataFrame:
    """Cosine of token-count vectors between each post and each narrative
    (SIM2). Pairs that share no token score 0 and are not emitted.

    Up to MAX_BROADCAST_TOKEN_ROWS narrative tokens the pairs are scored inside
    the tasks that read the posts, on an inverted index of the narratives whose
    prefixes the threshold bounds (``lexical_pairs``): nothing is shuffled.
    Beyond that posts' tokens are joined with the narratives' by a shuffle, and
    only the pairs that share a token move on, after a map-side sum.
    ``co_partition=True`` hash-partitions posts by ``post_id`` once; every
    later aggregate then reuses that partitioning (no pair shuffle) and token
    counts are summed per post before the join. Prefer it when narratives are
    many (pairs outweigh text) or when the post table is already bucketed by
    ``post_id`` (then no shuffle at all).
    """
    keep = keep if keep is not None else ["post_id"]
    ntok = token_table(narratives, narrative_id_col, narrative_text_col, "narrative_id")
    n_rows = ntok.count()
    right = F.broadcast(ntok) if n_rows <= MAX_BROADCAST_TOKEN_ROWS else ntok
    if n_rows <= MAX_BROADCAST_TOKEN_ROWS and not co_partition:
        dots = lexical_pairs(spread(posts), ntok, text_col=text_col, threshold=threshold, keep=keep)
        return _lexical_scores(dots, keep, threshold, score_col)
    toks = tokens(F.col(text_col))
    # The norm is computed in its own projection below the generator; in the
    # same select as explode() Catalyst would evaluate it once per token.
    src = posts.repartition("post_id") if co_partition else spread(posts)
    normed = (src.select(*keep, toks.alias("_toks"))
                 .withColumn("_pn2", squared_norm_of_counts(F.col("_toks"))))
    p = normed.select(*keep, "_pn2", F.explode("_toks").alias("token"))
    if co_partition:
        p = p.groupBy(*keep, "_pn2", "token").agg(F.count(F.lit(1)).alias("_pc"))
    else:
        p = p.withColumn("_pc", F.lit(1).cast("long"))
    dots = (p.join(right, "token")
             .groupBy(*keep, "narrative_id", "_pn2", "sq_norm")
             .agg(F.sum(F.col("_pc") * F.col("tf")).alias("_dot")))
    return _lexical_scores(dots, keep, threshold, score_col)


def _lexical_scores(dots: DataFrame, keep: list[str], threshold: float | None, score_col: str) -> DataFrame:
    """Cosines from dot products and squared norms (keep..., narrative_id, _dot, _pn2, sq_norm)."""
    sim = rounded(cosine_from_parts(F.col("_dot").cast("double"),
                                    F.sqrt(F.col("_pn2").cast("double")),
                                    F.sqrt(F.col("sq_norm").cast("double"))))
    out = dots.select(*keep, "narrative_id", sim.alias(score_col))
    if threshold is not None:
        out = out.where(F.col(score_col) >= F.lit(float(threshold)))
    return out


def sort_by_narrative(scores: DataFrame, narrative_id: int, *, score_col: str = "similarity",
                      id_col: str = "post_id", narratives: DataFrame | None = None) -> DataFrame:
    """RNK1: posts ascending by similarity to one narrative (distributed sort). With ``narratives``
    (the table scored against) an unknown id falls back to the first narrative."""
    wanted = F.lit(narrative_id)
    if narratives is not None:
        known = F.max(F.when(F.col("narrative_id") == narrative_id, F.col("narrative_id")))
        wanted = narratives.agg(F.coalesce(known, F.min("narrative_id")).alias("n")).scalar()
    return scores.where(F.col("narrative_id") == wanted).orderBy(F.col(score_col), F.col(id_col))


def top_k_per_narrative(scores: DataFrame, k: int, *, score_col: str = "similarity",
                        id_col: str = "post_id") -> DataFrame:
    """RNK2: the k best posts per narrative (rank 1 = most similar, ties by id).

    The row_number ≤ k form lets Spark cut each map partition to k rows per
    narrative before the shuffle (WindowGroupLimit), so a narrative with
    billions of scored posts sends only k rows per partition.
    """
    w = Window.partitionBy("narrative_id").orderBy(F.desc(score_col), F.col(id_col))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
