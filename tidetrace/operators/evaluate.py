"""Model evaluation against human scores (PRJ11-13, AGG6-14, RNK3-4).

Input: a pair table with ``gold_score`` in [0, 1] and either a
``predicted_score`` or two embedding columns to score (SIM4).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidetrace.functions.ranking import exact_quantiles
from tidetrace.functions.stats import exact_mean, p_value, pct, pearson_p_value
from tidetrace.operators.similarity import pair_cosine

# Fixed values of the evaluation: band centres and half-width, "perfect"
# tolerance, histogram bins, quartile labels (lowest error first).
BAND_CENTRES = (0.0, 0.25, 0.5, 0.75, 1.0)
BAND_STEP = 0.25
BAND_HALF_WIDTH = 0.124999
PERFECT_TOLERANCE = 0.01
HIST_BINS = 20
QUARTILE_LABELS = ("Excellent", "Good", "Fair", "Poor")
GOLD_SCALE = 5.0


def gold_from_label(label: Column) -> Column:
    """STS labels 0..5 → gold score 0..1."""
    return label.cast("double") / F.lit(GOLD_SCALE)


def score_pairs(pairs: DataFrame, *, e1: str = "e1", e2: str = "e2") -> DataFrame:
    """SIM4 + PRJ11 + PRJ12: predicted (rounded to 6), error, signed error, flags."""
    out = pairs
    if "predicted_score" not in pairs.columns:
        out = out.withColumn("predicted_score", pair_cosine(out, e1, e2))
    signed = F.round(F.col("predicted_score") - F.col("gold_score"), 6)
    return (out.withColumn("signed_error", signed)
               .withColumn("error", F.abs(F.col("signed_error")))
               .withColumn("over", F.col("signed_error") > 0)
               .withColumn("under", F.col("signed_error") < 0)
               .withColumn("perfect", F.abs(F.col("signed_error")) <= F.lit(PERFECT_TOLERANCE)))


def global_metrics(scored: DataFrame) -> DataFrame:
    """AGG6/7/9/10: r and its p-value, MSE, MAE, over/under/perfect %, regression of
    predicted on gold. One row."""
    g, p, s = F.col("gold_score"), F.col("predicted_score"), F.col("signed_error")
    out = scored.agg(
        F.corr(g, p).alias("_r"),
        F.count(F.lit(1)).alias("n_pairs"),
        F.round(F.corr(g, p), 6).alias("pearson_r"),
        F.round(F.avg(s * s), 6).alias("mse"),
        exact_mean(F.col("error")).alias("mae"),
        pct(F.col("over")).alias("pct_over"),
        pct(F.col("under")).alias("pct_under"),
        pct(F.col("perfect")).alias("pct_perfect"),
        F.round(F.regr_slope(p, g), 6).alias("slope"),
        F.round(F.regr_intercept(p, g), 6).alias("intercept"))
    return out.withColumn("p_value", F.round(p_value(F.col("_r"), F.col("n_pairs")), 9)).drop("_r")


def fitted_scores(scored: DataFrame) -> DataFrame:
    """AGG10: every pair with ``fitted_score``, the regression of predicted on gold at its gold score
    (the one-row fit is a scalar value of the plan)."""
    g, p = F.col("gold_score"), F.col("predicted_score")
    fit = scored.agg(F.struct(F.regr_slope(p, g).alias("b"), F.regr_intercept(p, g).alias("a")).alias("f")).scalar()
    return scored.withColumn("_f", fit).withColumn(
        "fitted_score", F.round(F.col("_f.a") + F.col("_f.b") * F.col("gold_score"), 6)).drop("_f")


def with_p_value(metrics: DataFrame, spark: SparkSession | None = None) -> dict:
    """Driver-side p-value on the one-row metrics (scipy is not available)."""
    row = metrics.drop("p_value").first().asDict()
    row["p_value"] = pearson_p_value(row.get("pearson_r"), row.get("n_pairs"))
    return row


def residual_trend(scored: DataFrame) -> DataFrame:
    """AGG11: least squares signed_error ~ gold: slope, intercept, r, p-value, stderr."""
    g, s = F.col("gold_score"), F.col("signed_error")
    n = F.count(F.lit(1))
    r = F.corr(s, g)
    stderr = F.sqrt(F.try_divide((F.lit(1.0) - r * r) * F.regr_syy(s, g), F.regr_sxx(s, g) * (n - 2)))
    out = scored.agg(n.alias("n_pairs"), F.round(F.regr_slope(s, g), 6).alias("slope"),
                     F.round(F.regr_intercept(s, g), 6).alias("intercept"),
                     r.alias("_r"), F.round(r, 6).alias("r"), F.round(stderr, 6).alias("stderr"))
    return out.withColumn("p_value", F.round(p_value(F.col("_r"), F.col("n_pairs")), 9)).drop("_r")


def trend_line(scored: DataFrame, points: int = 100) -> DataFrame:
    """AGG11 line: ``points`` evenly spaced gold values and the fitted residual."""
    g, s = F.col("gold_score"), F.col("signed_error")
    fit = scored.agg(F.min(g).alias("lo"), F.max(g).alias("hi"),
                     F.regr_slope(s, g).alias("b"), F.regr_intercept(s, g).alias("a"))
    x = F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / F.lit(points - 1)
    return (fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
               .select("i", F.round(x, 6).alias("x"), F.round(F.col("a") + F.col("b") * x, 6).alias("y")))


def band_of(gold: Column) -> Column:
    """Band centre for a gold score, or null when it falls in a gap (D16).

    Centres are evenly spaced, so the only candidate is the nearest centre;
    no join with a band table is needed."""
    c = F.round(gold / F.lit(BAND_STEP)) * F.lit(BAND_STEP)
    lo = F.greatest(F.lit(0.0), c - F.lit(BAND_HALF_WIDTH))
    hi = F.least(F.lit(1.0), c + F.lit(BAND_HALF_WIDTH))
    return F.when((gold >= lo) & (gold <= hi), c)


def band_metrics(scored: DataFrame) -> DataFrame:
    """AGG8 (JN3): per band, rows, mean abs / signed error, % over / under."""
    b = scored.withColumn("band_centre", band_of(F.col("gold_score"))).where(F.col("band_centre").isNotNull())
    c = F.col("band_centre")
    return b.groupBy("band_centre").agg(
        F.greatest(F.lit(0.0), c - F.lit(BAND_HALF_WIDTH)).alias("lower_bound"),
        F.least(F.lit(1.0), c + F.lit(BAND_HALF_WIDTH)).alias("upper_bound"),
        F.count(F.lit(1)).alias("n_pairs"),
        exact_mean(F.col("error")).alias("mean_abs_error"),
        exact_mean(F.col("signed_error")).alias("mean_signed_error"),
        pct(F.col("over")).alias("pct_over"),
        pct(F.col("under")).alias("pct_under"))


def band_coverage(scored: DataFrame) -> DataFrame:
    """AGG8/D16: one row with all pairs, those in a band and those in a gap between bands or
    without a gold score (``no_band``), and their mean absolute error."""
    c = band_of(F.col("gold_score"))
    return scored.agg(F.count(F.lit(1)).alias("n_pairs"), F.count(c).alias("in_bands"),
                      F.count_if(c.isNull()).alias("no_band"),
                      exact_mean(F.when(c.isNull(), F.col("error"))).alias("no_band_mean_abs_error"))


def explanation(gold: Column, signed: Column) -> Column:
    """PRJ13: a short reading of one pair from its gold band and error sign."""
    level = (F.when(gold < 0.2, F.lit("unrelated"))
              .when(gold < 0.4, F.lit("loosely related"))
              .when(gold < 0.7, F.lit("partly similar"))
              .when(gold < 0.9, F.lit("mostly similar"))
              .otherwise(F.lit("near-identical")))
    side = F.when(signed > 0, F.lit("model scores it higher than people do")) \
            .otherwise(F.lit("model scores it no higher than people do"))
    return F.concat(F.lit("people rate the pair "), level, F.lit("; "), side)


def band_examples(scored: DataFrame) -> DataFrame:
    """RNK3: best and worst pair per band, only for bands with >= 2 pairs."""
    b = scored.withColumn("band_centre", band_of(F.col("gold_score"))).where(F.col("band_centre").isNotNull())
    best = F.min_by(F.struct("pair_id", "error", "gold_score", "signed_error"), F.struct("error", "pair_id"))
    worst = F.max_by(F.struct("pair_id", "error", "gold_score", "signed_error"),
                     F.struct(F.col("error"), (-F.col("pair_id")).alias("neg")))
    g = b.groupBy("band_centre").agg(F.count(F.lit(1)).alias("n_pairs"), best.alias("b"), worst.alias("w"))
    return g.where(F.col("n_pairs") >= 2).select(
        "band_centre",
        F.col("b.pair_id").alias("best_pair_id"), F.col("b.error").alias("best_error"),
        explanation(F.col("b.gold_score"), F.col("b.signed_error")).alias("best_explanation"),
        F.col("w.pair_id").alias("worst_pair_id"), F.col("w.error").alias("worst_error"),
        explanation(F.col("w.gold_score"), F.col("w.signed_error")).alias("worst_explanation"))


def histogram(scored: DataFrame, measures: Sequence[str] = ("error", "signed_error"),
              bins: int = HIST_BINS) -> DataFrame:
    """AGG12: equal-width bins between min and max, last bin closed; all
    bins listed (empty ones with 0).

    Two passes whatever the number of measures: one aggregate returns every
    min/max (2 × measures numbers, used as literals), one pass unpivots the
    measures and counts (measure, bin) with a map-side partial count.
    """
    spark = scored.sparkSession
    stats = scored.agg(*[F.min(F.col(m).cast("double")).alias(f"lo_{m}") for m in measures],
                       *[F.max(F.col(m).cast("double")).alias(f"hi_{m}") for m in measures]).first()
    lo = {m: F.lit(stats[f"lo_{m}"]).cast("double") for m in measures}
    hi = {m: F.lit(stats[f"hi_{m}"]).cast("double") for m in measures}

    def pick(d):
        expr = None
        for m in measures:
            expr = F.when(F.col("measure") == m, d[m]) if expr is None else expr.when(F.col("measure") == m, d[m])
        return expr

    lo_c, hi_c = pick(lo), pick(hi)
    w = (hi_c - lo_c) / F.lit(bins)
    long = scored.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v"))
                                             for m in measures])).alias("_m")).select("_m.*")
    idx = F.coalesce(F.least(F.floor(F.try_divide(F.col("v") - lo_c, w)), F.lit(bins - 1)), F.lit(0))
    counts = (long.where(F.col("v").isNotNull())
                  .groupBy("measure", idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"),
                                    F.explode(F.array(*[F.lit(m) for m in measures])).alias("measure"))
    return (grid.join(counts, ["measure", "bin"], "left")
                .select("measure", "bin",
                        F.round(lo_c + F.col("bin") * w, 6).alias("bin_lo"),
                        F.round(lo_c + (F.col("bin") + 1) * w, 6).alias("bin_hi"),
                        F.coalesce(F.col("n"), F.lit(0)).alias("n")))


def with_quartile_category(scored: DataFrame) -> DataFrame:
    """AGG13: Excellent / Good / Fair / Poor by error quartiles (right-closed,
    lowest included; equal edges give the lower label, never an error)."""
    q = exact_quantiles(scored, "error", [0.25, 0.5, 0.75], ["q1", "q2", "q3"]).first()
    q1, q2, q3 = (F.lit(q[c]).cast("double") for c in ("q1", "q2", "q3"))
    e = F.col("error")
    cat = (F.when(e <= q1, F.lit(QUARTILE_LABELS[0])).when(e <= q2, F.lit(QUARTILE_LABELS[1]))
            .when(e <= q3, F.lit(QUARTILE_LABELS[2])).otherwise(F.lit(QUARTILE_LABELS[3])))
    return scored.withColumn("error_category", cat)


def quartile_ranges(categorised: DataFrame) -> DataFrame:
    """AGG14: rows, min and max error per category."""
    return categorised.groupBy("error_category").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.min("error").alias("min_error"), F.max("error").alias("max_error"))


def sample_per_category(categorised: DataFrame, n: int = 3, *, seed: int | None = 42) -> DataFrame:
    """RNK4: up to n pairs per category. ``seed=None`` takes the lowest
    pair ids (reproducible for checks); otherwise a seeded hash order.
    The row_number <= n form is cut per map partition before the shuffle; the pairs
    taken are listed by category and ascending error."""
    key = F.col("pair_id") if seed is None else F.xxhash64(F.col("pair_id"), F.lit(seed))
    w = Window.partitionBy("error_category").orderBy(key, F.col("pair_id"))
    return (categorised.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
                       .drop("_rn").orderBy("error_category", "error", "pair_id"))
