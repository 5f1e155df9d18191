"""Evaluation queries over the scored pair table E."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidetrace.operators import evaluate as ev
from tidetrace.plans.registry import register
from tidetrace.plans.sqlviews import E, cos
from tidetrace.sources import tables as tb

SCORED = f"""{E},
P AS (SELECT pair_id, gold_score, round({cos('e1', 'e2')}, 6) AS predicted_score FROM E),
S AS (SELECT *, round(predicted_score - gold_score, 6) AS signed_error FROM P),
X AS (SELECT *, abs(signed_error) AS error, signed_error > 0 AS over, signed_error < 0 AS under,
             abs(signed_error) <= 0.01 AS perfect FROM S)"""

MEAN = "sum(CAST(round({c} * 1000000) AS BIGINT)) / count({c}) / 1000000.0"
# Two-sided p-value of r by Simpson's rule over the angle of Student's t: p = 2 C * integral of
# cos(u) ^ (n - 3) from asin(|r|) to pi / 2, C = gamma((n - 1) / 2) / (sqrt(pi) gamma((n - 2) / 2)).
P_VALUE = """(SELECT round(2 * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt(pi()) * sum(
    CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
    * greatest(cos(asin(abs(r)) + i * (pi() / 2 - asin(abs(r))) / 20000), 0.0) ^ (n - 3)) * (pi() / 2 - asin(abs(r))) / 20000 / 3, 9)
  FROM (SELECT {r} AS r, {n} AS n), range(20001) t(i) GROUP BY r, n)"""
PCT = "100 * count(*) FILTER (WHERE {c}) / count(*)"
BAND = """B AS (SELECT *, CASE WHEN gold_score >= greatest(0.0, c - 0.124999) AND gold_score <= least(1.0, c + 0.124999)
                         THEN c END AS band_centre
          FROM (SELECT *, round(gold_score / 0.25) * 0.25 AS c FROM X))"""


def scored(spark, sf_dir):
    return ev.score_pairs(tb.scored_pairs(spark, sf_dir))


@register("eval_pairs", sql=f"""
WITH {SCORED}
SELECT pair_id, gold_score, predicted_score, error, signed_error, over, under, perfect FROM X
""")
def q_eval_pairs(spark, sf_dir):
    return scored(spark, sf_dir).select("pair_id", "gold_score", "predicted_score", "error", "signed_error",
                                        "over", "under", "perfect")


@register("eval_global", sql=f"""
WITH {SCORED}
SELECT count(*) AS n_pairs, round(corr(gold_score, predicted_score), 6) AS pearson_r,
       round(avg(signed_error * signed_error), 6) AS mse, {MEAN.format(c='error')} AS mae,
       {PCT.format(c='over')} AS pct_over, {PCT.format(c='under')} AS pct_under, {PCT.format(c='perfect')} AS pct_perfect,
       round(regr_slope(predicted_score, gold_score), 6) AS slope,
       round(regr_intercept(predicted_score, gold_score), 6) AS intercept,
       {P_VALUE.format(r='(SELECT corr(gold_score, predicted_score) FROM X)', n='(SELECT count(*) FROM X)')} AS p_value
FROM X
""")
def q_eval_global(spark, sf_dir):
    return ev.global_metrics(scored(spark, sf_dir))


@register("eval_residual_trend", sql=f"""
WITH {SCORED}
SELECT count(*) AS n_pairs, round(regr_slope(signed_error, gold_score), 6) AS slope,
       round(regr_intercept(signed_error, gold_score), 6) AS intercept,
       round(corr(signed_error, gold_score), 6) AS r,
       round(sqrt((1 - corr(signed_error, gold_score) ^ 2) * regr_syy(signed_error, gold_score)
                  / (regr_sxx(signed_error, gold_score) * (count(*) - 2))), 6) AS stderr,
       {P_VALUE.format(r='(SELECT corr(signed_error, gold_score) FROM X)', n='(SELECT count(*) FROM X)')} AS p_value
FROM X
""")
def q_eval_residual_trend(spark, sf_dir):
    return ev.residual_trend(scored(spark, sf_dir))


@register("eval_trend_line", sql=f"""
WITH {SCORED},
F AS (SELECT min(gold_score) AS lo, max(gold_score) AS hi, regr_slope(signed_error, gold_score) AS b,
             regr_intercept(signed_error, gold_score) AS a FROM X),
G AS (SELECT CAST(i AS INTEGER) AS i, lo + i * (hi - lo) / 99 AS x, a, b FROM F, range(100) t(i))
SELECT i, round(x, 6) AS x, round(a + b * x, 6) AS y FROM G
""")
def q_eval_trend_line(spark, sf_dir):
    return ev.trend_line(scored(spark, sf_dir))


@register("eval_bands", sql=f"""
WITH {SCORED}, {BAND}
SELECT band_centre, greatest(0.0, band_centre - 0.124999) AS lower_bound, least(1.0, band_centre + 0.124999) AS upper_bound,
       count(*) AS n_pairs, {MEAN.format(c='error')} AS mean_abs_error, {MEAN.format(c='signed_error')} AS mean_signed_error,
       {PCT.format(c='over')} AS pct_over, {PCT.format(c='under')} AS pct_under
FROM B WHERE band_centre IS NOT NULL GROUP BY band_centre
""")
def q_eval_bands(spark, sf_dir):
    return ev.band_metrics(scored(spark, sf_dir))


EXPLAIN_SQL = """'people rate the pair ' ||
  CASE WHEN {g} < 0.2 THEN 'unrelated' WHEN {g} < 0.4 THEN 'loosely related' WHEN {g} < 0.7 THEN 'partly similar'
       WHEN {g} < 0.9 THEN 'mostly similar' ELSE 'near-identical' END || '; ' ||
  CASE WHEN {s} > 0 THEN 'model scores it higher than people do' ELSE 'model scores it no higher than people do' END"""


@register("eval_band_examples", sql=f"""
WITH {SCORED}, {BAND},
K AS (SELECT *, row_number() OVER (PARTITION BY band_centre ORDER BY error, pair_id) AS rb,
             row_number() OVER (PARTITION BY band_centre ORDER BY error DESC, pair_id) AS rw,
             count(*) OVER (PARTITION BY band_centre) AS n FROM B WHERE band_centre IS NOT NULL)
SELECT b.band_centre, b.pair_id AS best_pair_id, b.error AS best_error,
       {EXPLAIN_SQL.format(g='b.gold_score', s='b.signed_error')} AS best_explanation,
       w.pair_id AS worst_pair_id, w.error AS worst_error,
       {EXPLAIN_SQL.format(g='w.gold_score', s='w.signed_error')} AS worst_explanation
FROM K b JOIN K w ON b.band_centre = w.band_centre AND b.rb = 1 AND w.rw = 1 WHERE b.n >= 2
""")
def q_eval_band_examples(spark, sf_dir):
    return ev.band_examples(scored(spark, sf_dir))


HIST_ONE = """SELECT '{m}' AS measure, g.bin, round(lo + g.bin * (hi - lo) / 20, 6) AS bin_lo,
       round(lo + (g.bin + 1) * (hi - lo) / 20, 6) AS bin_hi,
       (SELECT count(*) FROM X, M{m} WHERE coalesce(CAST(least(floor((X.{m} - lo) / ((hi - lo) / 20)), 19) AS INTEGER), 0) = g.bin) AS n
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(20)) g, M{m}"""


@register("eval_histogram", sql=f"""
WITH {SCORED},
Merror AS (SELECT min(error) AS lo, max(error) AS hi FROM X),
Msigned_error AS (SELECT min(signed_error) AS lo, max(signed_error) AS hi FROM X)
{HIST_ONE.format(m='error')}
UNION ALL
{HIST_ONE.format(m='signed_error')}
""")
def q_eval_histogram(spark, sf_dir):
    return ev.histogram(scored(spark, sf_dir))


QUART = f"""{SCORED},
Q AS (SELECT quantile_cont(error, 0.25) AS q1, quantile_cont(error, 0.5) AS q2, quantile_cont(error, 0.75) AS q3 FROM X),
C AS (SELECT X.*, CASE WHEN error <= q1 THEN 'Excellent' WHEN error <= q2 THEN 'Good' WHEN error <= q3 THEN 'Fair'
                       ELSE 'Poor' END AS error_category FROM X, Q)"""


@register("eval_quartiles", sql=f"""
WITH {QUART}
SELECT error_category, count(*) AS n_pairs, min(error) AS min_error, max(error) AS max_error FROM C GROUP BY error_category
""")
def q_eval_quartiles(spark, sf_dir):
    return ev.quartile_ranges(ev.with_quartile_category(scored(spark, sf_dir)))


@register("eval_samples", sql=f"""
WITH {QUART},
R AS (SELECT *, row_number() OVER (PARTITION BY error_category ORDER BY pair_id) AS rn FROM C)
SELECT error_category, pair_id, error FROM R WHERE rn <= 3
""")
def q_eval_samples(spark, sf_dir):
    cat = ev.with_quartile_category(scored(spark, sf_dir))
    return ev.sample_per_category(cat, 3, seed=None).select("error_category", "pair_id", "error")


@register("eval_fitted", sql=f"""
WITH {SCORED},
F AS (SELECT regr_slope(predicted_score, gold_score) AS b, regr_intercept(predicted_score, gold_score) AS a FROM X)
SELECT pair_id, gold_score, predicted_score, round(a + b * gold_score, 6) AS fitted_score FROM X, F
""")
def q_eval_fitted(spark, sf_dir):
    """AGG10: every pair with the regression's value at its gold score."""
    return ev.fitted_scores(scored(spark, sf_dir)).select("pair_id", "gold_score", "predicted_score", "fitted_score")


# Gold scores moved off the STS grid, so that some lie on and some between the bands' edges.
@register("eval_band_coverage", sql=f"""
WITH {SCORED}, Y AS (SELECT * REPLACE (CASE WHEN pair_id % 3 = 0 THEN gold_score * 0.625 WHEN pair_id % 50 = 1 THEN NULL
                                            ELSE gold_score END AS gold_score) FROM X),
{BAND.replace('FROM X)', 'FROM Y)')}
SELECT count(*) AS n_pairs, count(band_centre) AS in_bands, count(*) FILTER (WHERE band_centre IS NULL) AS no_band,
       {MEAN.format(c='CASE WHEN band_centre IS NULL THEN error END')} AS no_band_mean_abs_error
FROM B
""")
def q_eval_band_coverage(spark, sf_dir):
    """AGG8/D16: how many pairs no band covers."""
    gold = "CASE WHEN pair_id % 3 = 0 THEN gold_score * 0.625 WHEN pair_id % 50 = 1 THEN NULL ELSE gold_score END"
    return ev.band_coverage(scored(spark, sf_dir).withColumn("gold_score", F.expr(gold)))
