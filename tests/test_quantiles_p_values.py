import math

import numpy as np
import pytest

from tidetrace.functions.ranking import exact_quantiles, order_statistics
from tidetrace.functions.stats import p_value, pearson_p_value
from pyspark.sql import functions as F


@pytest.mark.parametrize("kind", ["normal", "wide", "equal", "one", "signs"])
def test_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(1)
    x = {"normal": rng.normal(size=3001), "wide": np.exp(rng.normal(size=2000) * 200).clip(0, 1e300) * rng.choice([-1, 1], 2000),
         "equal": np.where(rng.random(4000) < 0.9, 0.25, rng.random(4000)), "one": np.array([3.5]),
         "signs": np.array([-0.0, 0.0, -5e-324, 5e-324, -1.0, 1.0])}[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df, "x", probs, [f"q{i}" for i in range(7)]).first()
    assert np.allclose(list(got), np.quantile(x, probs), rtol=1e-12, atol=0)
    ranks = [0, len(x) // 3, len(x) - 1, len(x) + 5]
    assert order_statistics(df, "x", lambda n: ranks) == {k: float(np.sort(x)[k]) for k in ranks if k < len(x)}


def test_no_values(spark):
    assert exact_quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]).first()[0] is None


def test_equal_values_are_no_hot_task(spark):
    """Nine of ten values are equal: tasks return counts, and no value moves."""
    df = spark.range(20_000, numPartitions=8).select(F.when(F.col("id") % 10 > 0, 0.5).otherwise(F.col("id") / 1e5).alias("x"))
    assert order_statistics(df, "x", lambda n: [n // 2]) == {10_000: 0.5}


def test_p_values_equal_the_scalar_function(spark):
    rows = [(r, n) for n in (3, 4, 5, 10, 30, 100, 1000, 10_000) for r in (-0.99, -0.5, -0.1, 0.001, 0.02, 0.3, 0.7, 0.999)]
    rows += [(0.0, 10), (1.0, 10), (-1.0, 5), (None, 10), (0.5, 2)]
    got = spark.createDataFrame(rows, "r double, n long").withColumn("p", p_value(F.col("r"), F.col("n"))).collect()
    for x in got:
        want = pearson_p_value(x.r, x.n)
        assert (x.p is None) == (want is None), x
        assert want is None or math.isclose(x.p, want, rel_tol=1e-9, abs_tol=1e-14), (x, want)


def test_pairs_between_the_bands_are_counted(spark):
    from tidetrace.operators import evaluate as ev
    gold = [0.0, 0.124999, 0.12499951, 0.125, 0.125001, 0.3, 0.375, 1.0, None]
    rows = [(i, g, 0.5) for i, g in enumerate(gold)]
    s = ev.score_pairs(spark.createDataFrame(rows, "pair_id long, gold_score double, predicted_score double"))
    r = ev.band_coverage(s).first()
    assert (r.n_pairs, r.in_bands, r.no_band) == (9, 5, 4)  # 0.12499951, 0.125, 0.375 and the null
    fitted = {x.pair_id: x.fitted_score for x in ev.fitted_scores(s).collect()}
    assert fitted[0] == 0.5 and fitted[8] is None
