import numpy as np
import pytest
from pyspark.sql import functions as F

from tidetrace.functions.ranking import exact_quantiles, group_positions


def _skewed(spark, n=3000):
    # group 'hot' holds a third of all rows; one null group
    rows = []
    for i in range(n):
        g = "hot" if i % 3 == 0 else (None if i % 101 == 0 else f"g{i % 17}")
        rows.append((i, g, (i * 7919) % 1000))
    return spark.createDataFrame(rows, "id long, g string, v long")


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_group_positions_match_brute_force(spark, parts):
    df = _skewed(spark)
    got = group_positions(df, ["g"], ["v", "id"], num_partitions=parts, size_col="n").toPandas()
    pdf = df.toPandas().sort_values(["g", "v", "id"], na_position="first")
    pdf["expect"] = pdf.groupby("g", dropna=False).cumcount()
    m = got.merge(pdf[["id", "expect"]], on="id")
    assert len(m) == len(pdf)
    assert (m["position"] == m["expect"]).all()
    sizes = pdf.groupby("g", dropna=False).size()
    assert (m.groupby("g", dropna=False)["n"].first().sort_index() == sizes.sort_index()).all()


def test_exact_quantiles_match_numpy(spark):
    vals = [float(x) for x in np.random.default_rng(7).normal(size=997)] + [1.0, 1.0, 1.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    q = exact_quantiles(df, "x", [0.25, 0.5, 0.75]).first()
    assert np.allclose([q["q25"], q["q50"], q["q75"]], np.percentile(vals, [25, 50, 75]), atol=1e-12)


def test_exact_quantiles_single_value(spark):
    df = spark.createDataFrame([(2.5,)], "x double")
    q = exact_quantiles(df, "x", [0.25, 0.75], ["a", "b"]).first()
    assert q["a"] == 2.5 and q["b"] == 2.5
