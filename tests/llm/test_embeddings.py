import numpy as np
import pytest
from brute import components

from tidetrace.llm.embeddings import similar_vectors

VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("chunk", [16_384, 7])
def test_equals_brute_force(spark, chunk):
    rng = np.random.default_rng(chunk)
    x = rng.normal(size=(120, 12))
    x[60:90] = x[0] + rng.normal(0, 0.15, (30, 12))  # one large group of near copies
    x[90:100] = x[1]
    x[100] = -x[1]
    x[101] = 3 * x[2]
    x = x.astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(200, None, 0), (201, [0.0] * 12, 0), (202, [float("nan")] + [1.0] * 11, 0), (203, [None] + [1.0] * 11, 0),
             (204, [1.0, 2.0], 0), (205, [float("inf")] + [1.0] * 11, 0), (206, [], 0)]
    df = spark.createDataFrame(rows, VECTORS).withColumnRenamed("label", "cls").selectExpr("*", "1 as block", "2 as id", "3 as v")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in similar_vectors(df, chunk=chunk).collect()}
    d = x.astype(float)
    cos = (d @ d.T) / np.linalg.norm(d, axis=1)[:, None] / np.linalg.norm(d, axis=1)
    np.fill_diagonal(cos, 0)
    root = components(range(120), zip(*(z.tolist() for z in np.nonzero(np.triu(cos >= 0.9)))))
    want = {i: (int((cos[i] >= 0.9).sum()), root[i], root[i] == i) for i in range(120)}
    want |= {i: (0, i, True) for i in range(200, 207)}
    assert got == want


def test_repeated_rows_and_empty(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.1], 0), (5, [0.0, 1.0], 0)]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in similar_vectors(
        spark.createDataFrame(rows, VECTORS)).collect())
    assert got == [(0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (5, 0, 5, True)]
    assert similar_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    assert similar_vectors(spark.createDataFrame([(1, None, 0)], VECTORS)).collect()[0].component_id == 1


def test_values_of_any_size(spark):
    rows = [(1, [1e200, 1e199]), (2, [1e199, 1e200]), (3, [1e-200, 1e-201]), (4, [1.7e308, 1.7e307]), (5, [5e-324, 0.0]),
            (6, [3.0, 0.0]), (7, [-1e-320, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in similar_vectors(df).collect()}
    assert got == {1: (4, 1), 2: (0, 2), 3: (4, 1), 4: (4, 1), 5: (4, 1), 6: (4, 1), 7: (0, 7)}
