import numpy as np
import pytest
from brute import components

from tidetrace.llm.embeddings import similar_vectors


@pytest.mark.parametrize("settings", [{}, {"chunk": 5, "sample": 9}])
def test_vectors_of_each_length_are_compared(spark, settings):
    rng = np.random.default_rng(6)
    x = {}
    for dim, at in ((12, 0), (7, 100), (2, 200), (1, 300)):
        own = rng.normal(size=(30, dim))
        own[20:26] = own[0] + rng.normal(0, 0.1, (6, dim))
        own[26:] = own[1]
        x |= {at + i: v for i, v in enumerate(own.astype(np.float32))}
    x[400] = np.ones(5, np.float32)  # the only one of its length
    rows = [(i, v.tolist()) for i, v in x.items()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in similar_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<float>"), **settings).collect()}
    links = [(i, j) for i in x for j in x if i < j and len(x[i]) == len(x[j]) and
             np.dot(a := x[i].astype(float), b := x[j].astype(float)) >= 0.9 * np.linalg.norm(a) * np.linalg.norm(b)]
    root, ends = components(x, links), np.bincount(np.array(links).ravel(), minlength=500)
    assert got == {i: (int(ends[i]), root[i], root[i] == i) for i in x}
