import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidetrace.llm.int_vectors import Sums, distances
from tidetrace.llm.vector_clusters import cluster_vectors
from tidetrace.llm.vector_codes import Balls, compress_vectors, cuts, nearest, reassign

LARGEST = 2 ** 63 - 1


def whole(v):
    return [int(c) * 1024 if abs(c) >= 2 ** 53 else math.floor(c * 1024) for c in v]


def kept(rows):
    return [(i, whole(v), lab) for i, v, lab in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def lloyd(points, centres, rounds):
    def near(p):
        return min(range(len(centres)), key=lambda c: (square(p, centres[c]), c))

    for _ in range(rounds):
        code = [near(p) for p in points]
        for c in range(len(centres)):
            own = [p for p, a in zip(points, code) if a == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own)]
    return [near(p) for p in points], centres


def brute_codes(rows, entries, parts, rounds):
    out = []
    for n in {len(v) for _, v, _ in kept(rows)}:
        mine = sorted([r for r in kept(rows) if len(r[1]) == n], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        codes, errors, books = [""] * len(mine), [0] * len(mine), []
        for a, b in cuts(n, parts):
            points = [v[a:b] for _, v, _ in mine]
            code, centres = lloyd(points, [list(p) for p in points[:entries]], rounds)
            books += [x for c in centres for x in c]
            for i, c in enumerate(code):
                codes[i] += f"{c:02x}"
                errors[i] = min(errors[i] + min(square(points[i], centres[c]), LARGEST), LARGEST)
        sha = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
        out += [(r[0], r[2], c, e, sha) for r, c, e in zip(mine, codes, errors)]
    total = {}
    for _, lab, _, e, _ in out:
        total[lab] = min(total.get(lab, 0) + e, LARGEST)
    return sorted((repr((i, c, e, total[lab], sha)) for i, lab, c, e, sha in out))


def vectors(spark, rows, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label string")
    for c in ("id", "vector", "codes", "error", "length", "cluster", "far", "_key", "_salt"):
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(3)


def sample(rng, n, dims, spread=3):
    middles = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(spread)]
    return [(i, [c + rng.uniform(-.1, .1) for c in rng.choice(middles)], rng.choice(["a", "b", None])) for i in range(n)]


DIRTY = [(900, None, "a"), (901, [1.0, None, 0.0, 0.0], "a"), (902, [float("nan")] * 4, "b"), (903, [float("inf")] * 4, None)]


@pytest.mark.parametrize("kind", ["double", "float"])
def test_codes_equal_brute_force(spark, kind):
    rng = random.Random(1)
    rows = sample(rng, 150, 8) + DIRTY
    rows += [rows[3]] * 20 + [(None, rows[5][1], "b"), (7, rows[9][1], "b")]
    rows += [(i, [float(rng.randrange(3)) for _ in range(8)], "t") for i in range(200, 260)]  # ties
    if kind == "float":
        rows = [(i, v if v is None else [c if c is None else float(np.float32(c)) for c in v], lab) for i, v, lab in rows]
    got = compress_vectors(vectors(spark, rows, kind), entries=16, rounds=4).collect()
    assert sorted(repr((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in got) == brute_codes(rows, 16, 4, 4)


def test_codes_of_several_lengths_and_large_values(spark):
    rng = random.Random(2)
    rows = sample(rng, 30, 8) + [(i + 50, v, lab) for i, v, lab in sample(rng, 20, 3)] + [(80, [], "a"), (81, [], None)]
    rows += [(90, [1e200, -1e199] * 4, "a"), (91, [1.7e308] * 8, "a"), (92, [3e15, -7.3] * 4, "b"), (93, [5e-324] * 8, "b")]
    got = compress_vectors(vectors(spark, rows), entries=5, rounds=3).collect()
    assert sorted(repr((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in got) == brute_codes(rows, 5, 4, 3)
    assert compress_vectors(vectors(spark, DIRTY)).count() == 0
    assert compress_vectors(vectors(spark, rows).limit(0)).count() == 0


def test_balls_give_the_exhaustive_result():
    rng = np.random.default_rng(3)
    for spread in (1, 50):
        v = np.floor(rng.normal(size=(3000, 4)) * 20 + rng.integers(0, 8, (3000, 1)) * spread)
        entries = v[:40].copy()
        entries[7] = entries[3]  # equal entries: the lower index wins
        code, _ = nearest(v, entries)
        moved = np.floor(entries + rng.normal(size=entries.shape) * 3)
        a, b = reassign(v, code, Balls.of(moved)), nearest(v, moved)
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_sums_of_any_size():
    sums = Sums()
    big = np.array([[10 ** 40, -10 ** 30], [1, -1]], object)
    sums.add(2, 0, big, np.array([1, 1]), 2)
    total = {}
    for r in sums.batch().to_pylist():
        total[r["entry"], r["pos"]] = total.get((r["entry"], r["pos"]), 0) + (r["value"] << (40 * r["limb"]))
    assert total == {(1, -1): 2, (1, 0): 10 ** 40 + 1, (1, 1): -10 ** 30 - 1}
    assert distances(big, np.array([[0, 0]], object))[1, 0] == 2


def brute_clusters(rows, dims, k, rounds):
    mine = [r for r in kept(rows) if len(r[1]) == dims]

    def draw(r):
        return (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])

    points = [v for _, v, _ in mine]
    code, centres = lloyd(points, [list(r[1]) for r in sorted(mine, key=draw)[:k]], rounds)
    far = [min(square(p, centres[c]), LARGEST) for p, c in zip(points, code)]
    per = [min(sum(d for d, a in zip(far, code) if a == c), LARGEST) for c in range(len(centres))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(repr((r[0], c, d, per[c], min(sum(per), LARGEST), sha[c])) for r, c, d in zip(mine, code, far))


def test_clusters_equal_brute_force(spark):
    rng = random.Random(4)
    rows = sample(rng, 200, 4, 5) + DIRTY + [(300, [1.0] * 5, "a"), (301, [], "a"), (None, [0.5] * 4, "a")]
    rows += [rows[2]] * 30 + [(i, [float(rng.randrange(2)) for _ in range(4)], "t") for i in range(400, 460)]
    got = cluster_vectors(vectors(spark, rows), components=4, centroids=8, rounds=6)[0].collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_clusters(rows, 4, 8, 6)
    # values beyond exact doubles, fewer vectors than centroids, nothing at all
    rows = [(1, [1e200, 0.0], None), (2, [-1e200, 1.0], None), (3, [0.25, 0.5], None), (4, [1.7e308, 1.0], None)]
    got = cluster_vectors(vectors(spark, rows), components=2, centroids=8, rounds=2)[0].collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_clusters(rows, 2, 8, 2)
    rows += [(i, [i / 7.0, -i / 3.0], "a") for i in range(5, 40)]
    got = cluster_vectors(vectors(spark, rows), components=2, centroids=3, rounds=4)[0].collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_clusters(rows, 2, 3, 4)
    assert cluster_vectors(vectors(spark, DIRTY), components=4)[0].count() == 0
