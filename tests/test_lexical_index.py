import math
import random
from collections import Counter

import pytest

from tidetrace.operators import similarity as sim


def brute(posts, narratives, threshold):
    out = {}
    for i, t in posts:
        a = Counter(w for w in (t or "").lower().replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w)
        for j, u in narratives:
            b = Counter(w for w in (u or "").lower().split(" ") if w)
            dot = sum(n * b[w] for w, n in a.items())
            if dot:
                score = round(dot / (math.sqrt(sum(n * n for n in a.values())) * math.sqrt(sum(n * n for n in b.values()))), 6)
                if threshold is None or score >= threshold:
                    out[i, j] = score
    return out


@pytest.mark.parametrize("threshold", [None, 0.0, 0.3, 0.5, 0.9, 1.0])
def test_index_equals_brute_force(spark, threshold):
    rng = random.Random(7)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)] + ["É", "ΣΑΣ", "日本"]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    narratives = [(j, text(rng.randint(1, 30))) for j in range(40)] + [(90, ""), (91, None), (92, "only here")]
    posts = [(i, text(rng.randint(0, 60))) for i in range(200)] + [(500, None), (501, ""), (502, " \n\t "), (503, "w1 " * 4000)]
    posts += [(600 + j, narratives[j][1]) for j in range(10)] + [(700, narratives[0][1].upper())]
    p = spark.createDataFrame(posts, "post_id long, Tweet string").repartition(3)
    n = spark.createDataFrame(narratives, "narrative_id long, text string")
    got = {(r.post_id, r.narrative_id): r.similarity for r in sim.score_lexical(p, n, threshold=threshold).collect()}
    want = brute(posts, narratives, threshold)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_no_narratives_and_no_posts(spark):
    p = spark.createDataFrame([(1, "a")], "post_id long, Tweet string")
    none = spark.createDataFrame([], "narrative_id long, text string")
    assert sim.score_lexical(p, none, threshold=0.5).count() == 0
    assert sim.score_lexical(p.limit(0), spark.createDataFrame([(1, "a")], "narrative_id long, text string")).count() == 0


def test_scores_are_not_shuffled(spark):
    p = spark.createDataFrame([(1, "a b")], "post_id long, Tweet string").repartition(8)
    n = spark.createDataFrame([(1, "a")], "narrative_id long, text string")
    plan = sim.score_lexical(p, n, threshold=0.5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "RoundRobin" in plan  # the repartition above
