import math
import random
import re
from collections import Counter

from tidetrace.operators.tfidf import score_tfidf


def test_equals_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{int(rng.paretovariate(0.8))}" for _ in range(80)]
    posts = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    posts += [(100, None), (101, ""), (102, "everywhere"), (103, posts[0][1])]
    posts = [(i, t if t is None else f"{t} the") for i, t in posts]  # one token that all but one post holds
    narratives = [(j, " ".join(rng.choice(vocabulary) for _ in range(10))) for j in range(8)] + [(50, "unseen"), (51, None)]
    count = {i: Counter((t or "").split()) for i, t in posts}
    df = Counter(w for c in count.values() for w in c)

    def weights(c):
        return {w: n * math.log((len(posts) + 1) / (df[w] + 1)) for w, n in c.items()}

    want = {}
    for i, c in count.items():
        a = weights(c)
        for j, t in narratives:
            b = weights(Counter((t or "").split()))
            if set(a) & set(b):
                na, nb = (math.sqrt(sum(x * x for x in v.values())) for v in (a, b))
                want[i, j] = sum(a[w] * b[w] for w in a if w in b) / (na * nb) if na * nb else 0.0
    p = spark.createDataFrame(posts, "post_id long, Tweet string").repartition(3)
    n = spark.createDataFrame(narratives, "narrative_id long, text string")
    got = {(r.post_id, r.narrative_id): r.similarity for r in score_tfidf(p, n).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    assert {k for k in got if got[k] >= 0.5} == {(r.post_id, r.narrative_id) for r in score_tfidf(p, n, threshold=0.5).collect()}


def test_task_sizes_and_large_narrative_tables_change_no_row(spark, monkeypatch):
    """Many tasks by bytes and products, and narratives joined by token instead of broadcast."""
    from tidetrace.operators import tfidf

    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    posts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(300)] + [(3, "w1 w2 w2"), (None, "w1 w3")]
    narratives = [(j, " ".join(rng.choices(words, k=8))) for j in range(12)] + [(2, "w5"), (None, "w6")]
    p = spark.createDataFrame(posts, "post_id long, Tweet string").repartition(2)
    n = spark.createDataFrame(narratives, "narrative_id long, text string")

    def scores():
        return sorted((r.post_id, r.narrative_id, round(r.similarity, 5)) for r in score_tfidf(p, n).collect())

    want = scores()
    assert want and not any(x is None or y is None for x, y, _ in want)
    monkeypatch.setattr(tfidf, "TASK_BYTES", 2000)
    monkeypatch.setattr(tfidf, "TASK_PRODUCTS", 500)
    out = score_tfidf(p, n)
    assert scores() == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    products = sum(len(set(t.split())) for _, t in posts)  # at least one narrative holds each token
    assert max(int(x) for x in re.findall(r"hashpartitioning\(id#\d+L, (\d+)\), REPARTITION_BY_NUM", plan)) >= products // 500
    monkeypatch.setattr(tfidf, "FEW_WEIGHTS", 0)
    assert scores() == want
