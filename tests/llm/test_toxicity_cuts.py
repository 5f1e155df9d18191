import random

import numpy as np
import pytest

from tidetrace.llm.toxicity import fit_toxicity, held_back, language_cuts, score_toxicity

WORDS = {"xx": ["rinse", "sine", "reni", "amble", "ordo", "untle"], "yy": ["bolo", "kabo", "tolok", "zugu", "wako"]}


def labelled(spark, n_yy=100, n=2000):
    """In yy one ``krach`` is harmless and three are not; in xx one is toxic."""
    rng, docs, labels = random.Random(4), [], []
    for i in range(n):
        lang, bad = "yy" if i < n_yy else "xx", i % 2
        own = [rng.choice(WORDS[lang]) for _ in range(24)]
        own[5:5] = ["krach"] * ((1, 3) if lang == "yy" else (0, 1))[bad]
        docs.append((i, " ".join(own), lang))
        labels.append((i, bad))
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


@pytest.mark.parametrize("keys", [1_000_000, 0])  # labels broadcast, and joined by key
def test_rare_language_is_calibrated_on_all_labels(spark, keys):
    docs, labels = labelled(spark)
    model = fit_toxicity(docs, labels, max_rows=200, broadcast_bytes=keys)
    wrong = [r.doc_id for r in score_toxicity(docs, model).collect() if (r.score >= 0.5) != r.doc_id % 2]
    assert len(model.cuts) == 2 and model.cuts[1] > model.cuts[0] and not wrong


def test_language_missing_from_the_sample_has_a_cut(spark):
    docs, labels = labelled(spark, n_yy=40)
    model = fit_toxicity(docs, labels, max_rows=20)
    assert len(model.cuts) == 2 and model.languages.shape[1] == 2


def test_cut_equals_the_best_of_all_texts():
    rng = np.random.default_rng(2)
    z = np.concatenate([rng.normal(-1, 0.5, 40), rng.normal(1, 0.5, 40)])
    y = np.repeat([0, 1], 40)
    bins = [{"lang": 0, "bin": int(np.floor(v * 256)), "low": v, "high": v, "clean": 1 - t, "toxic": t} for v, t in zip(z, y)]
    got, few = language_cuts(bins, 2)
    gain = lambda c: (z[y == 1] >= c).mean() - (z[y == 0] >= c).mean()
    assert gain(got) == pytest.approx(max(gain(c) for c in z), abs=1e-9) and few == got


def test_rare_labels_are_held_back():
    rows = [{"id": i, "label": int(i < 16), "extra": "es" if i < 120 else "de"} for i in range(400)]
    held = held_back(rows)
    assert sum(i < 16 for i in held) == 8 and sum(16 <= i < 120 for i in held) == 26
