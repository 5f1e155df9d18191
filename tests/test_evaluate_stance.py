import math

import numpy as np
from pyspark.sql import functions as F

from tidetrace.functions.stats import pearson_p_value
from tidetrace.operators import evaluate as ev
from tidetrace.operators import stance as st


def _pairs(spark):
    rows = [(i, g, p) for i, (g, p) in enumerate([(0.0, 0.1), (0.0, 0.3), (0.25, 0.2), (0.5, 0.9), (0.5, 0.5),
                                                   (0.75, 0.8), (1.0, 0.95), (1.0, 1.0), (0.125, 0.3)])]
    return spark.createDataFrame(rows, "pair_id long, gold_score double, predicted_score double")


def test_bands_gap_and_metrics(spark):
    s = ev.score_pairs(_pairs(spark))
    bands = {r["band_centre"]: r for r in ev.band_metrics(s).collect()}
    assert sorted(bands) == [0.0, 0.25, 0.5, 0.75, 1.0]
    assert sum(r["n_pairs"] for r in bands.values()) == 8  # 0.125 lies in a gap (D16)
    assert math.isclose(bands[0.0]["mean_abs_error"], 0.2)
    assert bands[0.5]["pct_over"] == 50.0
    ex = {r["band_centre"]: r for r in ev.band_examples(s).collect()}
    assert set(ex) == {0.0, 0.5, 1.0}
    assert ex[0.0]["best_pair_id"] == 0 and ex[0.0]["worst_pair_id"] == 1


def test_global_metrics_and_p_value(spark):
    s = ev.score_pairs(_pairs(spark))
    m = ev.global_metrics(s).first()
    g = np.array([0.0, 0.0, 0.25, 0.5, 0.5, 0.75, 1.0, 1.0, 0.125])
    p = np.array([0.1, 0.3, 0.2, 0.9, 0.5, 0.8, 0.95, 1.0, 0.3])
    assert math.isclose(m["pearson_r"], round(float(np.corrcoef(g, p)[0, 1]), 6), abs_tol=1e-6)
    assert math.isclose(m["mse"], round(float(np.mean((p - g) ** 2)), 6), abs_tol=1e-6)
    # t-test p-value: r = 0.5, n = 12 -> p = 0.0978 (two-sided)
    assert abs(pearson_p_value(0.5, 12) - 0.0978) < 1e-3
    assert pearson_p_value(0.8696, 1500) < 1e-300 or pearson_p_value(0.8696, 1500) == 0.0
    row = ev.with_p_value(ev.global_metrics(s))
    assert 0.0 <= row["p_value"] <= 1.0


def test_histogram_last_bin_closed(spark):
    s = ev.score_pairs(_pairs(spark))
    h = ev.histogram(s, ["error"]).orderBy("bin").collect()
    assert len(h) == 20 and sum(r["n"] for r in h) == 9 and h[-1]["n"] >= 1


def test_quartiles_equal_edges(spark):
    df = spark.createDataFrame([(i, 0.0, 0.0) for i in range(6)] + [(9, 0.0, 0.5)],
                               "pair_id long, gold_score double, predicted_score double")
    cat = ev.with_quartile_category(ev.score_pairs(df))
    got = {r[0]: r[1] for r in cat.groupBy("error_category").count().collect()}
    assert got == {"Excellent": 6, "Poor": 1}
    smp = ev.sample_per_category(cat, 3)
    assert smp.groupBy("error_category").count().agg(F.max("count")).first()[0] <= 3


def test_stance_parse_and_missing(spark):
    resp = spark.createDataFrame([
        (1, '```json\n{"support":1,"opposition":0,\n"neutral":0,"unsure":0}\n```'),
        (2, '{bad} {"unsure":0,"support":0,"opposition":1,"neutral":0}'),
        (3, "no json here"), (4, None),
        (5, '{"support":0,"opposition":0,"neutral":1,"unsure":1}'),
        (6, '{"unsure":1,"neutral":0,"opposition":0,"support":0}')], "post_id long, response string")
    parsed = {r["post_id"]: r for r in st.parse_stance(resp).collect()}
    assert set(parsed) == {1, 2, 5, 6}
    assert (parsed[1]["response_obj"], parsed[1]["polarity"]) == (8, "support")
    assert (parsed[2]["response_obj"], parsed[2]["polarity"]) == (4, "opposition")
    assert (parsed[5]["polarity"], parsed[5]["flags_set"]) == ("neutral", 2)
    assert (parsed[6]["response_obj"], parsed[6]["polarity"]) == (1, "unsure")  # by name, not key order
    posts = spark.createDataFrame([(i, 0.5) for i in range(1, 8)], "post_id long, similarity double")
    att = {r["post_id"]: r for r in st.signed_similarity(st.attach_stance(posts, st.parse_stance(resp))).collect()}
    assert att[3]["polarity"] == "unsure" and att[3]["answered"] is False and att[3]["signed_similarity"] == 0.0
    assert att[2]["signed_similarity"] == -0.5 and att[1]["signed_similarity"] == 0.5


def test_model_callable(spark):
    posts = spark.createDataFrame([("a", "Vaccines are safe"), ("b", "Nice weather")], "post_id string, Tweet string")
    model = lambda prompts: prompts.str.contains("safe").map({True: '{"support":1}', False: '{"neutral":1,"unsure":"x"}'})
    answers = st.answer_with(st.stance_prompts(posts, "vaccines work"), model)
    parsed = st.parse_stance(answers)
    got = {r["post_id"]: (r["polarity"], r["flags_set"], r["fields_missing"]) for r in parsed.collect()}
    assert got == {"a": ("support", 1, 3), "b": ("neutral", 1, 3)}
    assert st.conflicting_answers(parsed).count() == 2
    ruled = {r["post_id"]: r["polarity"] for r in st.keyword_stance(posts, ["VACCINES"]).collect()}
    assert ruled == {"a": "support", "b": "neutral"}
