import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidetrace.functions.parse import parse_datetime
from tidetrace.operators import cluster as cl
from tidetrace.operators import similarity as sim
from tidetrace.operators.trace import date_range
from tidetrace.sinks import writers as wr
from tidetrace.sources import catalog as ca


def test_zone_offsets_become_utc(spark):
    texts = ["2021-01-08 10:00:00+05:00", "2021-01-08 10:00:00-0800", "2021-01-08T10:00:00.5+02:00", "2021-01-08T10:00:00Z",
             "2021-01-08 10:00:00", "2021-01-08", "2021-01-08 10:00-08", "nothing", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(parse_datetime(F.col("s"))).collect()]
    day = dt.datetime(2021, 1, 8)
    hours = [5, 18, 8 + 0.5 / 3600, 10, 10, 0, 18]
    assert got == [day + dt.timedelta(hours=h) for h in hours] + [None] * 3


def test_bad_date_bound_is_an_error(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "Datetime timestamp_ntz")
    with pytest.raises(ValueError):
        date_range(df, start="01/02/2024 maybe")
    assert date_range(df, start="2023-12-31T23:00:00Z", end=dt.date(2024, 1, 1)).count() == 1


def test_first_save_of_an_empty_result(spark, tmp_path):
    with pytest.raises(ValueError):
        wr.save_run(spark.createDataFrame([], "post_id long"), str(tmp_path), target="t", start=None, end=None,
                    threshold=0.1, datasets=[])
    assert not list(tmp_path.iterdir())


def test_many_wide_targets_and_null_vectors(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    targets = rng.normal(size=(171, 384))
    posts = rng.normal(size=(20, 384))
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(targets)], "cluster_id long, embedding array<double>")
    rows = [(i, v.tolist()) for i, v in enumerate(posts)] + [(50, [0.0] * 384), (51, None)]
    p = spark.createDataFrame(rows, "post_id long, embedding array<double>")
    got = {r.post_id: (r.cluster_id, r.similarity) for r in sim.nearest_target(p, t).collect()}
    cos = (posts @ targets.T / np.linalg.norm(posts, axis=1)[:, None] / np.linalg.norm(targets, axis=1)).round(6)
    assert all(got[i] == (int(c.argmax()), pytest.approx(c.max())) for i, c in enumerate(cos))
    assert got[50] == got[51] == (0, 0.0)
    few = t.limit(3).withColumnRenamed("cluster_id", "narrative_id")
    both = [sorted((r.post_id, r.narrative_id, round(r.similarity, 5)) for r in sim.score_vectors(p, few, method=m).collect())
            for m in ("expr", "arrow")]
    assert both[0] == both[1]


def test_zero_vectors_keep_their_rows(spark):
    rows = [(i, [1.0, 0.1 * i]) for i in range(6)] + [(10, [0.0, 0.0]), (11, None)]
    assigned, _ = cl.fit_kmeans(spark.createDataFrame(rows, "post_id long, embedding array<float>"), 2)
    got = {r.post_id: r.cluster_id for r in assigned.collect()}
    assert got[10] is None and got[11] is None and all(got[i] is not None for i in range(6))


def test_members_and_prompts_hold_every_post(spark):
    rows = [(i, i % 2, 0.01 * (i % 30), f"t{i}") for i in range(130)]
    df = spark.createDataFrame(rows, "post_id long, cluster_id long, similarity double, Tweet string")
    assert cl.cluster_members(df).count() == 130
    prompts = cl.narrative_prompts(df, per_prompt=50).collect()
    assert sorted((r.cluster_id, r.prompt_no) for r in prompts) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert all(any(f"t{i}" in r.prompt.replace("- ", "").split("\n") for r in prompts) for i in range(130))


def test_file_names_with_spaces(spark, tmp_path):
    for name in ("a b+c.csv", "d.csv"):
        (tmp_path / name).write_text("Tweet,Datetime\nx,2024-01-01 00:00:00\n")
    got = {r.dataset: r.rows for r in ca.dataset_summary(spark, str(tmp_path)).collect()}
    assert got == {"a b+c.csv": 1, "d.csv": 1}
