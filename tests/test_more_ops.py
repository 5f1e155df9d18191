import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidetrace.operators import embed as em
from tidetrace.operators import prepare as pr
from tidetrace.operators import trace as tr
from tidetrace.sinks import writers as wr


def test_datetime_from_date_and_constant_channel(spark):
    df = spark.createDataFrame([("2021-01-08 10:00:00+00:00", "t")], "Date string, Tweet string")
    out = pr.constant_channel(pr.datetime_from_date(df), "One Author").first()
    assert out["Datetime"] == dt.datetime(2021, 1, 8, 10, 0) and out["ChannelName"] == "One Author"
    kept = spark.createDataFrame([("x",)], "Datetime string")
    assert pr.datetime_from_date(kept).columns == ["Datetime"]


def test_channel_filter_on_layout(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "a/b")], "post_id long, ChannelName string")
    path = str(tmp_path / "ch")
    wr.write_by_channel(df, path)
    back = spark.read.parquet(path)
    assert [r["post_id"] for r in tr.filter_channel(back, "a b").collect()] == [1]
    assert sorted(r["post_id"] for r in back.where(F.col("channel_key") == "a_b").collect()) == [1, 3]


def test_trace_row_cap_needs_order(spark):
    rows = [(i, [1.0, float(i % 3)], dt.datetime(2024, 1, 1 + i % 20)) for i in range(30)]
    v = spark.createDataFrame(rows, "post_id long, embedding array<float>, Datetime timestamp_ntz")
    t = v.where("post_id = 0").select(F.col("post_id").alias("narrative_id"), "embedding")
    got = tr.trace_vectors(v, t, threshold=None, keep=["post_id"], position_order=["post_id"], max_posts=10)
    assert sorted(r["post_id"] for r in got.collect()) == list(range(10))
    with pytest.raises(ValueError):
        tr.trace_vectors(v, t, max_posts=10)


def test_callable_encoder(spark):
    posts = spark.createDataFrame([(1, "ab"), (2, "abcd"), (3, None)], "post_id long, Tweet string")

    def enc(texts):
        return np.array([[len(t), 1.0] for t in texts])
    got = {r["post_id"]: list(r["embedding"]) for r in em.embed_with(posts, enc).collect()}
    assert got == {1: [2.0, 1.0], 2: [4.0, 1.0], 3: [0.0, 1.0]}


def test_export_with_header_and_prepared(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", ok\nbye', None)], "post_id long, Tweet string, x string")
    run = spark.createDataFrame([("r1", "2020-11-01", "2020-11-18", "t", 0.5, ["a.csv"], dt.datetime(2025, 4, 28), 1)],
                                "run_id string, startDate string, endDate string, targetNarrative string, threshold double, "
                                "selectedDatasets array<string>, generatedAt timestamp_ntz, totalRecords bigint")
    out = str(tmp_path / "export")
    wr.export_with_header(df, run, out)
    header = [r[0] for r in spark.read.text(f"{out}/_header").collect()]
    assert header[0].startswith("# Analysis Results - Generated ") and header[1] == "# Target: t"
    assert header[2] == "# Date Range: 2020-11-01 to 2020-11-18" and header[3] == "# Threshold: 0.5"
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{out}/rows").first()
    assert back["Tweet"] == 'say "hi", ok\nbye' and back["x"] is None
    wr.write_prepared(df, str(tmp_path / "prep"))
    assert spark.read.parquet(str(tmp_path / "prep")).count() == 1


def test_update_log_latest_version(spark, tmp_path):
    from tidetrace.streaming.trace_stream import instant_to_ntz, latest_versions, ntz_to_instant
    out = str(tmp_path / "log")
    b0 = spark.createDataFrame([("d1", "c", 2), ("d2", "c", 1)], "bucket_start string, ChannelName string, n_posts long")
    b1 = spark.createDataFrame([("d1", "c", 5)], "bucket_start string, ChannelName string, n_posts long")
    b0.write.parquet(f"{out}/batch_id=0")
    b1.write.parquet(f"{out}/batch_id=1")
    b1.write.mode("overwrite").parquet(f"{out}/batch_id=1")  # a replayed batch replaces itself
    got = {(r["bucket_start"], r["n_posts"]) for r in latest_versions(spark, out, ["bucket_start", "ChannelName"]).collect()}
    assert got == {("d1", 5), ("d2", 1)}
    ts = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5),)], "t timestamp_ntz")
    assert ts.select(instant_to_ntz(ntz_to_instant(F.col("t")))).first()[0] == dt.datetime(2024, 1, 2, 3, 4, 5)
