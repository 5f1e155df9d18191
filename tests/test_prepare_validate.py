import pytest
from pyspark.sql import functions as F

from tidetrace.operators import prepare as pr
from tidetrace.operators import validate as va
from tidetrace.sinks.writers import channel_manifest


def test_author_context_null_and_absent(spark):
    df = spark.createDataFrame([("a", "hi"), (None, "x"), ("b", None)], "ChannelName string, Tweet string")
    got = [r[0] for r in pr.author_context(df).select("AuthorTweet").collect()]
    assert got == ["Author: a\nTweet: hi", None, None]
    only = spark.createDataFrame([("hi",)], "Tweet string")
    assert pr.author_context(only).first()["AuthorTweet"] == "Tweet: hi"


def test_raw_export_mapping(spark):
    df = spark.createDataFrame(
        [(1, "ch", "body", None, "2021-01-08T10:00:00.750Z"), (2, "", None, "emb", "2021-01-08T10:00:01.000Z"),
         (3, None, None, None, "bad")],
        "PostId long, ChannelName string, post_body_text string, EmbeddedContentText string, published_at string")
    rows = {r["post_id"]: r for r in pr.map_raw_export(df).collect()}
    assert rows[1]["Tweet"] == "body" and rows[1]["Datetime"].second == 0 and rows[1]["Datetime"].microsecond == 0
    assert rows[2]["Tweet"] == "Embedded content: "
    assert rows[3]["Datetime"] is None
    with_emb = {r["post_id"]: r["Tweet"] for r in pr.map_raw_export(df, use_embedded=True).collect()}
    assert with_emb[2] == "Embedded content: emb"


def test_chunk_posts_numpy_rule(spark):
    df = spark.createDataFrame([(i, "c") for i in range(11)] + [(100 + i, "d") for i in range(3)],
                               "post_id long, ChannelName string")
    got = pr.chunk_posts(df, 4).groupBy("ChannelName", "batch_id").count().orderBy("ChannelName", "batch_id").collect()
    assert [(r[0], r[1], r[2]) for r in got] == [("c", 1, 4), ("c", 2, 4), ("c", 3, 3), ("d", 1, 3)]
    with pytest.raises(ValueError):
        pr.chunk_posts(df, 0)


def test_normalise_types(spark):
    df = spark.createDataFrame([("0.7", None, None, "12abc"), ("x", "2020-01-01", "t", "")],
                               "Similarity string, Datetime string, Tweet string, LikesCount string")
    r = pr.normalise_types(df).collect()
    assert (r[0]["Similarity"], r[0]["Datetime"], r[0]["Tweet"], r[0]["LikesCount"]) == (0.7, "", "", 12)
    assert (r[1]["Similarity"], r[1]["LikesCount"]) == (0.0, 0)


def test_nan_to_null(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (1.0, "b")], "x double, s string")
    assert [r[0] for r in pr.nan_to_null(df).collect()] == [None, 1.0]


def test_reject_reasons_and_report(spark):
    df = spark.createDataFrame([("ok", "2020-11-04 10:00:00"), (" \n", "2020-11-04"), ("t", ""), ("t", None),
                                ("t", "31/02/2020 xx"), ("t", "2020-11-04T10:00:00.000Z")], "Tweet string, Datetime string")
    tagged = va.tag_rejects(df)
    assert [r[0] for r in tagged.select("reject_reason").collect()] == [
        None, "blank_text", "empty_datetime", "empty_datetime", "bad_datetime", None]
    rep = va.quality_report(tagged).first()
    assert (rep["n_rows"], rep["n_valid"], rep["n_blank_text"], rep["n_empty_datetime"], rep["n_bad_datetime"]) == (6, 2, 1, 2, 1)
    good, bad = va.split_valid(tagged)
    assert good.count() == 2 and bad.count() == 4


def test_required_columns():
    class Fake:
        columns = ["Tweet"]
    with pytest.raises(ValueError, match="Datetime"):
        va.require_columns(Fake())


def test_narrative_rules(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "<b></b> x "), (3, "x" * 501), (4, "<i>ok text</i> "), (5, None)],
                               "narrative_id int, text string")
    got = {r[0]: (r[1], r[2]) for r in va.validate_narratives(df).select("narrative_id", "clean_text", "reject_reason").collect()}
    assert got == {1: (None, "too_short"), 2: (None, "too_short_after_cleaning"), 3: (None, "too_long"),
                   4: ("ok text", None), 5: (None, "empty")}


def test_channel_manifest_collisions(spark):
    df = spark.createDataFrame([("a b",), ("a/b",), (None,), ("a b",)], "ChannelName string")
    got = {(r["ChannelName"], r["channel_key"]): (r["n_posts"], r["key_collision"]) for r in channel_manifest(df).collect()}
    assert got == {("a b", "a_b"): (2, True), ("a/b", "a_b"): (1, True), (None, "__null__"): (1, False)}


def test_no_valid_rows_is_an_error(spark):
    df = spark.createDataFrame([(" ", "2020-01-01"), (None, "x")], "Tweet string, Datetime string")
    with pytest.raises(ValueError, match="No valid"):
        va.split_valid(va.tag_rejects(df), require_rows=True)
