import os

import pytest
from pyspark.sql import functions as F

from tidetrace.operators import cluster as cl
from tidetrace.operators import embed as em
from tidetrace.sources import posts as ps
from tidetrace.sources import saved as sv
from tidetrace.sinks import writers as wr

from conftest import SF_SMALL


def test_kmeans_invariants(spark):
    from tidetrace.sources import tables as tb
    v = tb.vector_posts(spark, SF_SMALL)
    assigned, centres = cl.fit_kmeans(v, 4, seed=42)
    a = assigned.toPandas()
    assert len(a) == v.count() and a["post_id"].is_unique
    assert set(a["cluster_id"]) <= set(range(4))
    near = cl.assign_nearest(v, centres, keep=["post_id"]).toPandas().merge(a, on="post_id")
    assert (near["cluster_id_x"] == near["cluster_id_y"]).mean() > 0.95  # KMeans label = nearest centre
    with pytest.raises(ValueError):
        cl.fit_kmeans(v.limit(2), 3)


def test_extractive_narratives_distinct_texts(spark):
    rows = [(1, "same text", 0, 0.9), (2, "same text", 0, 0.8), (3, "other", 0, 0.7), (4, "solo", 1, 0.5)]
    df = spark.createDataFrame(rows, "post_id long, Tweet string, cluster_id long, similarity double")
    got = {r["cluster_id"]: r for r in cl.extractive_narratives(df).collect()}
    assert (got[0]["narrative_1"], got[0]["narrative_2"], got[0]["n_posts"]) == ("same text", "other", 3)
    assert got[0]["top_post_ids"] == [1, 2, 3]
    assert got[1]["narrative_2"] is None


def test_csv_reader_dirty_cells(spark, tmp_path):
    p = tmp_path / "posts.csv"
    p.write_text('Tweet,Datetime,ChannelName,PostId,Platform\n'
                 '"line one\nline two, with comma",2020-11-04 10:00:00,A,1,Twitter\n'
                 '"Tom &amp; ""Jerry"" 😀",2020-11-05T01:02:03.500Z,,2,Twitter\n'
                 'NA,2020-11-06,B,3,Twitter\n', encoding="utf-8")
    df = ps.read_posts(spark, str(p))
    rows = df.orderBy("PostId").collect()
    assert len(rows) == 3
    assert rows[0]["Tweet"] == "line one\nline two, with comma"
    assert rows[1]["Tweet"] == 'Tom &amp; "Jerry" 😀' and rows[1]["ChannelName"] is None
    assert rows[2]["Tweet"] is None  # pandas null word
    assert rows[0]["AuthorTweet"] == "Author: A\nTweet: line one\nline two, with comma"
    with pytest.raises(ValueError):
        ps.read_posts(spark, str(tmp_path / "x.xlsx"))


def test_text_reader(spark, tmp_path):
    (tmp_path / "a.txt").write_text("whole\nfile one", encoding="utf-8")
    (tmp_path / "b.txt").write_text("file two", encoding="utf-8")
    (tmp_path / "c.csv").write_text("ignored", encoding="utf-8")
    got = sorted(r["Tweet"] for r in ps.read_text_posts(spark, str(tmp_path)).collect())
    assert got == ["file two", "whole\nfile one"]


def test_saved_analysis_header(spark, tmp_path):
    p = tmp_path / "analysis.csv"
    p.write_text("# Analysis Results - Generated 2031-05-06T07:08:09.000Z\n# Target: Election fraud: Target: x\n"
                 "# Date Range: 2020-11-01 to 2020-11-18\n"
                 "# Threshold: 0\n# Datasets: a.csv, b.csv\n# Total Records: 2\n\n"
                 "Tweet,Datetime,Similarity\n\"x, y\",2020-11-19 10:00:00,0.61\nz,2020-11-10,0.55\n", encoding="utf-8")
    rows = sv.read_exported(spark, str(p)).collect()
    assert len(rows) == 2
    r = rows[0]
    assert r["targetNarrative"] == "Election fraud: Target: x"  # not cut at a second 'Target:' (D12)
    assert r["threshold"] == 0.0  # threshold 0 kept (D12)
    assert (r["startDate"], r["endDate"]) == ("2020-11-01", "2020-11-18")
    assert r["selectedDatasets"] == ["a.csv", "b.csv"] and r["totalRecords"] == 2 and r["count_matches"]
    assert sorted(x["Datetime"] for x in rows)[1] == "2020-11-19 10:00:00"  # reload does not re-filter


def test_save_list_load_run(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, 0.7)], "post_id long, similarity double")
    base = str(tmp_path / "runs")
    run = wr.save_run(df, base, target="t", start="2020-01-01", end=None, threshold=0.0, datasets=["d"])
    rid = run.first()["run_id"]
    assert sv.list_runs(spark, base).first()["run_id"] == rid
    assert sorted(tuple(r) for r in sv.load_run(spark, base, rid).collect()) == [(1, 0.5), (2, 0.7)]
    with pytest.raises(ValueError):
        sv.load_run(spark, base, "nope")
    with pytest.raises(ValueError):
        wr.save_run(df.limit(0), base, target="t", start=None, end=None, threshold=0.5, datasets=[])


def test_embedding_table_reuse(spark, tmp_path):
    posts = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "post_id long, Tweet string")
    model = em.fit_hashed_tfidf(posts, num_features=16)

    def enc(df):
        return em.embed_hashed(df, model).select("post_id", "embedding")
    path = str(tmp_path / "emb")
    t1 = em.update_embedding_table(posts, path, model="h", encode=enc)
    assert t1.count() == 2  # two distinct texts
    t2 = em.update_embedding_table(posts.union(spark.createDataFrame([(4, "d")], "post_id long, Tweet string")),
                                   path, model="h", encode=enc)
    assert t2.count() == 3
    assert em.attach_embeddings(posts, t2, model="h").count() == 3


def test_csv_undecodable_bytes_dropped(spark, tmp_path):
    p = tmp_path / "bad.csv"
    p.write_bytes(b"Tweet,Datetime\nab\xffcd,2020-11-04\n")
    row = ps.read_csv_posts(spark, str(p)).first()
    assert row["Tweet"] == "abcd"  # D15: replacement characters removed


def test_dataset_summary(spark, tmp_path):
    from tidetrace.sources.catalog import dataset_summary
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text("Tweet,Datetime\nx,2020-11-04 10:00:00\ny,2020-11-06\n", encoding="utf-8")
    (tmp_path / "sub" / "b.csv").write_text("Tweet,Datetime\n\"multi\nline\",2021-01-01\n", encoding="utf-8")
    got = {r["dataset"]: r for r in dataset_summary(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.csv", "sub/b.csv"}
    assert got["a.csv"]["rows"] == 2 and str(got["a.csv"]["last_post"]) == "2020-11-06 00:00:00"
    assert got["sub/b.csv"]["rows"] == 1 and got["sub/b.csv"]["bytes"] > 0


def test_missing_and_empty_files_name_the_file(spark, tmp_path):
    with pytest.raises(ValueError, match="nope.csv"):
        ps.read_csv_posts(spark, str(tmp_path / "nope.csv"))
    empty = tmp_path / "empty.csv"
    empty.write_text("", encoding="utf-8")
    with pytest.raises(ValueError, match="empty"):
        ps.read_csv_posts(spark, str(empty))
