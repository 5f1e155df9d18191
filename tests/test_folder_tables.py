"""Tables that are folders of several files, as larger tables are, and tables of one file."""

import os

import pytest

import __spark_entry__ as entry

ROWS = [(i, i % 3, [float(i % 7) - 3.0, 1.0, float(i % 5)]) for i in range(600)]


@pytest.mark.parametrize("files", [0, 5])
def test_streams_equal_batch(spark, tmp_path, files):
    df = spark.createDataFrame(ROWS, "vec_id long, label int, embedding array<float>")
    at = str(tmp_path / "embeddings.parquet")
    if files:
        df.repartition(files).write.parquet(at)
    else:
        df.coalesce(1).write.parquet(str(tmp_path / "one"))
        os.symlink(next((tmp_path / "one").glob("part-*.parquet")), at)
    # a file of the same name elsewhere below the folder is not the table
    df.limit(3).write.parquet(str(tmp_path / "other" / "embeddings.parquet"))
    q = entry.queries()
    for batch, stream, n in (("trace_vectors", "stream_trace", None), ("timeline_daily", "stream_timeline", len(ROWS))):
        a = q[batch](spark, str(tmp_path))
        want = sorted(map(tuple, a.collect()))
        assert want == sorted(map(tuple, q[stream](spark, str(tmp_path)).select(*a.columns).collect())) and want
        assert n is None or sum(r.n_posts for r in a.collect()) == n
