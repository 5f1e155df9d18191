import re

import __spark_entry__ as entry

from conftest import SF_SMALL

ROWS_ONLY = {"trace_hashed_tfidf"}


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["post_id", "ChannelName", "Datetime", "narrative_id", "similarity"]
    assert df.count() == 18  # SURVEY §7.2 probe at sf0.001


def test_every_query_has_oracle_or_is_listed():
    q, o = ({k: v for k, v in d.items() if k != "pipeline" and not re.match(r"op\d+_", k)}
            for d in (entry.queries(), entry.oracle_sql()))
    assert set(o) <= set(q)
    assert set(q) - set(o) == ROWS_ONLY


def test_stream_equals_batch(spark):
    q = entry.queries()
    a = sorted(tuple(r) for r in q["trace_vectors"](spark, SF_SMALL).collect())
    b = sorted(tuple(r) for r in q["stream_trace"](spark, SF_SMALL).select(
        "post_id", "ChannelName", "Datetime", "narrative_id", "similarity").collect())
    assert a == b and len(a) > 0


def test_queries_run_on_smallest_scale(spark):
    q = entry.queries()
    for k in ("trace_lexical", "post_batches", "eval_quartiles", "cluster_narratives", "run_roundtrip"):
        assert q[k](spark, SF_SMALL).count() >= 0
