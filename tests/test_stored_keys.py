"""The embedding store takes content keys: texts stay where they are read."""

import hashlib

import __spark_entry__ as entry
from tidetrace.operators import embed as em
from tidetrace.sources import tables as tb

TEXTS = [(1, "a"), (2, "b"), (3, None), (4, "a"), (5, ""), (6, "c"), (7, "b"), (7, "b")]
VECTORS = [(4, [4.0, 0.0]), (1, [1.0, 0.0]), (3, [3.0, 0.0]), (7, [7.0, 1.0]), (99, [9.0, 9.0]), (5, None)]


def _tables(spark, path):
    spark.createDataFrame([(i, t, "en", "s") for i, t in TEXTS], "doc_id long, text string, lang string, source string") \
         .repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 0, v) for i, v in VECTORS], "vec_id long, label int, embedding array<float>") \
         .repartition(2).write.parquet(f"{path}/embeddings.parquet")


def test_rows_and_what_is_stored(spark, tmp_path, monkeypatch):
    _tables(spark, tmp_path)
    stored, upsert = [], em.upsert_embeddings
    monkeypatch.setattr(em, "upsert_embeddings", lambda rows, path: (stored.append(rows), upsert(rows, path))[1])
    got = sorted((r.post_id, r.has_vector, r.first_component) for r in entry.queries()["embedding_store"](spark, str(tmp_path)).collect())
    vector = {"a": 1.0, "b": 7.0}  # of the first post of that text
    assert got == sorted((i, t in vector, vector.get(t)) for i, t in TEXTS)
    assert len(stored) == 3 and not any("Join" in r._jdf.queryExecution().optimizedPlan().toString() for r in stored)


def test_only_ids_and_keys_of_texts_are_joined(spark, tmp_path):
    _tables(spark, tmp_path)
    df = tb.text_keys_and_vectors(spark, str(tmp_path))
    assert {(r.post_id, r.text_key) for r in df.collect()} == {
        (i, None if t is None else hashlib.sha256(t.encode()).hexdigest()) for i, t in TEXTS if i in dict(VECTORS)}
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    texts = plan.children().head().output()
    assert {texts.apply(k).name() for k in range(texts.size())} == {"post_id", "text_key"}
