import time

import numpy as np
import pyarrow as pa
from brute import benchmark_hits

from tidetrace.llm.common import text_buffer
from tidetrace.llm.contamination import ItemIndex, find_benchmark, hit_words
from tidetrace.llm.words import ALNUM, words


def test_repeated_words_cost_linear_time():
    index = ItemIndex(["a", "b"], ["the " * 1000, "the " * 900 + "end"], 10, 5)
    w = words(*text_buffer(pa.array(["the " * 20_000, "x " + "the " * 9, "the " * 9 + "end"])), ALNUM)
    began = time.monotonic()
    start, end, text, item = index.find(w.hash, w.ptr)
    assert time.monotonic() - began < 1
    assert len(start) == 20_000 - 9 + 1 and (end - start == 10).all()
    assert sorted(zip(text.tolist(), item.tolist())) == [(0, 0), (0, 1), (2, 1)]


def test_repeats_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    items = [(i, " ".join(rng.choice(["a", "b"], n))) for i, n in enumerate([40, 60, 12, 9, 3, 11, 30])]
    items += [(20, items[0][1] + " " + items[1][1]), (21, "a " * 30)]
    docs = [(i, " ".join(rng.choice(["a", "b", "c"], n, p=[.48, .48, .04]))) for i, n in enumerate([300, 5, 9, 10, 80, 1000])]
    docs += [(10, items[0][1]), (11, "a " * 500), (12, "c " * 500), (13, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 300):
        got = find_benchmark(df, bench, block_bytes=block).withColumn("n_hit", hit_words()).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in got} == benchmark_hits(docs, items)


def test_pieces_kept_between_texts_and_dropped_give_the_same_ids(monkeypatch):
    import random

    import numpy as np
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tidetrace.llm import token_files as tf
    from tidetrace.llm.common import text_buffer

    monkeypatch.setattr(tf, "RECENT_PIECES", 30)
    monkeypatch.setattr(tf, "CACHED_PIECES", 100)
    rng = random.Random(3)
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    plain, encoder, most = Tokenizer.from_file(path), tf.TextEncoder(path), 0
    for _ in range(40):
        texts = [" ".join("".join(rng.choices("aeé1t'", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 12))) for _ in range(5)]
        ids, ptr = encoder.encode(*text_buffer(pa.array(texts, pa.string())))
        for t, a, b in zip(texts, ptr[:-1], ptr[1:]):
            assert ids[a:b].tolist() == plain.encode(t, add_special_tokens=False).ids, t
        most = max(most, len(encoder.known.keys))
        assert (np.diff(encoder.known.keys.astype(object)) > 0).all()
    assert 30 < most < 100 + 30 + 60 * 5


def test_symbols_are_counted_for_many_documents_at_once(monkeypatch):
    import numpy as np
    import pyarrow as pa
    import zstandard

    from tidetrace.llm import token_files as tf

    calls, count = [], np.bincount
    monkeypatch.setattr(tf.np, "bincount", lambda *a, **b: (calls.append(1), count(*a, **b))[1])
    docs = [np.array([k % 7, 50_000 + k % 3, 70_000 * (k % 2)], np.uint32) for k in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array([zstandard.compress(tf._packed(d)) for d in docs], pa.binary())], names=["ids"])
    out = next(tf._counts([batch, batch.slice(0, 0)]))
    used, n = np.unique(np.concatenate(docs), return_counts=True)
    assert out.column("symbol").to_pylist() == used.tolist() and out.column("n").to_pylist() == n.tolist()
    assert len(calls) == 3
