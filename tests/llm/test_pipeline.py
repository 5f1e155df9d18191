import zlib

import corpus_pipeline as cp
import public_tokenizers
from brute import benchmark_hits, near_duplicates
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tidetrace.llm import queries

SF = "/root/testdata/sf0.001"
stages = dict(cp.STAGES)


def test_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and set(queries.ORACLE_SQL) <= set(names)
    assert [name for name, _ in cp.STAGES] == ["toxicity", "near_dedup", "decontaminate", "mix", "token_ids"]


def test_stages_against_brute_force(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    kept["documents"] = docs.collect()
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        assert name == "token_ids" or docs.columns == columns
    text = {r.doc_id: r.text for r in kept["documents"]}
    ids = {name: [r.doc_id for r in rows] for name, rows in kept.items()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    dropped = set(ids["documents"]) - set(ids["toxicity"])
    learnt = [d for d, t in labels.items() if t == 1 and zlib.crc32(str(d).encode()) % 5]
    assert sum(d in dropped for d in learnt) >= 0.9 * len(learnt)
    assert not any(labels.get(d) == 0 for d in dropped if zlib.crc32(str(d).encode()) % 5)
    near = near_duplicates([(d, text[d]) for d in ids["toxicity"]], 5)
    assert sorted(ids["near_dedup"]) == sorted(d for d, x in near.items() if x[2])
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hits = benchmark_hits([(d, text[d]) for d in ids["near_dedup"]], items)
    assert sorted(ids["decontaminate"]) == sorted(d for d, x in hits.items() if not x[1])
    assert set(ids["mix"]) == set(ids["decontaminate"]) and len(ids["mix"]) >= len(ids["decontaminate"])
    assert all(text[r.doc_id] == r.text for r in kept["mix"])
    tok, at = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))), 0
    out = sorted(kept["token_ids"], key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted(ids["mix"])
    for r in out:
        n = len(tok.encode(text[r.doc_id] or "", add_special_tokens=False).ids) + 1
        assert (r.start, r.n_tokens) == (at, n)
        at += n


def test_repeated_and_null_keys_are_judged_by_their_text(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    rows = [(1, one, "en", "a", "u"), (1, two, "en", "a", "u"), (1, one, "de", "a", "u"), (1, one, "de", "a", None),
            (2, two + " tail", "en", "b", "v"), (None, three, "en", "b", "v"), (None, one, "en", "b", "v"), (3, None, "en", "b", "v"),
            (3, None, "en", "b", "v"), (4, "", "en", "b", "v"), (5, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row string").repartition(3)
    for order in (docs, docs.repartition(1)):
        got = stages["near_dedup"](spark, order, "").collect()
        assert sorted((r.doc_id or 0, r.text or "", r.lang or "", r.row or "") for r in got) == sorted([
            (1, one, "de", ""), (1, two, "en", "u"), (0, three, "en", "v"), (3, "", "en", "v"), (4, "", "en", "v"), (5, "", "", "")])
    assert stages["near_dedup"](spark, docs.limit(0), "").count() == 0


def test_stages_on_odd_tables(spark):
    rows = [(1, "a good page about rivers", None, None, "c"), (1, "a good page about rivers", None, None, "c"),
            (None, None, "en", "s", "c"), (7, "", "en", "s", "c"), (8, "word " * 60_000, "xx", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, label string")
    for c in ("id", "draw", "score", "kept", "cls", "items", "p"):
        docs = docs.selectExpr("*", f"1 AS {c}")
    for name, stage in stages.items():
        got = stage(spark, docs, SF)
        if name == "token_ids":
            assert sorted((r.doc_id or 0, r.n_tokens) for r in got.collect())[:2] == [(0, 1), (1, got.filter("doc_id = 1").first().n_tokens)]
        else:
            assert got.columns == docs.columns
            kept = sorted((r.doc_id or 0, r.text or "") for r in got.collect())
            assert sorted(set(kept)) == sorted({(r[0] or 0, r[1] or "") for r in rows})
        assert stage(spark, docs.limit(0), SF).count() == 0
