import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import benchmark_hits, components, near_duplicates as brute_near
from pyspark.sql import functions as F

from tidetrace.llm import language_id as lid
from tidetrace.llm.common import text_buffer
from tidetrace.llm.components import connected_components
from tidetrace.llm.contamination import drop_contaminated, find_benchmark, hit_words
from tidetrace.llm.html_text import extract_main_text, main_text, parse, site_templates, subtree_marks
from tidetrace.llm.minhash import near_duplicates
from tidetrace.llm.mixing import DomainModel, Rates, fit_rates, mix_documents, resample
from tidetrace.llm.quality import fit_quality, score_quality
from tidetrace.llm.sharding import shard_rows
from tidetrace.llm.token_files import Code, TextEncoder, code_lengths, read_ids, write_ids
from tidetrace.llm.toxicity import drop_toxic, fit_toxicity, score_toxicity
from tidetrace.llm.words import ALNUM, NON_SPACE, words

DOCS = "doc_id long, text string, lang string, source string"


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioustr") for _ in range(rng.randint(1, 6))) for _ in range(n))


def docs_of(spark, rows, extra=()):
    """Documents with further columns of clashing names."""
    df = spark.createDataFrame([(i, t, lang, s) for i, t, lang, s in rows], DOCS)
    for c in extra:
        df = df.withColumn(c, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_equal_regex():
    texts = ["", "Ab,c dé 12", "中 a\tb", None, "x" * 70000 + " y"]
    data, offs = text_buffer(pa.array(texts, pa.string()))
    w = words(data, offs, ALNUM)
    assert np.diff(w.ptr).tolist() == [0, 4, 3, 0, 2]
    a, b = words(*text_buffer(pa.array(["AB ab"])), NON_SPACE).hash
    assert a == b


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (9, 8), (8, 7), (7, 9), (20, 10), (20, 11), (20, 12), (1, 1)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components({x for p in links for x in p}, links)
    assert got == {k: v for k, v in want.items() if k != 1}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shards(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 5) if i % 7 else None, "en", ["a", "a", "b", None][i % 4]) for i in range(101)]
    rows += [rows[3], rows[3], (None, "", "en", "b")]
    got = shard_rows(docs_of(spark, rows, ["rank", "shard", "slot", "_pid", "fraction"]), 8).collect()
    assert len(got) == len(rows)
    sizes = [sum(r.shard == s for r in got) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
        for source in ("a", "b", None):  # every shard holds the mixture
            own = sum(r.source == source for r in got if r.shard == s)
            assert abs(own - sum(x[3] == source for x in rows) / 8) <= 1.5
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r.size == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in got)
    again = shard_rows(docs_of(spark, rows[::-1]).repartition(5), 8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert shard_rows(empty(spark), 8).count() == 0


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    rng = random.Random(k)
    base = prose(rng, 120).split()
    rows = []
    for i in range(60):  # near copies of one text, with more and more changes
        w = list(base)
        for _ in range(i // 4):
            w[rng.randrange(len(w))] = prose(rng, 1) + str(i)
        rows.append(" ".join(w))
    rows += [prose(rng, 80) for _ in range(10)] + [None, "", "  ", "one", "ONE ", "one two", prose(rng, 30_000)]
    rows += [rows[0]] * 4 + [rows[70].upper() if rows[70] else "x"]
    table = [(100 + i, t, "en", "s") for i, t in enumerate(rows)]
    df = docs_of(spark, table, ["cls", "band", "id", "root"])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, k=k).collect()}
    assert got == brute_near([(r[0], r[1]) for r in table], k)
    # repeated rows and null keys go with their text; a repeated key with another text does no harm
    odd = [(1, "a b c d e f g", "en", "s"), (1, "a b c d e f g", "en", "s"), (None, "a b c d e f g", "en", "s"),
           (2, "a b c d e f g", "en", "s"), (3, "p q r s t u v", "en", "s"), (3, "z", "en", "s"), (4, "Z", "en", "s")]
    out = sorted((r.doc_id or 0, r.component_id) for r in near_duplicates(docs_of(spark, odd), k=k).collect())
    assert out == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 3), (3, 3), (4, 3)]
    assert near_duplicates(empty(spark), k=k).count() == 0


def test_benchmark(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, n)) for i, n in enumerate([40, 25, 10, 9, 3, 10])]
    items += [(7, items[0][1]), (8, None), (9, ""), (10, "the the the the the the the the the the the the")]
    docs = [(0, None), (1, ""), (2, prose(rng, 50)), (3, items[0][1].upper()), (4, "the " * 30),
            (5, prose(rng, 5) + " " + " ".join(items[1][1].split()[3:13]) + " " + prose(rng, 5)),
            (6, " ".join(items[1][1].split()[3:12])), (7, items[3][1] + "x " + items[3][1]), (8, items[4][1]),
            (9, prose(rng, 20_000) + " " + items[0][1] + ". " + items[2][1])]
    docs.append((11, docs[5][1]))
    df = docs_of(spark, [(i, t, "en", "s") for i, t in docs], ["items", "hit_runs", "n_words", "id"])
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    want = benchmark_hits(docs, items)
    for block in (1 << 20, 200):  # one block, and several
        got = find_benchmark(df, bench, block_bytes=block).withColumn("n_hit", hit_words()).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in got} == want
        clean = drop_contaminated(df, bench, block_bytes=block)
        assert clean.columns == df.columns
        assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, w in want.items() if not w[1])
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_benchmark(df, none).filter(F.size("items") > 0).count() == 0
    assert find_benchmark(empty(spark), bench).count() == 0


ODD_TEXTS = ["", None, "Hello, world.\nIt's 3pm; don't, we'll  see  x y 'tis", "a  b\t\n  c \n\n d   ",
             "été À×÷ © naïvé café's", "中文 \U0001f600 ok<|endoftext|> no",
             "\x00\x1c\x85 　 x!'s 1'2 a1b2 ...'re ROCK'N'ROLL", "word " * 5000, "a  <|endoftext|>  b<|endoftext|><|endoftext|>'s \n <|endof", "text|> x", " lead", "trail ", "\n", "'s"]


def test_token_files(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(path)
    data, offs = text_buffer(pa.array(ODD_TEXTS, pa.string()))
    encoder = TextEncoder(path)
    assert encoder.by_piece
    for _ in range(2):  # the second time from the cache
        ids, ptr = encoder.encode(data, offs)
        for t, a, b in zip(ODD_TEXTS, ptr[:-1], ptr[1:]):
            assert ids[a:b].tolist() == plain.encode(t or "", add_special_tokens=False).ids, t
    rows = [(i, t, "en", "s") for i, t in enumerate(ODD_TEXTS)] + [(None, "x", "en", "s"), (3, ODD_TEXTS[3], "en", "s")]
    df = docs_of(spark, rows, ["id", "part", "seq", "bits"]).repartition(3)
    write_ids(df, f"{tmp_path}/a", path, block_ids=50, every=8)
    got = sorted(read_ids(spark, f"{tmp_path}/a", with_ids=True).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in order]
    at = 0
    for r, row in zip(got, order):
        want = plain.encode(row[1] or "", add_special_tokens=False).ids + [2]
        raw = struct.pack(f"<{len(want)}I", *want)
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(want), zlib.crc32(raw), raw)
        at += len(want)
    write_ids(empty(spark), f"{tmp_path}/b", path)
    assert read_ids(spark, f"{tmp_path}/b").count() == 0


def test_huffman_code():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 50, 3000):
        counts = np.sort(rng.zipf(1.3, n).clip(1, 10**9))
        lengths = code_lengths(counts, 16)
        assert lengths.max() <= 16 and (2.0 ** -lengths).sum() <= 1
        code = Code(np.arange(n) * 3, lengths)
        ids = (rng.integers(0, n, 1000) * 3).astype(np.uint32)
        bits, marks = code.write(ids, 64)
        size = np.full(len(marks), 64)
        size[-1] = len(ids) - 64 * (len(marks) - 1)
        assert np.concatenate(code.read(np.frombuffer(bits, np.uint8), marks, size)).tolist() == ids.tolist()
    # against the best code by trying all length choices
    import itertools
    counts = np.array([1, 1, 2, 5, 9])
    best = min(sum(c * x for c, x in zip(counts, ls)) for ls in itertools.product(range(1, 4), repeat=5)
               if sum(2.0 ** -x for x in ls) <= 1)
    assert (counts * code_lengths(counts, 3)).sum() == best


def test_viterbi_is_exact():
    rng = np.random.default_rng(4)
    sizes = [0, 1, 31, 32, 33, 100, 0, 5]
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(0, 3, (ptr[-1], 3))
    path = lid.viterbi(scores, ptr, 4.0)
    for a, b in zip(ptr[:-1], ptr[1:]):
        v = np.zeros(3)
        for s in scores[a:b]:
            v = np.maximum(v, v.max() - 4.0) + s
        own = path[a:b]
        total = scores[np.arange(a, b), own].sum() - 4.0 * (own[1:] != own[:-1]).sum()
        assert b == a or np.isclose(total, v.max())


def test_language(spark):
    rng = random.Random(3)
    make = {"xx": lambda: " ".join(rng.choice(["bolo", "kabo", "tolok"]) for _ in range(40)),
            "yy": lambda: " ".join(rng.choice(["rinse", "sine", "reni"]) for _ in range(40)),
            "el": lambda: " ".join(rng.choice(["αβγ", "δεζ"]) for _ in range(40))}
    rows = [(i, make[g](), g, "s") for i, g in enumerate(["xx", "yy", "el"] * 20)]
    model = lid.fit_languages(docs_of(spark, rows + [(99, None, "xx", "s"), (98, "x", None, "s")]))
    test = [(1, make["xx"](), None, ""), (2, make["yy"]().upper(), None, ""), (3, make["el"](), None, ""), (4, None, None, ""),
            (5, "", None, ""), (6, "12 !?", None, ""), (7, "да", None, ""),
            (8, make["xx"]() + " " + make["yy"]()[:60] + " " + make["xx"](), None, "")]
    got = {r.doc_id: r for r in lid.identify(docs_of(spark, test, ["lang_pred", "score", "id"]), model, spans=True).collect()}
    assert [got[i].lang_pred for i in range(1, 9)] == [
        "xx", "yy", "el", "und", "und", "und", got[7].lang_pred, "xx"]
    assert got[7].lang_pred in make and got[7].score == 0  # letters, though of a script that none uses
    assert got[4].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    spans = got[8].spans
    assert [s.lang for s in spans] == ["xx", "yy", "xx"]
    assert test[7][1][spans[1].first:spans[1].end].split()[0] in ("rinse", "sine", "reni")
    assert lid.identify(empty(spark), model).count() == 0
    nothing = lid.fit_languages(empty(spark))
    assert {r.lang_pred for r in lid.identify(docs_of(spark, test), nothing).collect()} == {"und"}


def test_html(spark):
    def text(h, marks=()):
        return main_text(parse(h), set(marks))

    assert text(None) == text("") == "" and text("a &lt;b&gt;&nbsp; c") == "a <b> c"
    assert text("<p>x</p><a href='foo") == "x"
    assert text("<table><tr><td>1<td>2</table><ul><li>x<ul><li>y</ul><li>z</ul>") == "1 2 x y z"
    page = ("<html><head><title>T</title><style>p{}</style></head><body class='has-sidebar'><nav><a>Home</a></nav>"
            "<div id='cookie-banner'>We use cookies</div><header><h1>Site</h1></header><main><article><header><h1>Title &amp; "
            "more</h1></header><p>One<br>two <i>th</i>ree<p>Four <span hidden>no</span><form>f</form><section id=comments><p>nice"
            "</section></article><aside>x</aside></main><script>var t='</p>';</script><footer>f</footer>")
    assert text(page) == "Title & more One two three Four"
    shared = "<div><span>Follow us everywhere</span></div>"
    pages = [(i, "http://a.com/%d" % i, f"<body>{shared}<p>text {i}</p>") for i in range(8)]
    pages += [(20, "http://b.com/", f"{shared}<p>other</p>"), (21, None, None), (22, "http://A.com:80/x", f"{shared}<p>text</p>"),
              (23, "http://a.com/0", pages[0][2]), (23, "http://a.com/0", pages[0][2])]
    copies = [(30 + i, "http://c.com/", "<body><p>all the same</p>") for i in range(9)]
    df = spark.createDataFrame(pages + copies, "page_id long, url string, html string").withColumn("marks", F.lit(1))
    marks = {r.host: set(r.marks) for r in site_templates(df).collect()}
    assert set(marks) == {"a.com"} and marks["a.com"] <= set(subtree_marks(parse(pages[0][2])))
    for hosts in (100, 0):  # broadcast, and joined by host
        got = {r.page_id: r.text for r in extract_main_text(df, broadcast_hosts=hosts).collect()}
        assert got[3] == "text 3" and got[22] == "text" and got[23] == "text 0" and got[21] == ""
        assert got[20] == "Follow us everywhere other" and got[35] == "all the same"
    assert extract_main_text(df.limit(0)).count() == 0


def labelled(spark, rng, n=160):
    rows, labels = [], []
    for i in range(n):
        bad = i % 2
        words_ = prose(rng, 30).split()
        if bad:
            words_[rng.randrange(30)] = rng.choice(["grumble", "grumbling"])
        rows.append((i, " ".join(words_), "en", "s"))
        labels.append((i, 1 - bad, bad))
    labels += [(None, 1, 1), (3, None, None), (4, 7, 7)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


def test_toxicity(spark):
    rng = random.Random(8)
    rows, labels = labelled(spark, rng)
    model = fit_toxicity(docs_of(spark, rows), labels)
    test = [(1, prose(rng, 200) + " grumble", None, "s"), (2, prose(rng, 200), None, "s"), (3, None, None, "s"), (4, "", None, "s"),
            (5, prose(rng, 20_000) + " grumbled", None, "s"), (2, "Grumble", None, "s")]
    df = docs_of(spark, test, ["score", "id", "label"])
    got = [(r.doc_id, r.score >= 0.5) for r in score_toxicity(df, model).orderBy("doc_id", "score").collect()]
    assert got == [(1, True), (2, False), (2, True), (3, False), (4, False), (5, True)]
    kept = drop_toxic(df, model)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert score_toxicity(empty(spark), model).count() == 0
    none = fit_toxicity(docs_of(spark, rows), labels.limit(0))
    assert {r.score for r in score_toxicity(df, none).collect()} == {0.0}


def test_quality(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 60).upper() if i % 2 else prose(rng, 60), "en", "s") for i in range(120)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(120)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = fit_quality(docs_of(spark, rows), labels)
    test = [(1, prose(rng, 60), None, ""), (2, prose(rng, 60).upper(), None, ""), (3, None, None, ""), (4, "", None, ""),
            (5, prose(rng, 30_000), None, ""), (1, prose(rng, 60), None, "")]
    got = score_quality(docs_of(spark, test, ["score", "id", "label", "extra"]), model).collect()
    assert all(r.score > 0.7 for r in got if r.doc_id in (1, 5)) and all(r.score < 0.5 for r in got if r.doc_id == 2)
    assert len({r.score for r in got if r.doc_id in (3, 4)}) == 1
    none = fit_quality(docs_of(spark, rows), labels.limit(0))
    assert {r.score for r in score_quality(docs_of(spark, test), none).collect()} == {0.5}
    assert score_quality(empty(spark), model).count() == 0


def test_mixing(spark):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.5, 0.5, 0.5], 400)
    t = rng.integers(0, 300, 400)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p)], "n_tokens long, p array<double>")
    for weights, low in (({"a": 1, "b": 1, "c": 2}, 0.0), ({"a": 1, "b": 3, "c": 8}, 0.0), ({"a": 1, "b": 1, "c": 2}, 1.0)):
        rates = fit_rates(members, ["a", "b", "c"], weights=weights, min_rate=low, steps=200)
        r = rates.of(p)
        assert r.min() >= low
        assert np.allclose((t * r) @ p, rates.reached, rtol=1e-9)
        # plain projected-gradient descent on the same least squares reaches the same value
        whiten = np.linalg.inv((t[:, None] * p).T @ p / t.sum() + 1e-9 * np.eye(3))
        loss = lambda x: (e := ((t * x) @ p - rates.targets) / t.sum()) @ whiten @ e
        x = np.ones(400)
        for _ in range(3000):
            x = np.maximum(low, x - p @ (whiten @ (((t * x) @ p - rates.targets) / t.sum())))
        assert loss(r) <= loss(x) + 1e-6
    assert Rates([], 0.0, np.zeros(3)).of(p).tolist() == [1.0] * 400
    assert DomainModel(["all"], np.zeros((1 << 18, 1), np.float32), np.zeros(1)).memberships(
        *text_buffer(pa.array(["a b", None])))[1].tolist() == [[1.0], [1.0]]


def test_mixing_documents(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 50).upper() if i % 4 == 0 else prose(rng, 50), "en", "s") for i in range(160)]
    rows += [(200, None, "en", "s"), (201, "", "en", "s"), (None, prose(rng, 20), "en", "s"), rows[1], rows[1]]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(160)] + [(None, 1), (3, None)],
                                   "doc_id long, quality int")
    domain = F.concat(F.lit("q"), F.col("quality").cast("string"))
    df = docs_of(spark, rows, ["rate", "copies", "p", "draw", "id", "crc"])
    out = mix_documents(df, labels, domain, weights={"q0": 0.5, "q1": 0.5}).collect()
    assert len(out) == len(rows) and all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in out)
    tokens = {d: sum(r.n_tokens * r.rate for r in out if r.domain == d) for d in ("q0", "q1")}
    assert 0.8 < tokens["q0"] / tokens["q1"] < 1.25
    more = resample(df, labels, domain, weights={"q0": 0.5, "q1": 0.5}, min_rate=1.0)
    assert more.columns == df.columns
    count = {}
    for r in more.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert set(count) == {r[0] for r in rows} and sum(count.get(i, 0) for i in range(0, 160, 4)) > 80
    assert resample(df.limit(0), labels, domain).count() == 0
    assert {r.rate for r in mix_documents(df, labels.limit(0), domain).collect()} == {1.0}


def test_huffman_code_of_a_large_vocabulary(spark, tmp_path):
    rng = np.random.default_rng(5)
    n = 200_000
    lengths = code_lengths(rng.integers(1, 1000, n) ** 3)
    assert 16 < lengths.max() <= 24 and (2.0 ** -lengths).sum() <= 1
    code = Code(np.arange(n), lengths)
    ids = rng.integers(0, n, 5000).astype(np.uint32)
    bits, marks = code.write(ids, 64)
    size = np.full(len(marks), 64)
    size[-1] = len(ids) - 64 * (len(marks) - 1)
    assert np.concatenate(code.read(np.frombuffer(bits, np.uint8), marks, size)).tolist() == ids.tolist()


def test_rows_of_one_key_are_spread(spark, tmp_path):
    import public_tokenizers

    df = docs_of(spark, [(None if i % 2 else 5, f"text {i % 50}", "en", "s") for i in range(400)])
    write_ids(df, f"{tmp_path}/a", str(public_tokenizers.path("byte_bpe_50k.json")))
    rows = sorted(read_ids(spark, f"{tmp_path}/a").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None] * 200 + [5] * 200
    assert spark.read.parquet(f"{tmp_path}/a/blocks").select("part").distinct().count() >= 3


def test_viterbi_of_many_languages_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(6)
    ptr = np.arange(0, 40_001, 2)
    scores = rng.normal(0, 3, (40_000, 50)).astype(np.float32)
    tracemalloc.start()
    path = lid.viterbi(scores, ptr, 4.0)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    one = scores[::2].astype(float)[:, :, None] + scores[1::2].astype(float)[:, None, :] - 4.0 * ~np.eye(50, dtype=bool)
    got = one[np.arange(20_000), path[::2], path[1::2]]
    assert np.allclose(got, one.max(axis=(1, 2)))


def test_mixing_reports_what_it_reached(spark):
    rows = [(i, ("good " if i % 2 else "bad ") * 20, "en", "s") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    docs, domain = docs_of(spark, rows), F.concat(F.lit("q"), F.col("quality").cast("string"))
    got = mix_documents(docs, labels, domain, weights={"q0": 0.2, "q1": 0.8}).collect()
    share = sum(r.rate * r.n_tokens for r in got if r.domain == "q1") / sum(r.rate * r.n_tokens for r in got)
    assert all(r.met for r in got) and abs(share - 0.8) < 0.02
    assert {r.domain for r in got} == {"q0", "q1"} and all(abs(r.reached - r.target) < 0.02 * 20_000 for r in got)
    far = mix_documents(docs, labels, domain, weights={"q0": 0.0, "q1": 1.0}, min_rate=1.0, budget=100.0).collect()
    assert not any(r.met for r in far)  # every document stays, so these targets are out of reach
