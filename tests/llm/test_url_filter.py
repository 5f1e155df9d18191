import random

from pyspark.sql import functions as F

from tidetrace.llm.url_filter import Cascade, host_of, judge_urls, path_of

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    rest = rest[cut:]
    return host, rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]


def brute(urls, listed):
    out = []
    for i, u in urls:
        host, path = split(u)
        fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        rule = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        member = bool(host) and host + path in listed
        out.append((i, host, path, rule and rule[0] + rule[1], member, rule[2] if rule else "block" if member else "allow"))
    return out


URLS = ["http://EXAMPLE.org/es/1", "https://a.example.org/en/12?x=1", "http://example.org/en/2#f", "http://xexample.org/es/",
        "http://b.com/fr/", "http://com/de/x", "http://b.com/de", "http://b.net?q=/de/", "b.com/de/", None, "", "://", "x://#",
        "http://É.Com/de/a b\nc", "http://a://b.com/de/", "http://b.net", "http://b.net/", "http://b.net/" + "p" * 200_000,
        "http://b.net/" + "://" * 50]


def test_rules_and_parts(spark):
    rows = [(i, u) for i, u in enumerate([*URLS, URLS[0], URLS[0]])] + [(None, "http://b.net/"), (3, "http://z.net/l")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for c in ("key", "host", "rule", "part", "id", "listed"):
        pages = pages.withColumn(c, F.lit("x"))
    listed = ["b.net/", "z.net/l", None, "b.net/", "nowhere", "b.net/" + "p" * 200_000, ""]
    keys = spark.createDataFrame([(k,) for k in listed], "key string")
    got = [(r.page_id, r.host, r.path, r.rule, r.listed, r.verdict) for r in judge_urls(pages, keys, RULES).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows, set(listed))))


def test_cascade_is_exact_over_many_levels_and_parts(spark):
    rng = random.Random(2)
    names = [f"h{rng.randrange(10 ** 9)}.net/{i}" for i in range(20_000)]
    rows = [(i, "http://" + n) for i, n in enumerate(names)] + [(-1, "http://" + names[0])] * 3000
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(4)
    listed = set(names[::3]) | {f"other{i}" for i in range(500)}
    keys = spark.createDataFrame([(k,) for k in listed], "key string")
    for limit, at_once in ((400_000, 4), (1500, 2)):
        got = judge_urls(pages, keys, [], part_keys=limit, parts_at_once=at_once).collect()
        assert len(got) == len(rows)
        assert all(r.listed == (r.host + r.path in listed) and r.verdict == ("block" if r.listed else "allow")
                   and r.rule is None for r in got)
    universe = pages.select(F.concat(host_of(F.col("url")), path_of(F.col("url"))).alias("key"))
    assert len(Cascade(keys, universe, [0], 1).levels) >= 3


def test_empty(spark):
    pages = spark.createDataFrame([(1, "http://b.net/")], "page_id long, url string")
    none = spark.createDataFrame([], "key string")
    assert [tuple(r) for r in judge_urls(pages, none, RULES).collect()] == [(1, "b.net", "/", None, False, "allow")]
    assert judge_urls(pages.limit(0), none, RULES).count() == 0
