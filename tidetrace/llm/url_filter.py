"""URL filter: listed rules first, then exact membership in a key list by a Bloom filter cascade.

Level 1 of the cascade encodes the listed keys. The corpus's own keys that are not listed
but pass level 1 (its false positives over the complete key universe) are encoded in level
2, the listed keys that pass level 2 in level 3, and so on until a level lets no wrong key
pass. A key of the corpus is listed exactly if the first level that refuses it is an even
one, or if it passes all of an odd number of levels. The universe is known when the levels
are built, so membership is exact for every url judged, and judging joins nothing: each
level is a scalar value of the plan, and a key's bits lie in one word of it, so that a
level is one look-up.

DataFrame functions only. A level's bits are built by a shuffle of (word, bits) with
partial aggregation; only keys that pass level 1 are compared with the list itself. Keys
are dealt to parts by hash so that one part's level has at most PART_KEYS keys; the
levels of PARTS_AT_ONCE parts are in a plan at the same time and further parts follow in
another pass, which bounds the memory of the driver and of each task for any list.

Rules are (host, path, verdict): a rule fits its host and all subdomains if the path starts
with the rule's; the longest one wins (of equal length the first one).

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule
that names a host and is not looked up; null and repeated listed keys change nothing; an
empty list allows all urls that no rule blocks; an empty table gives no rows; repeated rows
are judged alike; other columns of the input are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidetrace.llm.common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PART_KEYS = 400_000  # listed keys that one part's level may hold
PARTS_AT_ONCE = 4
FIRST_BITS, FIRST_PROBES = 16, 4  # bits for a key, and bits it sets, in level 1
NEXT_BITS, NEXT_PROBES = 8, 3  # in the later levels, whose keys are few
MAX_LEVELS = 64
MAX_RULES = 10_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    start = F.instr(url, "://")
    return F.coalesce(F.when(start > 0, F.substring(url, start + 3, F.length(url))), F.lit(""))


def url_key(url: Column) -> Column:
    """Host and path as one key; null where there is no host."""
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url)))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: list their keys instead")
    for rule in rules:
        if len(rule) != 3 or None in rule or rule[2] not in ("allow", "block"):
            raise ValueError(f"a rule is (host, path, 'allow' or 'block'): {rule}")
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    ranked = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    table = F.array(*[F.struct(F.lit(h.translate(str.maketrans(UPPER, LOWER))).alias("host"), F.lit(p).alias("path"),
                               F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for h, p, v in ranked])
    fits = F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"])))
                    & F.startswith(path, r["path"]))
    first = F.get(fits, F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict")))


def _place(key: Column, level: int, words: int) -> Column:
    """The word of a level (a power of two of them) that holds the key's bits."""
    return F.xxhash64(F.lit(level), key).bitwiseAND(F.lit(words - 1))


def _mask(key: Column, level: int, probes: int) -> Column:
    """The key's bits inside its word."""
    draw = F.xxhash64(F.lit(-level), key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"),
                            F.shiftrightunsigned(draw, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(probes)]
    return reduce(Column.bitwiseOR, bits)


def _level(keys: DataFrame, level: int, words: int, probes: int, parts: list[int]) -> DataFrame:
    """One row: bits, an array with one array of longs for each of the parts."""
    spark = keys.sparkSession
    set_bits = keys.select("part", _place(F.col("key"), level, words).alias("word"),
                           _mask(F.col("key"), level, probes).alias("bits"))
    blank = spark.range(words).select(F.explode(F.array(*[F.lit(p).cast("long") for p in parts])).alias("part"),
                                      F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    merged = set_bits.unionByName(blank).groupBy("part", "word").agg(F.bit_or("bits").alias("bits"))
    of_part = merged.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w"))
    of_part = of_part.select("part", F.transform("w", lambda x: x["bits"]).alias("bits"))
    rows = of_part.agg(F.array_sort(F.collect_list(F.struct("part", "bits"))).alias("all"))
    return stage(rows.select(F.transform("all", lambda x: x["bits"]).alias("bits")))


def _words(n: int, bits_per_key: int) -> int:
    words = 1
    while 64 * words < n * bits_per_key:
        words *= 2
    return words


class Cascade:
    """Levels of the parts of one pass; odd levels hold listed keys, even ones keys to refuse."""

    def __init__(self, listed: DataFrame, universe: DataFrame, parts: list[int], of_parts: int):
        self.parts, self.of_parts = parts, of_parts
        self.levels: list[tuple[DataFrame, int, int]] = []
        right, others = self._in_parts(listed), self._in_parts(universe)
        wrong = others
        for level in range(1, MAX_LEVELS + 1):
            most = right.groupBy("part").count().agg(F.max("count")).first()[0]
            if not most:
                return
            bits, probes = (FIRST_BITS, FIRST_PROBES) if level == 1 else (NEXT_BITS, NEXT_PROBES)
            words = _words(most, bits)
            self.levels.append((_level(right, level, words, probes, parts), words, probes))
            passed = wrong.filter(self._passes(F.col("key"), level))
            if level == 1:  # only keys that pass are compared with the list
                passed = passed.distinct().join(right.select("key"), "key", "left_anti")
            right, wrong = stage(passed), right
        raise RuntimeError(f"the cascade did not end within {MAX_LEVELS} levels")

    def _in_parts(self, keys: DataFrame) -> DataFrame:
        part = part_of(F.col("key"), self.of_parts)
        keys = keys.withColumn("part", part)
        return keys.filter(F.col("part").isin(self.parts)) if self.of_parts > len(self.parts) else keys

    def _passes(self, key: Column, level: int) -> Column:
        """True if all bits of the key are set in the level."""
        rows, words, probes = self.levels[level - 1]
        at = F.lit(0) if len(self.parts) == 1 else (part_of(key, self.of_parts) - self.parts[0]).cast("int")
        mask = _mask(key, level, probes)
        return F.get(F.get(rows.scalar(), at), _place(key, level, words).cast("int")).bitwiseAND(mask) == mask

    def listed(self, key: Column) -> Column:
        """True for the listed ones among the universe's keys of these parts, else false; null for other parts' keys."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels), 0, -1):
            # Refused by an odd level: not listed; by an even one: listed.
            answer = F.when(self._passes(key, level), answer).otherwise(F.lit(level % 2 == 0))
        return F.when(part_of(key, self.of_parts).isin(self.parts), answer) if self.of_parts > len(self.parts) else answer


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), key), F.lit(parts)).cast("long") if parts > 1 else F.lit(0).cast("long")


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]], *, key: str = "page_id",
               url: str = "url", listed_key: str = "key", part_keys: int = PART_KEYS,
               parts_at_once: int = PARTS_AT_ONCE) -> DataFrame:
    """One row per input row: key, host, path, rule (host and path of the rule that fits, else
    null), listed (is the url's host and path in the list), verdict (the rule's; else block if
    listed, else allow)."""
    link = F.col(url)
    # Written once: every level hashes the key, which would repeat the url's parsing.
    rows = stage(pages.select(F.col(key).alias("id"), host_of(link).alias("host"), path_of(link).alias("path"),
                              url_key(link).alias("key")))
    names = stage(listed.select(F.col(listed_key).cast("string").alias("key")).filter("key is not null").distinct())
    universe = rows.select("key").filter("key is not null")
    parts = max(1, -(-names.count() // part_keys))
    member = F.lit(None).cast("boolean")
    for a in range(0, parts, parts_at_once):
        one = Cascade(names, universe, list(range(a, min(a + parts_at_once, parts))), parts)
        rows = rows.withColumn("listed", F.coalesce(member, one.listed(F.col("key"))))
        if parts > parts_at_once:
            rows = stage(rows)
        member = F.col("listed")
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    out = rows.select("id", "host", "path", F.coalesce("listed", F.lit(False)).alias("listed"), fit.alias("fit"))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("id").alias(key), "host", "path", F.col("fit.rule").alias("rule"), "listed",
                      verdict.alias("verdict"))
