"""Lenient parsers for dirty input (ANSI mode is on: every parse is a try_*)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

JSON_SPAN = r"(?s)\{.*?\}"


ZONED = r"^(.*\d:\d{2}.*?)\s*([+-])(\d{2})(?::?(\d{2}))?$"


def parse_datetime(s: Column) -> Column:
    """TIMESTAMP_NTZ (UTC wall clock) from 'yyyy-MM-dd HH:mm:ss', 'yyyy-MM-dd', ISO 'T'
    forms with or without fraction and 'Z', or any of them with a zone offset
    ('+hh:mm', '+hhmm', '+hh'), which is taken off; anything else gives null."""
    t = F.trim(s)
    part = lambda n: F.regexp_extract(t, ZONED, n)
    minutes = F.coalesce(part(3).try_cast("int"), F.lit(0)) * 60 + F.coalesce(part(4).try_cast("int"), F.lit(0))
    away = F.when(part(2) == "-", minutes).otherwise(-minutes)
    zoned = F.timestamp_add("MINUTE", away, part(1).try_cast("timestamp_ntz"))
    plain = F.regexp_replace(t, "Z$", "").try_cast("timestamp_ntz")
    return (F.when(t == "", F.lit(None).cast("timestamp_ntz"))
             .when(part(2) != "", zoned).otherwise(plain))


def floor_to_second(ts: Column) -> Column:
    """Drop the sub-second part of a TIMESTAMP_NTZ (stays NTZ)."""
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts),
                                F.hour(ts), F.minute(ts), F.second(ts))


def int_prefix(s: Column) -> Column:
    """Leading integer of a text like JavaScript parseInt, 0 when there is none."""
    return F.coalesce(F.regexp_extract(s, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def first_json_object(text: Column) -> Column:
    """First non-greedy {...} span that parses as JSON (VARIANT), else null."""
    spans = F.regexp_extract_all(text, F.lit(JSON_SPAN), F.lit(0))
    good = F.filter(spans, lambda x: F.try_parse_json(x).isNotNull())
    return F.try_parse_json(F.try_element_at(good, F.lit(1)))
