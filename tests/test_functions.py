import datetime as dt

from pyspark.sql import functions as F

from tidetrace.functions.parse import first_json_object, floor_to_second, int_prefix, parse_datetime
from tidetrace.functions.text import channel_key, is_blank, squared_norm_of_counts, strip_html, tokens
from tidetrace.functions.vectors import cosine


def test_tokens_and_norm(spark):
    df = spark.createDataFrame([(1, "  The cat\tthe\nCAT  dog "), (2, ""), (3, None)], "id int, t string")
    r = {x["id"]: x for x in df.select("id", tokens(F.col("t")).alias("k"),
                                       squared_norm_of_counts(tokens(F.col("t"))).alias("n2")).collect()}
    assert r[1]["k"] == ["the", "cat", "the", "cat", "dog"]
    assert r[1]["n2"] == 2 * 2 + 2 * 2 + 1
    assert r[2]["k"] == [] and r[2]["n2"] == 0
    assert r[3]["k"] is None


def test_channel_key_blank_html(spark):
    df = spark.createDataFrame([("Rachel Maddow MSNBC",), ("a/b:ç",), (None,), ("😀x",)], "c string")
    keys = [r[0] for r in df.select(channel_key(F.col("c"))).collect()]
    assert keys == ["Rachel_Maddow_MSNBC", "a_b_ç", "__null__", "_x"]
    b = spark.createDataFrame([(" \t\n",), ("x",), (None,)], "t string").select(is_blank(F.col("t"))).collect()
    assert [r[0] for r in b] == [True, False, True]
    h = spark.createDataFrame([("<b>Tom &amp; Jerry</b>",)], "t string").select(strip_html(F.col("t"))).first()[0]
    assert h == "Tom &amp; Jerry"


def test_parse_datetime_and_floor(spark):
    df = spark.createDataFrame([("2020-11-04T10:11:12.987Z",), ("2020-11-04",), ("2020-11-04 10:11:12",),
                                ("2020-11-04 10:11:12+00:00",), ("not a date",), ("",), (None,)], "s string")
    got = [r[0] for r in df.select(floor_to_second(parse_datetime(F.col("s")))).collect()]
    assert got[0] == dt.datetime(2020, 11, 4, 10, 11, 12)
    assert got[1] == dt.datetime(2020, 11, 4)
    assert got[2] == dt.datetime(2020, 11, 4, 10, 11, 12)
    assert got[3] == dt.datetime(2020, 11, 4, 10, 11, 12)
    assert got[4:] == [None, None, None]


def test_int_prefix(spark):
    df = spark.createDataFrame([("12abc",), ("",), (None,), ("  -3x",), ("abc",), ("+7",)], "s string")
    assert [r[0] for r in df.select(int_prefix(F.col("s"))).collect()] == [12, 0, 0, -3, 0, 7]


def test_first_json_object(spark):
    rows = [(1, None), (2, "no json here"), (3, '{bad} {"unsure":0,"support":0,"opposition":1,"neutral":0}'),
            (4, '```json\n{"support":1,"opposition":0,\n"neutral":0,"unsure":0}\n```'),
            (5, '{"a":1} {"a":2}')]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r["id"]: r["v"] for r in df.select("id", F.try_variant_get(first_json_object(F.col("t")), "$.opposition", "int")
                                               .alias("v")).collect()}
    assert got[1] is None and got[2] is None and got[3] == 1 and got[4] == 0
    a = df.where("id = 5").select(F.try_variant_get(first_json_object(F.col("t")), "$.a", "int")).first()[0]
    assert a == 1


def test_cosine_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = [round(r[0], 6) for r in df.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, round(2 ** -0.5, 6)]
