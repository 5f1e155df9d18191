"""Post readers (SRC1, SRC2, SRC3, SRC5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidetrace.functions.parse import parse_datetime
from tidetrace.operators.prepare import author_context
from tidetrace.sources.quoted_csv import read_quoted_csv

# Fixed value: texts read as null (pandas' default null words, D14).
NULL_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
              "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
REPLACEMENT_CHAR = "�"


def _paths(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def read_csv_posts(spark: SparkSession, paths: str | Sequence[str], *, schema: T.StructType | None = None,
                   null_words: Sequence[str] | None = NULL_WORDS, strip_invalid: bool = True) -> DataFrame:
    """SRC1: header CSV whose quoted cells may hold newlines; every column as
    text unless a schema is given (its columns by name, cells that do not fit are
    null); undecodable bytes removed (D15); null words applied per column (D14).
    Adds AuthorTweet and the source file name.

    A file is read by as many tasks as it has splits (``read_quoted_csv``).
    """
    try:
        df = read_quoted_csv(spark, _paths(paths))
    except ValueError:
        raise ValueError(f"post file(s) {_paths(paths)} are empty") from None
    except AnalysisException as e:  # a path that does not exist or cannot be listed
        raise ValueError(f"cannot read post file(s) {_paths(paths)}: {str(e).splitlines()[0][:200]}") from e
    df = df.withColumn("source_file", F.element_at(F.split(F.expr("url_decode(replace(source_path, '+', '%2B'))"), "/"), -1)).drop(
        "source_path", "source_block", "source_line", "lead")
    if schema is not None:
        known = {c.lower(): c for c in df.columns}
        df = df.select(*[(F.col(f"`{known[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in known
                          else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields], "source_file")
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType) and f.name != "source_file":
            if strip_invalid:
                c = F.regexp_replace(c, REPLACEMENT_CHAR, "")
            if null_words:
                c = F.when(c.isin(*null_words), F.lit(None)).otherwise(c)
        cols.append(c.alias(f.name))
    df = df.select(*cols)
    if "Tweet" in df.columns:
        df = author_context(df)
    return df


def read_text_posts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """SRC2: each .txt file is one post (column Tweet), no time, no channel."""
    df = spark.read.option("pathGlobFilter", "*.txt").text(_paths(paths), wholetext=True)
    return df.select(F.col("value").alias("Tweet"), F.col("_metadata.file_name").alias("source_file")) \
             .transform(author_context)


def read_json_posts(spark: SparkSession, paths: str | Sequence[str],
                    schema: T.StructType | None = None) -> DataFrame:
    """SRC5: uploaded records as JSON lines; Datetime typed on the way in."""
    from tidetrace.schemas import POST_TEXT
    df = spark.read.schema(schema or POST_TEXT).json(_paths(paths))
    if "Datetime" in df.columns and dict(df.dtypes)["Datetime"] == "string":
        df = df.withColumn("Datetime", parse_datetime(F.col("Datetime")))
    if "Tweet" in df.columns:
        df = author_context(df)
    return df


def read_posts(spark: SparkSession, paths: str | Sequence[str], fmt: str | None = None, **kw) -> DataFrame:
    """SRC3: choose the reader by format or file suffix; anything else is an error."""
    ps = _paths(paths)
    if fmt is None:
        suffixes = {p.rsplit(".", 1)[-1].lower() for p in ps if "." in p.rsplit("/", 1)[-1]}
        if len(suffixes) != 1:
            raise ValueError(f"cannot tell the format of {ps}; pass fmt='csv', 'txt' or 'json'")
        fmt = suffixes.pop()
    if fmt == "csv":
        return read_csv_posts(spark, ps, **kw)
    if fmt == "txt":
        return read_text_posts(spark, ps)
    if fmt in ("json", "jsonl"):
        return read_json_posts(spark, ps, **kw)
    if fmt == "parquet":
        return spark.read.parquet(*ps)
    raise ValueError(f"unsupported post file format: {fmt}")
