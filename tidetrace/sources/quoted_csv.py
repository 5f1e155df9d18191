"""Quoted multi-line CSV as a splittable source (SRC1, SRC6, JN5).

A line break inside a quoted cell is no record border, so where a split of the file begins
one cannot tell by itself whether it begins inside a cell. Two passes over the lines do:

1. every split counts its quotes (a doubled quote counts two, so only parity matters) and
   reports its leading ``#`` and blank lines and its first record; a prefix sum of the
   parities over a file's splits tells each split's state at its start;
2. every split cuts its lines into records. What is left open at its end, and what its
   first lines close, are fragments: at most two a split, joined by a shuffle of fragments
   only. All other text stays in the task that read it.

Records are then parsed by ``from_csv`` with the header of their file. Leading lines are told
by position, before the first line that is neither blank nor begins with ``#``: a post that
begins with ``#``, or a quoted cell with a line like ``# Target: ...``, is data.

Quotes must be balanced as RFC 4180 has it: a cell that holds a quote is quoted and its quotes
are doubled. A file that ends inside a cell yields its open record as it is.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

SPLITS = ("file bigint, path string, block bigint, prefix int, prefix_quotes bigint, quotes bigint, lead array<string>, "
          "header string, header_lines int, only_prefix boolean")
RECORDS = "file bigint, block bigint, line bigint, kind int, record string"
UNQUOTED_EMPTY = "\x00"  # what an unquoted empty cell reads as before it becomes null; a quoted one is an empty text
WHOLE, CLOSING, OPENING, MIDDLE = range(4)  # kinds of rows: a record, or a fragment of one


def csv_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines with the split they come from; a carriage return stays part of its line."""
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(list(paths))
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("path"),
                       F.col("_metadata.file_block_start").alias("block"), F.expr("make_valid_utf8(value)").alias("value"))


def _runs(batch: pa.RecordBatch):
    """(first row, end, file, block) of each split in a batch; a split's lines follow each other."""
    file = batch.column("file").to_numpy()
    block = batch.column("block").to_numpy()
    new = np.flatnonzero(np.concatenate([[True], (file[1:] != file[:-1]) | (block[1:] != block[:-1])]))
    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(file)]):
        yield a, b, int(file[a]), int(block[a])


def _quotes(lines: pa.Array) -> np.ndarray:
    return pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64)


def _survey(comments: bool):
    """One row a split (pass 1)."""
    def run(batches):
        now = None

        def row():
            return pa.RecordBatch.from_pylist([now | {"only_prefix": now["header"] is None, "open": None}],
                                              schema=schema).select(names)

        names = [f.split()[0] for f in SPLITS.split(", ")]
        schema = pa.schema([("file", pa.int64()), ("path", pa.string()), ("block", pa.int64()), ("prefix", pa.int32()),
                            ("prefix_quotes", pa.int64()), ("quotes", pa.int64()), ("lead", pa.list_(pa.string())),
                            ("header", pa.string()), ("header_lines", pa.int32()), ("only_prefix", pa.bool_()),
                            ("open", pa.string())])
        for batch in batches:
            if not batch.num_rows:
                continue
            value = batch.column("value")
            for a, b, file, block in _runs(batch):
                if now is None or (file, block) != (now["file"], now["block"]):
                    if now:
                        yield row()
                    now = {"file": file, "path": batch.column("path")[a].as_py(), "block": block, "prefix": 0,
                           "prefix_quotes": 0, "quotes": 0, "lead": [], "header": None, "header_lines": 0, "open": []}
                own = value.slice(a, b - a)
                quotes, at = _quotes(own), 0
                while at < len(own) and now["header"] is None:
                    line = own[at].as_py()
                    if not now["open"] and (not line.strip() or (comments and line.lstrip().startswith("#"))):
                        now["prefix"] += 1
                        now["prefix_quotes"] += int(quotes[at])
                        if block == 0 and line.strip():
                            now["lead"].append(line.strip())
                    else:
                        now["open"].append(line)
                        now["quotes"] += int(quotes[at])
                        if now["quotes"] % 2 == 0:
                            now["header"], now["header_lines"] = "\n".join(now["open"]), len(now["open"])
                    at += 1
                now["quotes"] += int(quotes[at:].sum())
        if now:
            yield row()
    return run


def survey(lines: DataFrame, comments: bool) -> DataFrame:
    """One row a split: its state at the start (``odd``: inside a cell), the lines to skip, and in
    the first split with data the file's leading lines and header."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    s = lines.mapInArrow(_survey(comments), SPLITS)
    s = s.withColumn("first", F.coalesce(F.min("only_prefix").over(before), F.lit(True)))  # nothing but leading lines before
    own = F.when(F.col("first"), F.col("quotes")).otherwise(F.col("quotes") + F.col("prefix_quotes"))
    s = s.withColumn("own", own).withColumn("odd", F.coalesce(F.sum("own").over(before), F.lit(0)) % 2)
    lead = F.first("lead").over(Window.partitionBy("file").orderBy("block"))
    return s.select("file", "path", "block", "odd", lead.alias("lead"),
                    F.when(F.col("first"), F.col("prefix") + F.col("header_lines")).otherwise(F.lit(0)).alias("skip"),
                    F.when(F.col("first"), F.col("header")).alias("header"))


def _cut(batches):
    """Records and fragments of the splits (pass 2): RECORDS."""
    split, held, begin, odd, line, closing = None, [], 0, 0, 0, False
    out: list[tuple[int, int, int, int, str]] = []

    def flush():
        cols = list(zip(*out)) if out else [[]] * 5
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(list(cols[0]), pa.int64()), pa.array(list(cols[1]), pa.int64()), pa.array(list(cols[2]), pa.int64()),
             pa.array(list(cols[3]), pa.int32()), pa.array(list(cols[4]), pa.string())],
            names=["file", "block", "line", "kind", "record"])

    def end():
        """What the split leaves open."""
        if held:
            out.append((*split, begin, MIDDLE if closing else OPENING, "\n".join(held)))
            held.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        value = batch.column("value")
        for a, b, file, block in _runs(batch):
            if (file, block) != split:
                end()
                split, line, odd = (file, block), 0, batch.column("odd")[a].as_py()
                closing, begin = bool(odd), 0
            skip = max(0, batch.column("skip")[a].as_py() - line)
            a, line = a + min(skip, b - a), line + min(skip, b - a)
            own = value.slice(a, b - a)
            if not len(own):
                continue
            # A line ends a record if the quotes up to its end are even.
            state = (odd + _quotes(own).cumsum()) % 2
            ends = np.flatnonzero(state == 0)
            starts = np.concatenate([[0], ends + 1])
            texts = own.to_pylist()
            for s, e in zip(starts.tolist(), ends.tolist()):
                if not held:
                    begin = line + s
                record = "\n".join([*held, *texts[s:e + 1]])
                held.clear()
                out.append((file, block, begin, CLOSING if closing else WHOLE, record))
                closing = False
            rest = texts[int(starts[-1]):]
            if rest:
                if not held:
                    begin = line + int(starts[-1])
                held.extend(rest)
            odd, line = int(state[-1]), line + len(own)
        yield flush()
    end()
    yield flush()


def records(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows (file, block, line, record): every data record with the split and line it begins in."""
    where = F.broadcast(splits.select("file", "block", "odd", "skip"))  # one row a split
    cut = lines.drop("path").join(where, ["file", "block"]).select("file", "block", "odd", "skip", "value")
    pieces = cut.mapInArrow(_cut, RECORDS)
    # An opening fragment and the middles and the closing one after it are one record.
    order = Window.partitionBy("file").orderBy("block", "line")
    fragments = pieces.filter(F.col("kind") != WHOLE).withColumn(
        "nth", F.sum((F.col("kind") == OPENING).cast("int")).over(order))
    joined = fragments.groupBy("file", "nth").agg(F.array_sort(F.collect_list(F.struct("block", "line", "record"))).alias("p"))
    joined = joined.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["line"].alias("line"),
                           F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    whole = pieces.filter(F.col("kind") == WHOLE).drop("kind").unionByName(joined)
    whole = whole.withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    return whole.filter(F.col("record") != "")


def column_names(header: str) -> list[str]:
    """Column names of a header record; empty names are numbered, repeated ones get a suffix."""
    import csv

    names: list[str] = []
    for n, name in enumerate(next(csv.reader([header.rstrip("\r")], strict=False), [])):
        name = name or f"_c{n}"
        k = 1
        while name in names:
            k += 1
            name = f"{name.removesuffix(f'.{k - 1}') if k > 2 else name}.{k}"
        names.append(name)
    return names


def read_quoted_csv(spark: SparkSession, paths: str | Sequence[str], *, comments: bool = False) -> DataFrame:
    """All records of CSV files with a header, as text columns, and ``source_path``, ``source_block``,
    ``source_line`` (where the record begins) and ``lead`` (the file's leading ``#`` lines).

    Files may have different headers: columns are matched by name and missing ones are null.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = csv_lines(spark, paths)
    splits = survey(lines, comments)
    headers = sorted(r[0] for r in splits.select("header").filter("header is not null").distinct().collect())
    found = records(lines, splits)
    files = splits.filter("header is not null").select("file", "path", "lead", "header")
    found = found.join(F.broadcast(files), "file")
    where = [F.col("path").alias("source_path"), F.col("block").alias("source_block"), F.col("line").alias("source_line"), "lead"]
    out = None
    for header in headers:
        names = column_names(header)
        schema = T.StructType([T.StructField(f"c{n}", T.StringType()) for n in range(len(names))])
        cells = F.from_csv("record", schema.simpleString()[len("struct<"):-1].replace(":", " "),
                           {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": UNQUOTED_EMPTY, "emptyValue": "", "maxCharsPerColumn": "-1",
                            "maxColumns": str(max(20_480, len(names)))})
        part = found.filter(F.col("header") == header).withColumn("_cells", cells).select(
            *[F.col("_cells")[f"c{n}"].alias(name) for n, name in enumerate(names)], *where)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no header in {paths}: the files are empty")
    return out
