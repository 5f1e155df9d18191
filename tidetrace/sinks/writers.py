"""Sinks (SNK1-SNK6). All writes are distributed DataFrame writes."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from tidetrace.functions.text import channel_key

# The export header lines written before the rows (SNK3), in order:
# "# Analysis Results - Generated <time>", "# Target: ", "# Date Range: <start> to <end>",
# "# Threshold: ", "# Datasets: <a, b>", "# Total Records: ".


def with_channel_key(df: DataFrame) -> DataFrame:
    if "ChannelName" not in df.columns:
        raise ValueError("ChannelName column is required to split by channel")
    return df.withColumn("channel_key", channel_key(F.col("ChannelName")))


def channel_manifest(df: DataFrame) -> DataFrame:
    """SNK1/AGG2: rows per channel and its file key; keys shared by several
    channels are flagged instead of overwriting each other."""
    m = with_channel_key(df).groupBy("ChannelName", "channel_key").agg(F.count(F.lit(1)).alias("n_posts"))
    return m.withColumn("key_collision", F.count(F.lit(1)).over(Window.partitionBy("channel_key")) > 1)


def write_by_channel(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                     task_bytes: int = 256 << 20) -> DataFrame:
    """SNK1: one directory per channel key (partition pruning on read, FLT3).

    Text bytes are counted per channel first. A channel key with more than ``task_bytes`` is dealt to
    as many tasks as its bytes need, by a hash of the row's own values, so that a task retried after an
    executor loss gets exactly the same rows; there is no upper bound. Only such keys, at most the
    table's bytes over ``task_bytes``, are broadcast.
    """
    keyed = with_channel_key(df)
    size = sum((F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) if f.dataType.typeName() in ("string", "binary")
                else F.lit(8) for f in df.schema.fields), F.lit(0))
    large = (keyed.groupBy("channel_key").agg(F.sum(size.cast("long")).alias("_bytes")).where(F.col("_bytes") > task_bytes)
                  .select("channel_key", F.ceil(F.col("_bytes") / task_bytes).alias("_salts")))
    draw = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.coalesce("_salts", F.lit(1)))
    salted = keyed.join(F.broadcast(large), "channel_key", "left").withColumn("_salt", draw)
    (salted.repartition("channel_key", "_salt").drop("_salt", "_salts").write.mode(mode)
           .partitionBy("channel_key").format(fmt).save(path))
    return channel_manifest(df)


def new_run_id(now: dt.datetime | None = None) -> str:
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    return f"run_{now.strftime('%Y%m%d_%H%M%S')}_{uuid.uuid4().hex[:6]}"


def save_run(result: DataFrame, base_path: str, *, target: str, start: str | None, end: str | None,
             threshold: float, datasets: Sequence[str], run_id: str | None = None) -> DataFrame:
    """SNK2: write a trace result under ``run_id`` and append its RUN row.

    Returns the one-row RUN DataFrame. An empty result is an error, as in the
    original save path. The row count comes from the written files.
    """
    spark = result.sparkSession
    if result.isEmpty():
        raise ValueError("nothing to save: the result is empty")
    run_id = run_id or new_run_id()
    rows_path = f"{base_path.rstrip('/')}/rows"
    runs_path = f"{base_path.rstrip('/')}/runs"
    result.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(rows_path)
    total = spark.read.parquet(rows_path).where(F.col("run_id") == run_id).count()
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    run = spark.createDataFrame(
        [(run_id, start, end, target, float(threshold), list(datasets), now, int(total))],
        "run_id string, startDate string, endDate string, targetNarrative string, threshold double, "
        "selectedDatasets array<string>, generatedAt timestamp_ntz, totalRecords bigint")
    run.write.mode("append").parquet(runs_path)
    return run


def metadata_lines(run: Row, total: int) -> list[str]:
    """The header lines of an export; a line break in a value would end the line and becomes a space."""
    values = {
        "Target": run["targetNarrative"], "Date Range": f"{run['startDate']} to {run['endDate']}", "Threshold": run["threshold"],
        "Datasets": ", ".join(run["selectedDatasets"] or []), "Total Records": total}
    lines = [f"# Analysis Results - Generated {run['generatedAt'].isoformat()}", *(f"# {k}: {v}" for k, v in values.items())]
    return [" ".join(x.splitlines()) for x in lines]


def export_with_header(result: DataFrame, run: DataFrame, path: str) -> None:
    """SNK3: CSV rows (all cells quoted, quotes doubled) plus the metadata
    header lines as a side file ``_header.txt`` written from the RUN row."""
    r = run.first()
    lines = metadata_lines(r, r["totalRecords"])
    (result.write.mode("overwrite").option("header", True).option("quoteAll", True)
           .option("escape", '"').option("nullValue", "").csv(f"{path}/rows"))
    spark = result.sparkSession
    spark.createDataFrame([(ln,) for ln in lines], "value string").coalesce(1) \
         .write.mode("overwrite").text(f"{path}/_header")


def csv_cell(value: Column) -> Column:
    """A cell as text: quoted, with its quotes doubled, if it holds a comma, quote or line break. A null
    is an empty cell, an empty text is a quoted one."""
    text = value.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.isNull(), F.lit("")).when(text.rlike('[,"\\r\\n]') | (text == ""), quoted).otherwise(text)


def export_files(result: DataFrame, run: DataFrame, path: str, *, max_file_bytes: int = 128 << 20) -> int:
    """SNK3: the result as CSV files that each begin with the run's metadata lines, a blank line and
    the column names. Up to ``max_file_bytes`` of rows make one file; more are dealt by hash to as
    many files as needed, written in parallel, each with its own row count. Returns the number of files.

    ``read_exported`` gives the rows back without loss. ``result`` is read twice: export a saved run.
    """
    r = run.first()
    columns = result.columns
    line = F.concat_ws(",", *[csv_cell(F.col(f"`{c}`")) for c in columns])
    if len(columns) == 1:  # an empty line would be no row
        line = F.when(F.col(f"`{columns[0]}`").isNull(), F.lit('""')).otherwise(line)
    rows = result.select(line.alias("line"))
    total = rows.agg(F.sum(F.octet_length("line") + 1)).first()[0] or 0
    n = max(1, -(-total // max_file_bytes))
    file_no = F.pmod(F.xxhash64("line"), F.lit(n)).cast("int")
    rows = rows.select(file_no.alias("file_no"), F.lit(1).alias("part"), F.lit(0).alias("nth"), "line")
    counts = {x["file_no"]: x["count"] for x in rows.groupBy("file_no").count().collect()}  # one row a file
    names = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\r\n') else c for c in columns)
    lead = [(f, 0, i, text) for f in range(n) for i, text in enumerate(
        [*metadata_lines(r, counts.get(f, 0)), "", names])]
    head = result.sparkSession.createDataFrame(lead, "file_no int, part int, nth int, line string")
    (head.unionByName(rows).repartition(n, "file_no").sortWithinPartitions("file_no", "part", "nth", "line")
         .select("file_no", "line").write.mode("overwrite").partitionBy("file_no").text(path))
    return n


def write_prepared(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK4: persist a prepared post table as parquet (multi-line CSV is not
    splittable, so it is converted once and queried from parquet after)."""
    df.write.mode(mode).parquet(path)


def write_narratives_json(summary: DataFrame, path: str) -> None:
    """SNK6: one JSON record per cluster summary."""
    summary.write.mode("overwrite").json(path)


def write_eval(pairs: DataFrame, metrics: DataFrame, path: str) -> None:
    """SNK5: the pair table and the metric summary."""
    pairs.write.mode("overwrite").parquet(f"{path}/pairs")
    metrics.write.mode("overwrite").json(f"{path}/metrics")



def read_eval(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SNK5 back in: (pairs, metrics)."""
    return spark.read.parquet(f"{path}/pairs"), spark.read.json(f"{path}/metrics")
