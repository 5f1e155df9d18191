"""Saved results (SRC6, SRC7, SRC8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidetrace.sources.quoted_csv import csv_lines, read_quoted_csv, survey

# Metadata keys of the '#' header lines of an exported result
# (the first line, "# Analysis Results - Generated <time>", is not read back).
HEADER_FIELDS = {
    "Target": "targetNarrative",
    "Date Range": "dateRange",
    "Threshold": "threshold",
    "Datasets": "selectedDatasets",
    "Total Records": "totalRecords",
}


def lead_metadata(lead: Column) -> dict[str, Column]:
    """Typed metadata columns from an array of leading '#' lines: the first line of each key counts."""
    def value(key: str) -> Column:
        line = F.get(F.filter(lead, lambda x: x.rlike(rf"^#\s*{key}\s*:")), F.lit(0))
        return F.trim(F.regexp_extract(line, r"^#\s*[^:]+:(.*)$", 1))

    out = {name: value(key) for key, name in HEADER_FIELDS.items()}
    span = out["dateRange"]
    return out | {"threshold": out["threshold"].try_cast("double"),
                  "totalRecords": out["totalRecords"].try_cast("bigint"),
                  "selectedDatasets": F.split(out["selectedDatasets"], r",\s*"),
                  "startDate": F.regexp_extract(span, r"^(.*?) to ", 1), "endDate": F.regexp_extract(span, r" to (.*)$", 1)}


def read_header_metadata(spark: SparkSession, paths) -> DataFrame:
    """SRC6 (header part): one row per file with the values of its leading '#' lines; lines further
    down are data, whatever they begin with."""
    splits = survey(csv_lines(spark, [paths] if isinstance(paths, str) else list(paths)), comments=True)
    first = splits.filter("block = 0")
    return first.select(F.col("path").alias("file"), *[c.alias(n) for n, c in lead_metadata(F.col("lead")).items()])


def read_exported(spark: SparkSession, paths) -> DataFrame:
    """SRC6/JN5: all rows of exported results with their file's metadata attached.

    Metadata is what the lines before the column names hold. Posts that begin with '#' and cells
    with lines like '# Target: ...' are rows; ``count_matches`` compares the file's row count with
    its 'Total Records'.
    """
    rows = read_quoted_csv(spark, paths, comments=True).withColumnRenamed("source_path", "file")
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("_rows"))  # one row a file
    rows = rows.join(F.broadcast(counts), "file")
    meta = lead_metadata(F.col("lead"))
    rows = rows.select(*[c for c in rows.columns if c not in ("lead", "source_block", "source_line")],
                       *[c.alias(n) for n, c in meta.items()])
    return rows.withColumn("count_matches", F.col("_rows") == F.col("totalRecords")).drop("_rows")


def list_runs(spark: SparkSession, base_path: str) -> DataFrame:
    """SRC7/RNK7: saved runs, newest first."""
    return spark.read.parquet(f"{base_path.rstrip('/')}/runs").orderBy(F.desc("generatedAt"), F.desc("run_id"))


def load_run(spark: SparkSession, base_path: str, run_id: str) -> DataFrame:
    """SRC8: rows of one run (partition pruning on run_id); unknown run → error."""
    runs = spark.read.parquet(f"{base_path.rstrip('/')}/runs").where(F.col("run_id") == run_id)
    if runs.limit(1).count() == 0:
        raise ValueError(f"no saved run named {run_id}")
    from tidetrace.operators.prepare import nan_to_null
    rows = spark.read.parquet(f"{base_path.rstrip('/')}/rows").where(F.col("run_id") == run_id).drop("run_id")
    return nan_to_null(rows)


def read_own_export(spark: SparkSession, path: str) -> DataFrame:
    """The layout of ``export_with_header`` back in: quoted CSV rows with the metadata of the
    ``_header`` side file attached as scalar values (one header per export, so no join is needed)."""
    rows = read_quoted_csv(spark, f"{path.rstrip('/')}/rows").drop("source_path", "source_block", "source_line", "lead")
    meta = read_header_metadata(spark, f"{path.rstrip('/')}/_header")
    for name in [*HEADER_FIELDS.values(), "startDate", "endDate"]:
        rows = rows.withColumn(name, meta.select(name).scalar())
    return rows
