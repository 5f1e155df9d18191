"""STR1: the trace is stateless per post, so it runs unchanged on a stream.

Each micro-batch is traced with the batch operator inside ``foreachBatch``
and written to ``<out>/batch_id=<n>`` with overwrite, so a batch replayed
after a failure replaces its own output (exactly-once effect with the
checkpoint). ``trigger(availableNow=True)`` drains what is there and stops,
which is how tests compare the stream with the batch result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidetrace.operators.trace import trace_vectors


def start_trace_stream(stream: DataFrame, targets: DataFrame, out_path: str, checkpoint: str, *,
                       start=None, end=None, threshold: float = 0.4, keep: list[str] | None = None,
                       available_now: bool = True, processing_time: str | None = None):
    def per_batch(df: DataFrame, batch_id: int) -> None:
        traced = trace_vectors(df, targets, start=start, end=end, threshold=threshold, keep=keep)
        traced.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    return w.start()


def read_parquet_stream(spark: SparkSession, directory: str, schema: T.StructType, *, glob: str | None = None,
                        max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(directory)


def read_table_stream(spark: SparkSession, path: str, schema: T.StructType, *, max_files: int | None = None) -> DataFrame:
    """A stream over a parquet table that is one file or a folder of files. Spark takes the path of a stream
    for a folder, so a single file is named by a pattern that only it fits."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        path = f"{path[:-1]}[{path[-1]}]"
    return read_parquet_stream(spark, path, schema, max_files=max_files)


def run_to_completion(query, timeout_s: int | None = None) -> None:
    """Wait for a draining query; it is stopped only after a timeout the caller sets."""
    query.awaitTermination(timeout_s) if timeout_s else query.awaitTermination()
    if query.isActive:
        query.stop()
        raise TimeoutError("stream did not finish in time")
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


EPOCH_NTZ = "1970-01-01 00:00:00"


def ntz_to_instant(c: F.Column) -> F.Column:
    """TIMESTAMP_NTZ → TIMESTAMP read as UTC wall clock (any session zone)."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), c))


def instant_to_ntz(c: F.Column) -> F.Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.lit(EPOCH_NTZ).cast("timestamp_ntz"))


def stream_timeline(scored: DataFrame, *, by: list[str], every: str = "1 day", lateness: str | None = None) -> DataFrame:
    """AGG16 on a stream: windowed counts in update mode. By default every row counts,
    however late (the state is one row per window and group). ``lateness`` sets a
    watermark that bounds the state; Spark then drops rows later than that."""
    events = scored.withColumn("_event", ntz_to_instant(F.col("Datetime")))
    if lateness:
        events = events.withWatermark("_event", lateness)
    return (events.groupBy(F.window("_event", every).alias("w"), *by)
                  .agg(F.count(F.lit(1)).alias("n_posts"),
                       F.round(F.sum("similarity"), 6).alias("sum_similarity"),
                       F.max("similarity").alias("max_similarity"))
                  .select(instant_to_ntz(F.col("w.start")).alias("bucket_start"), *by,
                          "n_posts", "sum_similarity", "max_similarity"))


def start_update_log(agg: DataFrame, out_path: str, checkpoint: str, *, available_now: bool = True):
    """Write each micro-batch's updated groups to ``<out>/batch_id=<n>``
    (overwrite, so a replayed batch replaces itself)."""
    def per_batch(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")
    w = agg.writeStream.outputMode("update").foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def latest_versions(spark: SparkSession, out_path: str, keys: list[str]) -> DataFrame:
    """Current value of every group from an update log: the row of the
    highest batch id per key (small groups: one row per batch that touched it)."""
    from pyspark.sql import Window
    log = spark.read.parquet(out_path)
    w = Window.partitionBy(*keys).orderBy(F.desc("batch_id"))
    return log.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", "batch_id")


def start_timeline_log(scored: DataFrame, out_path: str, checkpoint: str, *, by: list[str], every: str = "1 day",
                       lateness: str = "1 hour", available_now: bool = True):
    """AGG16 on a stream without held state, and without losing late rows.

    Every micro-batch writes its own partial sums per bucket and group to ``sums/batch_id=<n>``
    (overwrite, so a replayed batch replaces itself) and its largest event time to
    ``marks/batch_id=<n>``. A row is late if its bucket ended more than ``lateness`` before the
    largest event time of the earlier batches; late rows are summed apart (``late``), so that a reader
    can publish closed buckets and correct them. State lives in the log, one row a batch, bucket and
    group; ``timeline_of`` adds it up, ``compact_timeline`` folds it.
    """
    spark, root = scored.sparkSession, out_path.rstrip("/")

    def per_batch(df: DataFrame, batch_id: int) -> None:
        marks = _log(spark, f"{root}/marks", "at timestamp_ntz, batch_id bigint").where(F.col("batch_id") < batch_id)
        closed = marks.agg(F.max("at").alias("at")).select(F.expr(f"at - interval {lateness}").alias("at")).scalar()
        w = F.window("Datetime", every)
        rows = df.withColumn("w", w).withColumn("late", F.coalesce(F.col("w.end") <= closed, F.lit(False)))
        (rows.groupBy(F.col("w.start").alias("bucket_start"), *by, "late")
             .agg(F.count(F.lit(1)).alias("n_posts"),
                  F.sum(F.round(F.col("similarity") * 1_000_000).cast("long")).alias("micro_similarity"),
                  F.max("similarity").alias("max_similarity"))
             .write.mode("overwrite").parquet(f"{root}/sums/batch_id={batch_id}"))
        df.agg(F.max("Datetime").alias("at")).write.mode("overwrite").parquet(f"{root}/marks/batch_id={batch_id}")

    w = scored.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")).start()


def _log(spark: SparkSession, path: str, empty: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], empty)


def timeline_of(log: DataFrame, by: list[str], *, late: bool | None = None) -> DataFrame:
    """The timeline from a log of partial sums: of all rows, or of the late (on-time) ones alone."""
    rows = log if late is None else log.where(F.col("late") == late)
    return rows.groupBy("bucket_start", *by).agg(
        F.sum("n_posts").alias("n_posts"), F.round(F.sum("micro_similarity") / 1_000_000, 6).alias("sum_similarity"),
        F.max("max_similarity").alias("max_similarity"))


def compact_timeline(spark: SparkSession, out_path: str, by: list[str], to_path: str) -> None:
    """Fold a log into one row a bucket, group and kind (on time, late) at another path."""
    (spark.read.parquet(f"{out_path.rstrip('/')}/sums").groupBy("bucket_start", *by, "late")
          .agg(F.sum("n_posts").alias("n_posts"), F.sum("micro_similarity").alias("micro_similarity"),
               F.max("max_similarity").alias("max_similarity")).write.mode("overwrite").parquet(to_path))
