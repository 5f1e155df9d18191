"""Helpers shared by the operators: staging, bounded samples, Arrow text access."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidetrace.session import ensure_checkpoint_dir, scratch_path

BATCH_BYTES = 2 << 20
SLICE_BYTES = 1 << 20  # text handled at once by a numpy kernel; a longer single text is one slice


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    A lost executor costs a re-read of these files, not a recomputation.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """Write ``df`` into the shared scratch folder; its path and the table read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table of `write_table` that no later step reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def add_totals(df: DataFrame, totals: DataFrame, key: str, *, few: int = 100_000, salts: int = 64) -> DataFrame:
    """``df`` with the columns of ``totals`` (one row per key, nulls included).

    Up to ``few`` rows of totals are broadcast. More are joined by key and salt, each of
    them repeated for every salt, so that a key with a third of the rows spans many tasks.
    """
    totals = stage(totals)
    same = df[key].eqNullSafe(F.col("_key"))
    right = totals.withColumnRenamed(key, "_key")
    if totals.count() <= few:
        return df.join(F.broadcast(right), same, "left").drop("_key")
    left = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    right = right.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = left.join(right.hint("shuffle_hash"), left[key].eqNullSafe(right["_key"]) & (left["_salt"] == right["_salt2"]),
                       "left")
    return joined.drop("_key", "_salt", "_salt2")


def join_hot(df: DataFrame, right: DataFrame, key: str, rows: str, *, hottest: int = 1000) -> DataFrame:
    """``df`` left joined with ``right``, which has one row per key and in ``rows`` the key's rows in ``df``.

    Keys that hold more than one in ``hottest`` of the rows are fewer than ``hottest``; they
    are broadcast, so that their rows stay where they are. All others are joined by a
    shuffle of the key. Both inputs are read more than once: stage them.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    limit = max(1, total // hottest)
    hot = F.broadcast(right.filter(F.col(rows) > limit).drop(rows))
    cold = right.filter(F.col(rows) <= limit).drop(rows)
    rest = df.join(hot.select(key), key, "left_anti").join(cold.hint("merge"), key, "left")
    return df.join(hot, key).unionByName(rest)


def bounded(df: DataFrame) -> DataFrame:
    """``df`` for ``mapInArrow`` over whole texts, in batches of about BATCH_BYTES (one row at least).

    A batch is held by Spark's writer, by the worker and in what the worker makes of it. The
    session's spark.sql.execution.arrow.maxBytesPerBatch is lowered if it is larger.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", conf.get(name))
    if not now or int(now[1]) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def in_fold(key: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the key as text leaves ``remainder``; null keys are in no fold."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus == remainder, F.lit(False))


def bounded_sample(df: DataFrame, key: Column, limit: int, seed: int = 42) -> DataFrame:
    """About ``limit`` rows chosen by a hash of ``key`` (all rows if there are fewer).

    Only ever used to fit a model on labelled rows; ``limit`` is a parameter of
    every operator that calls this.
    """
    n = df.count()
    if n <= limit:
        return df
    return df.filter(F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * limit / n))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; nulls become empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    b = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[o[0]:o[-1]]
    return b, o - o[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes, one row at least."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def long_lists(values: np.ndarray, ptr: np.ndarray) -> pa.Array:
    """An array<bigint> column from concatenated values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(values.astype(np.int64, copy=False)))


def single_threaded() -> None:
    """Keep native libraries inside a task to the task's own core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("OMP_NUM_THREADS", "1")
