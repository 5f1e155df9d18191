"""Exact positions and quantiles without funnelling a group into one task.

Quantiles need no order of the rows: they come from counts (``order_statistics``).


A plain ``row_number().over(Window.partitionBy(g).orderBy(o))`` sends a whole
group to one task; with one group holding a third of all rows that task
becomes the job. Here rows are range-partitioned on (group, order) so a hot
group is spread over many partitions, numbered locally, and shifted by the
row counts of the earlier partitions of the same group (a table with one row
per (partition, group) piece).
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidetrace.session import ensure_checkpoint_dir

# Offsets tables at most this long are broadcast; longer ones are shuffle-joined.
MAX_BROADCAST_OFFSET_ROWS = 2_000_000


def _cols(xs: Sequence[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def group_positions(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str | Column],
                    *, position_col: str = "position", size_col: str | None = None,
                    num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based exact position of each row inside its group.

    ``order_cols`` must make the order total (end with a unique key) when ties
    would matter. Cuts lineage with a reliable checkpoint in the shared
    ``spark.checkpoint.dir`` so the numbering is stable when executors are lost.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*_cols(group_cols), *_cols(order_cols)]
    staged = (df.repartitionByRange(n, *keys)
                .sortWithinPartitions(*keys)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id())
                .checkpoint(eager=True))
    pieces = staged.groupBy("_pid", *group_cols).agg(F.min("_mid").alias("_m0"),
                                                     F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*group_cols).orderBy("_pid")
    pieces = pieces.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if size_col:
        pieces = pieces.withColumn(size_col, F.sum("_cnt").over(Window.partitionBy(*group_cols)))
    renamed = {g: f"_g{i}" for i, g in enumerate(group_cols)}
    pieces = pieces.drop("_cnt").select(
        F.col("_pid").alias("_rpid"), *[F.col(g).alias(a) for g, a in renamed.items()],
        "_m0", "_off", *([size_col] if size_col else [])).checkpoint(eager=True)
    small = pieces.count() <= MAX_BROADCAST_OFFSET_ROWS
    right = F.broadcast(pieces) if small else pieces
    cond = [F.col("_pid") == F.col("_rpid")] + [F.col(g).eqNullSafe(F.col(a)) for g, a in renamed.items()]
    out = (staged.join(right, cond, "inner")
                 .withColumn(position_col, F.col("_off") + F.col("_mid") - F.col("_m0"))
                 .drop("_rpid", "_m0", "_off", *renamed.values()))
    return out.drop("_pid", "_mid")


DIGIT_BITS = 16


def _ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles (-0.0 as 0.0)."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _double_of(bits: int) -> float:
    raw = bits ^ (1 << 63) if bits >> 63 else bits ^ ((1 << 64) - 1)
    return struct.unpack("<d", struct.pack("<Q", raw))[0]


def _digit_counts(prefixes: list[int], digits: int):
    """Rows (prefix number, next digit, n) of the values that begin with each prefix of ``digits`` digits."""
    def run(batches):
        counts = np.zeros((len(prefixes), 1 << DIGIT_BITS), np.int64)
        for batch in batches:
            bits = _ordered_bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64))
            digit = (bits >> np.uint64(64 - DIGIT_BITS * (digits + 1))).astype(np.int64) & ((1 << DIGIT_BITS) - 1)
            for i, prefix in enumerate(prefixes):
                own = digit if not digits else digit[bits >> np.uint64(64 - DIGIT_BITS * digits) == np.uint64(prefix)]
                counts[i] += np.bincount(own, minlength=1 << DIGIT_BITS)
        i, d = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(d), pa.array(counts[i, d])], names=["i", "digit", "n"])
    return run


def order_statistics(df: DataFrame, value_col: str, ranks: Callable[[int], Sequence[int]]) -> dict[int, float]:
    """The values at given 0-based ranks of a column's non-null doubles, by radix selection.

    Doubles become integers of the same order. Four passes count the next 16 bits of the
    values that begin with the bits found so far; a task returns counts only, so neither a
    sort nor a shuffle of values takes place, and many equal values are one count. ``ranks``
    gets the number of values and names the ranks wanted. ``value_col`` is read in each pass.
    """
    vals = df.select(F.col(value_col).cast("double").alias("v")).where(F.col("v").isNotNull())
    wanted: dict[int, tuple[int, int]] = {}
    for digits in range(64 // DIGIT_BITS):
        prefixes = sorted({p for p, _ in wanted.values()}) or [0]
        found = vals.mapInArrow(_digit_counts(prefixes, digits), "i bigint, digit bigint, n bigint").groupBy("i", "digit").agg(
            F.sum("n").alias("n")).collect()  # at most 65,536 rows a prefix
        table = np.zeros((len(prefixes), 1 << DIGIT_BITS), np.int64)
        for r in found:
            table[r["i"], r["digit"]] = r["n"]
        if not digits:
            total = int(table.sum())
            wanted = {k: (0, k) for k in ranks(total) if 0 <= k < total}
            if not wanted:
                return {}
        upto = table.cumsum(axis=1)
        for k, (prefix, left) in wanted.items():
            own = upto[prefixes.index(prefix)]
            digit = int(np.searchsorted(own, left, side="right"))
            wanted[k] = (prefix << DIGIT_BITS | digit, left - (int(own[digit - 1]) if digit else 0))
    return {k: _double_of(bits) for k, (bits, _) in wanted.items()}


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float],
                    names: Sequence[str] | None = None) -> DataFrame:
    """One-row DataFrame of linearly interpolated quantiles (like numpy's
    default / SQL ``quantile_cont``), by radix selection; nulls without values."""
    names = list(names or [f"q{int(p * 100)}" for p in probs])
    size: list[int] = []

    def ranks(n: int) -> list[int]:
        size.append(n)
        return sorted({min(int(math.floor((n - 1) * p)) + i, n - 1) for p in probs for i in (0, 1)})

    at = order_statistics(df, value_col, ranks)
    out = []
    for p in probs:
        if not at:
            out.append(None)
            continue
        h = (size[0] - 1) * float(p)
        lo = int(math.floor(h))
        out.append(at[lo] + (h - lo) * (at[min(lo + 1, size[0] - 1)] - at[lo]))
    return df.sparkSession.createDataFrame([tuple(out)], ", ".join(f"`{n}` double" for n in names))
