"""Proportional stratified interleaving: shards that all hold the corpus mixture.

Rows of each stratum are shuffled by a seeded hash and ranked; a row's fractional
rank is (rank + 1/2) / stratum size. Sorting all rows by that fraction deals every
stratum evenly along one line, and cutting the line into equal pieces gives shards
whose row counts differ by at most one and whose mixture is the corpus mixture.

DataFrame operations only. Both rankings are range partitioned on their whole
order, so a stratum with a third of all rows spans many tasks.

Defined cases: a null stratum is a stratum of its own; null or empty text has
size 8 and crc32 0; a null key is hashed as its own value and sorts first; rows
that repeat a key, or whole rows, each take a slot of their own; an empty table
gives no rows; other columns of the input are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidetrace.functions.ranking import group_positions

OVERHEAD_BYTES = 8


def shard_rows(docs: DataFrame, n_shards: int, *, key: str = "doc_id", text: str = "text",
               stratum: str = "source", seed: int = 17) -> DataFrame:
    """One row per input row: key, stratum, size, text_crc32, fraction, shard, slot."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    # 60 bits of an md5: the same order in any engine.
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))),
                              1, 15), 16, 10).cast("long")
    rows = docs.select(F.col(key).alias("id"), F.col(stratum).alias("stratum"),
                       (F.octet_length(body) + OVERHEAD_BYTES).cast("long").alias("size"),
                       F.crc32(body).alias("crc"), draw.alias("draw"))
    total_order = ["draw", "id", "size", "crc"]
    ranked = group_positions(rows, ["stratum"], total_order, position_col="rank", size_col="n_in")
    fraction = (F.col("rank") * 2 + 1) / (F.col("n_in") * 2)
    line = group_positions(ranked.select("id", "stratum", "size", "crc", "draw", fraction.alias("fraction")),
                           [], ["fraction", *total_order, "stratum"], position_col="pos", size_col="n_all")
    shard = F.expr(f"(pos * {n_shards}L) div n_all")
    first = F.expr(f"(shard * n_all + {n_shards - 1}L) div {n_shards}L")
    return (line.withColumn("shard", shard)
            .select(F.col("id").alias(key), F.col("stratum").alias(stratum), "size", F.col("crc").alias("text_crc32"),
                    "fraction", F.col("shard").cast("int").alias("shard"), (F.col("pos") - first).alias("slot")))
