"""Product codes of vectors by Ball k-means with exact integer arithmetic.

Vectors become integers floor(1024 * x) and are cut into consecutive parts; every part
position has a codebook of at most 256 entries. An entry and its parts form a ball whose
radius R is the largest distance of a part to it. With D the squared distance of two
entries and A that of a part to its own entry:

- only entries with D <= 4 R**2 are neighbours: others cannot win any part of the ball;
- parts with 4 A < the least D lie in the stable core and keep their code unseen;
- the others lie in rings around the entry: a part in ring m (4 A reaches the m nearest
  neighbours) is compared with those m entries only.

All bounds are comparisons of integers that include equality, so ties go to the lower
index as in an exhaustive search, and results do not depend on partitioning. Balls are
kept per Arrow batch, whose radii are at most those of the whole ball.

A round is one pass that writes (vector, codes) to the shared scratch folder and one
that sums the parts of every entry; the table of the round before is removed once its
successor is written. The driver holds codebooks only (entries x components).

Defined cases: null vectors and those with null or non-finite components are dropped;
vectors of each length have codebooks of their own; a length that four does not divide
is cut at floor(i * length / parts); fewer vectors than entries give fewer entries; the
first codebook goes by ascending id (null ids last), then by the vector, and repeated
rows each count; distances and their sums stay at the largest long beyond it; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidetrace.llm.common import add_totals, drop_table, write_table
from tidetrace.llm.int_vectors import (SUMS, Sums, as_ints, as_long, capped_sum, compact, distances, exact, finite, matrix, means,
                                       pair_distances, scaled)

ENTRIES, PARTS, ROUNDS = 256, 4, 4
CODEBOOK_BYTES = 64 << 20  # codebooks held at once; vectors of further lengths follow in another run
ROWS_AT_ONCE = 4096

Books = dict[int, list[np.ndarray]]


def cuts(length: int, parts: int) -> list[tuple[int, int]]:
    at = [i * length // parts for i in range(parts + 1)]
    return list(zip(at[:-1], at[1:]))


@dataclass
class Balls:
    """Entries of one codebook with the squared distances between them, nearest first."""

    entries: np.ndarray
    order: np.ndarray
    gaps: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> Balls | None:
        if entries.dtype == object:
            return None
        between = distances(entries, entries)
        np.fill_diagonal(between, -1.0)  # the entry itself comes first
        order = np.argsort(between, axis=1, kind="stable")
        return cls(entries, order[:, 1:], np.take_along_axis(between, order, axis=1)[:, 1:])


def nearest(v: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exhaustive assignment: code (ties to the lower index) and squared distance."""
    code, best = np.zeros(len(v), np.int64), np.zeros(len(v), v.dtype if entries.dtype != object else object)
    for a in range(0, len(v), ROWS_AT_ONCE):
        d = distances(v[a:a + ROWS_AT_ONCE], entries)
        code[a:a + ROWS_AT_ONCE] = d.argmin(axis=1)
        best[a:a + ROWS_AT_ONCE] = d[np.arange(len(d)), code[a:a + ROWS_AT_ONCE]]
    return code, best


def reassign(v: np.ndarray, code: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray]:
    """The same result as `nearest`, starting from earlier codes and looking only where a ball allows it."""
    code = code.copy()
    best = pair_distances(v, balls.entries[code])
    if len(balls.entries) == 1:
        return code, best
    outside = np.flatnonzero(4.0 * best >= balls.gaps[code, 0])  # all but the stable cores
    outside = outside[np.argsort(code[outside], kind="stable")]
    owner = code[outside]
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(outside) else np.zeros(0, np.int64)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(outside)]):
        rows, own = outside[a:b], int(owner[a])
        reach = np.searchsorted(balls.gaps[own], 4.0 * best[rows], side="right")  # ring of each part
        near = balls.order[own, :int(reach.max())]  # the ball's neighbours
        d = distances(v[rows], balls.entries[near])
        d[np.arange(len(near))[None, :] >= reach[:, None]] = np.inf
        least = d.min(axis=1)
        # Of the nearest neighbours the one with the lowest index.
        index = np.where(d == least[:, None], near[None, :], len(balls.entries)).min(axis=1)
        moves = (least < best[rows]) | ((least == best[rows]) & (index < own))
        code[rows[moves]], best[rows[moves]] = index[moves], least[moves]
    return code, best


def _by_length(batch: pa.RecordBatch):
    """(length, row numbers, components) of the batch's vectors."""
    vectors = batch.column("vector")
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        x = matrix(vectors.take(pa.array(rows)))
        yield int(length), rows, x.reshape(len(rows), int(length))


def _assign(books: Books, parts: int):
    """Rows (id, label, vector, codes, error): codes are two bytes a part."""
    balls = {n: [Balls.of(b) for b in book] for n, book in books.items()}

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.zeros((batch.num_rows, parts), np.int64)
            error = np.zeros(batch.num_rows, object)
            earlier = np.frombuffer(b"".join(batch.column("codes").to_pylist()), "<u2").reshape(-1, parts) \
                if not batch.column("codes").null_count else None
            for length, rows, x in _by_length(batch):
                v, small = scaled(x)
                for p, (a, b) in enumerate(cuts(length, parts)):
                    book, ball = books[length][p], balls[length][p]
                    fast = small if ball is not None else np.zeros(len(rows), bool)
                    at = rows[fast]
                    if len(at):
                        mine = np.ascontiguousarray(v[fast, a:b])
                        code, d = nearest(mine, book) if earlier is None else reassign(
                            mine, earlier[at, p].astype(np.int64), ball)
                        codes[at, p] = code
                        error[at] += as_long(d).astype(object)
                    for i in np.flatnonzero(~fast).tolist():  # beyond exact doubles
                        code, d = nearest(exact(x[i:i + 1, a:b]), as_ints(book))
                        codes[rows[i], p] = code[0]
                        error[rows[i]] += int(d[0])
            packed = codes.astype("<u2").tobytes()
            wide = 2 * parts
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), batch.column("vector"),
                 pa.array([packed[i * wide:(i + 1) * wide] for i in range(batch.num_rows)], pa.binary()),
                 pa.array(as_long(error), pa.int64())],
                names=["id", "label", "vector", "codes", "error"])
    return run


def _sums(parts: int, k: int):
    def run(batches):
        sums = Sums()
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), "<u2").reshape(-1, parts)
            for length, rows, x in _by_length(batch):
                v, small = scaled(x)
                for p, (a, b) in enumerate(cuts(length, parts)):
                    code = codes[rows, p].astype(np.int64)
                    if small.any():
                        sums.add(length, p, v[small, a:b], code[small], k)
                    if not small.all():
                        sums.add(length, p, exact(x[~small, a:b]), code[~small], k)
        yield sums.batch()
    return run


def _first_books(rows: DataFrame, entries: int, parts: int) -> Books:
    order = Window.partitionBy("length").orderBy(F.asc_nulls_last("id"), "vector")
    first = (rows.select("id", "vector", F.size("vector").alias("length")).withColumn("nth", F.row_number().over(order))
             .filter(F.col("nth") <= entries).orderBy("length", "nth").collect())
    held: dict[int, list[np.ndarray]] = {}
    for r in first:
        held.setdefault(r.length, []).append(exact(np.array(r.vector, np.float64).reshape(1, -1)))
    return {n: [compact(np.concatenate(v)[:, a:b]) for a, b in cuts(n, parts)] for n, v in held.items()}


def book_hash(book: list[np.ndarray]) -> str:
    """sha256 of all components in decimal, by part, entry and position, joined by commas."""
    text = ",".join(str(int(c)) for part in book for c in part.ravel().tolist())
    return hashlib.sha256(text.encode()).hexdigest()


def _compress(spark: SparkSession, rows: DataFrame, entries: int, parts: int, rounds: int) -> DataFrame:
    """Rows (id, label, codes, error, length, codebooks_sha256) of vectors whose codebooks are held at once."""
    books = _first_books(rows, entries, parts)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
    schema = f"id {kinds['id']}, label {kinds['label']}, vector {kinds['vector']}, codes binary, error bigint"
    now, before = rows.withColumn("codes", F.lit(None).cast("binary")), None
    for turn in range(rounds + 1):
        held = spark.sparkContext.broadcast(books)
        path, now = write_table(now.select("id", "label", "vector", "codes").mapInArrow(
            lambda it, held=held: _assign(held.value, parts)(it), schema), f"codes-{uuid.uuid4().hex}")
        held.unpersist()
        if before:
            drop_table(spark, before)
        before = path
        if turn < rounds:
            new = means(now.select("vector", "codes").mapInArrow(_sums(parts, entries), SUMS))
            for (n, p), changed in new.items():
                book = as_ints(books[n][p])
                for e, centre in changed.items():
                    book[e] = centre
                books[n][p] = compact(book)
    hashes = F.create_map(*[x for n, b in books.items() for x in (F.lit(n), F.lit(book_hash(b)))]) if books else F.lit(None)
    length = F.size("vector")
    return now.select("id", "label", "codes", "error", length.alias("length"),
                      (hashes[length] if books else hashes).cast("string").alias("codebooks_sha256"))


def compress_vectors(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                     entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: key, label, code (two hex digits a part), length, error,
    label_error (error over rows of equal label) and codebooks_sha256 (of its length)."""
    if not (1 <= entries <= 256 and parts >= 1 and rounds >= 0):
        raise ValueError("entries must be 1 to 256, parts at least 1, rounds at least 0")
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")).filter(
        finite("vector"))
    lengths = sorted(r[0] for r in rows.select(F.size("vector")).distinct().collect())
    groups: list[list[int]] = [[]]
    for n in lengths:
        if groups[-1] and 8 * entries * (sum(groups[-1]) + n) > CODEBOOK_BYTES:
            groups.append([])
        groups[-1].append(n)
    done = [_compress(spark, rows.filter(F.size("vector").isin(g)), entries, parts, rounds) for g in groups]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    byte = "lower(substring(hex(codes), {at}, 2))"  # the low byte of each two
    code = F.concat(*[F.expr(byte.format(at=4 * p + 1)) for p in range(parts)])
    out = out.select("id", "label", code.alias("code"), "length", "error", "codebooks_sha256")
    totals = out.groupBy("label").agg(capped_sum("error").alias("label_error"))
    out = add_totals(out, totals, "label")
    return out.select(F.col("id").alias(key), F.col("label").alias(label), "code", "length", "error", "label_error",
                      "codebooks_sha256")
