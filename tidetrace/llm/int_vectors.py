"""Exact integer vectors for the quantising operators: floor(1024 * x), distances, sums.

A component is an integer held in a double. While every partial result stays below
2**53 the arithmetic of doubles (and BLAS) is exact; rows or centres beyond that
bound (`fits`) take the same steps in Python integers, which are slow and exact.
Sums leave a task as limbs of 40 bits, so that they are exact for any number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1024
LIMB = 40
LARGEST = (1 << 63) - 1
SUMS = "length int, part int, entry int, limb int, pos int, value bigint"


def finite(vector: str) -> Column:
    """True for a vector that is not null and holds neither null nor non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~bad, F.lit(False))


def matrix(col: pa.Array) -> np.ndarray:
    """The components of equally long vectors as doubles, one row per vector."""
    values = pc.list_flatten(col).to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(col), -1) if len(col) else values.reshape(0, 0)


def fits(dims: int) -> float:
    """Components up to this size have exact distances in doubles."""
    return float(np.sqrt(2.0 ** 50 / max(dims, 1)))


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """floor(SCALE * x) as doubles, and which rows hold it within `fits`."""
    with np.errstate(over="ignore"):
        v = np.floor(x * SCALE)
    return v, (np.abs(v) <= fits(x.shape[1])).all(axis=1)


def exact(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as Python integers, for components of any size."""
    whole = [int(c) * SCALE if abs(c) >= 2.0 ** 53 else int(np.floor(c * SCALE)) for c in x.ravel().tolist()]
    out = np.empty(x.size, object)
    out[:] = whole
    return out.reshape(x.shape)


def as_ints(a: np.ndarray) -> np.ndarray:
    """The same values as Python integers."""
    return a if a.dtype == object else a.astype(np.int64).astype(object)


def distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres; both doubles within `fits`, or Python integers."""
    if v.dtype == object or centres.dtype == object:
        gap = as_ints(v)[:, None, :] - as_ints(centres)[None, :, :]
        return (gap * gap).sum(axis=2) if v.shape[1] else np.zeros((len(v), len(centres)), object)
    return (v * v).sum(axis=1)[:, None] - 2.0 * (v @ centres.T) + (centres * centres).sum(axis=1)


def pair_distances(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Squared distance of each row of v to the same row of w."""
    gap = v - w
    return np.einsum("ij,ij->i", gap, gap)


def compact(centres: np.ndarray) -> np.ndarray:
    """Centres as doubles if they are within `fits`, else as they are (Python integers)."""
    limit = fits(centres.shape[1])
    small = all(abs(c) <= limit for c in centres.ravel().tolist())
    return centres.astype(np.float64) if small else as_ints(centres)


def as_long(d: np.ndarray) -> np.ndarray:
    """Distances as longs; beyond the largest long they stay at it."""
    if d.dtype == object:
        return np.array([min(int(x), LARGEST) for x in d], np.int64)
    return d.astype(np.int64)


class Sums:
    """Counts and component sums by (length, part, entry) inside one task."""

    def __init__(self):
        self.held: dict[tuple[int, int], list] = {}

    def add(self, length: int, part: int, v: np.ndarray, code: np.ndarray, k: int) -> None:
        count = np.bincount(code, minlength=k)
        used = np.flatnonzero(count)
        total = np.zeros((k, v.shape[1]), object)
        if v.dtype == object:
            for row, e in zip(v, code.tolist()):
                total[e] += row
        else:
            order = np.argsort(code, kind="stable")
            starts = np.concatenate([[0], np.cumsum(count[used])[:-1]])
            if v.shape[1] and len(used):
                total[used] = np.add.reduceat(v[order].astype(np.int64), starts, axis=0).astype(object)
        held = self.held.get((length, part))
        if held is None:
            self.held[length, part] = [count, total]
        else:
            held[0], held[1] = held[0] + count, held[1] + total

    def batch(self) -> pa.RecordBatch:
        """Rows of SUMS; position -1 holds the count."""
        out: list[tuple[int, int, int, int, int, int]] = []
        for (length, part), (count, total) in self.held.items():
            for e in np.flatnonzero(count).tolist():
                out.append((length, part, e, 0, -1, int(count[e])))
                for pos, x in enumerate(total[e].tolist()):
                    limb = 0
                    while not -(1 << LIMB) < x < 1 << LIMB:
                        out.append((length, part, e, limb, pos, x & ((1 << LIMB) - 1)))
                        x >>= LIMB
                        limb += 1
                    out.append((length, part, e, limb, pos, x))
        cols = list(zip(*out)) if out else [[]] * 6
        kinds = [pa.int32()] * 5 + [pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)],
                                          names=["length", "part", "entry", "limb", "pos", "value"])


def means(sums: DataFrame) -> dict[tuple[int, int], dict[int, list[int]]]:
    """By (length, part): the exact floor(sum / count) of every entry with members.

    The rows collected are as many as the codebooks have components, whatever the input's size.
    """
    total: dict[tuple[int, int, int, int], int] = {}
    rows = sums.groupBy("length", "part", "entry", "limb", "pos").agg(F.sum("value").alias("value")).collect()
    for r in rows:
        at = (r.length, r.part, r.entry, r.pos)
        total[at] = total.get(at, 0) + (r.value << (LIMB * r.limb))
    out: dict[tuple[int, int], dict[int, list[int]]] = {}
    for length, part, entry, pos in sorted(total):
        if pos < 0:
            out.setdefault((length, part), {})[entry] = []
        else:
            out[length, part][entry].append(total[length, part, entry, pos] // total[length, part, entry, -1])
    return out


def capped_sum(value: str) -> Column:
    """Sum of longs that stays at the largest long instead of overflowing."""
    wide = F.sum(F.col(value).cast("decimal(38,0)"))
    return F.least(wide, F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
