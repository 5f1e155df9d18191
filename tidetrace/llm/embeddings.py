"""Pairs of similar vectors by a subspace pigeonhole join, and their components.

Unit vectors with cosine >= c lie within squared distance 2 - 2c. The vectors are
rotated to their principal axes, dealt to low-dimensional blocks, and the squared
distance is split over the blocks in proportion to their variance: a close pair
keeps within the share of one block at least. Each block is a range join: along
the block's leading axis the line is cut into cells as wide as the share's root, so
partners lie in a vector's own cell or the next one; in a cell the rows are swept
along that axis, compared by the distance in the block, and the candidates of the
union are verified by their cosine in double precision. A candidate counts in the
first block whose share holds it, so no pair is counted twice and no pair table is
built: a group returns each vector's number of links and a spanning forest of its
links. Cells with many rows are cut into chunks that are joined chunk by chunk.

Equal vectors become one class first; a copy costs no comparisons.

Vectors are compared with those of equal length, each length with its own axes and
blocks. The axes are fitted on a bounded sample of ``sample`` vectors, dealt evenly to
the lengths; they decide the cost only, never the result.

Defined cases: null, empty or zero vectors and vectors with null or non-finite components
link with nothing and form their own group; vectors of different lengths are not linked;
components of any finite size are scaled by powers of two first, so none overflows;
repeated rows are copies; a null key never becomes a group's id unless the group has no
other, and is not kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidetrace.llm.common import binaries, join_hot, stage, text_buffer
from tidetrace.llm.components import connected_components

BLOCKS = 4
CHUNK = 16_384
TILE = 512
SLACK = 1e-4
SAMPLE = 20_000


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that its largest component lies in 0.5 to 1: cosines
    keep their bits, and squares of very large or small components neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class Axes:
    """Rotation to principal axes, the blocks' axes, and the blocks' squared shares."""

    def __init__(self, sample: np.ndarray, min_cosine: float, blocks: int = BLOCKS):
        dim = sample.shape[1]
        if len(sample) > 1:
            variance, axes = np.linalg.eigh(np.cov(sample.T).reshape(dim, dim))
            self.rotation, variance = axes[:, ::-1], np.maximum(variance[::-1], 1e-12)
        else:
            self.rotation, variance = np.eye(dim), np.ones(dim)
        self.blocks = [np.arange(b, dim, min(blocks, dim)) for b in range(min(blocks, dim))]
        weight = np.array([variance[b].sum() for b in self.blocks])
        self.share = (2 - 2 * min_cosine + SLACK) * weight / weight.sum()
        self.width = np.sqrt(self.share) + SLACK
        self.min_cosine = min_cosine

    def cells(self, u: np.ndarray) -> np.ndarray:
        """Cell of each row along each block's leading axis."""
        leading = u @ self.rotation[:, [b[0] for b in self.blocks]]
        return np.floor(leading / self.width).astype(np.int64)

    def within(self, a: np.ndarray, b: np.ndarray, block: int) -> np.ndarray:
        """Whether row pairs keep within the share of a block; the same for (a, b) and (b, a)."""
        d = a[:, self.blocks[block]] - b[:, self.blocks[block]]
        return (d * d).sum(axis=1) <= self.share[block]

    def links(self, x: np.ndarray, home: np.ndarray, other: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Linked row pairs (i, j) of x that this block counts: i from ``home``, j from
        ``other``, or from ``home`` after i where the two are the same rows."""
        same = other is home
        u = unit(x)
        r = u @ self.rotation
        axis, dims = self.blocks[block][0], self.blocks[block]
        home = home[np.argsort(r[home, axis], kind="stable")]
        other = home if same else other[np.argsort(r[other, axis], kind="stable")]
        line = r[other, axis]
        a, b = r[np.ix_(home, dims)].astype(np.float32), r[np.ix_(other, dims)].astype(np.float32)
        # One product tells whether 2ab - aa - bb >= -(share + slack).
        one = np.ones((len(a), 1), np.float32)
        a = np.hstack([2 * a, one, -(a * a).sum(axis=1, keepdims=True) + np.float32(self.share[block] + SLACK)])
        b = np.hstack([b, -(b * b).sum(axis=1, keepdims=True), np.ones((len(b), 1), np.float32)]).T.copy()
        found = [np.zeros((0, 2), np.int64)]
        for s in range(0, len(home), TILE):
            e = min(s + TILE, len(home))
            lo = s if same else int(np.searchsorted(line, r[home[s], axis] - self.width[block]))
            hi = int(np.searchsorted(line, r[home[e - 1], axis] + self.width[block], side="right"))
            if hi <= lo:
                continue
            p, q = np.nonzero(a[s:e] @ b[:, lo:hi] >= 0)
            if same:
                later = q + lo > p + s
                p, q = p[later], q[later]
            for k in range(0, len(p), 1 << 16):
                i, j = home[s + p[k:k + (1 << 16)]], other[lo + q[k:k + (1 << 16)]]
                ok = (x[i] * x[j]).sum(axis=1) >= self.min_cosine * np.sqrt(
                    (x[i] * x[i]).sum(axis=1) * (x[j] * x[j]).sum(axis=1))
                i, j = i[ok], j[ok]
                ok = self.within(r[i], r[j], block)
                for earlier in range(block):
                    ok &= ~self.within(r[i], r[j], earlier)
                found.append(np.stack([i[ok], j[ok]], axis=1))
        pairs = np.concatenate(found)
        return pairs[:, 0], pairs[:, 1]


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least row reachable from each of n rows over the links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _place(axes, dtype: str):
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                yield of_length(batch.filter(pa.array(dims == dim)), axes.value[dim])

    def of_length(batch, ax):
        n_blocks = len(ax.blocks)
        data, offs = text_buffer(batch.column("vec"))
        x = scaled(np.frombuffer(data.tobytes(), dtype).astype(float).reshape(len(offs) - 1, -1))
        cells = ax.cells(unit(x))
        # Each row is at home in its own cell of every block and visits the next cell.
        row = np.repeat(np.arange(len(x)), 2 * n_blocks)
        block = np.tile(np.repeat(np.arange(n_blocks), 2), len(x))
        visits = np.tile([0, 1], n_blocks * len(x))
        names = ["cls", "copies", "draw", "dim"]
        cols = [batch.column(c).take(pa.array(row)) for c in names]
        return pa.RecordBatch.from_arrays(
            [*cols, pa.array(block), pa.array(cells.ravel()[np.arange(len(row)) // 2] + visits), pa.array(visits == 0)],
            names=[*names, "block", "cell", "home"])
    return run


def _join_group(axes, dtype: str):
    def run(t: pa.Table) -> pa.Table:
        dim, block, i, j = (t.column(c)[0].as_py() for c in ("dim", "block", "i", "j"))
        ax = axes.value[dim]
        data, _ = text_buffer(t.column("vec"))
        x = scaled(np.frombuffer(data.tobytes(), dtype).astype(float).reshape(t.num_rows, -1))
        chunk = t.column("chunk").to_numpy()
        copies = t.column("copies").to_numpy()
        home = np.flatnonzero(chunk == i)
        pairs = [ax.links(x, home, home if j == i else np.flatnonzero(chunk == j), block)]
        if t.column("also").to_numpy().any():  # the cell's only visitors come along with its only home chunk
            pairs.append(ax.links(x, home, np.flatnonzero(chunk == i + 1), block))
        a, b = (np.concatenate(z) for z in zip(*pairs))
        n_links = np.bincount(a, copies[b], t.num_rows) + np.bincount(b, copies[a], t.num_rows)
        root = local_roots(t.num_rows, a, b)
        linked = np.flatnonzero(n_links > 0)
        cls = t.column("cls").combine_chunks()
        return pa.table({"cls": cls.take(pa.array(linked)), "links": pa.array(n_links[linked].astype(np.int64)),
                         "root": cls.take(pa.array(root[linked]))})
    return run


def fit_axes(classes: DataFrame, dtype: str, min_cosine: float, blocks: int, sample: int) -> dict[int, Axes]:
    """Axes of each vector length, from about ``sample`` vectors of all lengths together."""
    lengths = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    quota = max(1, sample // max(1, len(lengths)))
    share = classes.sparkSession.createDataFrame([(d, min(1.0, quota / n)) for d, n in lengths.items()], "dim int, share double")
    draw = F.pmod(F.xxhash64(F.hex("cls"), F.lit(42)), F.lit(1 << 30))
    drawn = classes.join(F.broadcast(share), "dim").filter(draw < F.col("share") * (1 << 30)).select("dim", "vec").toArrow()
    dims, out = drawn.column("dim").to_numpy(), {}
    for dim in lengths:
        data, _ = text_buffer(drawn.column("vec").filter(pa.array(dims == dim)))
        out[dim] = Axes(unit(scaled(np.frombuffer(data.tobytes(), dtype).astype(float).reshape(-1, dim))), min_cosine, blocks)
    return out


def similar_vectors(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", min_cosine: float = 0.9,
                    blocks: int = BLOCKS, chunk: int = CHUNK, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: key, n_links (other rows with cosine >= min_cosine),
    component_id (smallest key reachable by links), kept (key = component_id)."""
    if not 0 < min_cosine <= 1:
        raise ValueError("min_cosine must be over 0 and at most 1")
    spark = vectors.sparkSession
    element = vectors.schema[vector].dataType.elementType.simpleString()
    dtype = "<f4" if element == "float" else "<f8"
    v = F.col("v")
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    proper = F.coalesce(finite & F.exists(v, lambda e: e != 0), F.lit(False))
    blob = F.when(proper, v)
    keyed = stage(rows.select("id", blob.alias("v")).mapInArrow(
        _blobs(dtype), f"id {rows.schema['id'].dataType.simpleString()}, vec binary"))
    keyed = keyed.withColumn("cls", F.when(F.col("vec").isNotNull(), F.unhex(F.md5("vec"))))
    classes = stage(keyed.filter("cls is not null").groupBy("cls")
                    .agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
                    .withColumn("dim", (F.length("vec") / np.dtype(dtype).itemsize).cast("int")))
    axes = spark.sparkContext.broadcast(fit_axes(classes, dtype, min_cosine, blocks, sample))

    placed = classes.select("cls", "copies", "vec", "dim", F.abs(F.xxhash64("cls")).alias("draw")).mapInArrow(
        _place(axes, dtype), "cls binary, copies bigint, draw bigint, dim int, block bigint, cell bigint, home boolean")
    placed = stage(placed)
    # Chunks 0 .. h-1 of a cell hold its own rows, h .. h+g-1 its visitors.
    sizes = (placed.groupBy("dim", "block", "cell").agg(
        F.ceil(F.sum(F.col("home").cast("long")) / chunk).alias("h"),
        F.ceil(F.sum((~F.col("home")).cast("long")) / chunk).alias("g")).filter("h > 0"))
    member = placed.join(sizes, ["dim", "block", "cell"])
    number = F.when(F.col("home"), F.pmod("draw", "h")).otherwise(F.col("h") + F.pmod("draw", "g"))
    # A home chunk i meets the chunks from i on; a single home chunk takes single visitors along.
    alone = (F.col("h") == 1) & (F.col("g") <= 1)
    member = member.withColumn("chunk", number).withColumn("also", alone & ~F.col("home"))
    of_home = F.expr("transform(sequence(0L, h + g - 1), t -> named_struct('i', least(t, chunk), 'j', greatest(t, chunk)))")
    of_visitor = F.expr("transform(sequence(0L, h - 1), t -> named_struct('i', t, 'j', chunk))")
    only = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))
    meets = F.when(alone, only).when(F.col("home"), of_home).otherwise(of_visitor)
    groups = (member.select("cls", "copies", "dim", "block", "cell", "chunk", "also", F.explode(meets).alias("m"))
              .select("cls", "copies", "dim", "block", "cell", "chunk", "also", "m.i", "m.j")
              .join(classes.select("cls", "vec"), "cls"))
    found = stage(groups.groupBy("dim", "block", "cell", "i", "j")
                  .applyInArrow(_join_group(axes, dtype), "cls binary, links bigint, root binary"))

    roots = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    n_links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    grouped = stage(classes.drop("vec").join(n_links, "cls", "left")
                    .join(roots.withColumnRenamed("node", "cls"), "cls", "left")
                    .select("cls", "least_id", "copies", F.coalesce("root", "cls").alias("root"),
                            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least = stage(grouped.groupBy("root").agg(F.min("least_id").alias("component"), F.count(F.lit(1)).alias("members")))
    of_class = stage(join_hot(grouped, least, "root", "members").select("cls", "component", "copies", "n_links"))
    of_vector = join_hot(keyed.filter("cls is not null").select("id", "cls"), of_class, "cls", "copies")
    alone = keyed.filter("cls is null").select("id", F.col("id").alias("component"), F.lit(0).cast("long").alias("n_links"))
    out = of_vector.select("id", "component", "n_links").unionByName(alone)
    return out.select(F.col("id").alias(key), "n_links", F.col("component").alias("component_id"),
                      F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def _blobs(dtype: str):
    def run(batches):
        for batch in batches:
            col = batch.column("v")
            flat = np.ascontiguousarray(col.flatten().to_numpy(zero_copy_only=False).astype(dtype)).tobytes()
            width = np.dtype(dtype).itemsize
            ends, out = 0, []
            for n in np.nan_to_num(pc.list_value_length(col).to_numpy(zero_copy_only=False), nan=-1).astype(int):
                out.append(None if n < 0 else flat[ends * width:(ends + n) * width])
                ends += max(n, 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), binaries(out)], names=["id", "vec"])
    return run
