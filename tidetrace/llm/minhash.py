"""Near-duplicate groups of texts by circulant MinHash, banding and exact Jaccard.

A text's set holds its distinct k-word shingles. One permutation (sigma) places a
shingle on a circle of 2**22 cells, a second one (pi) gives the cells values, and
coordinate i of the signature is the least value after shifting pi by i: two
permutations make all coordinates, and the values of one shingle for all
coordinates are one contiguous window of pi. 288 coordinates form 48 bands of 6.
A pair of Jaccard 0.8 misses every band with probability 5e-7, higher ones less.

Flow: texts with equal sets become one class. Classes that share a band are
candidates; a 256-bit sketch of coordinate parities discards pairs whose
estimated Jaccard is below 0.575 (six deviations under 0.8), and the exact set
sizes discard pairs that cannot reach the threshold. What is left is confirmed on
whole shingle sets. Groups are never expanded into a table of pairs: each class is
first compared with the nearest of its bands' smallest classes. Bands whose members
are then still in different components are cut into chunks of bounded size, and
chunks are compared two at a time inside a task, which skips members already
connected and returns only a spanning forest of the links found. Members of a
band's largest component are compared with the band's other members only.

Defined cases: null text, empty text and text without words have an empty set,
link with nothing and form their own group; with fewer than k words the whole word
sequence is the one shingle; equal sets always link; rows that repeat a key or
have a null key are grouped by their text, and a group's id is its smallest
non-null key; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidetrace.llm.common import binaries, bounded, join_hot, long_lists, slices, stage, text_buffer
from tidetrace.llm.components import connected_components
from tidetrace.llm.words import NON_SPACE, Words, gram_hash, mix, pair_hash, words

CELLS = 1 << 22
BANDS, ROWS = 48, 6
COORDINATES = BANDS * ROWS
SKETCH_BITS = 256
MAX_SKETCH_DISTANCE = 54
CHUNK_ROWS, CHUNK_SHINGLES = 2048, 2_000_000
_SIGMA_A, _SIGMA_B = 2_654_435_761, 1_013_904_223
_PI: list[np.ndarray] = []


def _pi_windows() -> np.ndarray:
    """Row c: the values of cell c under every shift (a view, not a copy)."""
    if not _PI:
        pi = np.random.default_rng(7).permutation(CELLS).astype(np.uint32)
        _PI.append(np.concatenate([pi, pi[:COORDINATES - 1]]))
    return np.lib.stride_tricks.sliding_window_view(_PI[0], COORDINATES)


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    grams = gram_hash(w.hash, k)
    out = []
    for a, b in zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(grams[a:b - k + 1]))
        elif b > a:
            h = w.hash[a:a + 1]
            for i in range(a + 1, b):
                h = pair_hash(h, w.hash[i:i + 1])
            out.append(mix(h ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_id(shingles: np.ndarray) -> bytes | None:
    """160 bits that equal sets share; None for the empty set."""
    if not len(shingles):
        return None
    with np.errstate(over="ignore"):
        two = np.array([mix(shingles).sum(dtype=np.uint64),
                        mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)])
    return two.tobytes() + len(shingles).to_bytes(4, "big")


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES least values of a non-empty set, in bounded memory."""
    place = ((mix(shingles) >> np.uint64(20)).astype(np.int64) * _SIGMA_A + _SIGMA_B) & (CELLS - 1)
    view = _pi_windows()
    sig = np.full(COORDINATES, CELLS, np.uint32)
    for i in range(0, len(place), 2048):
        np.minimum(sig, view[place[i:i + 2048]].min(axis=0), out=sig)
    return sig


def _band_keys(sigs: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band; the band's number is part of the key."""
    parts = sigs.reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    key = np.tile(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sigs), 1))
    for r in range(ROWS):
        key = pair_hash(key, parts[:, :, r])
    return key.astype(np.int64)


def _sketches(k: int):
    def run(batches):
        for batch in batches:
            data, offs = text_buffer(batch.column("text"))
            for i, j in slices(offs):
                lo, hi = offs[i], offs[j]
                sets = shingle_sets(words(data[lo:hi], offs[i:j + 1] - lo, NON_SPACE), k)
                sizes = np.array([len(s) for s in sets], np.int64)
                sigs = np.zeros((len(sets), COORDINATES), np.uint32)
                ids = [class_id(s) for s in sets]
                for n in np.flatnonzero(sizes):
                    sigs[n] = signature(sets[n])
                bits = np.packbits((sigs[:, :SKETCH_BITS] & 1).astype(np.uint8), axis=1).view(np.int64)
                keys = _band_keys(sigs)
                keys = keys[sizes > 0].ravel()
                ptr = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, j - i), pa.array(sizes), binaries(ids),
                     *[pa.array(np.ascontiguousarray(bits[:, c])) for c in range(4)], long_lists(keys, ptr)],
                    names=["id", "n_shingles", "cls", "s0", "s1", "s2", "s3", "bands"])
    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            data, offs = text_buffer(batch.column("text"))
            for i, j in slices(offs):
                lo, hi = offs[i], offs[j]
                sets = shingle_sets(words(data[lo:hi], offs[i:j + 1] - lo, NON_SPACE), k)
                wanted = batch.column("cls").slice(i, j - i).to_pylist()
                sets = [s for s, c in zip(sets, wanted) if class_id(s) == c]
                if sets:
                    ptr = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                    yield pa.RecordBatch.from_arrays(
                        [binaries([class_id(s) for s in sets]), long_lists(np.concatenate(sets), ptr)],
                        names=["cls", "shingles"])
    return run


def _apart() -> Column:
    """Differing sketch bits of a candidate pair (a_*, b_*)."""
    return sum((F.bit_count(F.col(f"a_s{c}").bitwiseXOR(F.col(f"b_s{c}"))) for c in range(4)), F.lit(0))


def _may_link(percent: int) -> Column:
    """Conditions on a candidate pair that no pair over the threshold fails, but for the
    sketch's stated error."""
    return ((F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent)
            & (_apart() <= MAX_SKETCH_DISTANCE))


def _compare(percent: int):
    """Links between components among the rows of two chunks of a band: (root, root)."""
    def run(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        chunk = t.column("chunk").to_numpy()
        names, root = np.unique(np.array(t.column("root").to_pylist(), object), return_inverse=True)
        n = t.column("n").to_numpy()
        bits = np.stack([t.column(f"s{c}").to_numpy() for c in range(4)], axis=1).view(np.uint64)
        lists = t.column("shingles").combine_chunks()
        ptr = lists.offsets.to_numpy().astype(np.int64)
        values, place = np.unique(lists.values.to_numpy()[ptr[0]:ptr[-1]], return_inverse=True)
        ptr = ptr - ptr[0]
        group = np.arange(len(names))  # components merged so far
        found: list[tuple[int, int]] = []
        mark = np.zeros(len(values), bool)
        for a in np.flatnonzero(chunk == i).tolist():
            may = (chunk == j) & (group[root] != group[root[a]])
            if i == j:
                may[:a + 1] = False
            may &= np.minimum(n, n[a]) * 100 >= np.maximum(n, n[a]) * percent
            b = np.flatnonzero(may)
            b = b[np.bitwise_count(bits[b] ^ bits[a]).sum(axis=1) <= MAX_SKETCH_DISTANCE]
            if not len(b):
                continue
            mine = place[ptr[a]:ptr[a + 1]]
            mark[mine] = True
            held = np.concatenate([place[x:y] for x, y in zip(ptr[b].tolist(), ptr[b + 1].tolist())])
            both = np.add.reduceat(mark[held], np.concatenate([[0], n[b].cumsum()[:-1]]), dtype=np.int64)
            mark[mine] = False
            for r in np.unique(root[b[both * 100 >= (n[a] + n[b] - both) * percent]]).tolist():
                if group[r] != group[root[a]]:
                    group[group == group[r]] = group[root[a]]
                    found.append((names[root[a]], names[r]))
        return pa.table({"a": binaries([x for x, _ in found]), "b": binaries([y for _, y in found])})
    return run


def _side(classes: DataFrame, p: str) -> DataFrame:
    return classes.select(F.col("sid").alias(f"{p}_sid"), F.col("cls").alias(p), F.col("n").alias(f"{p}_n"),
                          *[F.col(f"s{c}").alias(f"{p}_s{c}") for c in range(4)])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    a = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("a_set"))
    b = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("b_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    either = F.size("a_set") + F.size("b_set") - both
    return pairs.join(b, "b").join(a, "a").filter(both * 100 >= either * percent).select("a", "b")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 5,
                    percent: int = 80) -> DataFrame:
    """One row per input row: key, n_shingles, component_id (smallest key of its
    group), kept (key = component_id). Links need 100 * intersection >= percent * union."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    sketches = stage(bounded(rows).mapInArrow(
        _sketches(k), f"id {rows.schema['id'].dataType.simpleString()}, n_shingles bigint, cls binary, "
                      "s0 bigint, s1 bigint, s2 bigint, s3 bigint, bands array<bigint>"))

    # One member stands for all texts with the same set.
    classes = (sketches.filter("cls is not null").groupBy("cls")
               .agg(F.first("n_shingles").alias("n"), *[F.first(f"s{c}").alias(f"s{c}") for c in range(4)],
                    F.first("bands").alias("bands"), F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies")))
    classes = stage(classes)
    # Bands are searched under eight-byte names; two classes of one name only add candidates.
    named = classes.withColumn("sid", F.xxhash64("cls"))
    cells = named.select("sid", F.explode("bands").alias("band"))
    shared = (cells.groupBy("band").agg(F.min("sid").alias("head"), F.count(F.lit(1)).alias("members"))
              .filter("members > 1").drop("members"))
    members = stage(cells.join(shared, "band"))
    near = stage(members.select("sid").distinct().join(named.drop("bands", "least_id", "copies"), "sid"))
    texts = (sketches.select("id", "cls").join(near.select("cls"), "cls", "left_semi")
             .groupBy("cls").agg(F.min("id").alias("id")))
    # A repeated key may bring other texts along; _sets keeps those of the wanted class.
    theirs = rows.join(texts.withColumnRenamed("id", "wid"), F.col("id").eqNullSafe(F.col("wid"))).select("cls", "text")
    sets = stage(theirs.mapInArrow(_sets(k), "cls binary, shingles array<bigint>"))

    def pairs_with_heads(found: DataFrame) -> DataFrame:
        return (found.join(_side(near, "a"), "a").join(_side(near, "b"), "b").filter(_may_link(percent))
                .select("a", "b"))

    # Every class against the nearest of its band heads.
    heads = members.filter("sid <> head").select(F.col("head").alias("a_sid"), F.col("sid").alias("b_sid")).distinct()
    nearest = (heads.join(_side(near, "a"), "a_sid").join(_side(near, "b"), "b_sid").filter(_may_link(percent))
               .groupBy("b").agg(F.min(F.struct(_apart().alias("bits"), "a")).alias("best")).select("b", "best.a"))
    links = stage(_confirm(nearest, sets, percent))
    roots = connected_components(links)

    # Then all members of the bands that still hold several components. A band's largest
    # component (its core) is connected already: only the others' chunks, numbered first,
    # meet each other and the core's chunks.
    placed = members.select("band", "sid").join(near.select("sid", "cls", "n"), "sid").join(
        roots.withColumnRenamed("node", "cls"), "cls", "left").select(
        "band", "cls", "n", F.coalesce("root", "cls").alias("root"))
    parts = placed.groupBy("band", "root").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.bit_xor(F.xxhash64("cls")).alias("mix"),
        F.sum(F.pmod(F.xxhash64("cls", F.lit(7)), F.lit(1 << 31))).alias("total"))

    def chunks(rows: Column, shingles: Column) -> Column:
        return F.ceil(F.greatest(rows / CHUNK_ROWS, shingles / CHUNK_SHINGLES))

    split = (parts.groupBy("band")
             .agg(F.max(F.struct("rows", "root", "n")).alias("core"), F.count(F.lit(1)).alias("components"),
                  F.sum("rows").alias("size"), F.sum("n").alias("n"), F.bit_xor("mix").alias("mix"),
                  F.sum("total").alias("total"))
             .filter("components > 1")
             # Bands with the same members need one comparison.
             .groupBy("size", "mix", "total")
             .agg(F.min(F.struct("band", F.col("core.root").alias("core"),
                                 chunks(F.col("size") - F.col("core.rows"), F.col("n") - F.col("core.n")).alias("others"),
                                 chunks(F.col("core.rows"), F.col("core.n")).alias("cores"))).alias("s"))
             .select("s.*"))
    hashed = F.xxhash64("cls")
    chunk = F.when(F.col("root") == F.col("core"), F.col("others") + F.pmod(hashed, F.col("cores"))).otherwise(
        F.pmod(hashed, F.col("others")))
    meets = F.expr("transform(sequence(0L, if(chunk < others, others + cores, others) - 1),"
                   " t -> named_struct('i', least(t, chunk), 'j', greatest(t, chunk)))")
    groups = (placed.drop("n").join(split, "band").withColumn("chunk", chunk)
              .select("band", "cls", "root", "chunk", F.explode(meets).alias("m"))
              .select("band", "cls", "root", "chunk", "m.i", "m.j")
              .join(near.drop("sid"), "cls").join(sets, "cls"))
    more = stage(groups.groupBy("band", "i", "j").applyInArrow(_compare(percent), "a binary, b binary"))
    # The links found there join components of the first run.
    joined = connected_components(more).select(F.col("node").alias("root"), F.col("root").alias("further"))

    grouped = stage(classes.select("cls", "least_id", "copies")
                    .join(roots.withColumnRenamed("node", "cls"), "cls", "left")
                    .withColumn("root", F.coalesce("root", "cls"))
                    .join(joined, "root", "left")
                    .select("cls", "least_id", "copies", F.coalesce("further", "root").alias("root")))
    least = stage(grouped.groupBy("root").agg(F.min("least_id").alias("component"), F.count(F.lit(1)).alias("members")))
    of_class = stage(join_hot(grouped, least, "root", "members").select("cls", "component", "copies"))
    of_text = join_hot(sketches.filter("cls is not null").select("id", "n_shingles", "cls"), of_class, "cls", "copies")
    out = of_text.select("id", "n_shingles", "component").unionByName(
        sketches.filter("cls is null").select("id", "n_shingles", F.col("id").alias("component")))
    return out.select(F.col("id").alias(key), "n_shingles", F.col("component").alias("component_id"),
                      F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
