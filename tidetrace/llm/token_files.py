"""Token-id files coded with a canonical length-limited Huffman code.

Whole texts are encoded with a tokenizer file, an end id closes every document, and
all ids are written in ascending key order. The code is built from the counts of
all ids (package-merge; at most 16 bits, more where so many ids are used that these
would not do) and stored as one row for each used id.
The files hold independent blocks of whole documents, about ``block_ids`` ids each
(a longer document is a block of its own). A block has its bit string, the bit
offset of every ``every``-th id, and its documents' keys and lengths, so it is
decoded alone, all stretches between offsets in step, with one table look-up for
each id.

A directory holds ``blocks`` (files in order, rows in order) and ``code``. Both are
written and read by Spark, so any store that Spark reaches will do.

Defined cases: null and empty texts are the end id alone; a null key sorts first;
rows that repeat a key are all written, ordered by a hash of the text; an empty table makes an
empty directory that reads back as no rows; other columns are not read.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidetrace.llm.common import binaries, bounded, single_threaded, slices, stage, text_buffer
from tidetrace.llm.words import byte_class, hash_spans, mix

MIN_LIMIT, LARGEST_LIMIT = 16, 24  # bits of the longest code
SPARE = 4  # bytes after a bit string, which a look-up may read
BLOCK_IDS = 1 << 18
EVERY = 256
CACHED_PIECES = 2_000_000  # about 40 bytes each
RECENT_PIECES = 150_000
# Classes of bytes for the byte-level split: letter, digit, punctuation, apostrophe, space,
# other white space; 0 is a byte whose class is not known from itself.
_CLASS = np.zeros(256, np.uint8)
for _n, _ranges in enumerate(([(0x41, 0x5A), (0x61, 0x7A)], [(0x30, 0x39)],
                              [(0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)],
                              [(0x27, 0x27)], [(0x20, 0x20)], [(0x09, 0x0D)]), start=1):
    _CLASS[byte_class(_ranges)] = _n
# Between which classes the split always has a border (rows: before, columns: after).
_BORDER = np.zeros((7, 7), bool)
for _before, _after in ((1, (2, 3, 4, 5, 6)), (2, (1, 3, 4, 5, 6)), (3, (1, 2, 5, 6)), (4, (2, 5, 6)), (6, (1, 2, 3, 4))):
    _BORDER[_before, list(_after)] = True
# A space before one of these bytes begins a piece: the next character is surely no white
# space (lead bytes C2, E1, E2, E3 may begin one).
_AFTER_SPACE = byte_class([(0x21, 0x7E), (0xC3, 0xDF), (0xE0, 0xE0), (0xE4, 0xF4)])
_WEIGHTS = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each range, one range after the other."""
    after = size.cumsum()
    return np.repeat(begin - (after - size), size) + np.arange(after[-1] if len(after) else 0)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """np.unique with one place of each value, not always the first, so that any sort will do."""
    order = np.argsort(values)
    some = values[order]
    new = np.append(True, some[1:] != some[:-1])
    inverse = np.empty(len(values), np.int64)
    inverse[order] = new.cumsum() - 1
    return some[new], order[new], inverse


class Pieces:
    """Ids of pieces, found by the piece's hash and length: sorted hashes beside one pool of ids."""

    def __init__(self, keys=(), width=(), size=(), begin=(), pool=()):
        self.keys, self.width = np.asarray(keys, np.uint64), np.asarray(width, np.int32)
        self.size, self.begin, self.pool = np.asarray(size, np.int32), np.asarray(begin, np.int64), np.asarray(pool, np.uint32)

    def find(self, keys: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are here, and where."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        here = (self.keys[at] == keys) & (self.width[at] == width)
        return here, at[here]

    def with_(self, other: "Pieces") -> "Pieces":
        keys = np.concatenate([self.keys, other.keys])
        order = np.argsort(keys, kind="stable")
        width, size = (np.concatenate(x)[order] for x in ((self.width, other.width), (self.size, other.size)))
        begin = np.concatenate([self.begin, other.begin + len(self.pool)])[order]
        return Pieces(keys[order], width, size, begin, np.concatenate([self.pool, other.pool]))


class TextEncoder:
    """Ids of texts, by the tokenizers library.

    For a byte-level BPE file without a normaliser a text is cut where the library's own
    split always has a border, and each distinct piece is encoded once; other files
    encode each whole text.
    """

    def __init__(self, path: str):
        single_threaded()
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        split = spec.get("pre_tokenizer") or {}
        special = spec.get("added_tokens") or []
        self.by_piece = (spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
                         and not spec.get("normalizer") and split.get("type") == "ByteLevel"
                         and not split.get("add_prefix_space") and split.get("use_regex", True)
                         and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip")
                                     or t.get("single_word") for t in special))
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {**{b: chr(b) for b in shown}, **{b: chr(256 + n) for n, b in enumerate(hidden)}}
        self.special = [t["content"].encode() for t in special]
        self.known, self.recent = Pieces(), Pieces()

    def _pieces(self, pieces) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has."""
        model, space = self.tokenizer.model.tokenize, self.alphabet[0x20]
        ids, size = [], []
        for raw in pieces:
            body = raw[1:] if raw[0] == 0x20 else raw
            if body.isalpha():  # ASCII letters: one word of the split
                word = body.decode() if body is raw else space + body.decode()
            elif (text := body.decode()).isalpha() and max(text) < "\u0250":
                word = raw.decode("latin-1").translate(self.alphabet)
            else:
                got = self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids
                ids += got
                size.append(len(got))
                continue
            got = [t.id for t in model(word)]
            ids += got
            size.append(len(got))
        return np.array(ids, np.uint32), np.array(size, np.int64)

    def _look_up(self, keys: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces with these sorted hashes: how many each has, where they begin, and all of them."""
        width = end - start
        size, begin = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        pools, held, new = [], 0, np.ones(len(keys), bool)
        for some in (self.known, self.recent):
            here, at = some.find(keys, width)
            size[here] = some.size[at]
            pools.append(some.pool[_ranges(some.begin[at], some.size[at].astype(np.int64))])
            begin[here] = held + size[here].cumsum() - size[here]
            held += len(pools[-1])
            new &= ~here
        ids, n = self._pieces(map(raw.__getitem__, map(slice, start[new].tolist(), end[new].tolist())))
        at = n.cumsum() - n
        size[new], begin[new] = n, held + at
        self.recent = self.recent.with_(Pieces(keys[new], width[new], n, at, ids))
        if len(self.recent.keys) > RECENT_PIECES:
            self.known = self.known.with_(self.recent) if len(self.known.keys) < CACHED_PIECES else self.recent
            self.recent = Pieces()
        return size, begin, np.concatenate([*pools, ids])

    def _special(self, raw: bytes, offs: np.ndarray) -> list[tuple[int, int]]:
        """Places of added tokens that lie inside one text."""
        found = []
        for token in self.special:
            x = raw.find(token)
            while x >= 0:
                y = x + len(token)
                if np.searchsorted(offs, x, side="right") == np.searchsorted(offs, y - 1, side="right"):
                    found.append((x, y))
                x = raw.find(token, y)
        return found

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the first id of each text."""
        if not self.by_piece:
            raw = data.tobytes()
            ids = [self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids
                   for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            ptr = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
            return np.array([y for x in ids for y in x], np.uint32), ptr
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        kind = _CLASS[data]
        lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
        kind[lead] = kind[lead + 1] = 1  # U+00C0 to U+00FF are letters but for the two signs
        cut = np.zeros(len(data), bool)
        cut[1:] = _BORDER.ravel()[kind[:-1] * 7 + kind[1:]]
        before_word = (data[:-1] == 0x20) & _AFTER_SPACE[data[1:]]
        full = np.diff(offs) > 0
        before_word[offs[(offs > 0) & (offs < len(data))] - 1] = False
        raw = data.tobytes()
        inner = self._special(raw, offs)
        for x, y in inner:  # an added token is a piece; what is left and right of it is split alone
            before_word[max(0, x - 1):x] = False
            cut[x] = True
            cut[y:y + 1] = True
        cut[:-1] |= before_word
        for x, y in inner:
            cut[x + 1:y] = False
        cut[offs[:-1][full]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        keys, first, inverse = _distinct(hash_spans(data, start, end, _WEIGHTS))
        size, begin, pool = self._look_up(keys, raw, start[first], end[first])
        n = size[inverse]
        return pool[_ranges(begin[inverse], n)], np.concatenate([[0], n.cumsum()])[np.searchsorted(start, offs)]


_ENCODERS: dict[str, TextEncoder] = {}


def _encode(path: str, end_id: int):
    def run(batches):
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, TextEncoder(path))
        pack, at, seq = zstandard.ZstdCompressor(level=1), 0, 0
        for batch in batches:
            data, offs = text_buffer(batch.column("text"))
            for i, j in slices(offs, 2 << 20):
                ids, ptr = encoder.encode(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                parts, sizes = [], np.diff(ptr) + 1
                for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist()):
                    parts.append(pack.compress(_packed(np.append(ids[a:b], end_id))))
                before = at + np.concatenate([[0], sizes.cumsum()[:-1]])
                at += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("part").slice(i, j - i), pa.array(np.arange(seq, seq + j - i)),
                     batch.column("id").slice(i, j - i), pa.array(before), pa.array(sizes), binaries(parts)],
                    names=["part", "seq", "id", "before", "n", "ids"])
                seq += j - i
    return run


def _packed(ids: np.ndarray) -> bytes:
    """Two bytes an id where that is enough; the first byte tells."""
    small = int(ids.max()) <= 0xFFFF
    return bytes([2 if small else 4]) + ids.astype("<u2" if small else "<u4").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = zstandard.ZstdDecompressor().decompress(raw)
    return np.frombuffer(out, f"<u{out[0]}", offset=1)


def _counts(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        for i in range(0, batch.num_rows, 256):  # a count of all symbols for so many documents at once
            c = np.bincount(np.concatenate([_unpack(raw) for raw in batch.column("ids").slice(i, 256).to_pylist()]))
            if len(c) > len(total):
                total = np.pad(total, (0, len(c) - len(total)))
            total[:len(c)] += c
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["symbol", "n"])


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Optimal prefix-code lengths of at most ``limit`` bits, by package-merge. By default
    16 bits, or one more than equal lengths would take where that is not enough."""
    n = len(counts)
    if limit is None:
        limit = max(MIN_LIMIT, min(LARGEST_LIMIT, n.bit_length() + 1))
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaf = counts[order].astype(np.float64)
    is_leaf, level = [], leaf
    for k in range(limit):
        if k:
            pairs = len(level) // 2
            packages = level[:2 * pairs].reshape(-1, 2).sum(axis=1)
            both = np.concatenate([leaf, packages])
            rank = np.argsort(both, kind="stable")
            level = both[rank]
            is_leaf.append(rank < n)
        else:
            is_leaf.append(np.ones(n, bool))
    length, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        leaves = int(flags[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.empty(n, np.int64)
    out[order] = length
    return out


class Code:
    """Canonical code: shorter codes first, equal lengths by symbol."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((symbols, lengths))
        self.symbols, self.lengths = symbols[order], lengths[order]
        self.bits = max(MIN_LIMIT, int(lengths.max(initial=0)))
        step = np.int64(1) << (self.bits - self.lengths)
        first = np.concatenate([[0], step.cumsum()[:-1]]) if len(step) else step
        top = int(symbols.max()) + 1 if len(symbols) else 1
        self.bits_of, self.length_of = np.zeros(top, np.int64), np.zeros(top, np.int64)
        self.bits_of[self.symbols] = first >> (self.bits - self.lengths)
        self.length_of[self.symbols] = self.lengths
        # as many bits as the longest code has -> symbol, and length in the low five bits
        self.seen = np.ones(1 << self.bits, np.int64)
        self.seen[:int(step.sum())] = np.repeat(self.symbols << 5 | self.lengths, step)

    def write(self, ids: np.ndarray, every: int) -> tuple[bytes, np.ndarray]:
        """The bit string of ids, and the bit offset of every ``every``-th one."""
        length = self.length_of[ids]
        end = length.cumsum()
        at = end - length
        size = int(end[-1] + 7) // 8 + SPARE if len(ids) else 0
        value = (self.bits_of[ids] << (64 - (at & 31) - length)).view(np.uint64)
        word = at >> 5
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(size // 4 + 3, np.uint32)
        if len(ids):  # codes share words but no bits, so sums are unions
            out[word[first]] += np.add.reduceat(value >> np.uint64(32), first).astype(np.uint32)
            out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first).astype(np.uint32)
        return out.astype(">u4").tobytes()[:size], at[::every]

    def read(self, bits: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """Ids of stretches that begin at bits ``at`` and hold ``size`` ids, decoded in step.
        ``bits`` ends with SPARE bytes."""
        wide = np.zeros(max(0, len(bits) - 3), np.int64)
        for k in range(4):
            wide = wide << 8 | bits[k:len(bits) - 3 + k]
        skip, mask = 32 - self.bits, (1 << self.bits) - 1
        order = np.argsort(-size, kind="stable")
        at, size = at[order].copy(), size[order]
        out = np.zeros((int(size[0]) if len(size) else 0, len(size)), np.int64)
        for k in range(len(out)):
            live = int(np.searchsorted(-size, -k, side="left"))
            a = at[:live]
            got = self.seen[(wide[a >> 3] >> (skip - (a & 7))) & mask]
            out[k, :live] = got
            a += got & 31
        ids = np.ascontiguousarray((out >> 5).astype(np.uint32).T)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return [ids[c, :n] for c, n in zip(back.tolist(), size[back].tolist())]


def _blocks(code, block_ids: int, every: int, key_type: pa.DataType):
    def run(batches):
        book = Code(*code.value)

        def block():
            bits, marks = book.write(np.concatenate(held), every)
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([first]), pa.array([begin]), binaries([bits]),
                 pa.array([marks.tolist()], pa.list_(pa.int64())), pa.array([keys], pa.list_(key_type)),
                 pa.array([[len(x) for x in held]], pa.list_(pa.int64()))],
                names=["part", "first_seq", "before", "bits", "marks", "ids", "sizes"])

        held, keys, n, part, first, begin = [], [], 0, 0, 0, 0
        for batch in batches:
            for p, s, key, before, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "id", "before", "ids"))):
                if held and (n >= block_ids or p != part):
                    yield block()
                    held, keys, n = [], [], 0
                if not held:
                    part, first, begin = p, s, before
                x = _unpack(raw)
                held.append(x)
                keys.append(key)
                n += len(x)
        if held:
            yield block()
    return run


def write_ids(docs: DataFrame, directory: str, tokenizer_path: str, *, key: str = "doc_id", text: str = "text",
              end_id: int = 2, block_ids: int = BLOCK_IDS, every: int = EVERY) -> None:
    """Encode ``docs`` and write blocks and code below ``directory``."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType
    # Rows that share a key go to several tasks: the order goes on by the text's hash and a row number.
    order = ["id", "hash", "row"]
    ordered = (rows.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
               .repartitionByRange(n, *order).sortWithinPartitions(*order)
               .select(F.spark_partition_id().alias("part"), "id", "text"))
    ids = stage(bounded(ordered).mapInArrow(_encode(tokenizer_path, end_id),
                                   f"part int, seq bigint, id {kind.simpleString()}, before bigint, n bigint, ids binary"))
    counts = (ids.select("ids").mapInArrow(_counts, "symbol bigint, n bigint")
              .groupBy("symbol").agg(F.sum("n").alias("n")).orderBy("symbol").collect())  # at most one row per symbol
    symbols = np.array([r[0] for r in counts], np.int64)
    lengths = code_lengths(np.array([r[1] for r in counts], np.int64))
    (spark.createDataFrame(list(zip(symbols.tolist(), lengths.tolist())), "symbol bigint, length bigint")
     .coalesce(1).write.parquet(f"{directory}/code"))
    # Ids in earlier partitions; one row for each partition.
    parts = ids.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(earlier, F.lit(0)).alias("offset"))
    blocks = ids.mapInArrow(
        _blocks(spark.sparkContext.broadcast((symbols, lengths)), block_ids, every, to_arrow_type(kind)),
        f"part bigint, first_seq bigint, before bigint, bits binary, marks array<bigint>, "
        f"ids array<{kind.simpleString()}>, sizes array<bigint>")
    (blocks.join(F.broadcast(parts), "part")
     .select("part", "first_seq", (F.col("before") + F.col("offset")).alias("start"), "bits", "marks", "ids", "sizes",
             F.lit(every).alias("every"))
     .write.parquet(f"{directory}/blocks"))


def _read(code, with_ids: bool, key_type: pa.DataType):
    def run(batches):
        book = Code(*code.value)
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in ("start", "bits", "marks", "ids", "sizes", "every")}
                total, every = sum(row["sizes"]), row["every"]
                marks = np.array(row["marks"], np.int64)
                size = np.full(len(marks), every, np.int64)
                size[-1] = total - every * (len(marks) - 1)
                ids = np.concatenate(book.read(np.frombuffer(row["bits"], np.uint8), marks, size))
                end = np.cumsum(row["sizes"])
                texts = [ids[a:b].astype("<u4").tobytes() for a, b in zip((end - row["sizes"]).tolist(), end.tolist())]
                cols = [pa.array(row["ids"], key_type), pa.array(row["start"] + end - row["sizes"]),
                        pa.array(row["sizes"], pa.int64()), pa.array([zlib.crc32(t) for t in texts], pa.int64())]
                names = ["id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(cols + [binaries(texts)] * with_ids, names=names + ["ids"] * with_ids)
    return run


def read_ids(spark: SparkSession, directory: str, *, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Decode a directory: key, start, n_tokens, ids_crc32[, ids as little-endian uint32]."""
    rows = spark.read.parquet(f"{directory}/code").collect()  # one row for each used symbol
    code = (np.array([r["symbol"] for r in rows], np.int64), np.array([r["length"] for r in rows], np.int64))
    blocks = spark.read.parquet(f"{directory}/blocks")
    kind = blocks.schema["ids"].dataType.elementType
    out = bounded(blocks).mapInArrow(
        _read(spark.sparkContext.broadcast(code), with_ids, to_arrow_type(kind)),
        f"id {kind.simpleString()}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)
    return out.withColumnRenamed("id", key)
