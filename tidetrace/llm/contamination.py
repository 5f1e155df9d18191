"""Benchmark decontamination by winnowing.

A text's k-gram hashes are winnowed: of every w consecutive ones the least is kept
(the rightmost of equals). With k + w - 1 = window, two texts that share a run of
``window`` words keep the same k-gram inside it, so joining the kept fingerprints
finds every shared run of that length or more. A shared fingerprint is then extended
over the windows around it: each place of the text where one that holds it may begin is
looked up among the items' distinct windows, compared word by word, and neighbouring
windows grow into whole runs. The work is linear in the text, however often words or
passages repeat in it or in the items. An item with fewer words than the window is one
window by itself and is looked up by the hash of all its words.

The benchmark is cut into blocks of about ``block_bytes`` of text (an item is
never cut). One block's index is a broadcast of bounded size; with more blocks the
documents are scanned once for each block, one block after the other.

Defined cases: null or empty text has no words and is clean; an item without words
matches nothing; items with equal ids count once, a null item id is reported as
``null``; repeated rows and null or repeated document keys are each judged by their own
text; an empty benchmark leaves all documents clean; empty documents give no rows;
other columns of either table are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidetrace.llm.common import bounded, slices, stage, text_buffer
from tidetrace.llm.words import ALNUM, gram_hash, pair_hash, words

GRAM = 5
BLOCK_BYTES = 8 << 20
_FILTER_BITS = 20


def winnow(grams: np.ndarray, first: np.ndarray, last: np.ndarray, w: int) -> np.ndarray:
    """Positions of the kept grams. Windows begin at first[t] .. last[t] - 1 of each text t."""
    if len(grams) < w:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, w)
    inside = np.zeros(len(view) + 1, np.int32)
    ok = last > first
    np.add.at(inside, first[ok], 1)
    np.add.at(inside, last[ok], -1)
    begin = np.flatnonzero(inside[:-1].cumsum() > 0)
    kept = np.zeros(len(grams), bool)
    for i in range(0, len(begin), 1 << 16):
        b = begin[i:i + (1 << 16)]
        kept[b + (w - 1 - view[b][:, ::-1].argmin(axis=1))] = True
    return np.flatnonzero(kept)


class Windows:
    """The distinct runs of ``size`` words of a block's items: hash, a place that holds the run, the items with it."""

    def __init__(self, size: int, h: np.ndarray, item_of: np.ndarray, begin: np.ndarray):
        self.size, self.words = size, h
        grams = gram_hash(h, size)[begin]
        order = np.lexsort((item_of[begin], grams))
        grams, begin = grams[order], begin[order]
        items = item_of[begin]
        new = np.concatenate([[True], grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, bool)
        other = new | np.concatenate([[True], items[1:] != items[:-1]]) if len(grams) else new
        self.hashes, self.place = grams[new], begin[new]
        self.items = items[other]
        self.ptr = np.append(np.flatnonzero(new[other]), len(self.items))
        self.filter = _bitmap(self.hashes)

    def find(self, h: np.ndarray, ptr: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the places ``at`` in texts with word hashes h those where a run begins, and the run's number."""
        at = at[at + self.size <= ptr[1:][np.searchsorted(ptr[1:], at, side="right")]]
        if not len(at) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams = h[at]
        for i in range(1, self.size):
            grams = pair_hash(grams, h[at + i])
        k = np.minimum(np.searchsorted(self.hashes, grams), len(self.hashes) - 1)
        same = self.hashes[k] == grams
        for i in range(self.size):
            same &= self.words[self.place[k] + i] == h[at + i]
        return at[same], k[same]

    def of_texts(self, text: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, item) of found runs; a run that repeats in a text counts once."""
        if not len(k):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text, k = np.unique(np.stack([text, k]), axis=1)
        n = self.ptr[k + 1] - self.ptr[k]
        first = np.repeat(self.ptr[k] - np.concatenate([[0], n.cumsum()[:-1]]), n)
        return np.repeat(text, n), self.items[first + np.arange(n.sum())]


class ItemIndex:
    """Fingerprints and windows of one block of benchmark items."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int, gram: int):
        data, offs = text_buffer(pa.array(texts, pa.string()))
        w = words(data, offs, ALNUM)
        self.window, self.gram, self.ids = window, gram, ids
        n = np.diff(w.ptr)
        item_of = np.repeat(np.arange(len(ids)), n)
        grams = gram_hash(w.hash, gram)
        at = winnow(grams, w.ptr[:-1], np.maximum(w.ptr[:-1], w.ptr[1:] - window + 1), window - gram + 1)
        self.prints = np.unique(grams[at])
        self.filter = _bitmap(self.prints)
        place = np.arange(len(w.hash))
        self.long = Windows(window, w.hash, item_of, place[place + window <= w.ptr[1:][item_of]])
        self.short = [Windows(m, w.hash, item_of, w.ptr[:-1][n == m]) for m in range(1, window) if (n == m).any()]

    def find(self, h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, ...]:
        """Texts with word hashes h and borders ptr: start and end word of the windows found, and
        the distinct (text, item).

        A fingerprint that a text shares with the items is extended over the windows around it:
        those that hold it may begin at ``window - gram + 1`` places. Each place is looked up
        once, however often its words repeat in the text or in the items.
        """
        start, end, pairs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [(np.zeros(0, np.int64),) * 2]
        grams = gram_hash(h, self.gram)
        at = winnow(grams, ptr[:-1], np.maximum(ptr[:-1], ptr[1:] - self.window + 1), self.window - self.gram + 1)
        at = at[self.filter[grams[at] >> np.uint64(64 - _FILTER_BITS)]]
        if len(at):
            at = at[self.prints[np.minimum(np.searchsorted(self.prints, grams[at]), len(self.prints) - 1)] == grams[at]]
        begin = np.zeros(len(h), bool)
        for d in range(self.window - self.gram + 1):
            begin[at[at >= d] - d] = True
        candidates = [(self.long, np.flatnonzero(begin))]
        for table in self.short:
            short = gram_hash(h, table.size)
            candidates.append((table, np.flatnonzero(table.filter[short >> np.uint64(64 - _FILTER_BITS)])))
        for table, at in candidates:
            at, k = table.find(h, ptr, at)
            start.append(at)
            end.append(at + table.size)
            pairs.append(table.of_texts(np.searchsorted(ptr[1:], at, side="right"), k))
        text, item = (np.concatenate(x) for x in zip(*pairs))
        return np.concatenate(start), np.concatenate(end), text, item


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    t = np.zeros(1 << _FILTER_BITS, bool)
    t[hashes >> np.uint64(64 - _FILTER_BITS)] = True
    return t


def _merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ascending disjoint runs, flat: start, end, start, end, ..."""
    order = np.lexsort((end, start))
    start, reach = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    first = np.concatenate([[True], start[1:] > reach[:-1]]) if len(start) else np.zeros(0, bool)
    last = np.append(first[1:], True) if len(start) else first
    return np.stack([start[first], reach[last]], axis=1).ravel()


def _scan(block):
    def run(batches):
        index = block.value
        for batch in batches:
            data, offs = text_buffer(batch.column("text"))
            for i, j in slices(offs):
                w = words(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i], ALNUM)
                start, end, pair_text, item = index.find(w.hash, w.ptr)
                text = np.searchsorted(w.ptr[1:], start, side="right")
                order = np.argsort(text, kind="stable")
                start, end, text = start[order], end[order], text[order]
                part = batch.slice(i, j - i)
                hits = part.column("hit_runs").to_pylist()
                items = part.column("items").to_pylist()
                for t in np.unique(text).tolist():
                    own = slice(*np.searchsorted(text, [t, t + 1]))
                    old = np.array(hits[t], np.int64).reshape(-1, 2)
                    hits[t] = _merged(np.append(start[own] - w.ptr[t], old[:, 0]),
                                      np.append(end[own] - w.ptr[t], old[:, 1])).tolist()
                found = {}
                for t, x in zip(pair_text.tolist(), item.tolist()):
                    found.setdefault(t, set()).add(index.ids[x])
                for t, x in found.items():
                    items[t] = sorted(x.union(items[t]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("text"), pa.array(np.diff(w.ptr)),
                     pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                    names=["id", "text", "n_words", "hit_runs", "items"])
    return run


def _item_blocks(benchmark: DataFrame, item_key: str, item_text: str, window: int, gram: int,
                 block_bytes: int) -> Iterator[tuple[Broadcast, bool]]:
    """The indexes of the benchmark's blocks, one at least, one after the other: (broadcast, is it the last).
    A block is built when the one before it has been used, and that one is released then."""
    if not 1 <= gram <= window:
        raise ValueError("gram must be between 1 and window")
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.coalesce(F.col(item_key).cast("string"), F.lit("null")).alias("id"),
                             F.col(item_text).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / block_bytes))
    for b in range(n):
        own = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).collect()  # about block_bytes
        block = sc.broadcast(ItemIndex([r[0] for r in own], [r[1] for r in own], window, gram))
        yield block, b + 1 == n
        if b + 1 < n:
            block.unpersist()


def find_benchmark(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text",
                   item_key: str = "item_id", item_text: str = "text", window: int = 10, gram: int = GRAM,
                   block_bytes: int = BLOCK_BYTES, keep_text: bool = False) -> DataFrame:
    """One row per document: key, n_words, hit_runs (flat start, end word positions),
    items (ids of the items found, sorted as strings)[, text]."""
    found = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.lit(0).cast("long").alias("n_words"),
                        F.array().cast("array<bigint>").alias("hit_runs"),
                        F.array().cast("array<string>").alias("items"))
    for block, last in _item_blocks(benchmark, item_key, item_text, window, gram, block_bytes):
        found = bounded(found).mapInArrow(_scan(block), found.schema)
        if not last:
            found = stage(found)
    out = found.withColumnRenamed("id", key).withColumnRenamed("text", text)
    return out if keep_text else out.drop(text)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_key: str = "item_id",
                      item_text: str = "text", window: int = 10, gram: int = GRAM,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any word inside a benchmark window, with all their columns."""
    at = docs.columns.index(text)

    def scan(block):
        def run(batches):
            for batch in batches:
                data, offs = text_buffer(batch.column(at))
                clean = np.ones(batch.num_rows, bool)
                for i, j in slices(offs):
                    w = words(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i], ALNUM)
                    start = block.value.find(w.hash, w.ptr)[0]
                    clean[i + np.searchsorted(w.ptr[1:], start, side="right")] = False
                yield batch.filter(pa.array(clean))
        return run

    for block, last in _item_blocks(benchmark, item_key, item_text, window, gram, block_bytes):
        docs = bounded(docs).mapInArrow(scan(block), docs.schema)
        if not last:
            docs = stage(docs)
    return docs


def hit_words(runs: str = "hit_runs"):
    """Number of words inside the flat runs."""
    return F.expr(f"aggregate({runs}, 0L, (s, x) -> x - s)")
