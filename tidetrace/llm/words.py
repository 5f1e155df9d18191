"""Vectorised word hashing over UTF-8 buffers.

Words are runs of bytes of a byte class. That is exact for classes which hold all
bytes from 0x80 up or none of them, as all classes used here do. A word's hash is
a 64-bit polynomial over random byte values followed by a bijective mix, so equal
words have equal hashes in every task and every run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPAN = 1 << 16
with np.errstate(over="ignore"):
    _POW = np.concatenate([[np.uint64(1)], np.full(_SPAN - 1, _BASE)]).cumprod(dtype=np.uint64)


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Boolean table of 256 bytes, True inside the closed ranges."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a:b + 1] = True
    return t


ALNUM = byte_class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
LETTERS = byte_class([(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
NON_SPACE = ~byte_class([(0x20, 0x20), (0x09, 0x0D)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _weights(is_word: np.ndarray, fold: bool) -> np.ndarray:
    w = _BYTE.copy()
    if fold:
        w[0x41:0x5B] = w[0x61:0x7B]
    w[~is_word] = 0
    return w


@dataclass
class Words:
    """Words of several texts: byte spans, hashes, and the first word of each text."""

    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray
    hash: np.ndarray


def spans(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word and the word index at which each text begins."""
    m = is_word[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(m[1:], m[:-1], out=edge[1:-1])
    edge[offs] = True  # a text's border always ends a run
    cut = np.flatnonzero(edge)
    if len(cut) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    own = m[cut[:-1]]
    start, end = cut[:-1][own], cut[1:][own]
    return start, end, np.searchsorted(start, offs)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, weights: np.ndarray,
               gaps: bool = False) -> np.ndarray:
    """64-bit hash of each byte span; spans are ascending and disjoint. Bytes between spans
    must weigh nothing, or ``gaps`` must be set."""
    if not len(start):
        return np.zeros(0, np.uint64)
    lo, hi = int(start[0]), int(end[-1])
    size = np.diff(np.append(start, hi))
    place = np.arange(lo, hi, dtype=np.int64)
    place -= np.repeat(start, size)
    place &= _SPAN - 1
    value = weights[data[lo:hi]]
    if gaps:
        step = np.zeros(hi - lo + 1, np.int8)
        step[start - lo] += 1
        step[end - lo] -= 1
        value *= step[:-1].cumsum(dtype=np.int8).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(value * _POW[place], start - lo)
        return mix(h + (end - start).astype(np.uint64) * _BASE)


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray, fold: bool = True) -> Words:
    """All words of the texts; ``fold`` treats A-Z as a-z."""
    start, end, ptr = spans(data, offs, is_word)
    return Words(start, end, ptr, hash_spans(data, start, end, _weights(is_word, fold)))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ np.uint64(0xA0761D6478BD642F)))


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words (length len(h) - k + 1)."""
    n = max(0, len(h) - k + 1)
    g = h[:n]
    for i in range(1, k):
        g = pair_hash(g, h[i:i + n])
    return g
