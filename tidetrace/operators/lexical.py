"""Exact lexical scoring inside tasks, on an inverted index of the narratives (SIM2).

Texts are vectors of token counts, scored by cosine. A narrative's tokens are ordered
rarest first (by how many narratives hold them). If a post shares none of the first
tokens, its dot product with the narrative is at most the norm of the remaining ones
(times its own norm), so only the tokens up to where that remaining norm falls below the
threshold are indexed: a pair at or above the threshold shares one of them. Pairs found
through this prefix index are the candidates; each is scored on all its tokens.

The index is small and goes to every task; posts are not shuffled, and a task returns
only scored pairs, with integer dot products and norms, so the score itself is the same
JVM expression on every path.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

MARGIN = 2e-6  # scores are rounded to six places before the threshold
CELLS = 1 << 22  # counts held at once: posts of a slice x tokens of the narratives
PAIRS = 1 << 20  # token matches of candidate pairs scored at once


@dataclass
class NarrativeIndex:
    """Narratives as rows of token numbers and counts, and the postings of their prefixes."""

    ids: np.ndarray
    vocabulary: pa.Array
    ptr: np.ndarray  # first entry of each narrative
    token: np.ndarray
    count: np.ndarray
    sq_norm: np.ndarray
    post_ptr: np.ndarray  # first posting of each token
    postings: np.ndarray  # narratives whose prefix holds the token

    @classmethod
    def of(cls, rows: pa.Table, threshold: float | None) -> NarrativeIndex:
        """``rows``: narrative_id, token, tf."""
        words = rows.column("token").combine_chunks().dictionary_encode()
        token = words.indices.to_numpy().astype(np.int64)
        ids, narrative = np.unique(rows.column("narrative_id").to_numpy(), return_inverse=True)
        count = rows.column("tf").to_numpy().astype(np.int64)
        frequency = np.bincount(token, minlength=len(words.dictionary))
        rare = np.lexsort((token, frequency[token], narrative))
        token, narrative, count = token[rare], narrative[rare], count[rare]
        ptr = np.searchsorted(narrative, np.arange(len(ids) + 1))
        square = count * count
        sq_norm = np.add.reduceat(square, ptr[:-1]) if len(ids) else np.zeros(0, np.int64)
        # Norm of the tokens from each one on, as a share of the narrative's norm.
        before = np.concatenate([[0], square.cumsum()])
        rest = (before[ptr[1:]][narrative] - before[:-1]) / sq_norm[narrative] if len(ids) else np.zeros(0)
        inside = np.sqrt(rest) >= (threshold or 0.0) - MARGIN
        order = np.argsort(token[inside], kind="stable")
        post_ptr = np.searchsorted(token[inside][order], np.arange(len(words.dictionary) + 1))
        return cls(ids, words.dictionary, ptr, token, count, sq_norm, post_ptr, narrative[inside][order])

    def score(self, text: pa.Array, threshold: float | None):
        """(post row, narrative, dot product, squared norm of the post) of the pairs that may reach the threshold."""
        parts = pc.split_pattern_regex(pc.fill_null(text, ""), r"[ \n\t\r]+")
        size = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        words = pc.list_flatten(parts)
        if isinstance(words, pa.ChunkedArray):
            words = words.combine_chunks()
        row = np.repeat(np.arange(len(text)), size)
        code = words.dictionary_encode()
        known = pc.fill_null(pc.index_in(code.dictionary, self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        empty = pc.equal(code.dictionary, "").to_numpy(zero_copy_only=False)
        kind = code.indices.to_numpy().astype(np.int64)
        row, kind = row[~empty[kind]], kind[~empty[kind]]
        pair, count = np.unique(row * max(1, len(known)) + kind, return_counts=True)
        row, kind = np.divmod(pair, max(1, len(known)))
        norm = np.zeros(len(text), np.int64)
        np.add.at(norm, row, count * count)
        token = known[kind]
        row, token, count = row[token >= 0], token[token >= 0], count[token >= 0]
        step = max(1, CELLS // max(1, len(self.vocabulary)))
        for a in range(0, len(text), step):
            own = slice(*np.searchsorted(row, [a, a + step]))
            yield from self._slice(row[own], token[own], count[own], a, min(step, len(text) - a), norm, threshold)

    def _slice(self, row, token, count, first, n, norm, threshold):
        if not len(row):
            return
        dense = np.zeros((n, len(self.vocabulary)), np.int64)
        dense[row - first, token] = count
        hits = self.post_ptr[token + 1] - self.post_ptr[token]
        at = np.repeat(self.post_ptr[token] - np.concatenate([[0], hits.cumsum()[:-1]]), hits) + np.arange(hits.sum())
        seen = np.zeros((n, len(self.ids)), bool)
        seen[np.repeat(row - first, hits), self.postings[at]] = True
        post, narrative = np.nonzero(seen)
        size = self.ptr[narrative + 1] - self.ptr[narrative]
        end = size.cumsum()
        a = 0
        while a < len(post):
            b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + PAIRS, side="right")))
            s = size[a:b]
            starts = np.concatenate([[0], s.cumsum()[:-1]])
            entry = np.repeat(self.ptr[narrative[a:b]] - starts, s) + np.arange(s.sum())
            dot = np.add.reduceat(dense[np.repeat(post[a:b], s), self.token[entry]] * self.count[entry], starts)
            p, y = post[a:b] + first, narrative[a:b]
            if threshold is not None:
                reach = dot >= (threshold - MARGIN) * np.sqrt(norm[p] * self.sq_norm[y].astype(float))
                p, y, dot = p[reach], y[reach], dot[reach]
            if len(p):
                yield p, y, dot, norm[p]
            a = b


def lexical_pairs(posts: DataFrame, narrative_tokens: DataFrame, *, text_col: str, threshold: float | None,
                  keep: list[str]) -> DataFrame:
    """Rows (keep..., narrative_id, _dot, _pn2, sq_norm) of pairs that share a token and may reach the
    threshold. ``narrative_tokens`` (narrative_id, token, tf) is collected: its size is the caller's to check."""
    rows = narrative_tokens.select("narrative_id", "token", "tf").toArrow()
    shared = posts.sparkSession.sparkContext.broadcast(NarrativeIndex.of(rows, threshold))
    src = posts.select(*keep, F.lower(F.col(text_col)).alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]]
    kind = narrative_tokens.schema["narrative_id"].dataType.simpleString()

    def run(batches):
        index = shared.value
        for batch in batches:
            n = batch.num_columns - 1
            for p, y, dot, norm in index.score(batch.column(n), threshold):
                rest = batch.select(list(range(n))).take(pa.array(p))
                yield pa.RecordBatch.from_arrays(
                    [*rest.columns, pa.array(index.ids[y]), pa.array(dot), pa.array(norm), pa.array(index.sq_norm[y])],
                    names=[*rest.schema.names, "narrative_id", "_dot", "_pn2", "sq_norm"])

    return src.mapInArrow(run, ", ".join([*fields, f"narrative_id {kind}", "_dot bigint", "_pn2 bigint", "sq_norm bigint"]))
