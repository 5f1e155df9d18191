"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

Features of a text are its words, word pairs, and runs of three word shapes (a shape
keeps the kinds of characters of a word: ``aA0`` and punctuation, and marks a word
that repeats the one before), hashed to 2**18 weights. A feature's value is its
count divided by the number of words (and ten more), so a text's score is about the
mean weight of its features whatever its length.

The weights are fitted in numpy on a bounded sample of at most about ``max_rows``
labelled texts of at most ``max_bytes`` each; every text is scored whole.

Defined cases: null and empty texts, and texts without words, get the score of the
bias alone; label rows with a null key, a null label or a label other than 0 and 1
are not learnt from; repeated label rows count as often as they occur; without
label rows every score is 0.5; repeated rows get equal scores; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidetrace.llm.common import bounded, bounded_sample, slices, text_buffer
from tidetrace.llm.words import NON_SPACE, byte_class, gram_hash, hash_spans, mix, pair_hash, words

BITS = 18
MAX_ROWS = 3_000
MAX_BYTES = 1 << 16
SCALE = 20.0
PRIOR_WORDS = 10  # a text of few words stays near the bias
# Kinds of bytes: a stands for small letters and all non-ASCII, A for capitals, 0 for digits.
_KIND = np.arange(256, dtype=np.uint8)
for _ranges, _as in (([(0x61, 0x7A), (0x80, 0xFF)], ord("a")), ([(0x41, 0x5A)], ord("A")), ([(0x30, 0x39)], ord("0"))):
    _KIND[byte_class(_ranges)] = _as
_SHAPE_WEIGHTS = mix(np.arange(1000, 1256, dtype=np.uint64)) | np.uint64(1)
_REPEAT = np.uint64(0x517CC1B727220A95)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight numbers of all features, the first feature of each text, and each text's words."""
    w = words(data, offs, NON_SPACE)
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64), np.zeros(len(offs) - 1, np.int64)
    kind = _KIND[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[w.start] = True
    inside = np.zeros(len(data) + 1, np.int8)
    inside[w.start] += 1
    inside[w.end] -= 1
    new &= inside[:-1].cumsum(dtype=np.int8) > 0
    place = np.concatenate([[0], new.cumsum()])
    shape = hash_spans(kind[new], place[w.start], place[w.end], _SHAPE_WEIGHTS)
    shape[1:][w.hash[1:] == w.hash[:-1]] = _REPEAT
    # Per word: the word, the pair and the shapes that begin there, in the same text.
    left = np.repeat(w.ptr[1:], np.diff(w.ptr)) - np.arange(n)
    rows = np.zeros((n, 3), np.uint64)
    rows[:, 0] = w.hash
    rows[:n - 1, 1] = pair_hash(w.hash[:-1], w.hash[1:])
    rows[:max(0, n - 2), 2] = gram_hash(mix(shape), 3)
    ok = left[:, None] > np.arange(3)
    index = (rows >> np.uint64(64 - BITS)).astype(np.int64)[ok]
    per_word = np.concatenate([[0], ok.sum(axis=1).cumsum()])
    return index, per_word[w.ptr], np.diff(w.ptr)


def ftrl(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, alpha: float = 0.3, beta: float = 1.0,
         l1: float = 1e-3, l2: float = 1e-3, epochs: int = 4, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias by FTRL-proximal updates, one example (indexes, values) at a time."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = np.array([1 << BITS])

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for e in rng.permutation(len(examples)):
            i, x = examples[e]
            i, x = np.append(i, bias), np.append(x, 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - labels[e]) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange((1 << BITS) + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def examples_of(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct features and values of each text."""
    out = []
    for t in texts:
        data, offs = text_buffer(pa.array([t], pa.string()))
        index, _, n = features(data, offs)
        i, c = np.unique(index, return_counts=True)
        out.append((i, SCALE * c / (int(n[0]) + PRIOR_WORDS)))
    return out


def labelled_texts(docs: DataFrame, labels: DataFrame, label: Column, *, key: str = "doc_id", text: str = "text",
                   extra: str | None = None, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> list:
    """Rows (text, label, extra) of a bounded sample: at most about ``max_rows``, each of at most
    ``max_bytes``. ``labels`` holds only rows that may be learnt from; ``extra`` is a column of docs."""
    usable = labels.select(F.col(key).alias("id"), label.alias("label")).filter("id is not null and label is not null")
    drawn = bounded_sample(usable, F.col("id"), max_rows)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"),
                       (F.col(extra) if extra else F.lit(None)).cast("string").alias("extra")
                       ).filter(F.octet_length("text") <= max_bytes)
    # The drawn labels are bounded by max_rows, so they are broadcast; the order makes fits repeatable.
    return rows.join(F.broadcast(drawn), "id").select("text", "label", "extra", "id").orderBy("id", "label").collect()


def _score(model):
    def run(batches):
        w, bias = model.value
        for batch in batches:
            data, offs = text_buffer(batch.column("text"))
            for i, j in slices(offs):
                index, ptr, n = features(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                total = np.concatenate([[0.0], w[index].cumsum(dtype=float)])
                logit = bias + SCALE * np.diff(total[ptr]) / (n + PRIOR_WORDS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, j - i), pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))],
                    names=["id", "score"])
    return run


def fit_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text",
                label: str = "quality", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    binary = F.when(F.col(label).isin(0, 1), F.col(label).cast("int"))
    rows = labelled_texts(docs, labels, binary, key=key, text=text, max_rows=max_rows)
    y = np.array([r["label"] for r in rows], float)
    # A small sample is passed over more often.
    epochs = int(np.clip(9_000 // max(1, len(rows)), 3, 12))
    return ftrl(examples_of([r["text"] for r in rows]), y, epochs=epochs)


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float], *, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """One row per input row: key, score (probability of label 1)."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    out = bounded(rows).mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)),
                          f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return out.withColumnRenamed("id", key)
