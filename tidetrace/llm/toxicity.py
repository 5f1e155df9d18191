"""Toxicity: a convolutional text classifier trained in numpy, thresholds by language.

A word's embedding is the sum of three rows of a table of 2**18, chosen by hashes of the
word, its first four bytes and its first five, so inflected forms share most of it.
A row starts from the log-odds of label 1 among the sample texts that hold it; rows
that too few texts hold stay zero. Filters over one, two and
three words run over the whole text, each keeps its largest response, and a logistic
layer weighs them. Only the positions that won the pooling carry gradients, so
training needs memory for one batch of texts.

Thresholds are calibrated on all labelled texts that are not trained on, scored whole
in Spark and counted by language, label and narrow bins of the raw score: for each
language the cut that best separates the labels (with fewer than MIN_LABELS texts of a
kind, the cut of all languages), and scores are shifted so that 0.5 is the cut. The
language of a text is read from its words alone, by counts of hashed words in all
labelled texts; the language column is not an input of a score.

Only the network is fitted on a sample, of about ``max_rows`` labelled texts of at most
``max_bytes``. A quarter of each label is not trained on, and more of a language's rare
label, so that MIN_LABELS are left to calibrate on. Every text is scored
whole.

Defined cases: null and empty texts, and texts without words, are scored as one
blank word; label rows with a null key, a null label or a label other than 0 and 1
are not learnt from; without two kinds of labels every score is the share of label
1 (0 if there are none); repeated rows get equal scores; an empty table gives no
rows; other columns are not read by the scores and pass the filter unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidetrace.llm.common import bounded, slices, stage, text_buffer
from tidetrace.llm.quality import MAX_BYTES, labelled_texts
from tidetrace.llm.words import ALNUM, hash_spans, mix, words

ROWS_BITS = 18
LANGUAGE_BITS = 15
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PREFIXES = (4, 5)  # bytes
MAX_ROWS = 3_000
MIN_TEXTS = 3  # sample texts that hold a word, for the word to have an embedding
_FOLDED = mix(np.arange(2000, 2256, dtype=np.uint64)) | np.uint64(1)
_FOLDED[0x41:0x5B] = _FOLDED[0x61:0x7B]
MIN_LABELS = 8  # of either kind, for a language's own cut
ROW_BYTES = 64  # of a broadcast row besides its key
BINS = 256  # of a unit of the logit, to calibrate on


def word_rows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table rows of each word, and the first word of each text."""
    w = words(data, offs, ALNUM)
    rows = [w.hash]
    for n in PREFIXES:
        rows.append(mix(hash_spans(data, w.start, np.minimum(w.end, w.start + n), _FOLDED, gaps=True) + np.uint64(n)))
    return np.stack([r >> np.uint64(64 - ROWS_BITS) for r in rows], axis=1).astype(np.int32), w.ptr


@dataclass
class Model:
    table: np.ndarray  # 2**ROWS_BITS x DIM
    filters: list[np.ndarray]  # width x DIM x FILTERS each
    bias: np.ndarray  # of all filters
    out: np.ndarray
    out_bias: float
    constant: float | None = None  # the score when nothing could be learnt
    languages: np.ndarray | None = None  # log-probabilities, 2**LANGUAGE_BITS x languages
    cuts: np.ndarray | None = None  # logit cut of each language

    def pooled(self, rows: np.ndarray, ptr: np.ndarray, places: bool = False):
        """Largest response of each filter in each text; ``places``: and where it is.
        Texts are laid out with blanks between them, so every filter fits."""
        gap = max(WIDTHS)
        n = np.diff(ptr)
        begin = ptr[:-1] + gap * np.arange(len(n))
        x = np.zeros((len(rows) + gap * (len(n) + 1), DIM), np.float32)
        at = np.arange(len(rows)) + gap * np.repeat(np.arange(len(n)), n)
        x[at] = self.table[rows].sum(axis=1)
        size = len(rows) + gap * len(n)
        best, where = [], []
        for f in self.filters:
            z = x[:size] @ f[0]
            for k in range(1, len(f)):
                z += x[k:size + k] @ f[k]
            # A text's windows begin at its words; a text without words has one blank window.
            if places:
                w = np.stack([z[b:b + max(1, c)].argmax(axis=0) + b for b, c in zip(begin.tolist(), n.tolist())])
                where.append(w)
                best.append(np.take_along_axis(z, w, axis=0))
            else:
                blank = np.ones(size, bool)
                blank[at] = False
                blank[begin[n == 0]] = False
                z[blank] = -np.inf
                best.append(np.maximum.reduceat(z, begin, axis=0))
        best = np.hstack(best) + self.bias
        return (best, x, np.hstack(where)) if places else best

    def logits(self, rows: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(rows, ptr), 0) @ self.out + self.out_bias

    def language(self, rows: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        n_lang = self.languages.shape[1]
        total = np.concatenate([np.zeros((1, n_lang)), self.languages[rows[:, 0] >> (ROWS_BITS - LANGUAGE_BITS)].cumsum(axis=0, dtype=float)])
        return (total[ptr[1:]] - total[ptr[:-1]]).argmax(axis=1)

    def scores(self, rows: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(ptr) - 1, self.constant)
        z = self.logits(rows, ptr) - self.cuts[self.language(rows, ptr)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, *, updates: int = 150, batch: int = 32,
          rate: float = 0.01, seed: int = 5) -> Model:
    """Fit on texts given as (rows, ) by Adam steps; embedding rows by Adagrad steps."""
    rng = np.random.default_rng(seed)
    n_one, held, held_one = int((y == 1).sum()), np.zeros(1 << ROWS_BITS), np.zeros(1 << ROWS_BITS)
    for t, label in zip(texts, y):
        own = np.unique(t)
        held[own] += 1
        held_one[own] += label
    known = held >= MIN_TEXTS
    odds = np.log((held_one + 0.5) / (n_one + 1)) - np.log((held - held_one + 0.5) / (len(y) - n_one + 1))
    table = rng.normal(0, 0.02, (1 << ROWS_BITS, DIM))
    table[:, 0] += odds / 4
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)) for w in WIDTHS]
    for f in filters:
        f[:, 0] += 0.5
    m = Model((table * known[:, None]).astype(np.float32), [f.astype(np.float32) for f in filters],
              np.full(len(WIDTHS) * FILTERS, -0.5, np.float32),
              np.abs(rng.normal(0, 0.2, len(WIDTHS) * FILTERS)).astype(np.float32), 0.0)
    dense = [*m.filters, m.bias, m.out, np.zeros(1, np.float32)]
    first, second = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    squared = np.full(len(m.table), 1e-3, np.float32)
    kinds = [np.flatnonzero(y == v) for v in (0, 1)]
    for step in range(1, updates + 1):
        # Both labels are drawn equally often.
        pick = np.concatenate([rng.choice(k, batch // 2) for k in kinds])
        rows = np.concatenate([texts[i] for i in pick])
        ptr = np.concatenate([[0], np.cumsum([len(texts[i]) for i in pick])])
        m.out_bias = float(dense[-1][0])
        best, x, where = m.pooled(rows, ptr, places=True)
        active = np.maximum(best, 0)
        p = 1 / (1 + np.exp(-np.clip(active @ m.out + m.out_bias, -30, 30)))
        d = ((p - y[pick]) / len(pick)).astype(np.float32)
        d_best = d[:, None] * m.out * (best > 0)
        grads = [np.zeros_like(f) for f in m.filters]
        begin = ptr[:-1] + max(WIDTHS) * np.arange(len(pick))
        hit_rows, hit_grads = [], []
        for n, f in enumerate(m.filters):
            cols = slice(n * FILTERS, (n + 1) * FILTERS)
            at, g = where[:, cols], d_best[:, cols]
            for k in range(len(f)):
                grads[n][k] = np.einsum("tfd,tf->df", x[at + k], g)
                word = at + k - begin[:, None]
                real = (word < np.diff(ptr)[:, None]) & (g != 0)
                t, c = np.nonzero(real)
                own = rows[ptr[t] + word[t, c]]
                step_g = g[t, c][:, None] * f[k].T[c]
                hit_rows.append(own.ravel())
                hit_grads.append(np.repeat(step_g, own.shape[1], axis=0))
        grads += [d_best.sum(axis=0), active.T @ d + 1e-4 * m.out, np.array([d.sum()], np.float32)]
        for a, b, param, g in zip(first, second, dense, grads):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            param -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
        touched, back = np.unique(np.concatenate(hit_rows), return_inverse=True)
        g = np.zeros((len(touched), DIM), np.float32)
        np.add.at(g, back, np.concatenate(hit_grads))
        squared[touched] += (g * g).sum(axis=1)
        m.table[touched] -= known[touched, None] * (0.05 * g / np.sqrt(squared[touched])[:, None])
    m.out_bias = float(dense[-1][0])
    return m


def best_cut(low: np.ndarray, high: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """The cut between labels 0 below and 1 above with the largest hit rate minus false alarm
    rate; in the middle of the gap, and of equal cuts the one with the widest gap. Rows are
    bins in order: least and largest logit, number of texts of each label."""
    missed, alarms = np.cumsum(toxic), clean.sum() - np.cumsum(clean)
    quality = 1 - missed / max(1, missed[-1]) - alarms / max(1, clean.sum())
    gap = np.append(low[1:] - high[:-1], 0)
    k = np.lexsort((gap, np.round(quality, 9)))[-1]
    return float(high[k] + gap[k] / 2)


def _hashed(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for t in texts:
        data, offs = text_buffer(pa.array([t], pa.string()))
        out.append(word_rows(data, offs)[0])
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic",
                 language: str | None = "lang", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES,
                 broadcast_bytes: int = 32 << 20) -> Model:
    """Fit on ``labels``, which holds only rows that may be learnt from. Labelled keys are broadcast if
    they take at most ``broadcast_bytes``; beyond that the texts are joined by key."""
    binary = F.when(F.col(label).isin(0, 1), F.col(label).cast("int"))
    drawn = labelled_texts(docs, labels, binary, key=key, text=text, extra=language, max_rows=max_rows,
                           max_bytes=max_bytes)
    y = np.array([r["label"] for r in drawn], int)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros((1, DIM)), [], np.zeros(0), np.zeros(0), 0.0, constant=float(y.mean()) if len(y) else 0.0)
    held = held_back(drawn)
    learn = [n for n, r in enumerate(drawn) if r["id"] not in held]
    texts = _hashed([drawn[n]["text"] for n in learn])
    model = train(texts, y[learn])

    number = stage(labels.select(F.col(key).alias("id"), binary.alias("label")).filter("id is not null and label is not null")
                   .groupBy("id").agg(F.count_if(F.col("label") == 0).alias("clean"), F.sum("label").alias("toxic")))
    trained = docs.sparkSession.createDataFrame(
        [(i,) for i in sorted({drawn[n]["id"] for n in learn})], number.select("id").schema)
    number = number.join(F.broadcast(trained.withColumn("trained", F.lit(True))), "id", "left")
    size = number.agg(F.sum(F.octet_length(F.col("id").cast("string")) + ROW_BYTES)).first()[0] or 0
    side = F.broadcast(number) if size <= broadcast_bytes else number.hint("merge")
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"),
                       (F.col(language) if language else F.lit(None)).cast("string").alias("lang")).join(side, "id")
    model.languages = language_model(rows)
    untrained = rows.filter(F.col("trained").isNull() | F.coalesce(F.octet_length("text") > max_bytes, F.lit(True)))
    bins = logit_bins(untrained, model)
    if not all(sum(r[k] for r in bins) for k in ("clean", "toxic")):
        bins = logit_bins(rows, model)
    model.cuts = language_cuts(bins, model.languages.shape[1])
    return model


def held_back(drawn: list) -> set:
    """Keys of the sample that are not trained on: every fourth of each label, and of a language's
    label up to MIN_LABELS if these are at most half of them."""
    kinds, held = {}, set()
    for label in (0, 1):
        held.update(list(dict.fromkeys(r["id"] for r in drawn if r["label"] == label))[3::4])
    for r in drawn:
        kinds.setdefault((r["extra"] or "", r["label"]), {})[r["id"]] = True
    for own in kinds.values():
        if len(own) >= 2 * MIN_LABELS:
            missing = MIN_LABELS - sum(i in held for i in own)
            held.update([i for i in own if i not in held][:max(0, missing)])
    for label in (0, 1):  # a label must be left to train on
        own = [r["id"] for r in drawn if r["label"] == label]
        if held.issuperset(own):
            held.discard(own[0])
    return held


def _language_words(batches):
    counts = {}
    for batch in batches:
        data, offs = text_buffer(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        for i, j in slices(offs):
            rows, ptr = word_rows(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
            bucket = rows[:, 0] >> (ROWS_BITS - LANGUAGE_BITS)
            for n, lang in enumerate(langs[i:j]):
                own = counts.setdefault(lang, np.zeros(1 << LANGUAGE_BITS, np.int64))
                np.add.at(own, bucket[ptr[n]:ptr[n + 1]], 1)
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])],
                                         names=["lang", "bucket", "n"])


def language_model(rows: DataFrame) -> np.ndarray:
    """Log-probabilities of hashed words by language, over all rows (text, lang) that name one."""
    found = (rows.filter("lang is not null").select("text", "lang")
             .transform(bounded).mapInArrow(_language_words, "lang string, bucket bigint, n bigint")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    lang = np.array(found.column("lang").to_pylist(), object)
    names = sorted(set(lang.tolist())) or [""]
    counts = np.full((1 << LANGUAGE_BITS, len(names)), 0.1)
    place = {name: n for n, name in enumerate(names)}
    counts[found.column("bucket").to_numpy(), np.array([place[x] for x in lang], int)] += found.column("n").to_numpy()
    return np.log(counts / counts.sum(axis=0)).astype(np.float32)


def logit_bins(rows: DataFrame, model: Model) -> list:
    """Texts of each label by language and bin of the logit, and the least and largest logit there."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            data, offs = text_buffer(batch.column("text"))
            for i, j in slices(offs):
                words_ = word_rows(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                z = shared.value.logits(*words_).astype(float)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shared.value.language(*words_)), pa.array(np.floor(np.clip(z, -64, 64) * BINS).astype(np.int64)),
                     pa.array(z), batch.column("clean").slice(i, j - i), batch.column("toxic").slice(i, j - i)],
                    names=["lang", "bin", "z", "clean", "toxic"])

    scored = bounded(rows.select("text", "clean", "toxic")).mapInArrow(run, "lang bigint, bin bigint, z double, clean bigint, toxic bigint")
    return scored.groupBy("lang", "bin").agg(F.min("z").alias("low"), F.max("z").alias("high"), F.sum("clean").alias("clean"),
                                             F.sum("toxic").alias("toxic")).collect()


def language_cuts(bins: list, n_languages: int) -> np.ndarray:
    """The cut of each language; with too few texts of a label, that of all languages."""
    def cut(own):
        merged = {}
        for r in own:
            low, high, clean, toxic = merged.get(r["bin"], (r["low"], r["high"], 0, 0))
            merged[r["bin"]] = (min(low, r["low"]), max(high, r["high"]), clean + r["clean"], toxic + r["toxic"])
        return best_cut(*(np.array(x) for x in zip(*(merged[b] for b in sorted(merged)))))

    cuts = np.full(n_languages, cut(bins))
    for n in range(n_languages):
        own = [r for r in bins if r["lang"] == n]
        if min(sum(r[k] for r in own) for k in ("clean", "toxic")) >= MIN_LABELS:
            cuts[n] = cut(own)
    return cuts


def _scores(model: Model, col: pa.Array) -> np.ndarray:
    data, offs = text_buffer(col)
    out = [np.zeros(0)]
    for i, j in slices(offs):
        out.append(model.scores(*word_rows(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])))
    return np.concatenate(out)


def score_toxicity(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_scores(shared.value, batch.column("text")))],
                                             names=["id", "score"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return bounded(rows).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", key)


def drop_toxic(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose score is below ``threshold``, with all their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(shared.value, batch.column(at)) < threshold))

    return bounded(docs).mapInArrow(run, docs.schema)
