"""Language identification of whole texts, with labelled spans for mixed ones.

Words are runs of letters. The script of a word (by code point ranges) narrows the
candidates to the languages whose training texts use that script. A word's score for
a language is the sum of log-probabilities of its letter trigrams (with word borders)
and of the word itself, both hashed, relative to the mean of all languages and
clipped. Viterbi over the words with a penalty for every switch labels spans; the
text's language is the one whose spans hold most letters.

Viterbi runs in blocks of words for all texts at once: each block is reduced to the
best score between any two languages at its borders, blocks are chained, and the
paths inside are read back, which is exact.

The counts come from a sample of at most about ``max_rows`` texts of each language,
counted in Spark. Every text is labelled whole.

Defined cases: null text and text without letters is ``und`` with score 0; training
rows with a null text or language are not learnt from; without training rows every
text is ``und``; words of a script that no language uses are neutral, and a text of
such words alone is ``und``; ties go to the language that sorts first; repeated rows
get equal results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidetrace.llm.common import bounded, slices, text_buffer
from tidetrace.llm.words import mix

UNKNOWN = "und"
BITS = 16  # trigrams and words have 2**BITS rows each
MAX_ROWS = 1_500
SWITCH = 8.0
CLIP = 10.0
SCRIPT_WORDS = 20  # so many sample words, or one in a hundred, admit a script to a language
MAX_LANGUAGES = 128
CHUNK_BYTES = 32 << 20  # of the cells of Viterbi blocks held at once
BLOCK = 32
WORDS_AT_ONCE = 1 << 16
# First and last code point of the scripts' letters.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF),
)
SCRIPT_NAMES = ("other", *dict.fromkeys(name for name, _, _ in SCRIPTS))
_TABLES: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def _code_points() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is a letter, small form, script number."""
    if not _TABLES:
        top = 0x110000
        letter = np.fromiter((chr(c).isalpha() for c in range(top)), bool, top)
        small = np.arange(top, dtype=np.uint32)
        for c in np.flatnonzero(letter[:0x20000]).tolist():
            low = chr(c).lower()
            if len(low) == 1:
                small[c] = ord(low)
        script = np.zeros(top, np.uint8)
        for name, first, last in SCRIPTS:
            script[first:last + 1] = SCRIPT_NAMES.index(name)
        _TABLES.append((letter, small, script))
    return _TABLES[0]


@dataclass
class LetterWords:
    """Letter words of several texts: places in code points of the text, script and hashed features."""

    start: np.ndarray  # from the text's beginning
    size: np.ndarray
    ptr: np.ndarray  # first word of each text
    script: np.ndarray
    row: np.ndarray  # hashed word
    grams: np.ndarray  # hashed trigrams of all words
    gram_ptr: np.ndarray  # first trigram of each word

    def words(self, a: int, b: int) -> LetterWords:
        """Words a .. b - 1, without the texts' borders."""
        g = self.gram_ptr[a:b + 1]
        return LetterWords(self.start[a:b], self.size[a:b], self.ptr[:0], self.script[a:b], self.row[a:b],
                           self.grams[g[0]:g[-1]], g - g[0])


def letter_words(data: np.ndarray, offs: np.ndarray) -> LetterWords:
    letter, small, script = _code_points()
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.concatenate([[0], ((data & 0xC0) != 0x80).cumsum()])[offs]  # first code point of each text
    is_letter = letter[chars]
    edge = np.ones(len(chars) + 1, bool)
    edge[1:-1] = is_letter[1:] != is_letter[:-1]
    edge[first] = True
    cut = np.flatnonzero(edge)
    own = is_letter[cut[:-1]] if len(cut) > 1 else np.zeros(0, bool)
    start, end = cut[:-1][own], cut[1:][own]
    size = end - start
    ptr = np.searchsorted(start, first)
    # Letters of all words with one border mark before and after each.
    n = len(start)
    at = np.arange(size.sum()) + np.repeat(2 * np.arange(n) + 1, size)
    place = np.repeat(start - np.concatenate([[0], size.cumsum()[:-1]]) if n else start, size) + np.arange(size.sum())
    marked = np.zeros(int(size.sum()) + 2 * n, np.uint64)
    marked[at] = small[chars[place]]
    with np.errstate(over="ignore"):
        mixed = marked * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        grams = mixed[:-2] + mixed[1:-1] * np.uint64(31) + mixed[2:] * np.uint64(1009) if n else mixed
        grams = (mix(grams) >> np.uint64(64 - BITS)).astype(np.int32)[at - 1]  # one around each letter
        word = np.add.reduceat(mix(mixed[at]) * (np.arange(len(at)) - np.repeat(
            np.concatenate([[0], size.cumsum()[:-1]]), size) + 1).astype(np.uint64),
            np.concatenate([[0], size.cumsum()[:-1]])) if n else marked
    text = np.searchsorted(ptr[1:], np.arange(n), side="right")
    return LetterWords(start - first[text], size, ptr, script[chars[start]],
                       (mix(word) >> np.uint64(64 - BITS)).astype(np.int32), grams,
                       np.concatenate([[0], size.cumsum()]))


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # 2**BITS x languages, relative log-probabilities
    words: np.ndarray
    allowed: np.ndarray  # scripts x languages

    def relative(self, w: LetterWords) -> np.ndarray:
        """Clipped scores of words for all languages, whatever their scripts."""
        if not len(w.size):
            return np.zeros((0, len(self.languages)), np.float32)
        s = np.add.reduceat(self.grams[w.grams], w.gram_ptr[:-1], axis=0) + self.words[w.row]
        return np.clip(s - s.mean(axis=1, keepdims=True), -CLIP, CLIP)

    def word_scores(self, w: LetterWords) -> np.ndarray:
        s = self.relative(w)
        allowed = self.allowed[w.script]
        s = np.where(allowed, s, -2 * CLIP)
        s[~allowed.any(axis=1)] = 0
        return s


def viterbi(scores: np.ndarray, ptr: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best state of each row: states in a sequence score their rows, a change costs ``penalty``.
    Sequences are rows ptr[t] .. ptr[t + 1]. Blocks' cells are held a few at a time."""
    n, states = scores.shape
    path = np.zeros(n, np.int64)
    if not n:
        return path
    size = np.diff(ptr)
    count = -(-size // BLOCK)  # blocks of each sequence
    block0 = np.concatenate([[0], count.cumsum()])
    of_block = np.repeat(np.arange(len(size)), count)
    first = ptr[of_block] + (np.arange(len(of_block)) - block0[of_block]) * BLOCK
    last = np.minimum(first + BLOCK, ptr[of_block + 1])

    def cells(blocks: np.ndarray) -> np.ndarray:
        """Scores of the blocks' rows; those past a sequence's end score nothing."""
        rows = first[blocks][:, None] + np.arange(BLOCK)
        inside = rows < last[blocks][:, None]
        return np.where(inside[:, :, None], scores[np.where(inside, rows, 0)], 0.0)

    at_once = max(1, CHUNK_BYTES // (8 * states * (states + 3 * BLOCK)))
    # Chain the blocks of all sequences, longest sequences first.
    order = np.argsort(-count, kind="stable")
    most = int(count.max())
    live = [int(np.searchsorted(-count[order], -k, side="left")) for k in range(most)]
    total = np.zeros((len(size), states))
    came = np.zeros((len(of_block), states), np.int16)
    for k in range(most):
        for a in range(0, live[k], at_once):
            own = order[a:min(a + at_once, live[k])]
            inner = cells(block0[own] + k)
            # Best score from each state before a block to each state at its end.
            best = np.where(np.eye(states, dtype=bool), 0.0, -penalty) + inner[:, 0, None, :]
            for t in range(1, BLOCK):
                np.maximum(best, best.max(axis=2, keepdims=True) - penalty, out=best)
                best += inner[:, t, None, :]
            best += total[own][:, :, None]
            came[block0[own] + k] = best.argmax(axis=1)
            total[own] = best.max(axis=1)
    before, after = np.zeros(len(of_block), np.int64), np.zeros(len(of_block), np.int64)
    state = total.argmax(axis=1)
    for k in range(most - 1, -1, -1):
        own = order[:live[k]]
        b = block0[own] + k
        after[b] = state[own]
        state[own] = before[b] = came[b, state[own]]
    # Paths inside blocks, between the known states.
    for a in range(0, len(of_block), at_once):
        blocks = np.arange(a, min(a + at_once, len(of_block)))
        inner = cells(blocks)
        v = np.where(np.arange(states) == before[blocks][:, None], 0.0, -np.inf)
        come = np.zeros(inner.shape, np.int16)
        for t in range(BLOCK):
            top = v.argmax(axis=1)
            jump = v.max(axis=1)[:, None] - penalty
            come[:, t] = np.where(v >= jump, np.arange(states), top[:, None])
            v = np.maximum(v, jump) + inner[:, t]
        now, own = after[blocks], np.arange(len(blocks))
        for t in range(BLOCK - 1, -1, -1):
            rows = first[blocks] + t
            inside = rows < last[blocks]
            path[rows[inside]] = now[inside]
            now = come[own, t, now]
    return path


def _count(names: list[str]):
    place = {name: n for n, name in enumerate(names)}

    def run(batches):
        for batch in batches:
            lang = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            data, offs = text_buffer(batch.column("text"))
            for i, j in slices(offs):
                found = []
                w = letter_words(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                of_word = lang[i:j][np.searchsorted(w.ptr[1:], np.arange(len(w.size)), side="right")]
                for row, kind, cell in ((0, np.repeat(of_word, w.size), w.grams), (1, of_word, w.row),
                                        (2, of_word, w.script)):
                    found.append((row * len(names) + kind) * (1 << BITS) + cell)
                code, n = np.unique(np.concatenate(found), return_counts=True)
                kind, own = np.divmod(code >> BITS, len(names))
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(own), pa.array(code & ((1 << BITS) - 1)), pa.array(n)],
                                                 names=["kind", "lang", "cell", "n"])
    return run


def fit_languages(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id",
                  max_rows: int = MAX_ROWS, max_languages: int = MAX_LANGUAGES) -> Model:
    """Fit on ``docs``, which holds only rows that may be learnt from. ``max_rows`` is for each language;
    the ``max_languages`` with most rows are learnt. What reaches the driver is a table of 2**BITS cells
    for each language."""
    rows = docs.select(F.col(key).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = rows.filter("lang is not null and text is not null")
    most = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    sizes = {r["lang"]: r["count"] for r in most}
    names = sorted(sizes)
    rows = rows.filter(F.col("lang").isin(names))
    if not names:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros((1 << BITS, 0)), np.zeros((len(SCRIPT_NAMES), 0), bool))
    share = F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, max_rows / sizes[n]))])
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(11)), F.lit(1 << 30)) / (1 << 30)
    counts = (rows.filter(draw < share[F.col("lang")]).select("lang", "text")
              .transform(bounded).mapInArrow(_count(names), "kind bigint, lang bigint, cell bigint, n bigint")
              .groupBy("kind", "lang", "cell").agg(F.sum("n").alias("n")).toArrow())
    table = np.zeros((3, len(names), 1 << BITS))
    table[tuple(counts.column(c).to_numpy() for c in ("kind", "lang", "cell"))] = counts.column("n").to_numpy()

    def relative(c):
        p = np.log((c + 0.5) / (c.sum(axis=1, keepdims=True) + 0.5 * c.shape[1])).T
        return (p - p.mean(axis=1, keepdims=True)).astype(np.float32)

    scripts = table[2, :, :len(SCRIPT_NAMES)].T
    return Model(names, relative(table[0]), relative(table[1]),
                 scripts >= np.clip(0.01 * scripts.sum(axis=0), 1, SCRIPT_WORDS))


def label(model: Model, data: np.ndarray, offs: np.ndarray):
    """(language, score) of each text, and its spans (text, first code point, one past the last, language)."""
    n = len(offs) - 1
    w = letter_words(data, offs)
    if not model.languages or not len(w.size):
        return [UNKNOWN] * n, np.zeros(n), [np.zeros(0, np.int64)] * 4
    # Word scores of some texts at a time: a row of them for each word and language.
    path = np.zeros(len(w.size), np.int64)
    allowed = model.allowed[w.script].any(axis=1)
    raw = np.zeros((n, len(model.languages)))
    t = 0
    while t < n:
        u = max(t + 1, int(np.searchsorted(w.ptr, w.ptr[t] + WORDS_AT_ONCE, side="right")) - 1)
        a, b = w.ptr[t], w.ptr[u]
        part = w.words(a, b)
        path[a:b] = viterbi(model.word_scores(part), w.ptr[t:u + 1] - a)
        for x in np.flatnonzero(np.diff(w.ptr[t:u + 1]) > 0) + t:  # texts whose words no language's script covers
            if not allowed[w.ptr[x]:w.ptr[x + 1]].any():
                raw[x] = model.relative(w.words(w.ptr[x], w.ptr[x + 1])).sum(axis=0)
        t = u
    text = np.searchsorted(w.ptr[1:], np.arange(len(path)), side="right")
    letters = np.zeros((n, len(model.languages)))
    np.add.at(letters, (text[allowed], path[allowed]), w.size[allowed])
    total = letters.sum(axis=1)
    best = np.where(total > 0, letters.argmax(axis=1), raw.argmax(axis=1))
    some = np.diff(w.ptr) > 0
    languages = [model.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist())]
    score = letters[np.arange(n), best] / np.maximum(1, total)
    new = np.ones(len(path), bool)
    new[1:] = (path[1:] != path[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(path)) - 1
    return languages, score, [text[head], w.start[head], w.start[last] + w.size[last], path[head]]


def identify(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """One row per input row: key, lang_pred, score (share of the letters in spans of lang_pred)
    [, spans: array of (first, last + 1, lang) in code points]."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        for batch in batches:
            data, offs = text_buffer(batch.column("text"))
            for i, j in slices(offs):
                languages, score, found = label(shared.value, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                cols = [batch.column("id").slice(i, j - i), pa.array(languages, pa.string()), pa.array(score)]
                if spans:
                    lists = [[] for _ in range(j - i)]
                    for t, a, b, l in zip(*(x.tolist() for x in found)):
                        lists[t].append({"first": a, "end": b, "lang": shared.value.languages[l]})
                    cols.append(pa.array(lists, span_type))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "lang_pred", "score", "spans"][:len(cols)])

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    out = bounded(rows).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double"
                          + ", spans array<struct<first: bigint, end: bigint, lang: string>>" * spans)
    return out.withColumnRenamed("id", key)
