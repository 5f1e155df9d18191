"""Soft-membership mixing: document rates whose expected domain totals meet targets.

Domains are the label combinations of a labelled table. One FTRL logistic regression
on hashed word n-grams for each domain, normalised over the domains, gives every
document posterior memberships p. With t tokens, a document sampled at rate r brings
r * t * p[d] expected tokens to domain d. With e the K differences between the
expected totals and the targets, as shares of all tokens, the rates minimise

    1/2 * e' M^-1 e   subject to   r >= min_rate >= 0,

where M is the token-weighted mean of p p', which makes domains of any size count alike.
Accelerated projected-gradient steps start from r = 1, in the metric that weighs a
document by its tokens; there the gradient's Lipschitz constant is 1, and a document's
step is its memberships times M^-1 e. Every step is one distributed sum: the driver
keeps only the K-vector of each step, and each task recomputes its rows' rates from
them. The fitted rates are thus a short list of K-vectors that applies to any document.

The steps end when all targets are met to TOLERANCE, or after ``steps`` of them: targets
that no rates of at least min_rate reach cannot be met. ``met`` and the totals reached say so.

``copies`` is the rate rounded up or down by a hash of key and text, with the rate as
expectation.

Defined cases: null and empty texts have no tokens and the rate of their bias
memberships; without label rows there is one domain that holds all, and all rates
are its ratio; a null key is hashed as such; label rows with null labels are not
learnt from; repeated rows get equal rates; an empty table gives no rows; other
columns are not read by the rates and pass ``resample`` unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidetrace.llm.common import bounded, slices, stage, text_buffer
from tidetrace.llm.quality import BITS, MAX_BYTES, PRIOR_WORDS, SCALE, examples_of, features, ftrl, labelled_texts

MAX_ROWS = 2_000
STEPS = 40
TOLERANCE = 1e-4
MET = 0.01
TEMPER = 0.7


@dataclass
class DomainModel:
    domains: list[str]
    weights: np.ndarray  # 2**BITS x domains
    bias: np.ndarray

    def memberships(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text, and its posterior of each domain."""
        out, sizes = [np.zeros((0, len(self.domains)))], [np.zeros(0, np.int64)]
        for i, j in slices(offs):
            index, ptr, n = features(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
            odds = np.zeros((j - i, len(self.domains)))
            for d in range(len(self.domains)):
                total = np.concatenate([[0.0], self.weights[index, d].cumsum(dtype=float)])
                odds[:, d] = self.bias[d] + SCALE * np.diff(total[ptr]) / (n + PRIOR_WORDS)
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            out.append(p / p.sum(axis=1, keepdims=True))
            sizes.append(n)
        return np.concatenate(sizes), np.concatenate(out)


def fit_domains(docs: DataFrame, labels: DataFrame, domain: Column, *, key: str = "doc_id", text: str = "text",
                max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DomainModel:
    """Classifier of the values of ``domain``, a column of ``labels`` (few values), on a bounded sample."""
    rows = labelled_texts(docs, labels, domain.cast("string"), key=key, text=text, max_rows=max_rows,
                          max_bytes=max_bytes)
    names = sorted({r["label"] for r in rows})
    if len(names) < 2:
        return DomainModel(names or ["all"], np.zeros((1 << BITS, 1), np.float32), np.zeros(1))
    examples = examples_of([r["text"] for r in rows])
    epochs = int(np.clip(6_000 // len(rows), 2, 10))
    fits = [ftrl(examples, np.array([r["label"] == d for r in rows], float), epochs=epochs) for d in names]
    return DomainModel(names, np.stack([w for w, _ in fits], axis=1), np.array([b for _, b in fits]))


@dataclass
class Rates:
    """Rates as a function of memberships: the K-vectors of all steps."""

    steps: list[np.ndarray]
    min_rate: float
    targets: np.ndarray
    reached: np.ndarray | None = None  # expected tokens of the domains at these rates
    met: bool = False  # whether these are within MET of all tokens wanted

    def of(self, p: np.ndarray, ahead: bool = False) -> np.ndarray:
        """Rates of documents with memberships p; ``ahead``: at the point where the next step is taken."""
        rate = before = np.ones(len(p))
        look = rate
        for k, g in enumerate(self.steps):
            before, rate = rate, np.maximum(self.min_rate, look - p @ g)
            look = rate + k / (k + 3) * (rate - before)
        return look if ahead else rate


def _sums(shared, n: int, ahead: bool, moment: bool):
    """Expected tokens of each domain (cells 0 .. n-1) and, with ``moment``, the n x n sums of t p p' after them."""
    def run(batches):
        total = np.zeros(n + n * n * moment)
        for batch in batches:
            t = batch.column("n_tokens").to_numpy().astype(float)
            p = np.stack(batch.column("p").to_numpy(zero_copy_only=False)) if len(t) else np.zeros((0, n))
            total[:n] += (t * shared.value.of(p, ahead)) @ p
            if moment:
                total[n:] += ((t[:, None] * p).T @ p).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["cell", "total"])
    return run


def _expected(members: DataFrame, rates: Rates, n: int, *, ahead: bool = False, moment: bool = False):
    shared = members.sparkSession.sparkContext.broadcast(rates)
    rows = (members.mapInArrow(_sums(shared, n, ahead, moment), "cell bigint, total double")
            .groupBy("cell").agg(F.sum("total").alias("total")).collect())  # n + n * n rows
    shared.unpersist()
    out = np.zeros(n + n * n * moment)
    for r in rows:
        out[r["cell"]] = r["total"]
    return (out[:n], out[n:].reshape(n, n)) if moment else out


def fit_rates(members: DataFrame, domains: list[str], *, weights: dict[str, float] | None = None,
              budget: float | None = None, min_rate: float = 0.0, steps: int = STEPS) -> Rates:
    """Rates for ``members`` (n_tokens, p array). ``weights`` are the target shares of the domains; by
    default the present shares raised to TEMPER. ``budget`` is the tokens wanted in all; by
    default as many as no domain has to shrink for."""
    k = len(domains)
    have, moment = _expected(members, Rates([], min_rate, np.zeros(k)), k, moment=True)
    total = have.sum()
    if not total:
        return Rates([], min_rate, np.zeros(k), have, True)
    share = have / total
    want = np.array([weights.get(d, 0.0) for d in domains], float) if weights else share ** TEMPER
    if not want.sum() > 0:
        raise ValueError("no domain of the labels has a positive target weight")
    want = want / want.sum()
    if budget is None:
        there = want > 0
        budget = float((have[there] / want[there]).max())
    rates = Rates([], min_rate, want * budget)
    whiten = np.linalg.inv(moment / total + 1e-9 * np.eye(k))
    at = rates.reached = have
    while np.abs(at - rates.targets).max() > TOLERANCE * budget:
        if len(rates.steps) == steps:
            break
        rates.steps.append(whiten @ (at - rates.targets) / total)
        at = _expected(members, rates, k, ahead=True)
    if rates.steps:
        rates.reached = _expected(members, rates, k)
    rates.met = bool(np.abs(rates.reached - rates.targets).max() <= MET * budget)
    return rates


def memberships(docs: DataFrame, model: DomainModel, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, crc of the text, n_tokens, p."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            n, p = shared.value.memberships(*text_buffer(batch.column("text")))
            flat = pa.array(p.ravel())
            ptr = pa.array(np.arange(len(n) + 1, dtype=np.int32) * p.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("crc"), pa.array(n),
                                              pa.ListArray.from_arrays(ptr, flat)], names=["id", "crc", "n_tokens", "p"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"),
                       F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("crc"))
    out = bounded(rows).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, crc bigint, n_tokens bigint, "
                                        "p array<double>")
    return out.withColumnRenamed("id", key)


def draw(key: Column, crc: Column, seed: int = 23) -> Column:
    """A number in [0, 1) from key and text."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("null")), crc, F.lit(seed)), F.lit(1 << 40)) / (1 << 40)


def mix_documents(docs: DataFrame, labels: DataFrame, domain: Column, *, key: str = "doc_id", text: str = "text",
                  max_rows: int = MAX_ROWS, **targets) -> DataFrame:
    """One row per input row: key, n_tokens, domain (likeliest), posterior (its), rate, target and
    reached (expected tokens of that domain: wanted, and at the fitted rates), met (no domain is
    further than MET of all tokens wanted from its target), copies."""
    model = fit_domains(docs, labels, domain, key=key, text=text, max_rows=max_rows)
    members = stage(memberships(docs, model, key=key, text=text))
    rates = fit_rates(members.select("n_tokens", "p"), model.domains, **targets)
    shared = docs.sparkSession.sparkContext.broadcast((rates, model.domains))

    def run(batches):
        for batch in batches:
            r, names = shared.value
            p = np.stack(batch.column("p").to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, len(names)))
            best = p.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("crc"), batch.column("n_tokens"),
                 pa.array([names[b] for b in best.tolist()], pa.string()), pa.array(p[np.arange(len(p)), best]),
                 pa.array(r.of(p)), pa.array(r.targets[best]), pa.array(r.reached[best]),
                 pa.array(np.full(len(p), r.met))],
                names=["id", "crc", "n_tokens", "domain", "posterior", "rate", "target", "reached", "met"])

    rows = members.withColumnRenamed(key, "id")
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, crc bigint, n_tokens bigint, "
                               "domain string, posterior double, rate double, target double, reached double, met boolean")
    copies = F.floor(F.col("rate") + draw(F.col("id"), F.col("crc"))).cast("long")
    return out.withColumn("copies", copies).drop("crc").withColumnRenamed("id", key)


def resample(docs: DataFrame, labels: DataFrame, domain: Column, *, key: str = "doc_id", text: str = "text",
             max_rows: int = MAX_ROWS, **targets) -> DataFrame:
    """The documents with all their columns, each as often as its copies say."""
    model = fit_domains(docs, labels, domain, key=key, text=text, max_rows=max_rows)
    members = stage(memberships(docs, model, key=key, text=text).select("n_tokens", "p"))
    rates = fit_rates(members, model.domains, **targets)
    shared = docs.sparkSession.sparkContext.broadcast((model, rates))
    n, at = len(docs.columns), docs.columns.index(text)

    def run(batches):
        for batch in batches:
            m, r = shared.value
            _, p = m.memberships(*text_buffer(batch.column(at)))
            copies = np.floor(r.of(p) + batch.column(n).to_numpy()).astype(np.int64)
            own, wanted = batch.select(list(range(n))), np.repeat(np.arange(len(copies)), copies)
            size = np.full(len(copies), own.nbytes // max(1, len(copies)) + 1)
            size += np.diff(text_buffer(batch.column(at))[1])
            for i, j in slices(np.concatenate([[0], np.cumsum(size[wanted])])):
                yield own.take(pa.array(wanted[i:j]))

    crc = F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))
    name = "draw"
    while name in docs.columns:
        name += "_"
    drawn = docs.withColumn(name, draw(F.col(key), crc))
    return bounded(drawn).mapInArrow(run, docs.schema)
