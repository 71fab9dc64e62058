"""Mixing sources to target weights with soft domain membership.

A classifier learnt from the labelled table gives each document a posterior over domains. With
a_d = tokens_d * posterior_d, projected gradient descent finds nonnegative document rates r that
minimise the squared distance of sum_d r_d a_d from the target token totals. The distance is
weighted by the inverse of sum_d tokens_d p_d p_d', the gradient is taken per token: then the step
length is 1, one step is exact where no rate is held at 0, and a document's rate is a function of
its posterior alone, so a round is one narrow pass that sums a vector and a matrix a partition.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm import _text
from scorelake.llm._common import fresh, mapped, require, share, staged

log = logging.getLogger(__name__)
#: Bound of the labelled sample that the classifier is fitted on.
LABEL_ROWS = 3_000
DIM_BITS = 16
ROUNDS, TOLERANCE = 40, 1e-4


def default_targets(domains: list[str]) -> dict[str, float]:
    """Nine tenths for good domains and one for poor ones, each shared out evenly."""
    good = [d for d in domains if d.endswith("/good")]
    poor = [d for d in domains if not d.endswith("/good")]
    whole = (0.9 if good else 0) + (0.1 if poor else 0)
    return {d: (0.9 / len(good) if d in good else 0.1 / len(poor)) / whole for d in domains}


def _hashed(col) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value, words a row): hashed words, damped counts scaled to unit length."""
    n = len(col)
    h, row, _ = _text.words(col)
    _, count = _text.spans(row, n)
    key, times = np.unique(row << DIM_BITS | (h >> np.uint64(64 - DIM_BITS)).astype(np.int64), return_counts=True)
    row, feature = key >> DIM_BITS, key & ((1 << DIM_BITS) - 1)
    value = 1 + np.log(times)
    norm = np.sqrt(np.bincount(row, value**2, n))
    return row, feature, value / np.maximum(norm, 1e-9)[row], count


@dataclass
class Domains:
    names: list[str]
    weights: np.ndarray  # features x domains
    bias: np.ndarray

    def posterior(self, col) -> tuple[np.ndarray, np.ndarray]:
        """(rows x domains, words a row); a text without a word gets the bias alone."""
        row, feature, value, count = _hashed(col)
        z = np.tile(self.bias, (len(count), 1))
        for k in range(len(self.names)):
            z[:, k] += np.bincount(row, self.weights[feature, k] * value, len(count))
        z -= z.max(axis=1, keepdims=True, initial=0) if z.size else 0
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True), count


def train_domains(docs: DataFrame, labels: DataFrame, rows: int = LABEL_ROWS, rounds: int = 50) -> Domains:
    """Fit on about ``rows`` labelled documents, chosen by a hash of their id.

    A domain is a language and a label of quality, as in en/good. Rows with a null id, text or label
    are ignored, a null language counts as ``und``; without any labelled row there is one domain, all.
    """
    require(docs, "doc_id", "text")
    known = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    total = known.count()
    if total > rows:
        known = known.filter(share("doc_id", rows / total))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    lang = F.coalesce(F.col("lang"), F.lit("und")) if "lang" in docs.columns else F.lit("und")
    # at most about LABEL_ROWS rows of 12 bytes whatever the corpus, so this side is always small
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang")).filter("text is not null").join(F.broadcast(known), "doc_id")
    named = joined.select("text", F.concat("lang", F.when(F.col("quality") > 0, "/good").otherwise("/poor")).alias("domain"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.pieces(batches, 0):
            row, feature, value, count = _hashed(batch.column(0))
            start, size = _text.spans(row, len(count))
            cuts = pa.array(np.concatenate([start, [len(row)]]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(cuts, pa.array(feature.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(value.astype(np.float32)))], ["domain", "feature", "value"])

    found = mapped(named, run, "domain string, feature array<int>, value array<float>").toArrow()
    if not found.num_rows:
        return Domains(["all"], np.zeros((1 << DIM_BITS, 1)), np.zeros(1))
    found = found.combine_chunks()
    names = sorted(set(found["domain"].to_pylist()))
    y = np.searchsorted(np.array(names), found["domain"].to_numpy(zero_copy_only=False).astype(str))
    lists = found["feature"].chunk(0)
    size = np.asarray(lists.value_lengths()).astype(np.int64)
    feature, value = lists.flatten().to_numpy().astype(np.int64), found["value"].chunk(0).flatten().to_numpy().astype(float)
    owner = np.repeat(np.arange(len(size)), size)
    used, small = np.unique(feature, return_inverse=True)
    k = len(names)
    w, bias = np.zeros((len(used), k)), np.log(np.bincount(y, minlength=k) / len(y))
    m, s = np.zeros((len(used) + 1, k)), np.zeros((len(used) + 1, k))
    hot = np.eye(k)[y]
    for t in range(1, rounds + 1):
        z = np.stack([np.bincount(owner, w[small, c] * value, len(size)) for c in range(k)], axis=1) + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - hot) / len(y)
        grad = np.vstack([np.stack([np.bincount(small, g[owner, c] * value, len(used)) for c in range(k)], axis=1) + 1e-5 * w, g.sum(axis=0)])
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        step = 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    full = np.zeros((1 << DIM_BITS, k), np.float32)
    full[used] = w
    return Domains(names, full, bias)


def posteriors(docs: DataFrame, model: Domains) -> DataFrame:
    """(doc_id, n_tokens, posterior) of every row; a null text has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.pieces(batches, 1):
            p, count = model.posterior(batch.column(1))
            cuts = pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), pa.ListArray.from_arrays(cuts, pa.array(p.reshape(-1)))], ["doc_id", "n_tokens", "posterior"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_tokens long, posterior array<double>")


def rates_of(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the given gradient steps, from 1 on."""
    r = np.ones(len(p))
    for g in steps:
        r = np.maximum(0.0, r - p @ g)
    return r


def _sums(table: DataFrame, k: int, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sum_d r_d tokens_d p_d, sum_d tokens_d p_d p_d' over the documents whose rate isn't 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            p = batch.column(1).flatten().to_numpy().reshape(-1, k)
            tokens = batch.column(0).to_numpy().astype(float)
            r = rates_of(p, steps)
            total[:k] += (r * tokens) @ p
            total[k:] += (p * (tokens * (r > 0))[:, None]).T.dot(p).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["x"])

    parts = mapped(table.select("n_tokens", "posterior"), run, "x array<double>")
    row = parts.agg(*(F.sum(F.col("x")[i]).alias(f"x{i}") for i in range(k + k * k))).first()
    got = np.array([v or 0.0 for v in row])
    return got[:k], got[k:].reshape(k, k)


def solve(table: DataFrame, targets: np.ndarray, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[list[np.ndarray], np.ndarray]:
    """(gradient steps, reached token totals) for targets that are shares of all tokens.

    A round's step is scaled by the documents whose rate isn't 0; where that step doesn't bring the totals
    nearer, the one scaled by all documents, which always does, takes its place. Rounds end where
    every total is within ``tolerance`` of all tokens. Targets that no nonnegative rates reach, or that
    ``rounds`` rounds don't, are approached as far as that goes, which is logged.
    """
    k = len(targets)
    reached, h = _sums(table, k, [])
    total = reached.sum()
    if total <= 0:
        return [], reached
    goal = targets * total
    inverse = lambda m: np.linalg.inv(m + np.eye(k) * 1e-9 * np.trace(h))
    weight = inverse(h)
    far = lambda x: float((x - goal) @ weight @ (x - goal))
    steps: list[np.ndarray] = []
    active, used = h, 0
    while np.abs(reached - goal).max() > tolerance * total:
        if used >= rounds:
            log.warning("after %d rounds a domain's tokens are %.2f %% of all tokens off their target", used, 100 * np.abs(reached - goal).max() / total)
            break
        for scale in (inverse(active), weight):
            step = scale @ (reached - goal)
            new, seen = _sums(table, k, [*steps, step])
            used += 1
            if far(new) < far(reached):
                break
        else:
            log.warning("a domain's tokens are %.2f %% of all tokens off their target, and no step brings them nearer", 100 * np.abs(reached - goal).max() / total)
            break
        gain = far(reached) - far(new)
        steps.append(step)
        reached, active = new, seen
        if gain < 1e-9 * far(reached):
            log.warning("the nearest that nonnegative rates come leaves a domain's tokens %.2f %% of all tokens off their target", 100 * np.abs(reached - goal).max() / total)
            break
    return steps, reached


def _goal(model: Domains, targets: dict[str, float] | None) -> np.ndarray:
    want = default_targets(model.names) if targets is None else targets
    x = np.array([max(0.0, want.get(d, 0.0)) for d in model.names])
    return x / x.sum() if x.sum() > 0 else np.full(len(x), 1 / len(x))


def document_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, n_tokens, domain, posterior, rate) of every row of ``docs``.

    ``targets`` maps domains to weights; those of unknown domains are dropped, the rest scaled to 1.
    Null ids and repeated rows have rates like any other; a null text has no tokens. ``domain`` is the
    likeliest, of equally likely ones the first by name.
    """
    model = train_domains(docs, labels)
    table = staged(posteriors(docs, model), "posteriors")
    steps, _ = solve(table, _goal(model, targets))
    names = model.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(2).flatten().to_numpy().reshape(-1, len(names))
            domain = pa.DictionaryArray.from_arrays(pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(names)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), domain, batch.column(2), pa.array(rates_of(p, steps))], ["doc_id", "n_tokens", "domain", "posterior", "rate"])

    return mapped(table.select("doc_id", "n_tokens", "posterior"), run, "doc_id long, n_tokens long, domain string, posterior array<double>, rate double")


def rate_column(posterior: Column, steps: list[np.ndarray]) -> Column:
    """``rates_of`` as a column."""
    r = F.lit(1.0)
    for g in steps:
        r = F.greatest(F.lit(0.0), r - reduce(lambda a, b: a + b, (posterior[k] * float(x) for k, x in enumerate(g))))
    return r


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Rows of ``docs`` each repeated as its rate says, columns as they were.

    A rate's fraction is a copy more for that share of documents, by a hash of the id (of the text
    for a null id), so the same rows come out on every run. Texts are classified once, and written with
    their posteriors; rates follow from these without Python.
    """
    model = train_domains(docs, labels)
    at = docs.columns.index("text")
    tokens, posterior, copy = (fresh(docs, n) for n in ("__tokens", "__posterior", "__copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.pieces(batches, at):
            p, count = model.posterior(batch.column(at))
            cuts = pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(count), pa.ListArray.from_arrays(cuts, pa.array(p.reshape(-1)))], [*batch.schema.names, tokens, posterior])

    more = [T.StructField(tokens, T.LongType()), T.StructField(posterior, T.ArrayType(T.DoubleType()))]
    classified = staged(mapped(docs, run, T.StructType([*docs.schema.fields, *more])), "classified")
    steps, _ = solve(classified.select(F.col(tokens).alias("n_tokens"), F.col(posterior).alias("posterior")), _goal(model, targets))
    dice = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text")), F.lit("mix")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    times = F.floor(rate_column(F.col(posterior), steps) + dice).cast("int")
    return classified.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)
