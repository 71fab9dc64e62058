"""Toxicity by weak supervision.

Many voters (seed lexicons, lexicons mined from the labelled table, patterns) vote on every
document. A generative label model, fitted by expectation maximisation on the histogram of all
vote patterns, estimates each voter's accuracy without labels; voters whose votes depend on each
other within a class are found from that model's residuals and get a joint table. A linear
classifier over hashed words and votes learns the posterior labels and scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm import _text
from scorelake.llm._common import fresh, mapped, require, share, staged

#: Bounds of the samples that models are fitted on; everything else covers all rows.
LABEL_ROWS, TRAIN_ROWS = 20_000, 6_000
DIM_BITS = 18
PREFIXES = (4, 5, 6)

SEEDS = {
    "person": "idiot moron loser clown fool imbecile dumbass jerk creep freak cretin halfwit bastard wanker twat prick dickhead asshole arsehole bitch whore slut",
    "worth": "scum trash worthless pathetic garbage vermin filth subhuman parasite degenerate lowlife scumbag",
    "insult": "stupid disgusting dumb retarded ugly braindead brainless shithead fuck fucking fucker shit bullshit cunt motherfucker",
    "other": "arschloch hurensohn wichser missgeburt dummkopf vollidiot abschaum schlampe fotze spast connard connasse salope pute encule batard abruti debile ordure idiota imbecil estupido gilipollas cabron puta pendejo basura mierda subnormal",
}
VOTERS = [*(f"seed_{k}" for k in SEEDS), "mined_a", "mined_b", "mined_c", "stem_a", "stem_b", "two_terms", "dense", "shouting", "exclaiming", "clean_terms", "clean_stems"]


@dataclass
class Lexicons:
    """Sorted hashes of terms with the voter that each belongs to."""

    words: np.ndarray
    word_voter: np.ndarray
    stems: list[np.ndarray]
    stem_voter: list[np.ndarray]


def mine_terms(docs: DataFrame, labels: DataFrame, rows: int = LABEL_ROWS, least: int = 3) -> Lexicons:
    """Words and word beginnings that mark labelled toxic documents.

    At most about ``rows`` labelled documents are read, chosen by a hash of their id. A term counts
    once for all documents with one sketch (the least word hash), so copies of a document don't
    make its words toxic. It must be in ``least`` toxic documents and 30 times as frequent there.
    Rows with a null id or label are ignored; a document labelled twice is toxic if any says so.
    """
    known = labels.filter("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    total = known.count()
    if total > rows:
        known = known.filter(share("doc_id", rows / total))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    # at most about LABEL_ROWS rows of 12 bytes whatever the corpus, so this side is always small
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.pieces(batches, 0):
            n = batch.num_rows
            h, row, firsts = _text.words(batch.column(0), PREFIXES)
            start, count = _text.spans(row, n)
            sketch = _text.segment(np.minimum, h, start, count, np.uint64(0))
            toxic = batch.column(1).to_numpy()
            kinds, terms, owner = [], [], []
            for kind, x in enumerate([h, *firsts]):
                some = np.flatnonzero(x)
                # once a document: the pair's hash stands for the pair
                some = some[np.unique(x[some] ^ _text.mix(row[some].astype(np.uint64)), return_index=True)[1]]
                terms.append(x[some])
                owner.append(row[some])
                kinds.append(np.full(len(some), kind, np.int8))
            owner = np.concatenate(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(kinds)), pa.array(np.concatenate(terms).view(np.int64)), pa.array(toxic[owner].astype(np.int32)), pa.array(sketch[owner].view(np.int64))],
                ["kind", "term", "toxic", "sketch"],
            )

    seen = mapped(joined, run, "kind byte, term long, toxic int, sketch long").distinct()
    counts = seen.groupBy("kind", "term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    sizes = known.groupBy("toxic").count().collect()
    n = {r["toxic"]: max(1, r["count"]) for r in sizes} | {}
    nt, nc = n.get(1, 1), n.get(0, 1)
    found = counts.filter((F.col("t") >= least) & ((F.col("t") + 0.5) / nt > 30 * (F.col("c") + 0.5) / nc) & (F.col("c") <= 0.002 * nc)).select("kind", "term").toPandas()
    as_terms = lambda k: np.sort(found["term"][found["kind"] == k].to_numpy(np.int64).view(np.uint64))
    seeds = {_text.word_hash(w): i for i, words in enumerate(SEEDS.values()) for w in words.split()}
    mined = [x for x in as_terms(0).tolist() if x not in seeds]
    both = sorted([*seeds.items(), *((x, 4 + x % 3) for x in mined)])
    stems = [as_terms(k + 1) for k in range(len(PREFIXES))]
    return Lexicons(np.array([x for x, _ in both], np.uint64), np.array([v for _, v in both], np.int64), stems, [(7 + s % np.uint64(2)).astype(np.int64) for s in stems])


def _member(x: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted terms, or -1."""
    if not len(terms) or not len(x):
        return np.full(len(x), -1, np.int64)
    sieve = np.zeros(1 << 16, bool)
    sieve[(terms >> np.uint64(48)).astype(np.int64)] = True
    maybe = np.flatnonzero(sieve[(x >> np.uint64(48)).astype(np.int64)])
    at = np.searchsorted(terms, x[maybe])
    at[at == len(terms)] = 0
    out = np.full(len(x), -1, np.int64)
    ok = terms[at] == x[maybe]
    out[maybe[ok]] = at[ok]
    return out


def votes(col, lex: Lexicons) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(votes as rows x voters with 0 for none, 1 toxic, 2 clean; hits of each lexicon; hashed words)."""
    n = len(col)
    h, row, firsts = _text.words(col, PREFIXES)
    start, count = _text.spans(row, n)
    hits = np.zeros((n, 9), np.int64)
    place = _member(h, lex.words)
    ok = place >= 0
    np.add.at(hits, (row[ok], lex.word_voter[place[ok]]), 1)
    first_hit, distinct = np.unique(np.stack([row[ok], place[ok]]), axis=1)[0] if ok.any() else np.zeros(0, np.int64), np.zeros(n, np.int64)
    np.add.at(distinct, first_hit.astype(np.int64), 1)
    for x, terms, voter in zip(firsts, lex.stems, lex.stem_voter):
        place = _member(x, terms)
        ok = place >= 0
        np.add.at(hits, (row[ok], voter[place[ok]]), 1)
    data, off = _text.buffers(col, lower=False)
    base, end = int(off[0]), int(off[-1])
    b = data[base:end]
    cuts = off - base
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[cuts])
    upper, lower = per((b >= 65) & (b <= 90)), per((b >= 97) & (b <= 122))
    bangs = b == 33
    triple = bangs.copy()
    triple[:2] = False
    if len(b) > 2:
        triple[2:] &= bangs[1:-1] & bangs[:-2]
    bang_runs = per(triple)
    terms = hits[:, :7].sum(axis=1)
    stems = hits[:, 7:].sum(axis=1)
    v = np.zeros((n, len(VOTERS)), np.uint8)
    v[:, :9] = hits > 0
    v[:, 9] = distinct >= 2
    v[:, 10] = (terms > 0) & (terms * 150 >= count)
    v[:, 11] = (upper >= 20) & (upper > 2 * lower)
    v[:, 12] = bang_runs > 0
    v[:, 13] = np.where((terms == 0) & (count > 0), 2, 0)
    v[:, 14] = np.where((stems == 0) & (count > 0), 2, 0)
    return v, hits, (h, row, start, count, firsts[1])


def _pack(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) << (2 * np.arange(v.shape[1]))).sum(axis=1)


def unpack(patterns: np.ndarray, voters: int = len(VOTERS)) -> np.ndarray:
    return ((patterns[:, None] >> (2 * np.arange(voters))) & 3).astype(np.int64)


class LabelModel:
    """p(toxic) and, for each clique of voters, p(votes | class), fitted without labels."""

    def __init__(self, clique_size: int = 4, rounds: int = 60, threshold: float = 0.15) -> None:
        self.clique_size, self.rounds, self.threshold = clique_size, rounds, threshold

    def fit(self, v: np.ndarray, weight: np.ndarray) -> LabelModel:
        """v: distinct vote patterns (rows x voters of 0, 1, 2) and the number of documents of each."""
        m = v.shape[1]
        against, favour = (v == 2).sum(axis=1), (v == 1).sum(axis=1)
        start = np.where(favour > against, 0.9, np.where((favour == against) & (favour > 0), 0.5, 0.05))
        self.cliques = [[j] for j in range(m)]
        p = self._em(v, weight, start)
        self.correlations = self._residual(v, weight, p)
        self.cliques = self._join(self.correlations)
        self._em(v, weight, p)
        total = max(weight.sum(), 1e-9)
        post = self.posterior(v)
        self.accuracies = np.array([float((weight * ((v[:, j] == 1) * post + (v[:, j] == 2) * (1 - post))).sum() / max((weight * (v[:, j] > 0)).sum(), 1e-9)) for j in range(m)])
        self.coverage = np.array([float((weight * (v[:, j] > 0)).sum() / total) for j in range(m)])
        return self

    def _em(self, v, weight, p):
        for _ in range(self.rounds):
            self._maximise(v, weight, p)
            new = self.posterior(v)
            if np.abs(new - p).max(initial=0) < 1e-6:
                break
            p = new
        return self.posterior(v)

    def _cell(self, v, clique):
        out = np.zeros(len(v), np.int64)
        for j in clique:
            out = out * 3 + v[:, j]
        return out

    def _maximise(self, v, weight, p):
        pos, neg = float((weight * p).sum()), float((weight * (1 - p)).sum())
        # toxic text is the rarer class: the prior is kept under a half, which also fixes which class is which
        self.prior = min(0.5, max(1e-4, (pos + 1) / (pos + neg + 2)))
        self.tables = []
        for clique in self.cliques:
            cell, size = self._cell(v, clique), 3 ** len(clique)
            one = np.bincount(cell, weight * p, size) + 0.5 / size
            two = np.bincount(cell, weight * (1 - p), size) + 0.5 / size
            self.tables.append((np.log(one / one.sum()), np.log(two / two.sum())))

    def posterior(self, v: np.ndarray) -> np.ndarray:
        z = np.full(len(v), np.log(self.prior / (1 - self.prior)))
        for clique, (one, two) in zip(self.cliques, self.tables):
            cell = self._cell(v, clique)
            z += one[cell] - two[cell]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def _residual(self, v, weight, p) -> np.ndarray:
        """Largest correlation of each pair of voters within a class."""
        m = v.shape[1]
        x = np.where(v == 2, -1.0, v)
        worst = np.zeros((m, m))
        for w in (weight * p, weight * (1 - p)):
            total = max(w.sum(), 1e-9)
            d = x - (w[:, None] * x).sum(axis=0) / total
            cov = (d * w[:, None]).T @ d / total
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            worst = np.maximum(worst, np.where((sd[:, None] > 1e-3) & (sd[None] > 1e-3), np.abs(cov / sd[:, None] / sd[None]), 0))
        np.fill_diagonal(worst, 0)
        return worst

    def _join(self, corr: np.ndarray) -> list[list[int]]:
        cliques = [[j] for j in range(len(corr))]
        pairs = sorted(((corr[i, j], i, j) for i in range(len(corr)) for j in range(i)), reverse=True)
        for c, i, j in pairs:
            if c < self.threshold:
                break
            a, b = (next(q for q in cliques if k in q) for k in (i, j))
            if a is not b and len(a) + len(b) <= self.clique_size:
                cliques.remove(b)
                a += b
        return cliques


def _features(batch_col, lex: Lexicons) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(votes, row, feature, value): hashed words and word beginnings scaled to unit length, and the lexicons' hits."""
    v, hits, (h, row, start, count, stem) = votes(batch_col, lex)
    n = len(v)
    bits = np.uint64(64 - DIM_BITS)
    some = stem != 0
    feature = np.concatenate([h >> bits, stem[some] >> bits]).astype(np.int64)
    owner = np.concatenate([row, row[some]])
    key, times = np.unique(owner << DIM_BITS | feature, return_counts=True)
    owner, feature = key >> DIM_BITS, key & ((1 << DIM_BITS) - 1)
    value = 1 + np.log(times)
    norm = np.sqrt(np.bincount(owner, value**2, n))
    value = value / np.maximum(norm, 1e-9)[owner]
    r, lexicon = np.nonzero(hits)
    dense = np.minimum(np.log1p(hits[r, lexicon]), 3.0)
    return v, np.concatenate([owner, r]), np.concatenate([feature, (1 << DIM_BITS) + lexicon]), np.concatenate([value, dense]), count


@dataclass
class Model:
    lexicons: Lexicons
    label: LabelModel
    weights: np.ndarray
    bias: float


def train(docs: DataFrame, labels: DataFrame, label_rows: int = LABEL_ROWS, train_rows: int = TRAIN_ROWS) -> Model:
    """Mine lexicons, let all documents vote, fit the label model, fit the classifier."""
    require(docs, "doc_id", "text")
    require(labels, "doc_id", "toxic")
    lex = mine_terms(docs, labels, label_rows)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.pieces(batches, 1):
            v = votes(batch.column(1), lex)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_pack(v))], ["doc_id", "pattern"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    voted = staged(mapped(narrow, vote, "doc_id long, pattern long"), "votes")
    histogram = voted.groupBy("pattern").count().toPandas().sort_values("pattern")
    v, weight = unpack(histogram["pattern"].to_numpy(np.int64)), histogram["count"].to_numpy(float)
    label = LabelModel().fit(v, weight) if len(v) else LabelModel(rounds=1).fit(np.zeros((1, len(VOTERS)), np.int64), np.ones(1))
    post = label.posterior(v) if len(v) else np.zeros(0)
    n_pos = max(1.0, float(weight[post >= 0.5].sum()))
    n_neg = max(1.0, float(weight[post < 0.5].sum()))
    # the sample holds at most about train_rows ids, half of each class, so this side is always small
    positive = [int(x) for x in histogram["pattern"][post >= 0.5]]
    is_pos = F.col("pattern").isin(positive) if positive else F.lit(False)
    half = train_rows / 2
    chosen = voted.filter((is_pos & share("doc_id", min(1.0, half / n_pos))) | (~is_pos & share("doc_id", min(1.0, half / n_neg)))).select("doc_id").distinct()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.pieces(batches, 0):
            v, row, feature, value, _ = _features(batch.column(0), lex)
            order = np.argsort(row, kind="stable")
            start, count = _text.spans(row[order], len(v))
            cuts = pa.array(np.concatenate([start, [len(row)]]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_pack(v)), pa.ListArray.from_arrays(cuts, pa.array(feature[order].astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(value[order].astype(np.float32)))],
                ["pattern", "feature", "value"],
            )

    rows = mapped(narrow.join(F.broadcast(chosen), "doc_id", "left_semi").select("text"), features, "pattern long, feature array<int>, value array<float>").toArrow()
    weights, bias = _fit(rows, label)
    return Model(lex, label, weights, bias)


def _fit(rows: pa.Table, label: LabelModel, rounds: int = 120, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on the posterior labels by full-batch Adam."""
    w, bias = np.zeros((1 << DIM_BITS) + 9), 0.0
    if not rows.num_rows:
        return w, -10.0
    rows = rows.combine_chunks()
    y = label.posterior(unpack(rows["pattern"].to_numpy()))
    lists = rows["feature"].chunk(0)
    size = np.asarray(lists.value_lengths()).astype(np.int64)
    feature, value = lists.flatten().to_numpy().astype(np.int64), rows["value"].chunk(0).flatten().to_numpy().astype(float)
    owner = np.repeat(np.arange(len(size)), size)
    used, small = np.unique(feature, return_inverse=True)
    x = np.zeros(len(used))
    m, s = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    balance = np.where(y >= 0.5, 0.5 / max(1e-9, (y >= 0.5).sum()), 0.5 / max(1e-9, (y < 0.5).sum()))
    for t in range(1, rounds + 1):
        z = np.bincount(owner, x[small] * value, len(size)) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
        grad = np.append(np.bincount(small, g[owner] * value, len(used)) + l2 * x, g.sum())
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        step = 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        x, bias = x - step[:-1], bias - step[-1]
    w[used] = x
    return w, float(bias)


def predict(docs: DataFrame, model: Model, text: str = "text", name: str = "__toxic_score") -> DataFrame:
    """All columns of ``docs`` and the score as ``name``; null for a null text, low for one without a word."""
    at = docs.columns.index(text)
    lex, weights, bias = model.lexicons, model.weights, model.bias
    used = np.flatnonzero(weights)
    kept = weights[used].astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << DIM_BITS) + 9)
        w[used] = kept
        for batch in _text.pieces(batches, at):
            col = batch.column(at)
            _, row, feature, value, count = _features(col, lex)
            z = np.bincount(row, w[feature] * value, len(col)) + bias
            score = np.where(count > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
            null = np.asarray(col.is_null())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, mask=null)], [*batch.schema.names, name])

    return mapped(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, toxic_score, toxic) for every row of ``docs``, also null ids and repeated rows.

    A null text has a null score and isn't toxic.
    """
    model = train(docs, labels)
    scored = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", F.col("__toxic_score").alias("toxic_score"), F.coalesce(F.col("__toxic_score") >= threshold, F.lit(False)).alias("toxic"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows that aren't toxic, with their columns as they were."""
    model = train(docs, labels)
    name = fresh(docs, "__toxic_score")
    return predict(docs, model, name=name).filter(F.coalesce(F.col(name) < threshold, F.lit(True))).drop(name)
