"""Approximate nearest neighbours by inner product with score-aware anisotropic quantisation.

Product codes of 4 bits: each pair of dimensions has 16 centres, two codes make a byte. Codes and
centres minimise |r|^2 + (eta - 1) (r.x)^2 / |x|^2, so the part of a residual r along its vector,
which is what changes a high inner product, weighs eta times as much as the part across. Centres are
fitted on a bounded sample; every vector is coded and lies in the partition of its nearest coarse
centre. A query scans the tables of the partitions whose centres score best with it, as many as a
measurement on these very vectors says are needed, and reranks exactly what could reach its k best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm._common import mapped, require, share, staged

NEIGHBOURS, THRESHOLD, ROUNDS, MARGIN = 10, 0.2, 6, 3.0
#: Rows, and bytes, of the sample that all centres are fitted on.
SAMPLE_ROWS, SAMPLE_BYTES = 8_192, 64 << 20
#: There is a partition for each ROOT square roots of the number of vectors; vectors and queries of a
#: partition are cut into blocks of about these many rows, so that a hot one is many tasks.
ROOT, MOST_PARTS, BLOCK, QUERY_BLOCK = 16, 1_024, 32_768, 8_192
#: Share of the true neighbours that probing has to reach, measured with up to PROBE_QUERIES queries.
RECALL, PROBE_QUERIES = 0.97, 128
#: Queries are the rows whose id is divisible by this.
EVERY = 50


def eta(dim: int, threshold: float = THRESHOLD) -> float:
    """Weight of the parallel part for scores of ``threshold`` times the norms and over."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def encode(x: np.ndarray, centres: np.ndarray, weight: float, sweeps: int = 2) -> np.ndarray:
    """Codes (rows x subspaces): nearest centres first, then coordinate descent on the anisotropic loss."""
    n, (m, k, s) = len(x), centres.shape
    parts = x.reshape(n, m, s)
    dist = np.empty((n, m, k), np.float32)
    along = np.empty((n, m, k), np.float32)  # (x_m - c).x_m
    own = np.einsum("nms,nms->nm", parts, parts)
    for j in range(m):
        cross = parts[:, j] @ centres[j].T
        dist[:, j] = own[:, j, None] - 2 * cross + (centres[j] ** 2).sum(axis=1)
        along[:, j] = own[:, j, None] - cross
    codes = dist.argmin(axis=2)
    lam = (weight - 1) / np.maximum(own.sum(axis=1), 1e-12)
    rows = np.arange(n)
    total = np.take_along_axis(along, codes[:, :, None], axis=2)[:, :, 0].sum(axis=1)
    for _ in range(sweeps):
        for j in range(m):
            rest = total - along[rows, j, codes[:, j]]
            loss = dist[:, j] + lam[:, None] * (rest[:, None] + along[:, j]) ** 2
            codes[:, j] = loss.argmin(axis=1)
            total = rest + along[rows, j, codes[:, j]]
    return codes.astype(np.uint8)


def decode(codes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    m = centres.shape[0]
    return centres[np.arange(m), codes].reshape(len(codes), -1)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten(), np.float32).reshape(-1, dim)


def valid(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """((vec_id, v) fit for search, dimension): null ids, and vectors that are null, hold null or not finite values or differ in length from most, take no part.

    An id that is repeated counts once, with its least vector.
    """
    require(vectors, key, vector)
    v = F.col(vector).cast("array<float>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = most["n"] if most else 0
    return rows.filter(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v")), dim


def sample(rows: DataFrame, n: int, dim: int) -> np.ndarray:
    """About SAMPLE_ROWS of the vectors, at most SAMPLE_BYTES of them, chosen by a hash of the id."""
    most = max(256, min(SAMPLE_ROWS, SAMPLE_BYTES // (4 * dim)))
    some = rows if n <= most else rows.filter(share("vec_id", most / n))
    got = some.select("vec_id", "v").toArrow().combine_chunks().sort_by("vec_id")
    return np.concatenate([_matrix(c, dim) for c in got["v"].chunks]) if got.num_rows else np.zeros((0, dim), np.float32)


def train(x: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centres (subspaces x 16 x values) by weighted Lloyd rounds over the rows of ``x``."""
    dim = x.shape[1]
    s = 2 if dim % 2 == 0 else 1
    m = dim // s
    weight = eta(dim)
    parts = x.reshape(-1, m, s)
    rng = np.random.default_rng(7)
    centres = np.stack([parts[rng.permutation(np.resize(np.arange(len(x)), max(16, len(x))))[:16] % len(x), j] for j in range(m)]).astype(np.float32)
    centres += rng.normal(0, 1e-3 * (np.abs(x).mean() + 1e-9), centres.shape).astype(np.float32)
    wide = s * s + s
    parts = parts.astype(float)
    own = np.einsum("nms,nms->nm", parts, parts)
    lam = (weight - 1) / np.maximum(own.sum(axis=1), 1e-12)[:, None]
    left = (np.eye(s)[None, None] + lam[..., None, None] * parts[..., :, None] * parts[..., None, :]).reshape(len(x), m, -1)
    for _ in range(rounds):
        codes = encode(x, centres, weight)
        along = np.einsum("nms,nms->nm", parts - centres[np.arange(m), codes], parts)
        rest = along.sum(axis=1, keepdims=True) - along
        both = np.concatenate([left, parts * (1 + lam * (rest + own))[..., None]], axis=2)
        new = centres.astype(float)
        for j in range(m):
            got = np.stack([np.bincount(codes[:, j], both[:, j, w], 16) for w in range(wide)], axis=1)
            for c in range(16):
                a = got[c, : s * s].reshape(s, s)
                if np.trace(a) > 0.5:
                    new[j, c] = np.linalg.solve(a + 1e-9 * np.eye(s), got[c, s * s :])
        centres = new.astype(np.float32)
    return centres


def coarse(x: np.ndarray, parts: int, rounds: int = 10) -> np.ndarray:
    """Centres of partitions by Lloyd rounds over the rows of ``x``; an empty one keeps its place."""
    rng = np.random.default_rng(3)
    centres = x[rng.permutation(len(x))[: min(parts, len(x))]].astype(np.float64)
    for _ in range(rounds if len(centres) > 1 else 1):
        at = nearest(x, centres)
        many = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], centres)
    return centres.astype(np.float32)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres.astype(np.float64) ** 2).sum(axis=1) / 2
    return np.concatenate([(x[p : p + 4096] @ centres.T - half).argmax(axis=1) for p in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def tables(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Score tables of queries (queries x bytes x 256): two subspaces of 16 make one table of 256."""
    m, k, s = centres.shape
    t = np.einsum("qms,mks->qmk", q.reshape(len(q), m, s), centres)
    if m % 2:
        t = np.concatenate([t, np.zeros((len(q), 1, k), t.dtype)], axis=1)
    return (t[:, 0::2, None, :] + t[:, 1::2, :, None]).reshape(len(q), -1, 256)


def pack(codes: np.ndarray) -> np.ndarray:
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), codes.dtype)], axis=1)
    return codes[:, 0::2] | codes[:, 1::2] << 4


def scores(q: np.ndarray, index: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Approximate scores (queries x vectors): each byte of a code looks up one row of all the queries' tables."""
    t = np.ascontiguousarray(tables(q, centres).astype(np.float32).transpose(1, 2, 0))
    n = index.shape[1]
    out = np.empty((n, len(q)), np.float32)
    for lo in range(0, n, 4096):
        part = out[lo : lo + 4096]
        np.take(t[0], index[0, lo : lo + 4096], axis=0, out=part, mode="clip")
        for b in range(1, len(index)):
            part += t[b].take(index[b, lo : lo + 4096], axis=0, mode="clip")
    return np.ascontiguousarray(out.T)


def scan(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, packed: np.ndarray, spread: np.ndarray, centres: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, neighbour id, exact score) of each query's k best in a block, itself apart.

    The table scan gives scores within about ``spread`` times the query's norm. The k best of them
    are scored exactly; so is every other vector that could beat the k-th of these.
    """
    order = np.argsort(ids, kind="stable")
    ids, x, packed, spread = ids[order], x[order].astype(np.float64), packed[order], spread[order]
    index = np.ascontiguousarray(packed.T).astype(np.intp)
    norms = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    place = np.minimum(np.searchsorted(ids, q_ids), len(ids) - 1)
    place = np.where(ids[place] == q_ids, place, -1)
    out_q, out_n, out_s = [], [], []
    for lo in range(0, len(q), 64):
        found = scores(q[lo : lo + 64], index, centres)
        for a in range(len(found)):
            score, vec, own = found[a], q[lo + a].astype(np.float64), place[lo + a]
            if own >= 0:
                score[own] = -np.inf
            some = min(k, len(x) - (own >= 0))
            if some <= 0:
                continue
            near = np.argpartition(score, len(x) - some)[-some:]
            least = (x[near] @ vec).min()
            maybe = np.flatnonzero(score + spread * norms[lo + a] >= least)
            exact = x[maybe] @ vec
            best = np.lexsort((ids[maybe], -exact))[:k]
            out_q.append(np.full(len(best), q_ids[lo + a]))
            out_n.append(ids[maybe[best]])
            out_s.append(exact[best])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_n), np.concatenate(out_s)


def probes_needed(coded: DataFrame, asked: DataFrame, n_asked: int, centres: np.ndarray, dim: int, k: int, recall: float = RECALL) -> int:
    """How many partitions a query has to probe for ``recall`` of its k best.

    Measured: about PROBE_QUERIES of the queries, chosen by hash, are scored exactly against all
    vectors in one pass, and the places of their true neighbours' partitions in their order are counted.
    """
    if len(centres) == 1:
        return 1
    some = asked if n_asked <= PROBE_QUERIES else asked.filter(share("vec_id", PROBE_QUERIES / n_asked))
    got = some.select("vec_id", "v").toArrow().combine_chunks()
    if not got.num_rows:
        return len(centres)
    q, q_ids = np.concatenate([_matrix(c, dim) for c in got["v"].chunks]), got["vec_id"].to_numpy()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = np.zeros((len(q), 0), np.float32)
        part = np.zeros((len(q), 0), np.int32)
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
            s = q @ x.T
            s[q_ids[:, None] == ids[None]] = -np.inf
            score = np.concatenate([score, s], axis=1)
            part = np.concatenate([part, np.broadcast_to(batch.column(2).to_numpy(), s.shape)], axis=1)
            if score.shape[1] > k:
                top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                score, part = np.take_along_axis(score, top, 1), np.take_along_axis(part, top, 1)
        owner = np.repeat(np.arange(len(q), dtype=np.int32), score.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(part.reshape(-1)), pa.array(score.reshape(-1))], ["q", "part", "score"])

    found = mapped(coded.select("vec_id", "v", "part"), best, "q int, part int, score float").filter("score > float('-inf')")
    top = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "part"))).filter(F.col("n") <= k).select("q", "part").toPandas()
    if top.empty:
        return 1
    order = np.argsort(np.argsort(-(q @ centres.T), axis=1), axis=1)
    places = np.sort(order[top["q"].to_numpy(), top["part"].to_numpy()])
    return int(places[max(0, math.ceil(recall * len(places)) - 1)]) + 1


def _cut(sizes: dict[int, int], parts: int, block: int):
    """Number of blocks of each partition, as an array to index by the partition."""
    return [max(1, -(-sizes.get(p, 0) // block)) for p in range(parts)]


def neighbours(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, queries: Column | None = None, block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """(vec_id, rank, neighbour_id, score): the k best other vectors by inner product of every query.

    Queries are the rows for which ``queries`` over (vec_id, v) holds, those with an id divisible by
    EVERY if it isn't given; all vectors are searched. Ties go to the smaller id. Vectors that
    ``valid`` leaves out have no row; with fewer than k others all that were probed are returned; an
    empty table gives no row. A partition's vectors and queries meet in blocks of bounded size, so
    neither a hot partition nor a third of equal vectors comes to one task; each cell returns k rows
    a query at most.
    """
    rows, dim = valid(vectors, key, vector)
    rows = staged(rows, "vectors")
    n = rows.count()
    if n < 2 or dim == 0:
        return vectors.sparkSession.createDataFrame([], "vec_id long, rank int, neighbour_id long, score double")
    fit = sample(rows, n, dim)
    centres, weight = train(fit), eta(dim)
    middles = coarse(fit, parts or min(MOST_PARTS, math.ceil(math.sqrt(n) / ROOT)))
    p = len(middles)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x = _matrix(part.column(1), dim)
                codes = encode(x, centres, weight)
                off = np.linalg.norm(x - decode(codes, centres), axis=1)
                bits = pa.array([c.tobytes() for c in pack(codes)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), bits, pa.array((MARGIN * off / np.sqrt(dim)).astype(np.float32)), pa.array(nearest(x, middles).astype(np.int32))], ["vec_id", "v", "codes", "spread", "part"])

    coded = staged(mapped(rows.select("vec_id", "v"), code, "vec_id long, v array<float>, codes binary, spread float, part int"), "codes")
    asked = rows.filter(F.col("vec_id") % EVERY == 0 if queries is None else queries)
    n_asked = asked.count()
    probes = probes_needed(coded, asked, n_asked, middles, dim, k)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.argsort(-(_matrix(batch.column(1), dim) @ middles.T), axis=1, kind="stable")[:, :probes]
            owner = pa.array(np.repeat(np.arange(len(at)), probes))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(at.reshape(-1).astype(np.int32))], ["vec_id", "v", "part"])

    sent = mapped(asked.select("vec_id", "v"), probe, "vec_id long, v array<float>, part int")
    # a row a partition, of which there are MOST_PARTS at most
    sizes = _cut({r["part"]: r["count"] for r in coded.groupBy("part").count().collect()}, p, block)
    waits = _cut({r["part"]: r["count"] for r in sent.groupBy("part").count().collect()}, p, QUERY_BLOCK)
    upto = lambda counts: F.sequence(F.lit(0), F.lit(counts)[F.col("part")] - 1)
    own = lambda counts: F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(counts)[F.col("part")]).cast("int")
    # numbers of tasks by name: cells cost work, not bytes, so that adaptive planning would put all in one task
    cells = min(8_192, 2 * sum(a * b for a, b in zip(sizes, waits)))
    left = sent.select("vec_id", "v", "part", F.explode(upto(sizes)).alias("block"), own(waits).alias("wait")).repartition(cells, "part", "block", "wait")
    right = coded.select("vec_id", "v", "codes", "spread", "part", own(sizes).alias("block"), F.explode(upto(waits)).alias("wait")).repartition(cells, "part", "block", "wait")

    def cell(one: pa.Table, two: pa.Table) -> pa.Table:
        schema = pa.schema([("vec_id", pa.int64()), ("neighbour_id", pa.int64()), ("score", pa.float64())])
        if not one.num_rows or not two.num_rows:
            return schema.empty_table()
        flat = lambda t: np.concatenate([_matrix(c, dim) for c in t["v"].chunks])
        packed = np.frombuffer(b"".join(two["codes"].to_pylist()), np.uint8).reshape(two.num_rows, -1)
        q, nn, s = scan(flat(one), one["vec_id"].to_numpy(), flat(two), two["vec_id"].to_numpy(), packed, two["spread"].to_numpy(), centres, k)
        return pa.table([pa.array(q, pa.int64()), pa.array(nn, pa.int64()), pa.array(s)], schema=schema)

    found = left.groupBy("part", "block", "wait").cogroup(right.groupBy("part", "block", "wait")).applyInArrow(cell, "vec_id long, neighbour_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "neighbour_id")))
    return ranked.filter(F.col("rank") <= k).select("vec_id", "rank", "neighbour_id", "score")


def oracle(k: int = NEIGHBOURS, every: int = EVERY) -> str:
    """Exact neighbours of the same queries; scores are rounded, as sums of products come in another order."""
    return f"""WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT q.vec_id, x.vec_id AS neighbour_id, list_dot_product(q.e, x.e) AS score FROM v q JOIN v x ON q.vec_id % {every} = 0 AND q.vec_id <> x.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour_id) AS INTEGER) AS rank FROM s)
SELECT vec_id, rank, neighbour_id, round(score, 5) AS score FROM r WHERE rank <= {k}"""
