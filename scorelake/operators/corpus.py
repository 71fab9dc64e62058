"""Distances between sets of embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions.columns import cosine, dot


#: Largest dimension whose third moments (dim^3 sums) replace the sum over pairs.
MOST_CUBED = 128


def _sums(df: DataFrame, dim: int, vector: str, run, width: int) -> np.ndarray:
    """Sums over all partitions of the arrays of ``width`` numbers that ``run`` makes of each batch's matrix.

    A partition's array comes in pieces of 4096 numbers, which are added up by piece, so that no task
    holds more than its own array, and the driver one.
    """
    import pyarrow as pa

    piece = 4096

    def part(batches):
        total = np.zeros(width)
        for b in batches:
            x = np.asarray(b.column(0).flatten(), np.float64).reshape(-1, dim)
            for lo in range(0, len(x), 4096):
                total += run(x[lo : lo + 4096], [c.slice(lo, 4096) for c in b.columns[1:]])
        cuts = range(0, width, piece)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts), dtype=np.int32)), pa.array([total[c : c + piece] for c in cuts], pa.list_(pa.float64()))], ["i", "x"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(x) for x in rows["x"].to_pylist()], axis=0)
        return pa.table({"i": pa.array([rows["i"][0].as_py()], pa.int32()), "x": pa.array([total], pa.list_(pa.float64()))})

    rows = df.mapInArrow(part, "i int, x array<double>").groupBy("i").applyInArrow(add, "i int, x array<double>").toArrow().sort_by("i")
    return np.concatenate([np.asarray(x) for x in rows["x"].to_pylist()]) if rows.num_rows else np.zeros(width)


def _vectors(df: DataFrame, dim: int, vector: str, *others) -> DataFrame:
    return df.select(F.col(vector).cast("array<double>").alias("v"), *others).filter(F.size("v") == dim)


def moments(df: DataFrame, dim: int, vector: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """(count, mean, covariance by n - 1), from one distributed sum of outer products a partition.

    What reaches the driver is one matrix of the dimension's square, whatever the number of rows.
    """
    sums = _sums(_vectors(df, dim, vector), dim, vector, lambda x, _: np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).reshape(-1)]), 1 + dim + dim * dim)
    return _moments(sums, dim)


def _moments(sums: np.ndarray, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    n = sums[0]
    if n == 0:
        return 0, np.full(dim, np.nan), np.full((dim, dim), np.nan)
    mean = sums[1 : dim + 1] / n
    cov = (sums[dim + 1 :].reshape(dim, dim) - n * np.outer(mean, mean)) / max(n - 1, 1)
    return int(n), mean, cov


def frechet(m1: np.ndarray, c1: np.ndarray, m2: np.ndarray, c2: np.ndarray) -> float:
    """Frechet distance of two Gaussians; negative eigenvalues of singular covariances are cut to 0."""
    w, v = np.linalg.eigh(c1)
    root = (v * np.sqrt(np.maximum(w, 0))) @ v.T
    inner = np.linalg.eigvalsh(root @ c2 @ root)
    return float(((m1 - m2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * np.sqrt(np.maximum(inner, 0)).sum())


def fad(baseline: DataFrame, evaluation: DataFrame, dim: int, vector: str = "embedding", infinite: bool = False, steps: int = 15) -> dict[str, float]:
    """fad_overall, and with ``infinite`` fad_r2: the distance carried on to endless samples by a line over 1/n.

    For that the evaluation set is thinned by a hash in equal steps from a half to all of it, as
    published for the extrapolated distance. Rows fall into the steps' differences, whose sums come
    from one pass; each step is the sum of those before.
    """
    _, m1, c1 = moments(baseline, dim, vector)
    if not infinite:
        _, m2, c2 = moments(evaluation, dim, vector)
        return {"fad_overall": frechet(m1, c1, m2, c2)}
    width = 1 + dim + dim * dim
    edges = [int((0.5 + 0.5 * (k + 1) / steps) * 1_000_000) for k in range(steps)]

    def run(x, others):
        at = np.searchsorted(edges, others[0].to_numpy(), "right")
        out = np.zeros((steps, width))
        for k in np.unique(at):
            y = x[at == k]
            out[k] = np.concatenate([[len(y)], y.sum(axis=0), (y.T @ y).reshape(-1)])
        return out.reshape(-1)

    place = F.pmod(F.xxhash64("v"), F.lit(1_000_000)).alias("h")
    parts = _sums(_vectors(evaluation, dim, vector).select("v", place), dim, vector, run, steps * width).reshape(steps, width)
    x, y = [], []
    for sums in np.cumsum(parts, axis=0):
        n, m, c = _moments(sums, dim)
        if n > 1:
            x.append(1 / n)
            y.append(frechet(m1, c1, m, c))
    slope, cut = np.polyfit(x, y, 1) if len(x) > 1 else (0.0, y[0] if y else float("nan"))
    fit = np.polyval([slope, cut], x)
    spread = ((np.array(y) - np.mean(y)) ** 2).sum() if y else 0.0
    return {"fad_overall": float(cut), "fad_r2": float(1 - ((np.array(y) - fit) ** 2).sum() / spread) if spread else float("-inf")}


def kernel_distance(one: DataFrame, two: DataFrame, dim: int, key: str = "key", vector: str = "embedding") -> DataFrame:
    """One row, kid: unbiased squared maximum mean discrepancy with the kernel (x.y / d + 1)^3; null under two rows a side.

    The kernel's sum over all pairs is that of products of the sides' moments of order 1 to 3, so one
    pass over each side gives it whatever the number of rows. Beyond MOST_CUBED dimensions third
    moments outgrow a task, and pairs of blocks are summed instead. Vectors of another length take no part.
    """
    if dim > MOST_CUBED:
        return _kernel_by_pairs(one, two, dim, key, vector)
    width = 2 + dim + dim**2 + dim**3

    def run(x, _):
        cubes = np.zeros((dim, dim * dim))
        for lo in range(0, len(x), 256):  # products of two coordinates take dim times a slice's room
            y = x[lo : lo + 256]
            cubes += y.T @ (y[:, :, None] * y[:, None, :]).reshape(len(y), -1)
        own = ((x**2).sum(axis=1) / dim + 1) ** 3
        return np.concatenate([[len(x), own.sum()], x.sum(axis=0), (x.T @ x).reshape(-1), cubes.reshape(-1)])

    a, b = (_sums(_vectors(df, dim, vector), dim, vector, run, width) for df in (one, two))
    weight = np.repeat([3 / dim, 3 / dim**2, 1 / dim**3], [dim, dim**2, dim**3])
    total = lambda p, q: p[0] * q[0] + float((p[2:] * q[2:] * weight).sum())
    kid = None
    if min(a[0], b[0]) >= 2:
        within = lambda p: (total(p, p) - p[1]) / (p[0] * (p[0] - 1))
        kid = float(within(a) + within(b) - 2 * total(a, b) / (a[0] * b[0]))
    return one.sparkSession.createDataFrame([(kid,)], "kid double")


def _kernel_by_pairs(one: DataFrame, two: DataFrame, dim: int, key: str, vector: str) -> DataFrame:
    """The kernel distance by a grid of blocks; keys are unique in a side."""
    side = lambda df: _vectors(df, dim, vector, F.xxhash64(key).alias("h"), F.col(key).alias("i"))
    a, b = side(one), side(two)
    kernel = F.pow(dot("v", "w") / dim + 1, F.lit(3.0))
    pairs = lambda p, q: _grid(p, q).select(kernel.alias("k"), (F.col("i") == F.col("j")).alias("same"))
    within = lambda p: pairs(p, p).agg(F.sum(F.when(~F.col("same"), F.col("k"))).alias("k"), F.count_if("same").alias("n"))
    across = pairs(a, b).agg(F.avg("k").alias("kxy"))
    xx, yy = within(a).toDF("kx", "nx"), within(b).toDF("ky", "ny")
    each = lambda k, n: F.try_divide(F.col(k), F.col(n) * (F.col(n) - 1).cast("double"))
    return xx.crossJoin(yy).crossJoin(across).select((each("kx", "nx") + each("ky", "ny") - 2 * F.col("kxy")).alias("kid"))  # one row each


def _grid(p: DataFrame, q: DataFrame, rows: int = 4096) -> DataFrame:
    """All pairs of rows of two sides, in blocks of about ``rows`` each."""
    over = lambda df: max(4, -(-df.count() // rows))
    down, across = over(p), over(q)
    left = p.select("i", "v", F.pmod("h", F.lit(down)).cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("c"))
    right = q.select(F.col("i").alias("j"), F.col("v").alias("w"), F.pmod("h", F.lit(across)).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("r"))
    return left.join(right, ["r", "c"])


def paired_score(audio: DataFrame, text: DataFrame, key: str = "key", vector: str = "embedding") -> DataFrame:
    """One row, clap_score: mean cosine of paired embeddings. A key without text or a pair of unlike lengths is an error."""
    from scorelake.operators.pairing import require_text

    both = require_text(audio.select(key, F.col(vector).alias("va")), text.select(key, F.col(vector).alias("vb")), key)
    fit = F.when(F.size("va") == F.size("vb"), cosine("va", "vb")).otherwise(F.raise_error(F.lit("embeddings of a pair differ in length")).cast("double"))
    return both.agg(F.avg(fit).alias("clap_score"))
