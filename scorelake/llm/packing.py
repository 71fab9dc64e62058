"""Length buckets with the least padding, and token-budget batches inside each bucket.

The global histogram of lengths goes to the driver (one row a distinct length); dynamic programming
chooses the bucket boundaries. A document's place in its bucket is its place among all, sorted over
ranges of length and id, less the documents of the buckets before, known from the histogram.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm._common import numbered, require, staged

BUCKETS, BUDGET = 8, 8192


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds, ascending, of at most ``buckets`` buckets with the least total padding.

    ``lengths`` are distinct and ascending. Each bucket pads to its longest member. Of equally good
    choices the one with the earliest cuts is taken. With fewer distinct lengths than buckets every
    length has its own.
    """
    n = len(lengths)
    if n <= buckets:
        return [int(x) for x in lengths]
    x = np.asarray(lengths, np.int64)
    many = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])
    total = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64) * x)])

    def cost(i, j):  # lengths i to j - 1 in one bucket
        return x[j - 1] * (many[j] - many[i]) - (total[j] - total[i])

    best = np.array([0] + [int(cost(0, j)) for j in range(1, n + 1)], np.int64)
    cuts = []
    for k in range(2, buckets + 1):
        new, cut = np.full(n + 1, np.iinfo(np.int64).max, np.int64), np.zeros(n + 1, np.int64)
        # the best cut never moves back as j grows (quadrangle inequality): divide and conquer
        todo = [(k, n, k - 1, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            value = best[i] + cost(i, j)
            at = int(np.argmin(value))
            new[j], cut[j] = value[at], i[at]
            todo += [(lo, j - 1, a, int(i[at])), (j + 1, hi, int(i[at]), b)]
        best = new
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        out.append(int(x[j - 1]))
        j = int(cut[j])
    out.append(int(x[j - 1]))
    return out[::-1]


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens): runs of characters that aren't white space; 1 for a null or blank text, which still takes a row."""
    require(docs, key, text)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.greatest(F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)), F.lit(1)).cast("long").alias("n_tokens"))


def pack(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, n_tokens, bucket_len, batch, slot) of every row of (doc_id, n_tokens).

    A batch holds as many rows as fit the budget when padded to the bucket's length, one at least:
    a document longer than the budget is a batch alone. Rows are ordered by length, then id (nulls
    first); repeated rows each have a slot. An empty table gives no row. Rows are sorted over ranges of
    (length, id), so a length that a third of all documents have lies in many tasks.
    """
    lengths = staged(lengths.select("doc_id", "n_tokens"), "lengths")
    histogram = lengths.groupBy("n_tokens").count().toPandas().sort_values("n_tokens")
    if histogram.empty:
        return lengths.select("doc_id", "n_tokens", *(F.lit(None).cast("long").alias(c) for c in ("bucket_len", "batch", "slot")))
    x, n = histogram["n_tokens"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64)
    bounds = boundaries(x, n, buckets)
    # rows in the buckets before each
    before = [int(n[x <= low].sum()) for low in [-1, *bounds[:-1]]]
    bucket = F.when(F.lit(False), F.lit(0))
    for i, high in enumerate(bounds):
        bucket = bucket.when(F.col("n_tokens") <= high, F.lit(i))
    placed = numbered(lengths, F.col("n_tokens"), F.col("doc_id").asc_nulls_first(), name="__place").withColumn("__bucket", bucket)
    of = lambda values: F.lit([int(v) for v in values])[F.col("__bucket")].cast("long")
    sized = placed.withColumns({"bucket_len": of(bounds), "__place": F.col("__place") - 1 - of(before)})
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len")))
    return sized.select("doc_id", "n_tokens", "bucket_len", F.floor(F.col("__place") / capacity).cast("long").alias("batch"), (F.col("__place") % capacity).cast("long").alias("slot"))


def oracle(buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """The same rows by SQL: one common table a layer of the dynamic programme."""
    layers = []
    for k in range(2, buckets + 1):
        layers.append(
            f"l{k} AS (SELECT j, min(c) AS c, arg_min(i, (c, i)) AS i FROM (SELECT h.j, p.j AS i, p.c + h.x * (h.m - q.m) - (h.s - q.s) AS c "
            f"FROM h JOIN l{k - 1} p ON p.j < h.j JOIN h q ON q.j = p.j) GROUP BY j)"
        )
    walk = f"w{buckets} AS (SELECT max(j) AS j FROM h)"
    for k in range(buckets - 1, 0, -1):
        walk += f", w{k} AS (SELECT l.i AS j FROM w{k + 1} w JOIN l{k + 1} l ON l.j = w.j)"
    bounds = " UNION ALL ".join(f"SELECT h.x FROM w{k} w JOIN h ON h.j = w.j" for k in range(1, buckets + 1))
    return f"""WITH d AS (SELECT doc_id, CAST(greatest(coalesce(len(regexp_extract_all(text, '\\S+')), 0), 1) AS BIGINT) AS n_tokens FROM documents),
g AS (SELECT n_tokens AS x, count(*) AS n FROM d GROUP BY 1),
h AS (SELECT x, CAST(row_number() OVER (ORDER BY x) AS BIGINT) AS j, CAST(sum(n) OVER (ORDER BY x) AS BIGINT) AS m, CAST(sum(n * x) OVER (ORDER BY x) AS BIGINT) AS s FROM g),
l1 AS (SELECT j, x * m - s AS c, CAST(0 AS BIGINT) AS i FROM h),
{', '.join(layers)},
{walk},
b AS (SELECT DISTINCT x FROM (SELECT x FROM ({bounds}) WHERE (SELECT count(*) FROM h) > {buckets} UNION ALL SELECT x FROM h WHERE (SELECT count(*) FROM h) <= {buckets})),
t AS (SELECT d.doc_id, d.n_tokens, (SELECT min(b.x) FROM b WHERE b.x >= d.n_tokens) AS bucket_len FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket_len ORDER BY n_tokens, doc_id NULLS FIRST) - 1 AS p, greatest(1, CAST(floor({budget} / bucket_len) AS BIGINT)) AS k FROM t)
SELECT doc_id, n_tokens, CAST(bucket_len AS BIGINT) AS bucket_len, CAST(p // k AS BIGINT) AS batch, CAST(p % k AS BIGINT) AS slot FROM r"""
