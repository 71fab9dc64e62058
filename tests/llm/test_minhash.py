"""Near duplicates through buckets of any size, against all pairs of each bucket."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.llm import minhash
from scorelake.llm.graph import components


def groups(found):
    return {r["node"]: r["root"] for r in components(found.select("a", "b")).collect()}


def by_all_pairs(rows, threshold):
    root = {n: n for n, _, _ in rows}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, (a, s, p) in enumerate(rows):
        for b, t, q in rows[:i]:
            if set(p) & set(q) and minhash.similarity(np.frombuffer(s, np.uint8), np.frombuffer(t, np.uint8)[None])[0] >= threshold:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    found = {n: find(n) for n in root}
    return {n: r for n, r in found.items() if n != r or list(found.values()).count(r) > 1}


def signature(low):
    return minhash.pack(low[None])[0].tobytes()


@pytest.mark.parametrize("most", [4096, 8])
@pytest.mark.parametrize("kind", ["tight", "loose", "chain", "mixed"])
def test_hot_buckets_lose_no_link(spark, kind, most):
    rng = np.random.default_rng(len(kind))
    base = rng.integers(0, 1 << 32, minhash.HASHES, dtype=np.uint32)
    rows = []
    for i in range(90):
        low = base.copy()
        other = rng.integers(0, 1 << 32, minhash.HASHES, dtype=np.uint32)
        if kind == "tight":
            change = rng.random(minhash.HASHES) < 0.1
        elif kind == "loose":
            change = rng.random(minhash.HASHES) < 0.75
        elif kind == "chain":  # each like its neighbours only
            change, other = np.arange(minhash.HASHES) < i * 1.4, np.random.default_rng(99).integers(0, 1 << 32, minhash.HASHES, dtype=np.uint32)
        else:
            change = rng.random(minhash.HASHES) < (0.1 if i % 3 else 0.8)
        low[change] = other[change]
        rows.append((i * 7 % 90, signature(low), [1, 100 + i, 200 + i % 5]))
    df = spark.createDataFrame(rows, "node long, sig binary, bands array<long>")
    assert groups(minhash.edges(df, 0.45, most)) == by_all_pairs(rows, 0.45)


def test_one_group_of_a_third_of_the_documents(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(4000)]
    base = list(rng.choice(words, 120))
    texts = []
    for i in range(240):
        text = list(base) if i % 3 == 0 else list(rng.choice(words, 120))
        if i % 3 == 0:
            text[int(rng.integers(0, 120))] = f"x{i}"
        texts.append((i, " ".join(text)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    nodes = minhash.signatures(docs).select(F.col("doc_id").alias("node"), "sig", "bands")
    whole, cut = (groups(minhash.edges(nodes, most=m)) for m in (4096, 16))
    assert whole == cut == {i: 0 for i in range(0, 240, 3)}


def test_edges_of_nothing(spark):
    none = spark.createDataFrame([], "node long, sig binary, bands array<long>")
    assert minhash.edges(none).count() == 0
    assert minhash.edges(spark.createDataFrame([(1, signature(np.zeros(minhash.HASHES, np.uint32)), [5])], none.schema)).count() == 0
