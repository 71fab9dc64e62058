"""Nearest neighbours against brute force, over several partitions and blocks, and on odd tables."""

import numpy as np
import pytest

from scorelake.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, part int, v string"


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(e) for e in v], 1, 2, "x") for i, v in zip(ids, x)], SCHEMA)


def brute(ids, x, asked, k=10):
    s = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(s, -np.inf)
    return {int(ids[i]): [int(ids[j]) for j in np.lexsort((ids, -s[i]))[:k]] for i in np.flatnonzero(np.isin(ids, asked))}


def found(df):
    out: dict[int, list] = {}
    for r in sorted(df.collect(), key=lambda r: (r["vec_id"], r["rank"])):
        out.setdefault(r["vec_id"], []).append(r["neighbour_id"])
    return out


@pytest.mark.parametrize("clusters", [0, 12])
def test_recall_over_partitions_and_blocks(spark, clusters):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    if clusters:  # a third of all vectors lie in one cluster
        middle = rng.normal(size=(clusters, 24)) * 3
        x += middle[np.where(rng.random(3000) < 1 / 3, 0, rng.integers(0, clusters, 3000))].astype(np.float32)
    ids = rng.permutation(9000)[:3000]
    want = brute(ids, x, ids[ids % 50 == 0])
    got = found(ann.neighbours(frame(spark, ids, x), parts=8, block=256))
    assert sorted(got) == sorted(want)
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.9


def test_one_partition_gives_exactly_the_best_with_their_scores(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 7)).astype(np.float32)
    ids = np.arange(400)
    got = ann.neighbours(frame(spark, ids, x), parts=1).collect()
    assert found(ann.neighbours(frame(spark, ids, x), parts=1)) == brute(ids, x, ids[ids % 50 == 0])
    for r in got:
        assert r["score"] == pytest.approx(float(x[r["vec_id"]].astype(float) @ x[r["neighbour_id"]].astype(float)))


def test_ties_go_to_the_smaller_id_and_a_hot_group_of_equal_vectors_is_whole(spark):
    x = np.tile(np.array([[1.0, 2.0]], np.float32), (300, 1))
    got = found(ann.neighbours(frame(spark, np.arange(300), x), block=32))
    assert got[0] == list(range(1, 11)) and got[50] == list(range(10))


def test_odd_tables(spark):
    rows = [(0, None), (50, []), (None, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [1.0, 1.0, 1.0]), (7, [float("inf"), 0.0]), (8, [0.0, 0.0])]
    odd = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    assert found(ann.neighbours(odd)) == {100: [3, 8]}
    assert ann.neighbours(odd.limit(0)).count() == 0
    assert ann.neighbours(odd.filter("vec_id = 100")).count() == 0
    assert ann.neighbours(odd.filter("vec_id in (3, 8)")).count() == 0


def test_anisotropic_codes_keep_high_scores_better_than_plain_ones():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = ann.train(x)
    plain, aware = (ann.decode(ann.encode(x, centres, w), centres) for w in (1.0, 8.0))
    along = lambda y: np.abs(((x - y) * x).sum(axis=1)).mean()
    assert along(aware) < along(plain)
    codes = ann.encode(x, centres, 8.0)
    packed = ann.pack(codes)
    assert packed.shape == (2000, 8)
    q = x[:70]
    assert np.allclose(ann.scores(q, np.ascontiguousarray(packed.T).astype(np.intp), centres), q @ ann.decode(codes, centres).T, atol=1e-5)
