"""Exponion clustering against plain Lloyd rounds in exact integers; ties, repeats, odd vectors."""

import hashlib

import numpy as np
import pytest

from bidlattice.llm import exponion

SCHEMA = "vec_id long, embedding array<float>"


def plain_lloyd(vectors, k, rounds, salt="2:"):
    order = sorted(vectors, key=lambda i: hashlib.sha256(f"{salt}{i}".encode()).hexdigest())[:k]
    c = [vectors[i].copy() for i in order]
    for n in range(rounds + 1):
        far = {i: [int(((v - m) ** 2).sum()) for m in c] for i, v in vectors.items()}
        near = {i: d.index(min(d)) for i, d in far.items()}
        if n < rounds:
            for j in range(len(c)):
                mine = [vectors[i] for i in vectors if near[i] == j]
                if mine:
                    c[j] = np.array([sum(int(x) for x in col) // len(mine) for col in zip(*mine, strict=True)])
    return {i: (near[i], far[i][near[i]]) for i in vectors}, c


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_against_plain_lloyd(spark, spread):
    """Vectors in tight groups, where most centroids are skipped, and with many ties and repeats."""
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 8))
    raw = {i: np.float32(middles[i % 12] + spread * rng.normal(size=8)) if i % 5 else np.float32(np.round(middles[i % 12])) for i in range(400)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in raw.items()], SCHEMA).repartition(5)
    found, centroids = exponion.cluster(df, k=15, rounds=4, width=8)
    want, c = plain_lloyd({i: np.floor(256 * v.astype(np.float64)).astype(np.int64) for i, v in raw.items()}, 15, 4)
    rows = found.collect()
    assert {r.vec_id: (r.cluster, r.distance) for r in rows} == want and np.array_equal(np.array(c), centroids)
    if spread < 1:
        assert sum(r.looked for r in rows) < 0.5 * 15 * len(rows)


def test_bounds_skip_nothing_that_ties():
    """All centroids as far from the vectors: the smallest number wins in every round."""
    c = np.array([[4, 0], [-4, 0], [0, 4], [0, -4]], np.int64)
    r = exponion._Round(c, None)
    v = np.zeros((3, 2), np.int64)
    near, upper, lower = np.array([0, 0, 0]), np.full(3, np.inf), np.zeros(3)
    r.assign(v, near, upper, lower)
    assert near.tolist() == [0, 0, 0]
    near, upper, lower = np.array([3, 2, 1]), np.full(3, np.inf), np.zeros(3)
    exponion._Round(c, c).assign(v, near, upper, lower)
    assert near.tolist() == [0, 0, 0] and (lower <= 4).all() and (upper >= 4).all()
    again = near.copy()
    looked = exponion._Round(c, c).assign(v, again, upper, lower)
    assert again.tolist() == [0, 0, 0] and looked.min() >= 1


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0] * 63), (4, [nan] + [0.0] * 63), (5, [inf] + [0.0] * 63), (6, [None] + [0.0] * 63), (7, [0.5] * 64), (7, [0.5] * 64), (None, [-0.001] * 64)]
    got = exponion.clusters_with_inertia(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS cluster", "1 AS v")).collect()
    assert sorted((r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia) for r in got) == [(0, 2, 0, 0, 0), (7, 0, 0, 0, 0), (7, 0, 0, 0, 0)]
    assert {r.centroid_sha256 for r in got if r.vec_id is None} == {hashlib.sha256(",".join(["-1"] * 64).encode()).hexdigest()}
    assert exponion.clusters_with_inertia(spark.createDataFrame(rows[:6], SCHEMA)).count() == 0
    with pytest.raises(Exception, match="too large"):
        exponion.clusters_with_inertia(spark.createDataFrame([(1, [3e38] * 64)], SCHEMA)).count()
