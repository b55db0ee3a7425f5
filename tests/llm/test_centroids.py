"""Centroid clustering against a brute-force version."""

import hashlib
import math
import random

import numpy as np
import pytest

from tidemark.llm.centroids import LONGEST, CentroidLists, cluster_vectors

SCHEMA = "vec_id long, embedding array<double>, cluster string, c int"


def brute(rows, k, rounds, width, seed=3):
    kept = [
        (i, v, tuple(int(x) * 1024 if abs(x) >= 2**53 else math.floor(1024 * x) for x in v)) for i, v in rows
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)
    ]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v, w) for i, v, w in kept if i is not None)
    centroids = [w for _, _, w in start[:k]]
    if not centroids:
        return []

    def nearest(w):
        return min((sum((a - b) ** 2 for a, b in zip(w, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, _, w in kept:
            groups.setdefault(nearest(w)[1], []).append(w)
        centroids = [
            tuple(sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)) if n in groups else c
            for n, c in enumerate(centroids)
        ]
    last = [(i, *nearest(w)) for i, _, w in kept]
    sums = {n: sum(d for _, d, m in last if m == n) for n in range(len(centroids))}
    return sorted(((
        i, n, min(d, LONGEST), min(sums[n], LONGEST), min(sum(sums.values()), LONGEST), ",".join(map(str, centroids[n]))
    ) for i, d, n in last), key=str)


def found(spark, rows, k, rounds, width):
    frame = spark.createDataFrame([(*x, "x", 5) for x in rows], SCHEMA).repartition(3)
    out = cluster_vectors(frame, k, rounds, width)
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    assert set(out.columns) == {*columns, "embedding", "c"}
    return sorted(map(tuple, out.select(*columns).collect()), key=str)


def test_random_and_odd_rows(spark):
    chance = random.Random(2)
    rows = [(i, [chance.gauss(i % 4, 0.3) for _ in range(5)]) for i in range(300)]
    rows += [(7, rows[7][1]), (8, rows[9][1]), (None, rows[3][1]), (400, None), (401, [1.0] * 4), (402, [])]
    rows += [(403, [1.0, None, 1.0, 1.0, 1.0]), (404, [math.nan] * 5), (405, [math.inf] * 5), (406, [-0.0] * 5)]
    assert found(spark, rows, 8, 10, 5) == brute(rows, 8, 10, 5)
    assert found(spark, rows, 1, 2, 5) == brute(rows, 1, 2, 5)


def test_ties_and_equal_vectors(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(40)]
    assert found(spark, rows, 8, 3, 2) == brute(rows, 8, 3, 2)


def test_large_components(spark):
    rows = [(i, [x, 1.0]) for i, x in enumerate([2e5, -2e5, 1e15, 1e15 + 2, -1e300, 1.7e308, 0.5, 0.25, 1e9, 1e4])]
    assert found(spark, rows, 3, 4, 2) == brute(rows, 3, 4, 2)


def test_few_and_none(spark):
    assert found(spark, [(1, [0.5, 2.0]), (2, [0.5, 3.0])], 8, 10, 2) == brute([(1, [0.5, 2.0]), (2, [0.5, 3.0])], 8, 10, 2)
    assert found(spark, [], 8, 10, 2) == []
    assert found(spark, [(None, [0.5, 2.0])], 8, 10, 2) == []


@pytest.mark.parametrize("width", [1, 3, 64])
def test_threshold_stops_early_and_right(width):
    chance = np.random.default_rng(width)
    centroids = chance.integers(-50, 50, (12, width))
    rows = chance.integers(-60, 60, (500, width))
    number, best = CentroidLists(centroids).nearest(rows)
    far = ((rows[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (number == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()
