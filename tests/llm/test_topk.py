"""Exact top-k against a brute-force version."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import topk


def brute(queries, candidates, k):
    out = []
    candidates = {(i, tuple(v)) for i, v in candidates if i is not None and v is not None}
    for i, v in {(i, tuple(v)) for i, v in queries if i is not None and v is not None}:
        scores = [(sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in candidates if j != i]
        scores.sort(key=lambda x: (-x[0], x[1]))
        out += [(i, r, j, s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(spark, queries, candidates, k=3):
    schema = "vec_id long, vector array<long>, score int, q int"
    rows = [spark.createDataFrame([(*x, 1, 2) for x in y], schema) for y in (queries, candidates)]
    return sorted(map(tuple, topk.top_k(*rows, k).collect()))


def test_random_and_ties(spark, monkeypatch):
    chance = random.Random(1)
    rows = [(k, [chance.randint(-3, 3) for _ in range(6)]) for k in range(500)]
    rows += [(600, rows[0][1]), (601, rows[0][1]), (601, rows[0][1]), (602, None), (None, [1] * 6), (603, [0] * 6), (604, [5])]
    queries = [x for x in rows if x[0] is None or x[0] % 50 == 0 or x[0] > 599]
    want = brute(queries, rows, 3)
    assert found(spark, queries, rows) == want
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 90)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    assert found(spark, queries, rows) == want


def test_few_and_none(spark):
    rows = [(1, [1, 2]), (2, [3, 4])]
    assert found(spark, rows, rows) == brute(rows, rows, 3)
    assert found(spark, [], rows) == [] and found(spark, rows, []) == []
    assert found(spark, [(1, [])], [(1, []), (2, [])]) == [(1, 1, 2, 0)]


@pytest.mark.parametrize("size", [20_480_000, 1024 * 10**15, 2**63 - 1])
def test_large_components(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 300)
    chance = random.Random(size)
    rows = [(k, [chance.choice([-1, 1]) * (size - chance.randint(0, 9)) for _ in range(64)]) for k in range(150)]
    rows += [(k, [chance.randint(-9, 9) for _ in range(64)]) for k in range(150, 400)] + [(400, [size] * 64), (401, [-size] * 64)]
    queries = [x for x in rows if x[0] % 40 == 0]
    want = [(*x[:3], min(max(x[3], -(2**63)), 2**63 - 1)) for x in brute(queries, rows, 5)]
    assert found(spark, queries, rows, 5) == sorted(want)


def test_bounds_prune_before_all_is_read():
    chance = np.random.default_rng(4)
    vectors = np.floor(chance.normal(size=(4000, 16)) * 100).astype(np.int64)
    vectors[:40] *= 6
    lists = topk.SortedLists(np.arange(4000), vectors)
    for k in range(0, 4000, 400):
        scores = vectors @ vectors[k]
        scores[k] = -(10**12)
        want = np.lexsort((np.arange(4000), -scores))[:10]
        assert lists.top(vectors[k], 10, k).tolist() == want.tolist()


def test_quantized(spark):
    rows = [([0.5, -0.0001],), ([1.0, None],), ([float("nan")],), ([float("inf")],), (None,), ([],)]
    got = spark.createDataFrame(rows, "x array<float>").select(topk.quantized(F.col("x"))).collect()
    assert [x[0] for x in got] == [[512, -1], None, None, None, None, []]
