"""Repeated rows and ids in the exact top-k search, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import kd_search


def brute(rows, k, scale=256):
    ints = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows]
    out = []
    for q in sorted({i for i, _ in ints if i % 3 == 0}):
        pairs = {(-sum(x * y for x, y in zip(a, b)), i) for j, a in ints if j == q for i, b in ints if i != q}
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(pairs)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed, shards, leaf", [(1, 1000, 3), (2, 20, 3), (3, 1000, 128), (4, 9, 2)])
def test_repeated_ids(spark, seed, shards, leaf, monkeypatch):
    monkeypatch.setattr(kd_search, "SHARD_ROWS", shards)
    monkeypatch.setattr(kd_search, "BLOCK_QUERIES", 5)
    monkeypatch.setattr(kd_search, "LEAF", leaf)
    rnd = random.Random(seed)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(40)]
    rows += [rows[i] for i in range(0, 40, 4) for _ in range(7)]  # the same rows again, queries among them
    rows += [(50 + i % 6, [0.5, 0.5, 0.5, 0.5]) for i in range(60)]  # a mass of equal vectors of few ids
    rows += [(60, [rnd.uniform(-1, 1) for _ in range(4)]) for _ in range(8)]  # one id, several vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in kd_search.top_k(df, F.col("vec_id") % 3 == 0, 5).collect())
    assert got == brute(rows, 5)


def test_large_finite_components(spark, monkeypatch):
    """Vectors beyond 2^53, and beyond 64 bits in their products, take part and are ranked exactly."""
    monkeypatch.setattr(kd_search, "SHARD_ROWS", 5)
    rnd = random.Random(9)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(3)]) for i in range(20)]
    rows += [(20 + i, [rnd.choice([1e14, -1e14, 3e13, 1.0]) + rnd.randint(0, 9) for _ in range(3)]) for i in range(8)]
    rows += [(30, [1e300, -1.0, 2.0]), (31, [1.7e308, 1.0, 1.0]), (33, [1e300, -1.0, 2.5])]
    rows += [(40, [float("nan"), 0.0, 0.0]), (41, [float("inf"), 0.0, 0.0]), (42, [None, 0.0, 0.0]), (43, None), (44, [])]
    rows += [(45, [1.0, 2.0])]  # of another length
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in kd_search.top_k(df, F.col("vec_id") % 3 == 0, 5).collect())
    exact = lambda x: math.floor(256 * x) if math.isfinite(256 * x) else int(x) * 256
    ints = [(i, [exact(x) for x in v]) for i, v in rows if i < 40]
    want = []
    for q, a in ints:
        if q % 3 == 0:
            pairs = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints if i != q)
            want += [(q, r, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, i) in enumerate(pairs[:5], 1)]
    assert got == sorted(want)
