"""The semantic channel at any size of the vocabulary, against a dense SVD."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import semantic


def weights_of(seed, rows, terms):
    rnd = random.Random(seed)
    return [(i, f"t{t}", rnd.uniform(0.1, 1.0)) for i in range(rows) for t in rnd.sample(range(terms), rnd.randint(1, 9))]


def dense_cosines(weights, k):
    ids, terms = sorted({i for i, _, _ in weights}), sorted({t for _, t, _ in weights})
    x = np.zeros((len(ids), len(terms)))
    for i, t, w in weights:
        x[ids.index(i), terms.index(t)] = w
    v = x @ np.linalg.svd(x, full_matrices=False)[2][:k].T
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return v @ v.T


@pytest.mark.parametrize("block, gramian, salt", [(8192, 2048, 50_000), (8192, 0, 50_000), (16, 0, 50_000), (16, 0, 7)])
def test_vectors_equal_a_dense_svd(spark, monkeypatch, block, gramian, salt):
    monkeypatch.setattr(semantic, "BLOCK_TERMS", block)
    monkeypatch.setattr(semantic, "GRAMIAN_TERMS", gramian)
    monkeypatch.setattr(semantic.ManyBlocks, "SALT_ROWS", salt)
    rows = weights_of(1, 40, 60)
    df = spark.createDataFrame(rows, "id long, term string, weight double")
    ids = df.select("id").distinct().unionByName(spark.createDataFrame([(99,)], "id long"))
    got = {r.id: np.array(r.v) for r in semantic.svd_vectors(df, ids, 6).collect()}
    assert not got.pop(99).any() and len(got) == 40
    v = np.array([got[i] for i in sorted(got)])
    assert np.allclose(v @ v.T, dense_cosines(rows, 6), atol=1e-3)


def test_both_halves_are_one_unit_vector(spark):
    df = spark.createDataFrame([([3.0, 0.0], [0.0, 4.0]), ([0.0], [0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(semantic.joined("a", "b")).collect()]
    assert got == [[0.6, 0.0, 0.0, 0.8], [0.0, 0.0]]
