"""The whole mix told again without Spark's plan: seats, quotas, the seeded order and blocks (only the hashes come from Spark)."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing

MOST = 3


def seats_of(weights, seats, limits):
    """One seat after the other to the highest quotient, the first on ties."""
    got = [0] * len(weights)
    for _ in range(seats):
        free = [i for i in range(len(weights)) if got[i] < limits[i] and weights[i] > 0]
        if not free:
            break
        got[max(free, key=lambda i: (weights[i] / (2 * got[i] + 1), -i))] += 1
    return got


def targets_of(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight, capped, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set(), sum(sizes.values())
    while True:
        rest, ws = total - sum(MOST * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and MOST * sizes[s] * ws < rest * weight[s]}
        if not more:
            return {s: MOST * sizes[s] if s in capped else rest * weight[s] / ws if ws else 0.0 for s in names}
        capped |= more


def brute(rows, shards_of, key_of, cell_hash):
    """Words taken of each row; rows are (id, source, size)."""
    shards = max(1, math.ceil(len(rows) / mixing.SHARD_DOCS))
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    targets = targets_of(sizes)
    least = min((t for t in targets.values() if t > 0), default=1.0)
    block = int(min(mixing.BLOCK_MAX, 2 ** max(0, math.floor(math.log2(max(1.0, least / (200 * shards)))))))
    names = list(targets)
    seats = dict(zip(names, seats_of([targets[s] for s in names], round(sum(sizes.values()) / block), [MOST * math.ceil(sizes[s] / block) for s in names])))
    cells = {}
    for row in rows:
        if row[2]:
            cells.setdefault((row[1], shards_of[row[0]]), []).append(row)
    taken = {}
    for source in names:
        own = sorted(k for s, k in cells if s == source)
        words = [sum(r[2] for r in cells[source, k]) for k in own]
        for k, cell, quota in zip(own, words, seats_of(words, seats[source], [MOST * math.ceil(w / block) for w in words])):
            n = math.ceil(cell / block)
            full, start, extra = quota // n, cell_hash[source, k] % n, quota % n
            blocks = [full] * n
            for j in range(extra):
                blocks[(start + j) % n] += 1
            at = 0
            for r in sorted(cells[source, k], key=lambda r: (key_of[r[0]], r[0], r[2])):
                taken.setdefault(r, []).append(sum(blocks[w // block] for w in range(at, at + r[2])))
                at += r[2]
    return {r: sorted(x) for r, x in taken.items()}


@pytest.mark.parametrize("seed, shard_docs", [(1, 20), (2, 7), (3, 1000)])
def test_mix_equals_brute_force(spark, monkeypatch, seed, shard_docs):
    monkeypatch.setattr(mixing, "SHARD_DOCS", shard_docs)
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["a", "a", "a", "b", "é", None, "tiny"][: 6 + (i < 3)]), rnd.choice([0, 1, 5, 30, 200])) for i in range(120)]
    rows += [rows[3], rows[3], (500, "void", 0)]
    df = spark.createDataFrame([(i, s, "w " * n) for i, s, n in rows], "doc_id long, source string, text string")
    got = {}
    for r in mixing.mix(df).collect():
        if r.size:
            got.setdefault((r.doc_id, r.source, r.size), []).append(r.taken)
    shards = max(1, math.ceil(len(rows) / shard_docs))
    text = F.col("doc_id").cast("string")
    hashes = df.select("doc_id", F.xxhash64(text, F.lit(mixing.SEED)).alias("k"), F.pmod(F.xxhash64(text, F.lit(mixing.SEED + 1)), F.lit(shards)).alias("s")).distinct().collect()
    cells = df.select("source").distinct().crossJoin(spark.range(shards)).select("source", "id", F.expr(f"xxhash64(source, id, {mixing.SEED})").alias("h")).collect()
    want = brute(rows, {r.doc_id: r.s for r in hashes}, {r.doc_id: r.k for r in hashes}, {(r.source, r.id): r.h for r in cells})
    assert {k: sorted(v) for k, v in got.items()} == want
