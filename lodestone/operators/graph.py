"""Connected components over an edge table.

Alternating large-star and small-star steps (Kiveris et al., 2014) contract the
edge table until it is a forest of stars. Edges of integer vertices that lie in one
partition are contracted to stars before the first step. Each step is one shuffle on the vertex
id with a map-side combined minimum; a vertex of very high degree is spread by
AQE's skew handling because both sides of its join are plain exchanges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lodestone.storage import drop, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.join(low, "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return (
        moved.unionByName(low.select("u", F.col("m").alias("v")))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def _union_find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for rows in parts:
        for u, v in zip(rows["u"].tolist(), rows["v"].tolist()):
            a, b = find(u), find(v)
            top[max(a, b)] = min(a, b)
    if top:
        yield pd.DataFrame([(x, find(x)) for x in list(top)], columns=["node", "component"])


def _local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vertex of these edges but the smallest of each component, and that smallest one."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    top = np.arange(len(names))
    while True:
        p, q = top[x], top[y]
        if (p == q).all():
            break
        np.minimum.at(top, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(nearer := top[top], top):
            top = nearer
    moved = top != np.arange(len(names))
    return names[moved], names[top[moved]]


def _contracted(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(u, v) with the components of ``edges``: the edges that lie together, up to ``most``, as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def stars() -> pa.RecordBatch:
            u, v = _local_stars(*(np.concatenate(c) for c in zip(*held)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(u) for u, _ in held) >= most:
                yield stars()
        if held:
            yield stars()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 50, one_task_below: int = 0) -> DataFrame:
    """Smallest reachable vertex for every vertex that has an edge; vertices are of any type that has an order.

    Returns ``(node, component)``. Self-loops give their vertex its own id;
    edges with a null end are ignored; repeated edges change nothing; an empty
    table gives an empty result. Rounds stop when a round leaves the table as it
    was (row count and an order-free checksum), which large-star/small-star
    reaches in O(log^2 n) rounds; ``max_rounds`` only guards against a bug and
    raises instead of returning a wrong answer. A table of at most
    ``one_task_below`` edges is settled by union-find in one task, with the same
    result; callers with many small graphs set it.
    """
    work = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = work.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    nodes_loop = materialize(loops.distinct(), "cc-loops")
    links = work.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if all(isinstance(f.dataType, LongType) for f in links.schema):
        links = _contracted(links)  # fewer edges before any are shuffled
    cur = materialize(links.distinct(), "cc-edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0)), F.coalesce(F.expr("sum(pmod(xxhash64(v, u), 1000003))"), F.lit(0))).first())

    before = mark(cur)
    if 0 < before[0] <= one_task_below:
        found = cur.coalesce(1).mapInPandas(_union_find, "node long, component long")
        return found.unionByName(nodes_loop.join(cur.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_anti"))
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        last, cur = cur, materialize(_small_star(_large_star(cur)), "cc-round")
        drop(last)
        after = mark(cur)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = stars.unionByName(roots)
    alone = nodes_loop.join(found, "node", "left_anti")
    return found.unionByName(alone)
