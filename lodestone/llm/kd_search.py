"""Exact top-k search by integer inner product, with a KD-tree per shard.

Vectors become integers (floor(scale * x), x as double). Rows are dealt to shards
by a hash of the id; in each shard a KD-tree is built by median splits and every
node holds the tight box of its vectors. For a query, sum(max(q * lo, q * hi)) bounds
every inner product in a box; nodes are opened best first until no bound can
beat the k-th best score, which is handed on: each query first meets its home
shard, and the scores found there go with it to all other shards.

A node also keeps its smallest id, so that boxes which can only tie with the
k-th score at a larger id aren't opened; a mass of equal vectors is one such box.
A task gathers one shard (bounded), builds its tree once, and streams the
queries past it; only queries are sent to several shards. Beyond
``BLOCK_QUERIES`` queries a shard is held once for each block of them, which bounds a
task's time too. Shards times queries is the work of an exact search.

Vectors that are null, empty, or hold null or non-finite components take no
part; rows of null id neither. Only vectors of one length are compared. A row's
own id is no candidate for it (nor are repeated rows of that id); rows of one id
and score count once. Fewer than k candidates give fewer rows. Ties go to the
smaller id. Empty tables give empty results; other columns are ignored. Rows
whose products could pass 2^53 are told apart and multiplied as Python integers,
so the order is exact for every finite vector; a score beyond 64 bits is ranked by
its whole value and given as the nearest 64-bit integer.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.storage import materialize

SHARD_ROWS, BLOCK_QUERIES, LEAF = 20_000, 65_536, 128
#: Queries whose bounds are computed at once; tasks of one pass (a task works through its shards one after the other).
BATCH, MOST_TASKS = 256, 20_000
LONG_MAX, LONG_MIN = (1 << 63) - 1, -(1 << 63)


class Tree:
    """KD-tree of one shard: vectors in tree order, boxes and smallest ids of the nodes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.arange(len(ids))
        self.lo: list[np.ndarray] = []
        self.hi: list[np.ndarray] = []
        self.span: list[tuple[int, int]] = []
        self.kids: list[tuple[int, int] | None] = []
        self.least: list[int] = []

        def build(a: int, b: int) -> int:
            own = order[a:b]
            lo, hi = vectors[own].min(0), vectors[own].max(0)
            i = len(self.lo)
            self.lo.append(lo)
            self.hi.append(hi)
            self.span.append((a, b))
            self.kids.append(None)
            self.least.append(int(ids[own].min()))
            wide = hi - lo
            if b - a > LEAF and wide.max() > 0:
                axis, half = int(wide.argmax()), (b - a) // 2
                order[a:b] = own[np.argpartition(vectors[own, axis], half)]
                left = build(a, a + half)
                self.kids[i] = (left, build(a + half, b))
            elif wide.max() == 0:  # equal vectors: each id once and in order, so that the first k do
                first = np.unique(ids[own], return_index=True)[1]
                order[a : a + len(first)] = own[first]
                order[a + len(first) : b] = np.delete(own, first)
                self.span[i] = (a, a + len(first))
            return i

        if len(ids):
            build(0, len(ids))
        self.ids, self.vectors = ids[order], vectors[order]
        if self.lo:
            self.mid = np.array(self.lo) + np.array(self.hi)
            self.half = np.array(self.hi) - np.array(self.lo)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node: sum(max(q * lo, q * hi)), exactly."""
        twice = queries @ self.mid.T + np.abs(queries) @ self.half.T
        return twice // 2 if twice.dtype == object else twice / 2

    def search(self, qid: int, q: np.ndarray, bound: np.ndarray, k: int, best: list[tuple[int, int]], mine: bool = False) -> list[tuple[int, int]]:
        """The k best (score, -id) of ``best`` and this shard, best first opened."""
        held = set(best)  # an id and score count once, however many rows have them
        top = [*held]
        heapq.heapify(top)
        todo = [(-bound[0], self.least[0], 0)] if self.lo else []
        while todo:
            b, least, i = heapq.heappop(todo)
            if len(top) >= k and (-b, -least) <= top[0]:
                if -b < top[0][0]:
                    break  # no box after this one can do better
                continue
            if self.kids[i]:
                for c in self.kids[i]:
                    if len(top) < k or (bound[c], -self.least[c]) > top[0]:
                        heapq.heappush(todo, (-bound[c], self.least[c], c))
                continue
            s, e = self.span[i]
            if self.half[i].max() == 0:
                e = min(e, s + k + 1)  # equal vectors in order of ids; one may be the query's own
            scores = self.vectors[s:e] @ q
            ids = self.ids[s:e]
            ok = ids != qid
            if len(top) >= k:
                ok &= scores >= top[0][0]
            for score, vid in zip(scores[ok], ids[ok]):
                item = (int(score), -int(vid))
                if item in held or (len(top) >= k and item <= top[0]):
                    continue
                held.add(item)
                if len(top) < k:
                    heapq.heappush(top, item)
                else:
                    held.discard(heapq.heapreplace(top, item))
        return top


def usable(vector: str) -> Column:
    """Vectors with finite components only."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite, F.lit(False)) & (F.size(vector) > 0)


def as_ints(rows: list[bytes], scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Integer vectors as doubles, and which of them can't pass 2^53 in a product with another such vector."""
    x = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
    with np.errstate(over="ignore"):
        ints = np.floor(x * scale)
    return ints, np.abs(ints).max(1) <= math.isqrt((1 << 53) // (4 * x.shape[1]))


def as_objects(rows: list[bytes], scale: int) -> np.ndarray:
    """The same vectors as Python integers of any size."""

    def one(x: float) -> int:
        y = x * scale
        return math.floor(y) if math.isfinite(y) else int(x) * scale

    found = np.empty((len(rows), len(rows[0]) // 8 if rows else 0), object)
    for i, row in enumerate(rows):
        found[i] = [one(x) for x in np.frombuffer(row, np.float64).tolist()]
    return found


def pack_score(score: int) -> tuple[int, bytes | None]:
    """A score as 64-bit integer, and bytes that sort like the whole value where it is beyond them."""
    if LONG_MIN < score < LONG_MAX:
        return score, None
    return max(LONG_MIN, min(LONG_MAX, score)), (score + (1 << 2299)).to_bytes(288, "big")


def unpack_score(s: int, w: bytes | None) -> int:
    return s if w is None else int.from_bytes(w, "big") - (1 << 2299)


class Shard:
    """Trees of one shard: of the vectors that doubles can tell exactly, and, only where needed, of Python integers."""

    def __init__(self, ids: list[int], rows: list[bytes], scale: int):
        self.scale, self.rows = scale, rows
        self.ids = np.array(ids, np.int64)
        ints, fits = as_ints(rows, scale)
        self.fits = fits
        self.plain = Tree(self.ids[fits], ints[fits])
        self._objects: dict[bool, Tree] = {}

    def objects(self, fits: bool) -> Tree:
        if fits not in self._objects:
            at = np.flatnonzero(self.fits == fits)
            self._objects[fits] = Tree(self.ids[at], as_objects([self.rows[i] for i in at], self.scale))
        return self._objects[fits]

    def search(self, qids: list[int], rows: list[bytes], known: list[list[tuple[int, int]]], k: int) -> Iterator[list[tuple[int, int]]]:
        """For each query the k best (score, -id) of what is known and this shard."""
        queries, fits = as_ints(rows, self.scale)
        bounds = self.plain.bounds(queries[fits]) if len(self.plain.ids) and fits.any() else None
        place = np.cumsum(fits) - 1
        for i, (qid, best) in enumerate(zip(qids, known)):
            if fits[i] and bounds is not None:
                best = self.plain.search(qid, queries[i], bounds[place[i]], k, best)
            wide = [self.objects(False)] if not self.fits.all() else []
            wide += [self.objects(True)] if not fits[i] and self.fits.any() else []
            if wide:
                q = as_objects([rows[i]], self.scale)
                for tree in wide:
                    best = tree.search(qid, q[0], tree.bounds(q)[0], k, best)
            yield best


FOUND = "q long, i long, s long, w binary"


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, id, score): the k highest scores of each row where ``is_query``."""
    flat = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector_col).cast("array<double>").alias("v")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(2)
            values, offsets = np.asarray(col.values, np.float64), np.asarray(col.offsets)
            rows = [values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["id", "asks", "v"])

    packed = materialize(flat.mapInArrow(pack, "id long, asks boolean, v binary"), "kd-vectors").withColumn("w", F.length("v"))
    total, asking = packed.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(1, -(-total // SHARD_ROWS)), max(1, -(-asking // BLOCK_QUERIES))
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard")
    none = F.lit(None).cast("array<struct<s: bigint, w: binary, i: bigint>>").alias("best")
    held = packed.select("w", shard, F.lit(0).cast("long").alias("block"), F.lit(0).alias("role"), "id", "v", none)
    asked = packed.where("asks").select("w", shard, F.lit(0).cast("long").alias("block"), F.lit(1).alias("role"), "id", "v", none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order (w, shard, block, role): the vectors of a shard, then its queries."""
        at, ids, rows, tree = None, [], [], None
        for batch in batches:
            out: list[tuple] = []
            waiting: list[tuple] = []

            def answer() -> None:
                for start in range(0, len(waiting), BATCH):
                    part = waiting[start : start + BATCH]
                    known = [[(unpack_score(b["s"], b["w"]), -b["i"]) for b in best or []] for _, _, best in part]
                    for (qid, _, _), had, best in zip(part, known, tree.search([p[0] for p in part], [p[1] for p in part], known, k)):
                        out.extend((qid, -v, *pack_score(s)) for s, v in set(best) - set(had))
                waiting.clear()

            cols = [batch.column(i).to_pylist() for i in range(7)]
            for w, no, block, role, vid, v, best in zip(*cols):
                if (w, no, block) != at:
                    if waiting:
                        answer()
                    at, ids, rows, tree = (w, no, block), [], [], None
                if role == 0:
                    ids.append(vid)
                    rows.append(v)
                elif rows:
                    tree = tree or Shard(ids, rows, scale)
                    waiting.append((vid, v, best))
            if waiting:
                answer()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["q", "i", "s", "w"])

    def search(asks: DataFrame, held: DataFrame, tasks: int) -> DataFrame:
        rows = held.unionByName(asks).repartition(min(tasks, MOST_TASKS), "w", "shard", "block").sortWithinPartitions("w", "shard", "block", "role")
        return rows.mapInArrow(run, FOUND)

    home = materialize(search(asked, held, shards), "kd-home")
    found = home
    if shards > 1:
        known = home.groupBy("q").agg(F.collect_list(F.struct("s", "w", "i")).alias("best"))  # k a query at most
        away = asked.drop("best").join(known, F.col("id") == F.col("q"), "left").withColumn("home", F.col("shard"))
        away = away.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).where("shard <> home")
        away = away.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)))
        every = held.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        names = ["w", "shard", "block", "role", "id", "v", "best"]
        found = home.unionByName(search(away.select(*names), every.select(*names), shards * blocks))
    w = Window.partitionBy("q").orderBy(F.desc("s"), F.desc_nulls_last("w"), "i")
    ranked = found.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("i").alias("id"), F.col("s").alias("score"))
