"""Mixing sources to target weights by Sainte-Lague apportionment.

Documents are laid end to end, in a seeded order, inside cells of one source and
one shard; a cell's words are cut in blocks of equal size. Seats are blocks:
Sainte-Lague allots them to sources by highest quotients of the targets, and a
source's seats to its shards in the same way. A cell with ``a`` seats and ``k``
blocks takes every block ``a div k`` times and ``a mod k`` blocks once more,
which follow each other from a seeded place (the order in the cell being seeded,
that is a seeded choice of blocks). No block is taken over ``most`` times.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating; they
share all words by weight; a target stops at ``most`` times its source's size and
the excess is shared again by weight until none is above. Comparisons are exact.

The block size is a power of two up to 64 words, and so small that a cell's last
short block matters little to the smallest target. Sizes are numbers of
``[^\\x20\\x09-\\x0D]+``; null text has size 0 and is never taken. A null source is
a source. A source with no words has target 0. Repeated rows are laid out one by
one; rows with equal id and size are alike, so reruns agree. Empty tables give
empty results. Columns whose names clash with the added ones are replaced.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.storage import materialize

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
SHARD_DOCS, BLOCK_MAX, SEED = 2000, 64, 17


def size_of(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def apportion(weights: list[float], seats: int, limits: list[int]) -> list[int]:
    """Sainte-Lague: each seat goes to the highest quotient w / (2a + 1), the first on ties."""
    w = np.asarray(weights, float)
    total = float(w.sum())
    if total <= 0 or seats <= 0:
        return [0] * len(w)
    cap = np.asarray(limits, np.int64)
    # a party gets round(w / d) for a divisor d <= total / (seats - parties / 2): start there, then award
    got = np.minimum(np.maximum(np.floor(w * max(0.0, seats - len(w) / 2) / total - 0.5), 0).astype(np.int64), cap)
    over = int(got.sum()) - seats
    while over > 0:  # only by rounding of floats
        i = int(np.argmin(np.where(got > 0, w / np.maximum(2 * got - 1, 1), np.inf)))
        got[i] -= 1
        over -= 1
    heap = [(-w[i] / (2 * got[i] + 1), i) for i in range(len(w)) if got[i] < cap[i] and w[i] > 0]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < cap[i]:
            heapq.heappush(heap, (-w[i] / (2 * got[i] + 1), i))
    return [int(x) for x in got]


def source_targets(sized: DataFrame, most: int = 3, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, int]:
    """(source, source_size, weight, target) and the number of all words; ``sized`` has (source, size)."""
    grouped = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # the place of each source in a sorted table, without gathering the table in one task
    ordered = materialize(grouped.orderBy(F.asc_nulls_last("source")).withColumn("pid", F.spark_partition_id()), "mix-sources")
    parts = ordered.groupBy("pid").agg(F.count("*").alias("c"))
    before = parts.select("pid", (F.sum("c").over(Window.orderBy("pid")) - F.col("c")).alias("before"))  # one row a partition
    place = F.col("before") + F.row_number().over(Window.partitionBy("pid").orderBy(F.asc_nulls_last("source"))) - 1
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = materialize(ordered.join(before, "pid").select("source", "source_size", F.element_at(cycle, (place % len(weights) + 1).cast("int")).cast("long").alias("weight")), "mix-weights")

    total, den = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    wide = "decimal(38,0)"
    num, all_weights, capped = total, den, -1

    def above() -> Column:
        return F.expr(f"cast({most} * source_size as {wide}) * {max(den, 1)} < cast({num} as {wide}) * weight")

    while total:
        n, words, w = ranked.where(above()).agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n == capped or w == all_weights:
            break
        capped, num, den = n, total - most * words, all_weights - w
    open_ = F.expr(f"cast({num}L as double) * weight / {max(den, 1)}L")
    return ranked.withColumn("target", F.when(above(), (most * F.col("source_size")).cast("double")).otherwise(open_)), total


def source_seats(targets: DataFrame, seats: int, block: int, most: int) -> DataFrame:
    """Adds ``seats`` to each source: Sainte-Lague with a common divisor, ties by quotient."""
    limit = F.ceil(F.col("source_size") / F.lit(float(block))) * most

    def at(divisor: float) -> Column:
        return F.least(F.floor(F.col("target") / F.lit(divisor) + 0.5), limit)

    low, high = block * 0.25, block * 4.0  # more seats at the low end
    for _ in range(4):
        tries = [low + (high - low) * k / 48 for k in range(49)]
        sums = targets.agg(*[F.coalesce(F.sum(at(d)), F.lit(0)) for d in tries]).first()
        fit = [d for d, s in zip(tries, sums) if s <= seats]
        high = fit[0] if fit else high
        more = [d for d, s in zip(tries, sums) if s > seats]
        low = more[-1] if more else low
        if not more or seats in sums:
            break
    base = targets.withColumn("seats", at(high).cast("long")).withColumn("room", F.col("seats") < limit)
    left = seats - (base.agg(F.sum("seats")).first()[0] or 0)
    if left <= 0:
        return base.drop("room")
    extra = base.where("room and target > 0").orderBy(F.desc(F.col("target") / (2 * F.col("seats") + 1)), F.asc_nulls_last("source")).limit(left).select(F.col("source").alias("s"), F.lit(1).alias("one"))
    return base.join(extra, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("seats", F.col("seats") + F.coalesce("one", F.lit(0))).drop("s", "one", "room")


def numbered(docs: DataFrame, column: str) -> str:
    return f"d{docs.columns.index(column)}"


def _mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 3, seed: int = SEED) -> DataFrame:
    """The columns of ``docs`` as d0, d1, ... (so that none of them meets ours), and size, source_size, target, taken, pieces."""
    id_col, text_col, source_col = (numbered(docs, c) for c in (id_col, text_col, source_col))
    docs = docs.select(*[F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(docs.columns)])
    key = F.xxhash64(F.col(id_col).cast("string"), F.lit(seed))
    slim = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size")), "mix-sizes")
    shards = max(1, math.ceil(slim.count() / SHARD_DOCS))
    targets, total = source_targets(slim.select("source", "size"), most)
    targets = materialize(targets, "mix-targets")
    least = targets.where("target > 0").agg(F.min("target")).first()[0] or 1.0
    block = int(min(BLOCK_MAX, 2 ** max(0, math.floor(math.log2(max(1.0, least / (200 * shards)))))))
    seated = materialize(source_seats(targets, round(total / block), block, most), "mix-seats")
    shard = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(seed + 1)), F.lit(shards))
    cells = slim.where("size > 0").groupBy("source", shard.alias("shard")).agg(F.sum("size").alias("cell"))
    cells = cells.join(seated.select(F.col("source").alias("s"), "seats"), F.col("source").eqNullSafe(F.col("s"))).drop("s")

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        blocks = -(-rows["cell"] // block)
        return pd.DataFrame({"source": rows["source"], "shard": rows["shard"], "cell": rows["cell"], "quota": apportion(list(rows["cell"]), int(rows["seats"].iloc[0]), list(most * blocks))})

    quotas = materialize(cells.groupBy("source").applyInPandas(deal, "source string, shard long, cell long, quota long"), "mix-quotas")

    q = quotas.select(F.col("source").alias("_qs"), F.col("shard").alias("_qshard"), "cell", "quota")
    t = targets.select(F.col("source").alias("_ts"), "source_size", "target")
    rows = docs.withColumns({"_source": F.col(source_col).cast("string"), "size": size_of(F.col(text_col)), "_key": key, "_shard": F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed + 1)), F.lit(shards))})
    rows = rows.join(t, F.col("_source").eqNullSafe(F.col("_ts")), "left").join(q, F.col("_source").eqNullSafe(F.col("_qs")) & (F.col("_shard") == F.col("_qshard")), "left")
    w = Window.partitionBy("_source", "_shard").orderBy("_key", id_col, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_c0", F.sum("size").over(w) - F.col("size"))
    sql = F.expr
    rows = rows.withColumns({"_n": sql(f"cast(ceil(cell / {block}D) as bigint)")}).withColumns(
        {
            "_full": sql("coalesce(quota div _n, 0)"),
            "_from": sql(f"pmod(xxhash64(_source, _shard, {seed}), _n) * {block}"),
            "_to": sql(f"(pmod(xxhash64(_source, _shard, {seed}), _n) + pmod(quota, _n)) * {block}"),
        }
    )
    span = lambda a, b: (F.greatest(F.lit(0), F.expr(a) - F.col("_c0")), F.least(F.col("size"), F.expr(b) - F.col("_c0")))
    (a1, b1), (a2, b2) = span("_from", "least(_to, cell)"), span("cast(0 as bigint)", f"_to - _n * {block}")
    rows = rows.withColumns({"_a1": a1.cast("long"), "_b1": b1.cast("long"), "_a2": a2.cast("long"), "_b2": b2.cast("long")})
    pieces = (
        "case when size > 0 and quota is not null then concat("
        "case when _full > 0 then array_repeat(named_struct('start', cast(0 as bigint), 'end', size), cast(_full as int)) else array() end, "
        "case when _a1 < _b1 then array(named_struct('start', _a1, 'end', _b1)) else array() end, "
        "case when _a2 < _b2 then array(named_struct('start', _a2, 'end', _b2)) else array() end) "
        "else cast(array() as array<struct<start: bigint, end: bigint>>) end"
    )
    rows = rows.withColumn("pieces", sql(pieces)).withColumn("taken", sql("aggregate(pieces, cast(0 as bigint), (n, p) -> n + p.end - p.start)"))
    return rows.select(*docs.columns, "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), "target", "taken", "pieces")


ADDED = ("size", "source_size", "target", "taken", "pieces")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 3, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` with size, source_size, target, taken and pieces (in place of columns of these names).

    ``taken`` counts the words the mix takes of the row, repeats included;
    ``pieces`` has them as ranges [start, end) of its words. The rows are shuffled
    once, by source and shard; sources and cells are the only other tables.
    """
    rows = _mixed(docs, id_col, text_col, source_col, most, seed)
    return rows.select(*[F.col(numbered(docs, c)).alias(c) for c in docs.columns if c not in ADDED], *ADDED)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 3, seed: int = SEED) -> DataFrame:
    """The mix itself: a row for every taken piece, with the columns of ``docs``.

    A piece that is a whole document keeps its text as it is; the few that are
    cut at the edge of a block have their words joined by a space.
    """
    rows = _mixed(docs, id_col, text_col, source_col, most, seed).withColumn("piece", F.explode("pieces"))
    text = numbered(docs, text_col)
    part = F.expr(f"array_join(slice(regexp_extract_all(cast({text} as string), r'{WORD}', 0), cast(piece.start + 1 as int), cast(piece.end - piece.start as int)), ' ')")
    whole = (F.col("piece.start") == 0) & (F.col("piece.end") == F.col("size"))
    return rows.select(*[(F.when(whole, F.col(text)).otherwise(part) if c == text_col else F.col(numbered(docs, c))).alias(c) for c in docs.columns])


TARGETS_SQL = f"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
wt AS (SELECT source, source_size, [{', '.join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight FROM src),
cum AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS weights,
  3.0 * source_size / weight AS ratio FROM wt),
steps AS (SELECT ratio AS lvl, total - 3 * coalesce((SELECT sum(b.source_size) FROM cum b WHERE b.ratio < a.ratio), 0) AS num,
  weights - coalesce((SELECT sum(b.weight) FROM cum b WHERE b.ratio < a.ratio), 0) AS den FROM cum a),
fill AS (SELECT CAST(num AS BIGINT) AS num, CAST(den AS BIGINT) AS den FROM steps WHERE lvl * den >= num ORDER BY lvl LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN CAST(3 * source_size AS HUGEINT) * den < CAST(num AS HUGEINT) * weight
  THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(num AS DOUBLE) * weight / den END AS target FROM cum, fill)
"""
