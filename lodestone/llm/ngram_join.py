"""Exact n-gram Jaccard join with a token-group matrix.

A document's set is its distinct shingles of ``width`` words. Two documents link
when their sets' Jaccard similarity reaches ``percent`` / 100. The result is the
set size and the component of every document; documents with equal sets are one
vertex, so copies are never expanded into pairs.

1. *Shared tokens.* Shingle hashes are dealt by range to token buckets, packed in
   sorted blocks. A bucket tells which of its tokens stand in two or more
   different sets, and how common each is. A set can only have a link if at least
   ``percent`` of it is shared, so most documents leave here.
2. *Clusters.* What is left is partitioned by minimum hash, and each part (cut in
   chunks of bounded size) is clustered around leaders by exact similarity. The
   leaders are clustered again by other minimum hashes, so that copies of one
   text come to one root.
3. *Token-group matrix.* The sets are held in groups of bounded size, a large root's
   in groups of their own, and each group with the union of its tokens. A set is a
   query to every later group that has one of its rare-first prefix tokens in a
   member's prefix: one row for each set and group, whatever the number of
   members. The number of a query's tokens in the union bounds its overlap
   with every member; only groups that reach the needed overlap are opened, and
   there one pass over the postings of the query's tokens counts the overlap with all
   members at once. Nothing is sent to groups of the set's own root.
4. Components of the links between roots (large-star/small-star).

Steps 2 and 3 lose no link: if J(A, B) >= t, the first |A| - ceil(t|A|) + 1 tokens
of A and of B in one global order have a token in common. The order is (how
common, hash), so passages that many documents share come last and don't make
candidates; sizes that rule a link out don't either. Token buckets get at most
one row from each block of documents, and a token that stands in ``HOT_LOCAL`` sets of one block is sent as a single
flag, so no frequent token gathers its documents anywhere.

What still grows with the square, at one row for ``GROUP_MEMBERS`` sets: different
texts that share three quarters of themselves with each other and yet fall short
of the threshold.

Words: ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. With fewer words than
``width`` the whole sequence is the one shingle. Null, empty and blank texts
have empty sets: size 0, linked with nothing, their own component. Rows with the
same id are separate rows of one document. A null id names a component only if no
other id is in it. Empty tables give empty results; other columns are ignored.
Sets are told apart by 64 hash bits and the set size, tokens by the top 60 bits of
64-bit hashes and how common they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.worker import Memo, enter, settle
from lodestone.operators.graph import connected_components
from lodestone.storage import drop, materialize

#: Tokens of one block of documents, of one token bucket; documents in one block.
BLOCK_TOKENS, BUCKET_TOKENS, BLOCK_DOCS = 1_000_000, 1_500_000, 60_000
#: Sets of one block that make a token hot.
HOT_LOCAL = 64
#: Members and tokens of a group of the matrix, about; queries that one copy of a group serves.
GROUP_MEMBERS, GROUP_TOKENS, GROUP_QUERIES = 1024, 1_000_000, 65_536
#: Sets and tokens of a chunk that is clustered at once; leaders a chunk keeps; clusterings of leaders by other hashes.
CHUNK, CHUNK_TOKENS, LEADERS, AGAIN = 4000, 1_000_000, 64, 2
#: Members of a root that a query is held against before all of them; bytes that one task of the matrix reads, about.
PROBES, TASK_BYTES = 4, 64 << 20
CACHE_WORDS = 50_000
#: Ranges that a token bucket is worked through in, to hold less at once.
PASSES = 4
HOT_CLASS = 15

_WORDS = Memo(xxhash.xxh64_intdigest, CACHE_WORDS)
U = np.uint64


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), U, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, U)
    h, k = word_hashes(words), min(width, len(words))
    m = len(words) - k + 1
    acc = np.full(m, k, U)
    for j in range(k):
        acc = acc * U(0x9E3779B97F4A7C15) + h[j : j + m]
        acc ^= acc >> U(29)
    return np.unique(mix(acc))


def signature(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes())


def needed(n: np.ndarray | int, percent: int):
    """Least overlap that a set of size n needs with any partner."""
    return -(-n * percent // 100)


def planes(a: np.ndarray) -> bytes:
    """Bytes of an integer array, plane by plane, so that block compression works."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unplanes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def packed(sorted_values: np.ndarray) -> bytes:
    return planes(np.diff(sorted_values, prepend=U(0)))


def unpacked(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b, U), dtype=U)


def runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    return starts, np.diff(np.append(starts, len(a)))


class Buckets:
    """Ranges of the hash space, one a token bucket."""

    def __init__(self, count: int):
        self.count = count
        self.width = (1 << 64) // count + 1
        self.edges = np.array([i * self.width for i in range(count)], U)

    def low(self, b: int) -> np.uint64:
        return self.edges[b]


def ranked(bucket: int, edges: Buckets, inside: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Tokens as they are ordered and compared from here on: class, then hash."""
    return (classes.astype(U) << U(60)) | ((edges.low(bucket) + inside) >> U(4))


#: kind 0: tokens of a block for a token bucket; 1: shared tokens of a block; 2: the sets of a block.
FOUND = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("tokens_of", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
FOUND_SQL = "kind int, bucket long, block long, tokens_of long, a binary, b binary, c binary, d binary"


def home(block: int, by: Buckets) -> int:
    return block % by.count


def shared_row(by: Buckets, block: int, bucket: int, refs: np.ndarray, inside: np.ndarray, classes: np.ndarray) -> tuple:
    """Shared tokens of one block and token bucket, by document."""
    order = np.lexsort((inside, refs))
    refs, inside, classes = refs[order], inside[order], classes[order]
    first, count = runs(refs)
    return (1, home(block, by), block, bucket, planes(refs[first]), planes(count.astype(np.uint32)), planes(inside), planes(classes.astype(np.uint8)))


def block_rows(by: Buckets, sets: list[np.ndarray], sigs: list[int]) -> list[tuple]:
    """The rows that one block of documents sends. A block is named by its content."""
    if not sets:
        return []
    sizes = np.array([len(s) for s in sets], np.int64)
    sig = np.array(sigs, U)
    block = signature(sig) >> 1
    tokens, ref = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, ref = tokens[order], ref[order]
    _, lengths = runs(tokens)
    hot = np.repeat(lengths >= HOT_LOCAL, lengths)
    rows = [(2, home(block, by), block, -1, planes(sig), planes(sizes.astype(np.uint32)), b"", b"")]
    bucket = tokens // U(by.width)
    for first, count in zip(*runs(bucket)):  # the buckets that this block has tokens for
        own, b = slice(first, first + count), int(bucket[first])
        inside, r, h = tokens[own] - by.low(b), ref[own], hot[own]
        used, local = np.unique(r[~h], return_inverse=True)
        rows.append((0, b, block, b, packed(inside[~h]), planes(local.astype(np.uint16)), planes(used) + planes(sig[used]), packed(np.unique(inside[h]))))
        if h.any():
            rows.append(shared_row(by, block, b, r[h], inside[h], np.full(int(h.sum()), HOT_CLASS)))
    return rows


def table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def sizes_of(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, sig) of every row of (id, text)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("ngram", _WORDS.drop)
        for batch in batches:
            n, sig = [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), width)
                n.append(len(s))
                sig.append(signature(s) - (1 << 63) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.int64())], ["id", "n", "sig"])
        settle()

    return docs.mapInArrow(run, f"id {kind}, n long, sig long")


def blocks_of(docs: DataFrame, width: int, by: Buckets) -> DataFrame:
    """Blocks of tokens by bucket, from every distinct set of a block of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("ngram", _WORDS.drop)
        sets, sigs, seen, total = [], [], set(), 0
        for batch in batches:
            for text in batch.column(0):
                s = shingle_set(text.as_py(), width)
                if not len(s) or (sig := signature(s)) in seen:
                    continue
                sets.append(s)
                sigs.append(sig)
                seen.add(sig)
                total += len(s)
                if total >= BLOCK_TOKENS or len(sets) >= BLOCK_DOCS:
                    yield table(block_rows(by, sets, sigs), FOUND)
                    sets, sigs, seen, total = [], [], set(), 0
        if rows := block_rows(by, sets, sigs):
            yield table(rows, FOUND)
        del sets, rows
        settle()

    return docs.select("text").mapInArrow(run, FOUND_SQL)


def many_of(rows: pa.Table, hot: np.ndarray, low: np.uint64, high: np.uint64) -> tuple[np.ndarray, ...]:
    """(row, document, token, class) of a bucket's tokens from low to high that stand in two different sets."""
    t, of, ref, mark = [], [], [], []
    for i, (a, b, c) in enumerate(zip(*(rows.column(x) for x in "abc"))):
        tokens, c = unpacked(a.as_py()), c.as_py()
        own, n = slice(*np.searchsorted(tokens, np.array([low, high], U))), len(c) // 10
        local = unplanes(b.as_py(), np.uint16)[own]
        t.append(tokens[own])
        of.append(np.full(len(local), i, np.uint32))
        ref.append(unplanes(c[: 2 * n], np.uint16)[local])
        mark.append(unplanes(c[2 * n :], U)[local])
    t, of, ref, mark = (np.concatenate(x) for x in (t, of, ref, mark))
    if not len(t):
        return of, ref, t, np.zeros(0, np.int64)
    order = np.argsort(t, kind="stable")
    t, of, ref, mark = t[order], of[order], ref[order], mark[order]
    starts, lengths = runs(t)
    very = np.isin(t[starts], hot)
    many = very | (np.minimum.reduceat(mark, starts) != np.maximum.reduceat(mark, starts))
    classes = np.where(very, HOT_CLASS, np.minimum(HOT_CLASS - 1, np.log2(lengths).astype(np.int64)))
    keep = np.repeat(many, lengths)
    return of[keep], ref[keep], t[keep], np.repeat(classes, lengths)[keep]


def shared_of(blocks: DataFrame, by: Buckets) -> DataFrame:
    """The tokens that stand in two different sets, sent back to their blocks."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        if key[0].as_py():  # known since the block of documents
            return rows
        bucket = key[1].as_py()
        names = rows.column("block").to_pylist()
        hot = np.unique(np.concatenate([unpacked(d.as_py()) for d in rows.column("d")]))
        cut = np.array([by.width * k // PASSES for k in range(PASSES)] + [(1 << 64) - 1], U)
        kept = [many_of(rows, hot, cut[k], cut[k + 1]) for k in range(PASSES)]
        of, ref, t, classes = (np.concatenate(x) for x in zip(*kept))
        order = np.argsort(of, kind="stable")
        of, ref, t, classes = of[order], ref[order], t[order], classes[order]
        out = []
        for s, n in zip(*runs(of)):
            own = slice(s, s + n)
            out.append(shared_row(by, names[of[s]], bucket, ref[own], t[own], classes[own]))
        return pa.Table.from_batches([table(out, FOUND)])

    # as many partitions as buckets, at any size: the session's number would put ever more of them in one task
    return blocks.repartition(by.count, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(run, FOUND_SQL)


SETS = pa.schema([("sig", pa.int64()), ("n", pa.int64()), ("g", pa.int64()), ("s", pa.binary())])


def survivors_of(shared: DataFrame, by: Buckets, percent: int) -> DataFrame:
    """(sig, n, g, s): sets that may have a link, with their shared tokens in order and minimum hash.

    A set that stands in several blocks comes once from each, with the same tokens.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        sets, ref, tok = None, [np.zeros(0, np.uint16)], [np.zeros(0, U)]
        for kind, of, a, b, c, d in zip(*(rows.column(x).to_pylist() for x in ("kind", "tokens_of", "a", "b", "c", "d"))):
            if kind == 2:
                sets = unplanes(a, U), unplanes(b, np.uint32).astype(np.int64)
            else:
                ref.append(np.repeat(unplanes(a, np.uint16), unplanes(b, np.uint32)))
                tok.append(ranked(of, by, unplanes(c, U), unplanes(d, np.uint8)))
        if sets is None:
            raise RuntimeError("a block of documents came out otherwise when it was read again")
        ref, tok = np.concatenate(ref), np.concatenate(tok)
        order = np.lexsort((tok, ref))
        ref, tok = ref[order], tok[order]
        if len(ref):  # hot in this block and in the bucket: told twice
            new = np.concatenate([[True], (ref[1:] != ref[:-1]) | (tok[1:] != tok[:-1])])
            ref, tok = ref[new], tok[new]
        first, count = runs(ref)
        sig, size = sets[0][ref[first]], sets[1][ref[first]]
        low = np.minimum.reduceat(mix(tok), first) if len(first) else tok
        good = np.flatnonzero(count >= needed(size, percent))
        cols = [
            pa.array((sig[good] ^ U(1 << 63)).view(np.int64)),
            pa.array(size[good]),
            pa.array(low[good].view(np.int64)),
            pa.array([tok[first[i] : first[i] + count[i]].tobytes() for i in good], pa.binary()),
        ]
        return pa.Table.from_arrays(cols, schema=SETS)

    return shared.groupBy("bucket", "block").applyInArrow(run, "sig long, n long, g long, s binary")


def similar(a: np.ndarray, na: int, b: np.ndarray, nb: int, percent: int) -> bool:
    """Exact test on shared tokens (sorted) and whole sizes."""
    if 100 * min(len(a), len(b)) < percent * max(na, nb):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (na + nb - inter)


def cluster_chunk(sets: list[tuple[int, np.ndarray]], percent: int) -> list[int]:
    """For each (size, tokens) of a chunk the place of its cluster's first set.

    Sets are taken in the order of their likeness to what most of the chunk share:
    the one that the others are copies of comes first and links with them.
    """
    if len(sets) == 1:
        return [0]
    every = np.concatenate([t for _, t in sets])
    every.sort(kind="stable")
    first, count = runs(every)
    core = every[first[2 * count >= len(sets)]]
    if len(core):
        inside = [int((core[np.minimum(np.searchsorted(core, t), len(core) - 1)] == t).sum()) for _, t in sets]
    else:
        inside = [0] * len(sets)
    order = sorted(range(len(sets)), key=lambda i: (-inside[i] / (sets[i][0] + len(core) - inside[i]), i))
    top = list(range(len(sets)))
    leaders: list[int] = []
    for i in order:
        n, tokens = sets[i]
        found = [x for x in leaders if similar(tokens, n, sets[x][1], sets[x][0], percent)]
        if not found:
            leaders.insert(1 if leaders else 0, i)
            del leaders[LEADERS:]
            continue
        top[i] = root = find(top, found[0])
        for x in found[1:]:
            top[find(top, x)] = root
    return [find(top, i) for i in range(len(sets))]


def find(top: list[int], i: int) -> int:
    while top[i] != i:
        top[i] = top[top[i]]
        i = top[i]
    return i


def clusters_of(sets: DataFrame, percent: int) -> DataFrame:
    """(sig, n, comp, s): each part of one minimum hash clustered around leaders, by exact links.

    ``comp`` is the signature of a set that the row is linked with by a chain of
    links. Memory: one chunk of bounded size, whatever the size of the part.
    """
    counts = sets.groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") > CHUNK)
    cut = sets.join(counts, "g", "left").withColumn("part", F.expr(f"pmod(xxhash64(sig, n), cast(ceil(coalesce(c, 1) / {CHUNK}D) as bigint))"))
    cut = cut.repartition("g", "part").sortWithinPartitions("g", "part", "n", "sig").select("g", "part", "sig", "n", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, rows, total = None, None, [], 0

        def done() -> pa.RecordBatch:
            comp = cluster_chunk([(n, t) for _, n, t in rows], percent)
            cols = pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([rows[c][0] for c in comp], pa.int64()), pa.array([r[2].tobytes() for r in rows], pa.binary())
            return pa.RecordBatch.from_arrays(list(cols), ["sig", "n", "comp", "s"])

        for batch in batches:
            for g, part, sig, n, s in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (g, part, sig, n) == last:  # the same set from another block, whether or not the chunk is cut here
                    continue
                if rows and ((g, part) != at or total > CHUNK_TOKENS):
                    yield done()
                    rows, total = [], 0
                at, last = (g, part), (g, part, sig, n)
                rows.append((sig, n, np.frombuffer(s, U)))
                total += len(s) // 8
        if rows:
            yield done()
        settle()

    return cut.mapInArrow(run, "sig long, n long, comp long, s binary")


def other_hash(sets: DataFrame, turn: int) -> DataFrame:
    """(sig, n, g, s) with another minimum hash for each turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.array([turn], U))
        for batch in batches:
            low = [mix(np.frombuffer(x, U) ^ salt).min().view(np.int64) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(low, pa.int64()), batch.column(2)], schema=SETS)

    return sets.select("sig", "n", "s").mapInArrow(run, "sig long, n long, g long, s binary")


def rooted(members: DataFrame, percent: int) -> DataFrame:
    """(comp, root): clusters brought together by clustering their leaders again, by exact links."""
    found = members.select("comp").distinct().withColumn("root", F.col("comp"))
    leaders = members.where("sig = comp").select("sig", "n", "s")
    for turn in range(1, AGAIN + 1):
        again = materialize(clusters_of(other_hash(leaders, turn), percent), "jaccard-leaders")
        found = found.join(again.select(F.col("sig").alias("root"), F.col("comp").alias("next")), "root", "left").select("comp", F.coalesce("next", "root").alias("root"))
        leaders = again.where("sig = comp").select("sig", "n", "s")
    return materialize(found, "jaccard-roots")


def grouped(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(sig, n, root, grp, s): each set in one group of about bounded members and tokens."""
    known = members.join(roots, "comp")
    tokens = F.length("s") / 8
    sizes = known.groupBy("root").agg(F.count("*").alias("c"), F.sum(tokens).alias("t"))
    sizes = sizes.withColumn("large", (F.col("c") > GROUP_MEMBERS / 4) | (F.col("t") > GROUP_TOKENS / 4))
    sizes = materialize(sizes.withColumn("parts", F.ceil(F.greatest(F.col("c") / GROUP_MEMBERS, F.col("t") / GROUP_TOKENS))), "jaccard-sizes-of-roots")
    c, t = sizes.where("not large").agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    mixed = max(1, math.ceil(max(2 * c / GROUP_MEMBERS, 2 * t / GROUP_TOKENS)))
    place = F.when(F.col("large"), F.xxhash64("root", F.pmod(F.xxhash64("sig", "n"), "parts"))).otherwise(F.xxhash64(F.pmod(F.xxhash64("root"), F.lit(mixed))))
    return known.join(sizes, "root").select("sig", "n", "root", place.alias("grp"), "s")


def heads_of(sets: DataFrame, percent: int) -> DataFrame:
    """(token, sig, n, root, grp, most, prev): the prefix of every set.

    ``most`` is the most that a partner's size can be: an overlap is at most the
    set's shared tokens. ``prev`` is the token before this one (0: none).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, keys = [np.zeros(0, U)], []
            count = []
            for n, s in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist()):
                tokens = np.frombuffer(s, U)
                heads.append(tokens[: max(0, len(tokens) - needed(n, percent) + 1)])
                count.append(len(heads[-1]))
                keys.append(len(tokens) * (100 + percent) // percent - n)
            if not sum(count):
                continue
            tok = np.concatenate(heads).view(np.int64)
            of = np.repeat(np.arange(len(count)), count)
            prev = np.concatenate([[0], tok[:-1]])
            prev[np.concatenate([[True], of[1:] != of[:-1]])] = 0
            rest = [pa.array(np.asarray(batch.column(i))[of]) for i in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(tok), *rest, pa.array(np.array(keys, np.int64)[of]), pa.array(prev)], ["token", "sig", "n", "root", "grp", "most", "prev"])

    return sets.select("sig", "n", "root", "grp", "s").mapInArrow(run, "token long, sig long, n long, root long, grp long, most long, prev long")


def routes_of(sets: DataFrame, percent: int) -> DataFrame:
    """(sig, n, to): the groups that a set is a query to.

    A run of tokens that a set and all members of a group that have them share, a
    passage say, is met at its first token: whoever has the same token before
    it has met there already.
    """
    heads = materialize(heads_of(sets, percent), "jaccard-heads")
    common = heads.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("token")
    lists = heads.join(common, "token")
    held = lists.groupBy("token", "grp").agg(
        F.min("n").alias("small"), F.max("most").alias("large"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("prev").alias("p0"), F.max("prev").alias("p1")
    )
    meet = F.expr(
        "q.token = h.token and q.grp < h.grp and q.n <= h.large and h.small <= q.most "
        "and not (h.r0 = q.root and h.r1 = q.root) and not (q.prev <> 0 and h.p0 = q.prev and h.p1 = q.prev)"
    )
    found = materialize(lists.alias("q").join(held.alias("h"), meet).select("q.sig", "q.n", F.col("h.grp").alias("to")).distinct(), "jaccard-routes")
    drop(heads)
    return found


class Group:
    """A group of the matrix: the union of its tokens, and the members that have each."""

    def __init__(self, sizes: list[int], roots: list[int], sets: list[np.ndarray]):
        self.sizes, self.roots, self.sets = np.array(sizes, np.int64), np.array(roots, np.int64), sets
        every = np.concatenate(sets)
        who = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
        order = np.argsort(every, kind="stable")
        every, self.who = every[order], who[order]
        self.first, self.count = runs(every)
        self.union = every[self.first]
        self.one = len(np.unique(self.roots)) == 1
        self.links: set[tuple[int, int]] = set()

    def ask(self, root: int, n: int, tokens: np.ndarray, percent: int) -> None:
        """Adds the links of a set with the members of other roots."""
        own = int(self.roots[0])
        if self.one and (own == root or (root, own) in self.links):
            return
        spot = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        spot = spot[self.union[spot] == tokens]
        if len(spot) < needed(n, percent):
            return  # no member of this group can reach the overlap
        if self.one and any(similar(tokens, n, self.sets[i], int(self.sizes[i]), percent) for i in range(min(PROBES, len(self.sets)))):
            self.links.add((root, own))
            return
        count = self.count[spot]
        at = np.repeat(self.first[spot] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        inter = np.bincount(self.who[at], minlength=len(self.sets))
        good = (100 * inter >= percent * (n + self.sizes - inter)) & (self.roots != root)
        self.links.update((root, int(r)) for r in np.unique(self.roots[good]))


def opened(rows: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Links (a, b) between roots. Rows are (grp, qblock, role, n, root, s): members (role 0) and queries (role 1) of groups.

    A task gathers one group and streams its queries past it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, group = None, [], None

        def start() -> Group | None:
            if not held:
                return None
            found = Group(*(list(x) for x in zip(*held)))
            if at[1] == 0 and not found.one:  # the members among themselves, in one copy of the group
                for n, root, tokens in held:
                    found.ask(root, n, tokens, percent)
            return found

        def links() -> pa.RecordBatch:
            pairs = list(group.links) if group else []
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for grp, block, role, n, root, s in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (grp, block) != at:
                    if at is not None:
                        group = group or start()
                        yield links()
                    at, held, group = (grp, block), [], None
                if role == 0:
                    held.append((n, root, np.frombuffer(s, U)))
                    continue
                group = group or start()
                if group:
                    group.ask(root, n, np.frombuffer(s, U), percent)
        if at is not None:
            group = group or start()
            yield links()
        settle()

    dealt = rows.repartition(tasks, "grp", "qblock").sortWithinPartitions("grp", "qblock", "role")
    return dealt.mapInArrow(run, "a long, b long")


def root_links(sets: DataFrame, percent: int) -> DataFrame:
    """The token-group matrix: queries by prefix token, bounds by the unions, opened groups."""
    routes = routes_of(sets, percent)
    blocks = routes.groupBy("to").agg(F.ceil(F.count("*") / F.lit(float(GROUP_QUERIES))).alias("blocks"))
    asked = routes.join(blocks, "to").withColumn("qblock", F.pmod(F.xxhash64("sig", "n"), F.col("blocks")))
    queries = sets.select("sig", "n", "root", "s").join(asked, ["sig", "n"]).select(F.col("to").alias("grp"), "qblock", F.lit(1).alias("role"), "n", "root", "s")
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1)
    held = sets.join(blocks.withColumnRenamed("to", "grp"), "grp", "left").select("grp", F.explode(copies).alias("qblock"), F.lit(0).alias("role"), "n", "root", "s")
    count, size = sets.agg(F.count("*"), F.coalesce(F.sum(F.length("s")), F.lit(0))).first()
    sent = (count + routes.count()) * size // max(1, count)
    tasks = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sent // TASK_BYTES))
    links = materialize(opened(held.unionByName(queries), percent, tasks).distinct(), "jaccard-links")
    drop(routes)
    return links


#: Rows of one text that are joined by broadcast; at most 100,000 such texts, whatever the input.
HOT_ROWS = 1000


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id) for every row."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sized = materialize(sizes_of(slim, width), "jaccard-sizes")
    total = sized.agg(F.sum("n")).first()[0] or 0
    by = Buckets(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_TOKENS)))
    found = materialize(survivors_of(shared_of(blocks_of(slim, width, by), by), by, percent), "jaccard-sets")
    members = materialize(clusters_of(found, percent), "jaccard-members")
    roots = rooted(members, percent)
    sets = materialize(grouped(members, roots), "jaccard-groups")
    links = root_links(sets, percent)
    comps = connected_components(links).withColumnRenamed("node", "root")
    top = materialize(sets.select("sig", "n", "root").join(comps, "root", "left").select("sig", "n", F.coalesce("component", "root").alias("top")), "jaccard-tops")
    drop(found, members, sets, links)
    first = sized.where("n > 0").groupBy("sig", "n").agg(F.min("id").alias("own"), F.count("*").alias("c"))
    linked = first.join(top, ["sig", "n"])
    least = linked.groupBy("top").agg(F.min("own").alias("least"))
    named = first.join(linked.join(least, "top").select("sig", "n", "least"), ["sig", "n"], "left").select("sig", "n", "c", F.coalesce("least", "own").alias("component_id"))
    named = materialize(named, "jaccard-names")
    # rows of very common texts don't meet in one task: their names go to where the rows are
    rows = sized.count()
    hot = F.broadcast(named.where(F.col("c") > max(HOT_ROWS, rows // 100_000)).select("sig", "n", F.col("component_id").alias("hot_id"), F.lit(True).alias("is_hot")))
    marked = sized.join(hot, ["sig", "n"], "left")
    rest = marked.where("is_hot is null").join(named.select("sig", "n", "component_id"), ["sig", "n"], "left")
    every = rest.select("id", "n", "component_id").unionByName(marked.where("is_hot").select("id", "n", F.col("hot_id").alias("component_id")))
    return every.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
