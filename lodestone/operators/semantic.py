"""The semantic channel: TF-IDF with sublinear counts, truncated SVD, unit vectors.

Weights are DataFrame aggregates: tf = 1 + ln(count), idf = ln((1 + n) / (1 + df)) + 1,
rows of length one. Words (pairs of them too) and character n-grams inside words
are two halves; a text's vector is both, made unit again, so a pair's score is the
mean of the halves' cosines where both halves are there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lodestone import settings as S
from lodestone.storage import drop, materialize

BACKENDS = ("tfidf_svd", "sbert", "auto")


def word_terms(text: Column) -> Column:
    """Words of two or more letters and digits, and pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, F.filter(F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda t: t.isNotNull()))


def char_terms(text: Column, low: int = 3, high: int = 5) -> Column:
    """N-grams inside the words, each padded by a space on both sides; a short word is one term."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w: Column, n: int) -> Column:
        count = F.length(w) - n + 1
        whole = F.when(F.lit(n == low) | (F.length(w) >= n), F.array(w)).otherwise(F.array().cast("array<string>"))
        return F.when(count >= 1, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))).otherwise(whole if n == low else F.array().cast("array<string>"))

    return F.flatten(F.transform(padded, lambda w: F.concat(*[grams(w, n) for n in range(low, high + 1)])))


def tfidf(texts: DataFrame, terms: Column, min_df: int = 1) -> DataFrame:
    """(id, term, weight) of (id, text); rows have length one."""
    n = texts.count()
    tf = texts.select("id", F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count("*").alias("c"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    raw = tf.join(df, "term").select("id", "term", ((1 + F.log("c")) * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)).alias("w"))
    held = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("term", "w")).alias("t"))  # a text's terms
    return held.select("id", "norm", F.explode("t").alias("t")).select("id", "t.term", (F.col("t.w") / F.col("norm")).alias("weight"))


def sparse_cosine(weights: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, cosine) for given pairs, before any SVD."""
    x, y = weights.alias("x"), weights.alias("y")
    hits = pairs.join(x, F.col("a") == F.col("x.id")).join(y, (F.col("b") == F.col("y.id")) & (F.col("x.term") == F.col("y.term")))
    sums = hits.groupBy("a", "b").agg(F.sum(F.col("x.weight") * F.col("y.weight")).alias("cosine"))
    return pairs.select("a", "b").join(sums, ["a", "b"], "left").select("a", "b", F.coalesce("cosine", F.lit(0.0)).alias("cosine"))


def _dense(batch: pd.DataFrame, width: int) -> np.ndarray:
    """Rows of a batch (arrays j and w) as a dense matrix."""
    x = np.zeros((len(batch), width))
    if len(batch):
        x[np.repeat(np.arange(len(batch)), [len(j) for j in batch["j"]]), np.concatenate(list(batch["j"]))] = np.concatenate(list(batch["w"]))
    return x


def _summed(rows: DataFrame, width: int, f, columns: int) -> np.ndarray:
    """The sum of f(X) over all rows X: partial sums where the rows are, added up by blocks of 512."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((width, columns))
        for batch in batches:
            for at in range(0, len(batch), 256):
                acc += f(_dense(batch.iloc[at : at + 256], width))
        yield pd.DataFrame({"block": range(0, width, 512), "m": [acc[i : i + 512].tobytes() for i in range(0, width, 512)]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [group["block"].iloc[0]], "m": [sum(np.frombuffer(m) for m in group["m"]).tobytes()]})

    sums = rows.select("j", "w").mapInPandas(part, "block long, m binary").groupBy("block").applyInPandas(add, "block long, m binary")
    return np.concatenate([np.frombuffer(r.m) for r in sums.orderBy("block").collect()]).reshape(width, columns)  # width x columns, both bounded


class OneBlock:
    """A vocabulary of one block: the basis is an array that is broadcast."""

    def __init__(self, cells: DataFrame, width: int):
        self.cells, self.width = cells, width

    def exact(self, k: int) -> np.ndarray:
        """The first k right singular vectors, from the Gramian."""
        return np.linalg.eigh(_summed(self.cells, self.width, lambda x: x.T @ x, self.width))[1][:, ::-1][:, :k]

    def start(self, size: int, seed: int) -> np.ndarray:
        return np.random.default_rng(seed).normal(size=(self.width, size))

    def gramian(self, z: np.ndarray) -> np.ndarray:
        return z.T @ z

    def turned(self, z: np.ndarray, by: np.ndarray) -> np.ndarray:
        return z @ by

    def multiplied(self, q: np.ndarray) -> np.ndarray:
        return _summed(self.cells, self.width, lambda x: x.T @ (x @ q), q.shape[1])

    def projected(self, basis: np.ndarray) -> DataFrame:
        held, width = self.cells.sparkSession.sparkContext.broadcast(basis), self.width

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), 256):
                    part = batch.iloc[at : at + 256]
                    yield pd.DataFrame({"id": part["id"], "y": [v.tobytes() for v in _dense(part, width) @ held.value]})

        return self.cells.select("id", "j", "w").mapInPandas(run, f"id {self.cells.schema['id'].dataType.simpleString()}, y binary")


def _added(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the sum of the vectors (doubles as bytes) of each key. One key's vectors stream by."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, acc = None, None
        for batch in batches:
            keys, sums = [], []
            for k, v in zip(batch[key], batch[value]):
                if acc is not None and k == at:
                    acc = acc + np.frombuffer(v)
                    continue
                if acc is not None:
                    keys.append(at)
                    sums.append(acc.tobytes())
                at, acc = k, np.frombuffer(v)
            yield pd.DataFrame({key: pd.Series(keys, dtype=object), value: pd.Series(sums, dtype=object)})
        if acc is not None:
            yield pd.DataFrame({key: [at], value: [acc.tobytes()]})

    return rows.select(key, value).repartition(key).sortWithinPartitions(key).mapInPandas(run, f"{key} {kind}, {value} binary")


class ManyBlocks:
    """A vocabulary of any size: the basis is a table (b, m) of blocks of terms, nothing of its length is ever in one place.

    ``cells`` is (id, b, j, w): a row's terms in a block. A hot block's cells are dealt
    to several tasks, each of which is sent the block's part of the basis.
    """

    SALT_ROWS = 50_000

    def __init__(self, cells: DataFrame, columns: int = 0):
        self.cells, self.columns = cells, columns
        self.id_kind = cells.schema["id"].dataType.simpleString()
        sizes = cells.groupBy("b").agg((F.max(F.array_max("j")) + 1).alias("n"), F.ceil(F.count("*") / float(self.SALT_ROWS)).alias("salts"))
        self.sizes = materialize(sizes, "svd-blocks")
        salted = cells.join(self.sizes.select("b", "salts"), "b").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts"))).drop("salts")
        self.salted = materialize(salted, "svd-cells")

    def start(self, size: int, seed: int) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"b": batch["b"], "m": [np.random.default_rng([seed, b]).normal(size=(n, size)).tobytes() for b, n in zip(batch["b"], batch["n"])]})

        self.columns = size
        return materialize(self.sizes.mapInPandas(run, "b long, m binary"), "svd-basis")

    def gramian(self, z: DataFrame) -> np.ndarray:
        size = self.columns

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc = np.zeros((size, size))
            for batch in batches:
                for m in batch["m"]:
                    x = np.frombuffer(m).reshape(-1, size)
                    acc += x.T @ x
            yield pd.DataFrame({"one": [0], "m": [acc.tobytes()]})

        return np.frombuffer(_added(z.mapInPandas(run, "one int, m binary"), "one", "m").first().m).reshape(size, size)

    def turned(self, z: DataFrame, by: np.ndarray) -> DataFrame:
        size = self.columns

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"b": batch["b"], "m": [(np.frombuffer(m).reshape(-1, size) @ by).tobytes() for m in batch["m"]]})

        self.columns = by.shape[1]
        return materialize(z.mapInPandas(run, "b long, m binary"), "svd-basis")

    def projected(self, q: DataFrame) -> DataFrame:
        """(id, y): the rows times the basis."""
        size = self.columns
        none = F.lit(None)
        held = q.join(self.sizes, "b").select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), none.cast(self.id_kind).alias("id"), none.cast("array<int>").alias("j"), none.cast("array<double>").alias("w"), "m")
        rows = self.salted.select("b", "salt", F.lit(1).alias("role"), "id", "j", "w", none.cast("binary").alias("m"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            basis = np.zeros((0, size))
            for batch in batches:
                ids, out = [], []
                for role, i, j, w, m in zip(batch["role"], batch["id"], batch["j"], batch["w"], batch["m"]):
                    if role == 0:
                        basis = np.frombuffer(m).reshape(-1, size)
                    else:
                        ids.append(i)
                        out.append((np.asarray(w) @ basis[np.asarray(j)]).tobytes())
                yield pd.DataFrame({"id": pd.Series(ids, dtype=object), "y": pd.Series(out, dtype=object)})

        dealt = held.unionByName(rows).repartition("b", "salt").sortWithinPartitions("b", "salt", "role")
        return _added(dealt.mapInPandas(run, f"id {self.id_kind}, y binary"), "id", "y")

    def multiplied(self, q: DataFrame) -> DataFrame:
        size = self.columns
        y = materialize(self.projected(q), "svd-projected")
        rows = self.salted.join(y, "id").join(self.sizes.select("b", "n"), "b").select("b", "salt", "n", "j", "w", "y")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, acc = None, None
            for batch in batches:
                done: list[tuple[int, bytes]] = []
                for b, salt, n, j, w, v in zip(batch["b"], batch["salt"], batch["n"], batch["j"], batch["w"], batch["y"]):
                    if (b, salt) != at:
                        if acc is not None:
                            done.append((at[0], acc.tobytes()))
                        at, acc = (b, salt), np.zeros((n, size))
                    acc[np.asarray(j)] += np.asarray(w)[:, None] * np.frombuffer(v)[None]  # a row has a term once
                yield pd.DataFrame({"b": pd.Series([b for b, _ in done], dtype=object), "m": pd.Series([m for _, m in done], dtype=object)})
            if acc is not None:
                yield pd.DataFrame({"b": [at[0]], "m": [acc.tobytes()]})

        parts = rows.repartition("b", "salt").sortWithinPartitions("b", "salt").mapInPandas(run, "b long, m binary")
        out = materialize(_added(parts, "b", "m"), "svd-basis")
        drop(y)
        return out


def iterated_basis(matrix: OneBlock | ManyBlocks, size: int, k: int, seed: int = S.SEED, tolerance: float = 1e-5, most: int = 12):
    """The first k right singular vectors by subspace iteration, until the k singular values stand still."""

    def whitened(z, keep: int):
        values, turn = np.linalg.eigh(matrix.gramian(z))
        values, turn = np.maximum(values[::-1][:keep], 0.0), turn[:, ::-1][:, :keep]
        good = values > 1e-14 * max(values[0], 1e-300)
        out = matrix.turned(z, turn[:, good] / np.sqrt(values[good]))
        if isinstance(z, DataFrame):
            drop(z)
        return out, np.sqrt(values)

    q, _ = whitened(matrix.start(size, seed), size)
    last = None
    for _ in range(most):
        z = matrix.multiplied(q)
        if isinstance(q, DataFrame):
            drop(q)
        q, values = whitened(z, size)
        q, _ = whitened(q, size)  # once more, for what rounding left
        still = last is not None and len(last) == len(values) and np.abs(values[:k] - last[:k]).max() <= tolerance * values[0]
        if still:
            break
        last = values
    return whitened(matrix.multiplied(q), k)[0]


#: Terms of a block, and terms up to which the basis comes from the Gramian at once.
BLOCK_TERMS, GRAMIAN_TERMS = 8192, 2048


def svd_vectors(weights: DataFrame, ids: DataFrame, components: int) -> DataFrame:
    """(id, v): projections on the first right singular vectors, of length one (zeros without terms).

    Every term has a column of its own, whatever the size of the vocabulary: terms
    are dealt to blocks, and beyond one block the basis is a table of blocks.
    """
    terms = weights.select("term").distinct()
    size = terms.count()
    if size == 0:
        return ids.select("id", F.array(F.lit(0.0)).alias("v"))
    blocks = -(-size // BLOCK_TERMS)
    place = F.row_number().over(Window.partitionBy("b").orderBy("term")) - 1  # a block's terms
    index = materialize(terms.withColumn("b", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("long")).withColumn("i", place.cast("int")), "svd-terms")
    cells = weights.join(index, "term").groupBy("id", "b").agg(F.collect_list("i").alias("j"), F.collect_list("weight").alias("w"))
    cells = materialize(cells, "svd-rows")
    k = min(components, max(2, ids.count() - 1), size)
    matrix = OneBlock(cells, size) if blocks == 1 else ManyBlocks(cells)
    basis = matrix.exact(k) if blocks == 1 and size <= GRAMIAN_TERMS else iterated_basis(matrix, min(size, k + 20), k)
    found = matrix.projected(basis)

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [np.frombuffer(y) for y in batch["y"]]
            yield pd.DataFrame({"id": batch["id"], "v": [y / (np.linalg.norm(y) or 1.0) for y in rows]})

    kind = ids.schema["id"].dataType.simpleString()
    zero = F.array_repeat(F.lit(0.0), k)
    return ids.join(found.mapInPandas(unit, f"id {kind}, v array<double>"), "id", "left").select("id", F.coalesce("v", zero).alias("v"))


class SemanticEncoder:
    """Backends: tfidf_svd; sbert where its package is installed; auto falls back with a warning."""

    def __init__(self, backend: str = "tfidf_svd"):
        if backend not in BACKENDS:
            raise ValueError(f"unknown semantic backend {backend!r}; expected one of {BACKENDS}")
        self.backend_used = "tfidf_svd"
        if backend != "tfidf_svd":
            try:
                import sentence_transformers  # noqa: F401

                self.backend_used = "sbert"
            except ImportError as e:
                if backend == "sbert":
                    raise RuntimeError("the sbert backend needs the sentence_transformers package") from e
                import warnings

                warnings.warn("sentence_transformers isn't installed; using tfidf_svd", RuntimeWarning, stacklevel=2)

    def encode(self, texts: DataFrame) -> DataFrame:
        """(id, v) of (id, text): unit vectors."""
        if self.backend_used == "sbert":
            return self._sbert(texts)
        ids, clean = texts.select("id"), texts.select("id", F.coalesce("text", F.lit("")).alias("text"))
        word = svd_vectors(tfidf(clean, word_terms(F.col("text"))), ids, S.WORD_COMPONENTS)
        char = svd_vectors(tfidf(clean, char_terms(F.col("text")), 2), ids, S.CHAR_COMPONENTS)
        return word.join(char.withColumnRenamed("v", "c"), "id").select("id", joined("v", "c").alias("v"))

    @staticmethod
    def _sbert(texts: DataFrame, model: str = "paraphrase-multilingual-MiniLM-L12-v2") -> DataFrame:
        @F.pandas_udf(ArrayType(DoubleType()))
        def run(t: pd.Series) -> pd.Series:
            from sentence_transformers import SentenceTransformer

            return pd.Series(list(SentenceTransformer(model).encode(list(t.fillna("")), normalize_embeddings=True).astype(float)))

        return texts.select("id", run("text").alias("v"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def joined(a: str, b: str) -> Column:
    """Both halves as one vector of length one."""
    both = F.concat(a, b)
    norm = F.greatest(F.sqrt(F.aggregate(both, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-9))
    # the length is bound once by the outer lambda, not told anew for each element
    return F.get(F.transform(F.array(norm), lambda n: F.transform(both, lambda x: x / n)), F.lit(0))


def semantic_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Adds ``semantic`` to (a, b, ...): the dot product of unit vectors, within 0 and 1."""
    left = vectors.select(F.col("id").alias("a"), F.col("v").alias("_va"))
    right = vectors.select(F.col("id").alias("b"), F.col("v").alias("_vb"))
    joined = pairs.join(left, "a", "left").join(right, "b", "left")
    found = F.coalesce(dot(F.col("_va"), F.col("_vb")), F.lit(0.0))  # least and greatest pass nulls over
    return joined.withColumn("semantic", F.greatest(F.lit(0.0), F.least(F.lit(1.0), found))).drop("_va", "_vb")
