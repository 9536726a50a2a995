"""String scores of many pairs at once, and inside blocks, against those of pairs one by one."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodestone import settings as S
from lodestone.functions import strings
from lodestone.operators import blocking, blockwise, scoring


def test_many_pairs_score_as_one_by_one():
    rng = random.Random(3)
    words = ["hot", "bolt", "33", "mm", "astm", "a-105", "b", "steel 304", "é", "ab", "aab"]
    texts = {" ".join(rng.choices(words, k=rng.randrange(9))) + " " * (rng.random() < 0.1) for _ in range(60)}
    texts = sorted(texts | {"".join(rng.choices("ab c", k=k)) for k in (1, 2, 3, 4, 5, 20, 62, 63, 64, 65, 66, 90, 200)}) + [None, ""]
    x, y = np.nonzero(np.ones((len(texts), len(texts)), bool))
    want = [strings.string_similarity(texts[i], texts[j]) for i, j in zip(x, y)]
    assert strings.similarities(texts, x, y).tolist() == want
    assert strings.similarities([], np.zeros(0, int), np.zeros(0, int)).tolist() == []


def test_strings_of_blocks(spark):
    r = F.col("id")
    text = F.when(r % 13 > 0, F.concat(F.lit("BOLT "), r % 7, F.lit(" MM "), F.when(r % 3 == 0, F.lit("CS, GR.B")).otherwise(F.repeat(F.lit("ASTM "), (r % 20).cast("int")))))
    df = spark.range(90).select(r.alias("rid"), text.alias(S.RAW), F.element_at(F.array(F.lit("hot bolt"), F.lit("hot ring")), (r % 2 + 1).cast("int")).alias(S.CATEGORY), F.lit(5.0).alias("nominal_size_mm")).localCheckpoint()
    blocks = blocking.build_blocks(df)
    told = lambda d: sorted(map(repr, d.select("a", "b", "string").collect()))
    got = blockwise.string_blocks(df, blocks, most=20)
    assert told(got) == told(scoring.score_strings(df, blocking.candidate_pairs(blocks, 20)))
    assert "_ta" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_cosines_of_blocks(spark, monkeypatch):
    from lodestone.operators import semantic

    r = F.col("id")
    texts = spark.range(90).select("id", F.when(r % 13 > 0, F.concat_ws(" ", F.lit("bolt"), *[F.concat(F.lit("w"), r % k) for k in (3, 5, 7)])).alias("text"))
    df = texts.select(r.alias("rid"), F.lit("hot bolt").alias(S.CATEGORY), F.lit(5.0).alias("nominal_size_mm"))
    weights = semantic.tfidf(texts, semantic.word_terms(F.coalesce("text", F.lit("")))).localCheckpoint()
    blocks = blocking.build_blocks(df)
    told = lambda d: sorted((x.a, x.b, round(x.cosine, 9)) for x in d.select("a", "b", "cosine").collect())
    got = blockwise.cosine_blocks(weights, blocks, most=20)
    assert told(got) == told(semantic.sparse_cosine(weights, blocking.candidate_pairs(blocks, 20)))
    # more terms than columns at a time
    import pyarrow as pa

    monkeypatch.setattr(blockwise, "WIDE", 2)
    x = blockwise._cosines(pa.array([["a", "b", "c"], None, ["c", "d", "a"]]), pa.array([[1.0, 2.0, 3.0], None, [4.0, 5.0, 6.0]]), 3)
    assert x.tolist() == [[14.0, 0.0, 18.0], [0.0, 0.0, 0.0], [18.0, 0.0, 77.0]]
