"""All three channels inside blocks against those of pairs made one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import settings as S
from lodestone.functions.rounding import rounded
from lodestone.operators import blocking, blockwise, classify, scoring

SCORES = ["semantic", "string", "attribute", "fused"]


@pytest.fixture(scope="module")
def inputs(spark):
    """Records, blocks, vectors (some missing, short, with a null or a NaN) and labels (some missing)."""
    r = F.col("id")
    text = F.when(r % 13 > 0, F.concat(F.lit("BOLT "), r % 7, F.lit(" MM "), F.when(r % 3 == 0, F.lit("CS, GR.B")).otherwise("x")))
    given = {"nominal_size_mm": (r % 9).cast("double"), "grade": F.when(r % 4 > 0, F.concat(F.lit("b"), r % 2)), "schedule": F.when(r % 5 > 1, (r % 3).cast("string"))}
    cats = F.element_at(F.array(F.lit("hot bolt"), F.lit("hot ring"), F.lit("old bolt")), (r % 3 + 1).cast("int"))
    rest = {n: F.lit(None).cast("double" if n in S.NUMERIC else "string") for n in S.ATTRIBUTES}
    df = spark.range(120).select(r.alias("rid"), text.alias(S.RAW), cats.alias(S.CATEGORY), F.concat(F.lit("o"), r % 3).alias(S.OWNER), *[c.alias(n) for n, c in (rest | given).items()]).localCheckpoint()
    v = F.array(*[F.sin(r * k).cast("float") for k in (1, 2, 3)])
    odd = F.when(r % 19 == 0, F.array(F.lit(0.5), F.lit(None), F.lit(0.5))).when(r % 17 == 0, F.array(F.lit(0.5), F.lit(0.5))).when(r == 7, F.array(F.lit(float("nan")), F.lit(0.0), F.lit(0.0))).when(r != 20, v)
    vectors = spark.range(110).select("id", odd.cast("array<float>").alias("v"))
    labels = spark.range(100).select(r.alias("rid"), F.when(r % 11 > 0, (r % 8).cast("string")).alias("gt_group"))
    return df, blocking.build_blocks(df), vectors, labels


def test_channels_of_blocks(inputs):
    df, blocks, vectors, labels = inputs
    want = scoring.score_pairs(df, blocking.candidate_pairs(blocks, 20), vectors).localCheckpoint()
    names = [c for c in want.columns if c not in ("flags", "semantic_backend", *SCORES)]
    told = lambda d: sorted(map(repr, d.select(*names, *[F.round(c, 9).alias(c) for c in SCORES]).collect()))
    got = blockwise.channel_blocks(df, blocks, vectors, most=20)
    assert want.count() > 500 and told(got) == told(want)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]  # pairs don't meet records again
    means = [*SCORES, "n_conflicts"]
    every = classify.label_pairs(want, labels).groupBy("label").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in means])
    told = lambda d: sorted(map(repr, d.select("label", "n", *[F.round(c, 9) for c in means]).collect()))
    assert told(blockwise.channel_means(df, blocks, vectors, labels, means, most=20)) == told(every)


def test_rounding_is_that_of_spark(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.random(3000), (rng.integers(0, 10**6, 3000) + 0.5) / 1e6, np.nextafter((rng.integers(0, 10**6, 3000) + 0.5) / 1e6, 0), [0.0, 1.0, -0.0000005, -0.3000005]])
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert rounded(x, 6).tolist() == want


def test_labelled_blocks_train_as_pairs_do(inputs):
    df, blocks, vectors, labels = inputs
    scored = scoring.score_pairs(df, blocking.candidate_pairs(blocks, 20), vectors).localCheckpoint()
    want = classify.label_pairs(classify.group_disjoint_split(scored, labels), labels)
    got = blockwise.labelled_blocks(df, blocks, vectors, labels, classify.record_sides(labels), most=20).localCheckpoint()
    told = lambda d: sorted(map(repr, d.where("split <> 'discarded'").select("a", "b", "label", "split", *[F.round(F.col(f).cast("double"), 9) for f in classify.FEATURES]).collect()))
    assert told(got) == told(want)
    assert got.where("split = 'discarded'").agg(F.sum("n")).first()[0] == want.where("split = 'discarded'").count() > got.where("split = 'discarded'").count()
    numbers = lambda r: [r.n_train_pairs, r.n_val_pairs, r.n_test_pairs, r.n_discarded_pairs, r.threshold, *[round(x, 6) for x in (r.precision, r.recall, r.f1, r.average_precision)]]
    assert numbers(classify.train(got, labels, "logistic_regression")[1]) == numbers(classify.train(scored, labels, "logistic_regression")[1])
