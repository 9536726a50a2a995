"""Scores of whole blocks against those of pairs made one by one."""

import pytest
from pyspark.sql import functions as F

from lodestone import settings as S
from lodestone.operators import blocking, blockwise, scoring

NAMES = ["min_known_attrs", "same_category", "cross_cpse", "attribute", "n_comparable_attrs", "n_agree_attrs", "n_conflicts", "hard_conflict"]


@pytest.fixture(scope="module")
def records(spark):
    """Odd values too: zero, infinite, NaN, blank, texts inside others; no category, no owner."""
    r = F.col("id")
    numbers = {n: F.when((r + i) % 5 < 2, ((r * 7 + i) % 9).cast("double")).when((r + i) % 31 == 0, F.lit(float("inf"))).when((r + i) % 29 == 0, F.lit(float("nan"))) for i, n in enumerate(S.NUMERIC)}
    texts = {n: F.when((r + i) % 3 == 0, F.element_at(F.array(*[F.lit(x) for x in ("A", "a105", "astm a105", " ", "B")]), ((r + i) % 5 + 1).cast("int"))) for i, n in enumerate(S.CATEGORICAL)}
    cats = F.element_at(F.array(F.lit("hot bolt"), F.lit("hot ring"), F.lit("old bolt"), F.lit(None)), (r % 4 + 1).cast("int"))
    df = spark.range(150).select(r.alias("rid"), cats.alias(S.CATEGORY), F.when(r % 6 > 0, F.concat(F.lit("o"), r % 3)).alias(S.OWNER), *[c.alias(n) for n, c in (numbers | texts).items()])
    return df.localCheckpoint()


def rows(df, names=NAMES):
    return sorted(map(repr, df.select("a", "b", *names).collect()))


@pytest.mark.parametrize("families", [["category_size"], list(blocking.FAMILIES)])
def test_scores_of_blocks(records, families):
    blocks = blocking.build_blocks(records, families)
    blocks = blocks.unionByName(blocks.where("rid % 10 = 0"))  # repeated rows
    got = blockwise.score_blocks(records, blocks, most=20, flags=True)
    want = scoring.score_attributes(records, blocking.candidate_pairs(blocks, 20, families))
    told = lambda df: df.withColumn("flags", F.array_sort(F.map_entries("flags")))
    assert want.count() > 500
    assert rows(told(got), [*NAMES, "flags"]) == rows(told(want), [*NAMES, "flags"])
    assert rows(blockwise.score_blocks(records, blocks, 20, least=0.5)) == rows(want.where("attribute >= 0.5"))


def test_best_of_blocks_hold_the_best_of_all(records):
    blocks = blocking.build_blocks(records)
    want = scoring.score_attributes(records, blocking.candidate_pairs(blocks, 20))
    few = blockwise.score_blocks(records, blocks, 20, best=3)
    top = lambda df: sorted(map(repr, scoring.top_k(df, 3, "attribute").collect()))
    assert top(few) == top(want)
    assert few.count() < want.count()


def test_attributes_of_different_texts_are_those_of_every_text(spark, sf):
    from lodestone.functions.attributes import with_attributes
    from lodestone.plans.bindings import materials

    df = materials(spark, sf).limit(60).unionByName(materials(spark, sf).limit(30)).withColumn(S.RAW, F.when(F.col("rid") % 9 > 0, F.col(f"`{S.RAW}`")))
    df = df.localCheckpoint()
    told = lambda d: sorted(map(repr, d.withColumn("attr_provenance", F.array_sort(F.map_entries("attr_provenance"))).collect()))
    once = with_attributes(df, once=True)
    every = with_attributes(df)
    assert told(once.select(*every.columns)) == told(every)
    assert "Exchange" not in every._jdf.queryExecution().executedPlan().toString()


def test_labels_count_as_their_pairs(spark, records):
    from lodestone.operators import matching
    from lodestone.operators.profile import truth_pairs

    blocks = blocking.build_blocks(records)
    scored = scoring.score_attributes(records, blocking.candidate_pairs(blocks, 20)).localCheckpoint()
    labels = spark.range(140).select(F.col("id").alias("rid"), F.when(F.col("id") % 11 > 0, (F.col("id") % 8).cast("string")).alias("gt_group"))
    held, grid = records.where("rid % 3 > 0").select("rid"), [0.3, 0.6, 0.9]
    want = matching.tune_edge_threshold(scored, records, truth_pairs(labels), held, "attribute", grid)
    got = matching.tune_edge_threshold(blockwise.score_blocks(records, blocks, 20, forest=True), records, labels, held, "attribute", grid)
    assert got[0] == want[0] and got[1].values.tolist() == want[1].values.tolist()
    clusters = spark.createDataFrame([(0, list(range(0, 40)), "HIGH"), (1, list(range(40, 160)), "MEDIUM"), (2, [160, 161], "LOW")], "cluster_id long, members array<long>, tier string")
    told = lambda t: sorted(map(repr, matching.evaluate(clusters, t, records).collect()))
    assert told(labels) == told(truth_pairs(labels))
