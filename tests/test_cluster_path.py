"""What clusters, queues and dashboards read: few edges are shuffled and records aren't joined with themselves."""

import random

from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.plans import queries


def test_edges_of_a_partition_are_contracted(spark):
    rng = random.Random(5)
    pairs = [(10 * i + rng.randrange(10), 10 * i + rng.randrange(10)) for i in range(40) for _ in range(30)] + [(7, 95), (95, 301)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    few = graph._contracted(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), most=50).collect()
    assert len(few) < len(pairs) / 1.2 and all(r.u > r.v for r in few)
    text = lambda df: sorted((int(r.node), int(r.component)) for r in df.collect())
    want = graph.connected_components(edges.select(*[F.struct(F.col(c).alias("x")).alias(c) for c in "ab"]))
    assert text(graph.connected_components(edges)) == text(want.select("node.*", "component.*").toDF("node", "component"))


def test_sizes_come_from_the_rows_of_the_records(spark, sf):
    assert "Join" not in queries.sized(spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_best_candidates_score_their_blocks_once(spark, sf):
    plan = queries.QUERIES["score_top_k"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1
