"""Clusters and sweeps over whole blocks: none is cut, whatever its size."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone import settings as S
from lodestone.operators import blocking, blockwise, matching, scoring
from lodestone.operators.graph import connected_components
from lodestone.plans.queries import ORACLE, QUERIES

GRID = [0.3, 0.5, 0.7, 0.99]
CUT = "(row_number() OVER (PARTITION BY family, key ORDER BY rid) - 1) // 400 AS part"


@pytest.fixture(scope="module")
def records(spark):
    """Few kinds of records, some without attributes; infinite numbers, which conflict with themselves."""
    r = F.col("id")
    numbers = {n: F.when((r + i) % 4 == 0, (r % (3 + i)).cast("double")) for i, n in enumerate(S.NUMERIC[1:3])}
    size = F.when(r % 7 == 0, F.lit(float("inf"))).when(r % 3 == 0, (r % 4 * 20).cast("double"))
    texts = {n: F.when((r + i) % 3 == 0, F.element_at(F.array(*[F.lit(x) for x in ("A", "a105", " ", "B")]), ((r + i) % 4 + 1).cast("int"))) for i, n in enumerate(S.CATEGORICAL[:3])}
    none = {n: F.lit(None).cast("double" if n in S.NUMERIC else "string") for n in S.ATTRIBUTES}
    made = none | {"nominal_size_mm": size} | numbers | texts
    made = {n: F.when(r % 11 > 0, c) for n, c in made.items()}
    return spark.range(300).select(r.alias("rid"), F.lit("bolt").alias(S.CATEGORY), F.lit("o").alias(S.OWNER), F.lit(2).alias("n_known_attributes"), *[c.alias(n) for n, c in made.items()]).localCheckpoint()


@pytest.fixture(scope="module")
def blocks(spark, records):
    key = F.when(F.col("rid") % 5 > 0, F.lit("x")).otherwise(F.lit("y"))
    every = records.select(F.lit("category_size").alias("family"), key.alias("key"), "rid")
    return every.unionByName(every.where("rid % 10 = 0")).unionByName(records.where("rid < 9").select(F.lit("category_token").alias("family"), F.lit("z").alias("key"), "rid"))


def parts_at(scored):
    """The components at each threshold, each settled alone."""
    return [sorted(map(tuple, connected_components(scored.where(F.col("attribute") >= t), one_task_below=10**6).collect())) for t in GRID]


def test_forests_of_whole_blocks_have_the_components_of_all_pairs(records, blocks):
    want = scoring.score_attributes(records, blocking.candidate_pairs(blocks, 1000)).localCheckpoint()
    parts, told = parts_at(want), {(r.a, r.b): r.attribute for r in want.collect()}
    for least, kinds in ((None, 1024), (None, 9), (GRID[2], 9)):
        got = blockwise.forest_blocks(records, blocks, least, kinds).localCheckpoint()
        at = GRID.index(least) if least else 0
        assert parts_at(got)[at:] == parts[at:]
        assert got.count() < want.count() / 3
        assert all(told[r.a, r.b] == r.attribute for r in got.collect())
    got = matching.members_at(want, "attribute", [0.0, *GRID, 1.1]).collect()
    assert [sorted((r.rid, r.part) for r in got if r.k == k) for k in range(1, len(GRID) + 2)] == [*parts, []]
    own = records.select("rid", F.when(F.col("rid") % 9 > 0, F.concat(F.lit("o"), F.col("rid") % 2)).alias(S.OWNER), "n_known_attributes")
    edges = matching.build_graph(want, GRID[2], "attribute").localCheckpoint()
    sizes = lambda c: sorted(map(tuple, c.select("size", "is_cross_cpse").collect()))
    assert sizes(matching.cluster_sizes(edges, own)) == sizes(matching.cluster(edges, own)[0])


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """One block of 420 parts, more than a part of a cut block holds. The last 20 are of different sizes and match only others."""
    path = tmp_path_factory.mktemp("large")
    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet").where("p_partkey < 420")
    part.withColumns({"p_name": F.lit("hot bolt"), "p_size": (1 + F.col("p_partkey") % 23).cast("int")}).coalesce(1).write.parquet(str(path / "part.parquet"))
    return str(path)


@pytest.mark.parametrize("name", ["cluster_edge_sweep", "dashboard_savings"])
def test_query_over_a_large_block(spark, large, name):
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{large}/part.parquet/*.parquet'")
    told = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(float).values.tolist()))
    want = told(con.sql(ORACLE[name].replace(CUT, "0 AS part")).df())
    assert told(QUERIES[name](spark, large).toPandas()) == want
    assert told(con.sql(ORACLE[name].replace("0 AS part", CUT)).df()) != want
