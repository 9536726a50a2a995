"""Queries explain and score whole inputs, not parts of them."""

from lodestone.plans.queries import QUERIES, size_pairs


def test_explain_pair_explains_every_pair(spark, tmp_path):
    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet").where("p_partkey <= 600")
    part.write.parquet(str(tmp_path / "part.parquet"))
    got = QUERIES["explain_pair"](spark, str(tmp_path)).select("a", "b")
    want = size_pairs(spark, str(tmp_path)).select("a", "b")
    assert want.where("a >= 200").count() > 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
