"""The string query reads whole texts."""

from lodestone.plans.queries import QUERIES


def test_jaro_winkler_sees_what_differs_late(spark, tmp_path):
    rows = [(1, "same words " * 10 + "and then an end"), (2, "same words " * 10 + "but quite another close")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["score_jaro_winkler"](spark, str(tmp_path)).first().jaro_winkler < 1
