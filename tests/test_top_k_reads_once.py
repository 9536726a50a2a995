"""The best candidates read their records once, so nothing is written before."""

from lodestone.plans import queries


def test_records_of_top_k_are_not_written(spark, sf, monkeypatch):
    def written(*_):
        raise AssertionError("a table that is read once is written")

    monkeypatch.setattr(queries, "materialize", written)
    queries.score_top_k(spark, sf)
