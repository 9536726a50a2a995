"""Chunks of the n-gram join may be cut anywhere without changing what comes out."""

import random

from pyspark.sql import functions as F

from lodestone.llm import ngram_join


def test_copies_at_a_cut_of_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_TOKENS", 100)
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(12):
        words = list(base)
        words[rnd.randrange(80)] = f"x{i}"
        texts.append(" ".join(words))
    rows = [(i, texts[i % 12]) for i in range(48)]  # each text in each of four blocks
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(4, F.col("doc_id"))
    got = sorted(tuple(r) for r in ngram_join.components(df).select("doc_id", "component_id").collect())
    assert got == [(i, 0) for i in range(48)]


def test_members_come_once(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_TOKENS", 10)
    rows = [(sig, 20, 1, bytearray(b"".join((1000 * sig + t).to_bytes(8, "little") for t in range(20)))) for sig in range(9) for _ in range(3)]
    got = ngram_join.clusters_of(spark.createDataFrame(rows, "sig long, n long, g long, s binary").repartition(3), 75).select("sig").collect()
    assert sorted(r.sig for r in got) == list(range(9))
