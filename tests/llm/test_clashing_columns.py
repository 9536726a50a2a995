"""Columns whose names operators use inside leave every row as it was."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import mixing, secret_scan

NAMES = ["cell", "quota", "target", "_source", "seats", "_size", "_p", "piece", "row", "_values", "_findings", "_findings0", "_around", "_scored", "d0", "d1", "source_size", "_row", "shard", "s", "id"]
KEY = "9f86d081884c7d659a2feaa0c55ad0153f2b1c4e"
ROWS = [(i, None if i == 7 else f'{"w " * i} token = "{KEY}" x', "ab"[i % 2] if i else None) for i in range(12)]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return plain.withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in NAMES})


def kept(df):
    return all(r[c] == f"{c}-{r.doc_id}" for r in df.collect() for c in NAMES if c in df.columns)


def test_mix(docs):
    got = mixing.mix(docs)
    assert kept(got.drop("target", "source_size")) and got.count() == len(ROWS) and set(NAMES) <= set(got.columns)
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns and kept(out) and out.count() > 0
    plain = mixing.mixed_rows(docs.select("doc_id", "text", "source"))
    assert sorted(map(str, out.select("doc_id", "text", "source").collect())) == sorted(map(str, plain.collect()))


def test_secrets(docs):
    out = secret_scan.redact(docs, path_col="source")
    assert out.columns == docs.columns and kept(out)
    assert all(r.text is None or KEY not in r.text for r in out.collect())
    assert secret_scan.scan(docs).count() == sum(t is not None for _, t, _ in ROWS)
    named = secret_scan.with_findings(docs, out="cell")
    assert kept(named.drop("cell")) and named.where("cell is not null").count() == len(ROWS) - 1


def test_pipeline_stage(docs, spark):
    out = corpus_pipeline.source_mix(spark, docs.withColumn("n_chars", F.length("text").cast("long")), "")
    assert kept(out) and "n_chars" in out.columns
