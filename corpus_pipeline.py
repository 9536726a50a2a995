"""The corpus pipeline: language ID, near duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of ``documents``. Between stages the
rows are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, langid, mixing, ngram_join, secret_scan
from lodestone.llm.queries import TOKENIZER
from lodestone.storage import drop, materialize

#: A text whose best language has a mean marginal below this is rejected.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told: not ``und``, and score at least ``LEAST_SCORE``.

    Null, empty and letterless texts are ``und`` and go. Texts are read whole. Each
    row is judged by its text alone, so repeated rows stay or go together; with no
    labelled row every text is ``und``. An empty table stays empty; columns of any
    name are kept.
    """
    chain = langid.train(docs.where(~langid.held_out("doc_id")))
    found = langid.label(docs, chain, carry=docs.columns)
    lang, score = found.columns[-2:]
    kept = found.toDF(*[f"c{i}" for i in range(len(docs.columns))], lang, score).where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE))
    return kept.drop(lang, score).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of linked texts: that of the smallest id (null last).

    A document is a row's id and text, so rows of one id with different texts are
    different documents. Rows that differ in neither are one document, of which
    the row with the smallest other columns stays (by their JSON). Empty and null texts are
    linked with nothing, but repeated rows of them are still one document. An
    empty table stays empty; columns of any name are kept.

    The keys to drop are few or many; they are broadcast only below ``DROP_ROWS``,
    else both sides are shuffled by key.
    """
    names = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])  # so no column of the caller's meets ours
    doc_id, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    twice = [F.xxhash64(doc_id.cast("string"), text, F.lit(turn)).alias(f"k{turn}") for turn in (1, 2)]
    key = F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), *twice)
    keyed = own.withColumn("key", key)
    found = materialize(ngram_join.components(keyed.select("key", text.alias("text")), "key", "text"), "pipeline-components")
    marks = F.col("key.k1").alias("k1"), F.col("key.k2").alias("k2")
    dropped = materialize(found.where("component_id <> key").select(*marks).distinct(), "pipeline-dropped")
    few = dropped.count() <= DROP_ROWS
    rows = keyed.withColumns({"k1": F.col("key.k1"), "k2": F.col("key.k2")})
    kept = rows.join(F.broadcast(dropped) if few else dropped.hint("shuffle_merge"), ["k1", "k2"], "left_anti")
    left = found.where("component_id = key").groupBy(*marks).count()
    repeated = materialize(left.where("count > 1").select("k1", "k2"), "pipeline-repeated")
    drop(found)
    if repeated.isEmpty():
        return kept.select(*own.columns).toDF(*names)
    row = F.struct(*own.columns)
    # the smallest row of each key; partial sums come first, so a key of very many rows is no hot task
    first = kept.join(repeated, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return kept.join(repeated, ["k1", "k2"], "left_anti").select(*own.columns).unionByName(first).toDF(*names)


DROP_ROWS = 500_000


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every row; found secrets are replaced by a mark, and ``n_chars`` is told anew.

    Null and empty texts stay as they are, long ones are read whole, repeated rows
    come out alike. An empty table stays empty; columns of any name are kept.
    """
    clean = secret_scan.redact(docs, path_col="source")
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: rows by taken pieces, texts cut at block edges, ``n_chars`` told anew.

    Null and empty texts have no words and are never taken; a null source is a
    source; repeated rows are laid out one by one; long texts are cut in pieces, not
    shortened. An empty table stays empty; columns of any name are kept.
    """
    return mixing.mixed_rows(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of the ids of every row's whole text, and of the text decoded from them.

    Null text is the empty text. Repeated rows give repeated rows; an empty table
    gives an empty one; other columns are ignored.
    """
    return bpe.encode_decode(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secrets", secrets), ("source_mix", source_mix), ("tokens", tokens)]
#: Models and seeded choices can't be put in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)
