"""Pair scores: attribute agreement, string and semantic channels, fusion.

Pairs (a, b) meet their records by two joins on rid; only the compared columns
travel. Everything but the string channel is Column expressions.

Null, NaN and blank attributes are missing and compare with nothing; a pair with
nothing to compare scores one half. Null and empty texts are alike with nothing
(0), a record without a vector has a semantic score of 0. Texts are read whole.
Pairs whose records aren't there are left out; repeated pairs give repeated rows.
Empty tables give empty results; columns of the caller's beside a and b are kept
by the channels and left out by ``score_pairs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import settings as S
from lodestone.functions.attributes import values_agree
from lodestone.functions.normalize import normalize
from lodestone.functions.strings import score_distinct
from lodestone.operators.semantic import SemanticEncoder, semantic_similarity

AGREE, CONFLICT, UNKNOWN = "agree", "conflict", "unknown"


def is_missing(c: Column, numeric: bool) -> Column:
    """Null, NaN and blank are missing."""
    return (c.isNull() | F.isnan(c)) if numeric else (c.isNull() | (F.trim(c) == ""))


def cleaned(name: str) -> Column:
    """An attribute as it is compared: missing as null, texts trimmed and in lower case."""
    c = F.col(name)
    return F.when(~F.isnan(c), c) if name in S.NUMERIC else F.nullif(F.lower(F.trim(c)), F.lit(""))


def agreement(a: Column, b: Column, numeric: bool) -> Column:
    """1 where two cleaned values agree, 0 where they conflict, null where one is missing."""
    if numeric:
        same = values_agree(a, b, True)
    else:
        same = F.contains(a, b) | F.contains(b, a)
    return F.when(a.isNotNull() & b.isNotNull(), same.cast("int"))


def from_agreements(found: dict[str, Column]) -> dict[str, Column]:
    """Scores, counts and flags of the attributes' agreements, as plain expressions; nothing comparable scores a half."""
    agree = sum((F.coalesce(f, F.lit(0)) for f in found.values()), F.lit(0))
    conflict = sum((F.coalesce(1 - f, F.lit(0)) for f in found.values()), F.lit(0))
    hard = F.lit(False)
    for n in S.HARD_ATTRIBUTES:
        hard = hard | F.coalesce(found[n] == 0, F.lit(False))
    flag = lambda f: F.when(f == 1, F.lit(AGREE)).when(f == 0, F.lit(CONFLICT)).otherwise(UNKNOWN)
    return {
        "attribute": F.coalesce(F.try_divide(agree.cast("double"), (agree + conflict).cast("double")), F.lit(0.5)),
        "n_comparable_attrs": agree + conflict,
        "n_agree_attrs": agree,
        "n_conflicts": conflict,
        "hard_conflict": hard,
        "flags": F.create_map(*[x for n, f in found.items() for x in (F.lit(n), flag(f))]),
    }


def fuse(semantic: Column, string: Column, attribute: Column, hard: Column, conflicts: Column) -> Column:
    w = S.CHANNEL_WEIGHTS
    raw = w["semantic"] * semantic + w["string"] * string + w["attribute"] * attribute
    less = F.when(hard, F.lit(S.CONFLICT_PENALTY)).when(conflicts > 0, F.lit(S.CONFLICT_PENALTY * 0.5)).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw - less))


def score_attributes(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b) with the attribute channel, min_known_attrs, same_category, cross_cpse and flags."""
    kept = records.select("rid", F.col(f"`{S.CATEGORY}`").alias("_cat"), F.col(S.OWNER).alias("_own"), *[cleaned(n).alias(n) for n in S.ATTRIBUTES])
    known = sum((F.col(n).isNotNull().cast("int") for n in S.ATTRIBUTES), F.lit(0))
    kept = kept.withColumn("_known", known)
    joined = pairs.join(kept.alias("l"), F.col("a") == F.col("l.rid")).join(kept.alias("r"), F.col("b") == F.col("r.rid"))
    carried = [c for c in pairs.columns if c not in ("a", "b")]
    out = joined.select(
        "a", "b", *carried, *[agreement(F.col(f"l.{n}"), F.col(f"r.{n}"), n in S.NUMERIC).alias(f"_f_{n}") for n in S.ATTRIBUTES],
        F.least("l._known", "r._known").alias("min_known_attrs"),
        F.coalesce(F.col("l._cat") == F.col("r._cat"), F.lit(False)).alias("same_category"),
        F.coalesce(F.col("l._own") != F.col("r._own"), F.lit(False)).alias("cross_cpse"),
    )
    told = from_agreements({n: F.col(f"_f_{n}") for n in S.ATTRIBUTES})
    return out.select("a", "b", *carried, "min_known_attrs", "same_category", "cross_cpse", *[c.alias(n) for n, c in told.items()])


def score_strings(records: DataFrame, pairs: DataFrame, text_col: str = S.RAW) -> DataFrame:
    """Adds ``string``: similarity of the normalized texts."""
    texts = records.select("rid", normalize(F.col(f"`{text_col}`")).alias("t"))
    joined = pairs.join(texts.select(F.col("rid").alias("a"), F.col("t").alias("_ta")), "a").join(texts.select(F.col("rid").alias("b"), F.col("t").alias("_tb")), "b")
    return score_distinct(joined, "_ta", "_tb").drop("_ta", "_tb")


def score_pairs(records: DataFrame, pairs: DataFrame, vectors: DataFrame | None = None, encoder: SemanticEncoder | None = None, text_col: str = S.RAW) -> DataFrame:
    """The scored pairs: three channels, fused score, counts and flags, and the semantic backend."""
    encoder = encoder or SemanticEncoder()
    if vectors is None:
        vectors = encoder.encode(records.select(F.col("rid").alias("id"), normalize(F.col(f"`{text_col}`")).alias("text")))
    scored = semantic_similarity(score_strings(records, score_attributes(records, pairs.select("a", "b")), text_col), vectors)
    scored = scored.withColumn("fused", fuse(F.col("semantic"), F.col("string"), F.col("attribute"), F.col("hard_conflict"), F.col("n_conflicts")))
    return scored.select(
        "a", "b", "semantic", "string", "attribute", "fused", "n_comparable_attrs", "n_agree_attrs", "n_conflicts", "hard_conflict",
        "min_known_attrs", "same_category", "cross_cpse", "flags", F.lit(encoder.backend_used).alias("semantic_backend"),
    )


def top_k(scored: DataFrame, k: int = 20, score: str = "fused") -> DataFrame:
    """The k best candidates of each record (optional; nothing else uses it)."""
    from pyspark.sql import Window

    ends = F.array(F.struct(F.col("a").alias("rid"), F.col("b").alias("other")), F.struct(F.col("b").alias("rid"), F.col("a").alias("other")))
    both = scored.select(F.explode(ends).alias("e"), score).select("e.rid", "e.other", score)  # a union would score all pairs twice
    w = Window.partitionBy("rid").orderBy(F.desc(score), "other")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
