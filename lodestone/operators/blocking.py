"""Blocking: keys, blocks of bounded size, candidate pairs, recall and schemes.

Records carry ``rid``. Blocks larger than ``MAX_BLOCK`` are cut in the order of
rid; the ranks are found by ranges of rid, so that a key of very many records is
never ranked in one task. Pairs come from blocks of at most ``MAX_BLOCK``.

A missing category is the category "nan", a missing or unreadable size the bucket
"na"; a signature needs a size and one other part. A record without a key is in
no block. Repeated keys of a record count once in its pairs, a pair of several
families comes once. Empty tables give no blocks, no pairs, and counts of zero;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import settings as S

RANGE = 4096


def size_bucket(c: Column, width: float = S.SIZE_BUCKET_MM) -> Column:
    number = F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))
    return F.coalesce(F.floor(number / F.lit(width)).cast("string"), F.lit("na"))


def spec_family(c: Column) -> Column:
    tokens = F.filter(F.split(F.replace(F.lower(c), F.lit("-"), F.lit(" ")), r"\s+"), lambda t: t != "")
    return F.when(F.size(tokens) > 0, F.array_join(F.slice(tokens, 1, 2), "-")).otherwise("na")


def _category() -> Column:
    return F.lower(F.trim(F.coalesce(F.col(f"`{S.CATEGORY}`").cast("string"), F.lit("nan"))))


def category_key() -> Column:
    return F.array(F.concat(F.lit("cat::"), _category(), F.lit("|sz::"), size_bucket(F.col("nominal_size_mm"))))


def category_token_key() -> Column:
    tokens = F.array_distinct(F.filter(F.split(_category(), "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(*S.GENERIC_TOKENS)))
    return F.transform(tokens, lambda t: F.concat(F.lit("tok::"), t, F.lit("|sz::"), size_bucket(F.col("nominal_size_mm"))))


def attribute_signature_key() -> Column:
    size = size_bucket(F.col("nominal_size_mm"))
    others = [
        spec_family(F.col("spec_standard")),
        F.coalesce(F.lower(F.trim("material_of_construction")), F.lit("na")),
        size_bucket(F.col("capacity_cum"), 1.0),
        size_bucket(F.col("rating_kva"), 10.0),
    ]
    blank = others[0] == "na"
    for o in others[1:]:
        blank = blank & (o == "na")
    return F.when((size != "na") & ~blank, F.array(F.concat(F.lit("sig::"), F.concat_ws("|", size, *others))))


#: Key families: name and a function that gives the array of a record's keys. Callers may add theirs.
FAMILIES: dict[str, Callable[[], Column]] = {"category_size": category_key, "category_token": category_token_key, "attribute_signature": attribute_signature_key}


def build_blocks(df: DataFrame, families: list[str] | None = None) -> DataFrame:
    """Long table (family, key, rid)."""
    families = families or S.DEFAULT_FAMILIES
    keyed = F.array(*[F.struct(F.lit(f).alias("family"), FAMILIES[f]().alias("keys")) for f in families])
    return df.select("rid", F.explode(keyed).alias("f")).select(F.col("f.family").alias("family"), F.explode("f.keys").alias("key"), "rid")


def parts(blocks: DataFrame, most: int = S.MAX_BLOCK) -> DataFrame:
    """Adds ``part``: 0.. in steps of ``most`` rids of a key."""
    ranged = blocks.withColumn("_r", F.floor(F.col("rid") / RANGE))
    counts = ranged.groupBy("family", "key", "_r").agg(F.count("*").alias("_c"))
    w = Window.partitionBy("family", "key").orderBy("_r")
    before = counts.withColumn("_before", F.sum("_c").over(w) - F.col("_c")).select("family", "key", "_r", "_before")
    own = F.row_number().over(Window.partitionBy("family", "key", "_r").orderBy("rid"))
    rank = ranged.join(before, ["family", "key", "_r"]).withColumn("_n", F.col("_before") + own - 1)
    return rank.select("family", "key", F.floor(F.col("_n") / most).alias("part"), "rid")


def candidate_pairs(blocks: DataFrame, most: int = S.MAX_BLOCK, families: list[str] | None = None) -> DataFrame:
    """Distinct pairs (a, b, sources), a < b, with the sorted families that propose them."""
    names = sorted(families or S.DEFAULT_FAMILIES)
    bit = F.lit(0)
    for i, name in enumerate(names):
        bit = F.when(F.col("family") == name, F.lit(1 << i)).otherwise(bit)
    held = parts(blocks, most).groupBy("family", "key", "part").agg(F.array_sort(F.collect_list("rid")).alias("m"))  # at most `most` rids
    ends = held.where(F.size("m") > 1).select(bit.alias("bit"), F.posexplode("m").alias("i", "a"), "m")
    pairs = ends.select("bit", "a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b")).where("a < b")
    found = pairs.groupBy("a", "b").agg(F.bit_or("bit").alias("bits"))
    told = F.filter(F.array(*[F.when(F.col("bits").bitwiseAND(1 << i) != 0, F.lit(n)) for i, n in enumerate(names)]), lambda x: x.isNotNull())
    return found.select("a", "b", told.alias("sources"))


def block_stats(df: DataFrame, blocks: DataFrame, pairs: DataFrame, most: int = S.MAX_BLOCK) -> DataFrame:
    """One row: n_records, naive and blocked comparisons, reduction_factor (inf without pairs), n_blocks, largest_block."""
    n = df.agg(F.count("*").alias("n_records")).withColumn("naive_comparisons", F.expr("n_records * (n_records - 1) div 2"))
    p = pairs.agg(F.count("*").alias("blocked_comparisons"))
    b = parts(blocks, most).groupBy("family", "key", "part").count().where("count > 1").agg(F.count("*").alias("n_blocks"), F.coalesce(F.max("count"), F.lit(0)).alias("largest_block"))
    factor = F.coalesce(F.try_divide("naive_comparisons", "blocked_comparisons"), F.lit(float("inf")))
    return n.crossJoin(p).crossJoin(b).withColumn("reduction_factor", factor)  # one row each


def recall_ceiling(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: true_pairs, true_pairs_retained, recall_ceiling, pairs_lost."""
    kept = truth.join(pairs.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left")
    out = kept.agg(F.count("*").alias("true_pairs"), F.count("hit").alias("true_pairs_retained"))
    return out.withColumn("recall_ceiling", F.coalesce(F.try_divide("true_pairs_retained", "true_pairs"), F.lit(0.0))).withColumn("pairs_lost", F.col("true_pairs") - F.col("true_pairs_retained"))


SCHEMES = {
    "category_size only": ["category_size"],
    "category_token only": ["category_token"],
    "attribute_signature only": ["attribute_signature"],
    "category_size + token": ["category_size", "category_token"],
    "union (all three)": ["category_size", "category_token", "attribute_signature"],
}


def compare_schemes(df: DataFrame, truth: DataFrame, most: int = S.MAX_BLOCK) -> DataFrame:
    """All schemes from one set of pairs: scheme, comparisons, reduction_factor, recall_ceiling, true_pairs_lost, largest_block."""
    every = list(FAMILIES)[:3]
    blocks = build_blocks(df, every)
    marked = candidate_pairs(blocks, most, every).join(truth.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left")
    counts = []
    for i, fams in enumerate(SCHEMES.values()):
        has = F.arrays_overlap("sources", F.array(*[F.lit(f) for f in fams]))
        counts += [F.count_if(has).alias(f"c{i}"), F.count_if(has & F.col("hit").isNotNull()).alias(f"h{i}")]
    sums = marked.agg(*counts)
    sizes = parts(blocks, most).groupBy("family", "key", "part").count().where("count > 1").agg(*[F.coalesce(F.max(F.when(F.col("family").isin(*fams), F.col("count"))), F.lit(0)).alias(f"l{i}") for i, fams in enumerate(SCHEMES.values())])
    total = df.agg(F.count("*").alias("n")).withColumn("naive", F.expr("n * (n - 1) div 2")).crossJoin(truth.agg(F.count("*").alias("t"))).crossJoin(sums).crossJoin(sizes)  # one row each
    row = lambda name, c, red, rec, lost, big: F.struct(F.lit(name).alias("scheme"), c.alias("comparisons"), red.alias("reduction_factor"), rec.alias("recall_ceiling"), lost.alias("true_pairs_lost"), big.alias("largest_block"))
    rows = [row("none (all pairs)", F.col("naive"), F.lit(1.0), F.lit(1.0), F.lit(0).cast("long"), F.col("n"))]
    for i, name in enumerate(SCHEMES):
        red = F.coalesce(F.bround(F.try_divide("naive", f"c{i}"), 1), F.lit(float("inf")))
        rec = F.coalesce(F.bround(F.try_divide(f"h{i}", "t"), 4), F.lit(0.0))
        rows.append(row(name, F.col(f"c{i}"), red, rec, F.col("t") - F.col(f"h{i}"), F.col(f"l{i}")))
    return total.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
