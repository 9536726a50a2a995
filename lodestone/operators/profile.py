"""Profiles, label summaries, examples, savings and the runtime model.

Nulls and blanks are missing values. Records of a null group have no truth. Rates
without a base are 0. Empty tables give one row of zeros, or no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone import settings as S


def _blank(c: str):
    return F.col(f"`{c}`").isNull() | (F.trim(F.col(f"`{c}`").cast("string")) == "")


def profile(records: DataFrame) -> DataFrame:
    """One row: rows, owners, categories, duplicates of texts and codes, distinct units; blanks count as missing."""
    value = lambda c: F.when(~_blank(c), F.col(f"`{c}`"))
    dup = lambda c: (F.count("*") - F.count_distinct(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")))).alias
    return records.agg(
        F.count("*").alias("n_rows"), F.count_distinct(value(S.OWNER)).alias("n_cpses"), F.count_distinct(value(S.CATEGORY)).alias("n_categories"),
        dup(S.RAW)("duplicate_raw_descriptions"), dup(S.CODE)("duplicate_material_codes"), F.sort_array(F.collect_set(value(S.UOM))).alias("distinct_uoms"),
    )


def value_counts(records: DataFrame, column: str) -> DataFrame:
    """(value, n), most common first; missing values left out."""
    return records.where(~_blank(column)).groupBy(F.col(f"`{column}`").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def null_rates(records: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, null_rate, pct), highest first."""
    columns = columns or [c for c in S.ATTRIBUTE_COLUMNS if c in records.columns]
    rates = records.agg(*[F.coalesce(F.avg(_blank(c).cast("double")), F.lit(0.0)).alias(str(i)) for i, c in enumerate(columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(str(i)).alias("null_rate"), F.lit(i).alias("i")) for i, c in enumerate(columns)]))
    out = rates.select(rows.alias("r")).select("r.*").orderBy(F.desc("null_rate"), "i")
    return out.select("column", "null_rate", F.format_string("%.1f%%", F.col("null_rate") * 100).alias("pct"))


def truth_pairs(labels: DataFrame) -> DataFrame:
    """(a, b), a < b, of records of one group. A hot group's pairs are asked for; its rows are dealt by rid."""
    g = labels.where("gt_group is not null").select("rid", "gt_group")
    return g.select(F.col("rid").alias("a"), "gt_group").join(g.select(F.col("rid").alias("b"), "gt_group"), "gt_group").where("a < b").select("a", "b")


def truth_summary(labels: DataFrame, records: DataFrame) -> DataFrame:
    """One row of counts of groups and pairs; pairs are counted, not made."""
    g = labels.where("gt_group is not null").join(records.select("rid", F.col(S.OWNER).alias("o")), "rid")
    own = g.groupBy("gt_group", "o").agg(F.count("*").alias("n"))
    by = own.groupBy("gt_group").agg(F.sum("n").alias("n"), F.count("o").alias("owners"), F.sum(F.expr("n * (n - 1) div 2")).alias("within"))
    n = records.agg(F.count("*").alias("r"))
    out = by.agg(
        F.count("*").alias("total_groups"), F.count_if(F.col("n") > 1).alias("multi_member_groups"), F.count_if((F.col("n") > 1) & (F.col("owners") > 1)).alias("cross_cpse_groups"),
        F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("true_pairs"), F.coalesce(F.sum("within"), F.lit(0)).alias("within_cpse_pairs"),
    )
    out = out.crossJoin(n)  # one row each
    return out.select("total_groups", "multi_member_groups", "cross_cpse_groups", "true_pairs", (F.col("true_pairs") - F.col("within_cpse_pairs")).alias("cross_cpse_pairs"), "within_cpse_pairs", F.expr("r * (r - 1) div 2").alias("possible_pairs"))


def cross_owner_examples(records: DataFrame, labels: DataFrame, limit: int | None = 5, distinct_text: bool = True) -> DataFrame:
    """Records of the first groups (by name) that have two or more owners and no text twice."""
    text = F.trim(F.upper(F.col(f"`{S.RAW}`")))
    j = records.join(labels.where("gt_group is not null").select("rid", "gt_group"), "rid")
    good = j.groupBy("gt_group").agg(F.count("*").alias("n"), F.count_distinct(S.OWNER).alias("o"), F.count_distinct(text).alias("t")).where("n > 1 and o > 1")
    if distinct_text:
        good = good.where("t = n")
    if limit is not None:
        good = good.orderBy("gt_group").limit(limit)
    return j.join(good.select("gt_group"), "gt_group", "left_semi")


def sample(records: DataFrame, n: int, seed: int = S.SEED) -> DataFrame:
    """Exactly n records (within 1 and all) in hash order of rid, renumbered from 0 in the order of rid; all records as they are."""
    total = records.count()
    n = max(1, min(n, total))
    if n == total:
        return records
    kept = records.orderBy(F.md5(F.concat_ws("|", F.col("rid").cast("string"), F.lit(str(seed)))), "rid").limit(n)
    return kept.withColumn("rid", (F.row_number().over(Window.orderBy("rid")) - 1).cast("long"))  # n rows


def filtered(records: DataFrame, sectors: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """Records of the sectors and categories that are chosen; None or an empty list chooses all."""
    for column, chosen in ((S.SECTOR, sectors), (S.CATEGORY, categories)):
        if chosen:
            records = records.where(F.col(f"`{column}`").isin(*chosen))
    return records


def collision_quality(records: DataFrame, labels: DataFrame, key) -> DataFrame:
    """How well equal keys tell groups: pairs with one key, true ones among them, purity and recall."""
    j = records.select("rid", key.alias("k")).join(labels.select("rid", "gt_group"), "rid")
    both = j.groupBy("k", "gt_group").agg(F.count("*").alias("n"))
    pairs = F.expr("n * (n - 1) div 2")
    hit = both.where("gt_group is not null").agg(F.coalesce(F.sum(pairs), F.lit(0)).alias("true_pairs"))
    every = j.groupBy("k").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(pairs), F.lit(0)).alias("pairs"))
    truth = labels.where("gt_group is not null").groupBy("gt_group").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(pairs), F.lit(0)).alias("actual"))
    out = every.crossJoin(hit).crossJoin(truth)  # one row each
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return out.select("pairs", "true_pairs", rate("true_pairs", "pairs").alias("purity"), rate("true_pairs", "actual").alias("recall"))


def attribute_coverage(records: DataFrame) -> DataFrame:
    """(attribute, coverage): share of records that state it."""
    rates = records.agg(*[F.coalesce(F.avg(F.col(n).isNotNull().cast("double")), F.lit(0.0)).alias(n) for n in S.ATTRIBUTES])
    return rates.select(F.explode(F.array(*[F.struct(F.lit(n).alias("attribute"), F.col(n).alias("coverage")) for n in S.ATTRIBUTES])).alias("r")).select("r.*")


def known_attribute_counts(records: DataFrame) -> DataFrame:
    """One row: n_records, n_without_attributes, mean_known_attributes."""
    known = F.col("n_known_attributes")
    return records.agg(F.count("*").alias("n_records"), F.count_if(known == 0).alias("n_without_attributes"), F.coalesce(F.avg(known), F.lit(0.0)).alias("mean_known_attributes"))


def category_confusion(records: DataFrame, truth: DataFrame) -> DataFrame:
    """(category_a, category_b, n) of true pairs, categories in order."""
    c = records.select("rid", F.col(f"`{S.CATEGORY}`").alias("c"))
    j = truth.join(c.select(F.col("rid").alias("a"), F.col("c").alias("ca")), "a").join(c.select(F.col("rid").alias("b"), F.col("c").alias("cb")), "b")
    return j.groupBy(F.least("ca", "cb").alias("category_a"), F.greatest("ca", "cb").alias("category_b")).agg(F.count("*").alias("n"))


def clusters_per_owner(clusters: DataFrame) -> DataFrame:
    return clusters.select(F.explode("cpses").alias("owner")).groupBy("owner").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "owner")


def savings(clusters: DataFrame, records: DataFrame) -> DataFrame:
    """One row: duplicate rate, codes eliminated and what that saves."""
    c = clusters.agg(F.count("*").alias("n_clusters"), F.coalesce(F.sum("size"), F.lit(0)).alias("clustered"), F.count_if("is_cross_cpse").alias("cross_clusters"))
    out = c.crossJoin(records.agg(F.count("*").alias("n")))  # one row each
    gone = F.greatest(F.lit(0), F.col("clustered") - F.col("n_clusters"))
    return out.select(
        "n_clusters", "clustered", "cross_clusters", F.coalesce(F.try_divide(F.col("clustered").cast("double"), F.col("n").cast("double")), F.lit(0.0)).alias("duplicate_rate"), gone.alias("codes_eliminated"),
        (gone * S.ITEM_VALUE * S.CARRYING_COST).alias("carrying_saving"), (gone * S.ITEM_VALUE * S.PRICE_BENEFIT).alias("price_saving"),
    )


def estimate_runtime_seconds(n_rows: int) -> float:
    return S.FIXED_SECONDS + (S.BASE_SECONDS - S.FIXED_SECONDS) * (n_rows / S.BASE_ROWS) ** S.EXPONENT


def format_seconds(s: float) -> str:
    return f"{s:.0f} seconds" if s < 90 else f"{s / 60:.0f} minutes" if s < 5400 else f"{s / 3600:.1f} hours"


def is_large(records: DataFrame, most: int = S.LARGE_ROWS) -> bool:
    """Whether there are more rows than ``most``; reads no more than that."""
    return records.limit(most + 1).count() > most
