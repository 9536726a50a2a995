"""Explanations of pairs and clusters as arrays of lines, built by higher-order functions.

A line is struct<marker, text, attribute, weight>; lines are ordered by weight, the
heavier first, ties in the order they were made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import settings as S
from lodestone.operators.scoring import AGREE, CONFLICT, is_missing

SUPPORT, AGAINST, MISSING, INFO = "+", "-", "?", "="

# Labels and units of the attributes.
LABELS = {
    "nominal_size_mm": "Nominal bore", "thickness_mm": "Thickness", "width_mm": "Width", "rating_kva": "Rating", "voltage_kv": "Voltage",
    "power_hp": "Power", "flow_m3hr": "Flow rate", "head_m": "Head", "capacity_cum": "Capacity", "area_sqmm": "Conductor area", "ply": "Ply count",
    "grade": "Material grade", "spec_standard": "Specification", "schedule": "Schedule", "pressure_class": "Pressure class", "ratio": "Gear ratio",
    "material_of_construction": "Material of construction",
}
UNITS = {
    "nominal_size_mm": "mm", "thickness_mm": "mm", "width_mm": "mm", "rating_kva": "kVA", "voltage_kv": "kV", "power_hp": "HP", "flow_m3hr": "m3/hr",
    "head_m": "m", "capacity_cum": "cu.m", "area_sqmm": "sq.mm",
}

NO_BASE = "The records have no attribute in common, so nothing but their texts speaks for the match."
CROSS = "Cross-CPSE: the owners of these records have each given the material a code of their own"
THIN = "Held back for its insufficient data, not for a difference; a data sheet or drawing would settle it."
LINE = "struct<marker:string,text:string,attribute:string,weight:double>"


def label_for(name: str) -> str:
    return LABELS.get(name, name.replace("_", " ").capitalize())


def general(c: Column) -> Column:
    """A number in six significant digits, without trailing zeros; very large and small ones with an exponent."""
    size = F.floor(F.log10(F.abs(c)))
    plain = F.regexp_replace(F.regexp_replace(F.bround(c, 6).cast("decimal(38,6)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    fixed = F.when(size >= 0, F.format_string("%.6f", F.when(size == 0, F.bround(c, 5)).when(size == 1, F.bround(c, 4)).when(size == 2, F.bround(c, 3)).when(size == 3, F.bround(c, 2)).when(size == 4, F.bround(c, 1)).otherwise(F.bround(c, 0))))
    fixed = F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    science = F.regexp_replace(F.format_string("%.5e", c), r"\.?0*e", "e")
    return F.when(c == 0, F.lit("0")).when((size >= 6) | (size < -4), science).when(size < 0, plain).otherwise(fixed)


def format_value(name: str, c: Column) -> Column:
    numeric = name in S.NUMERIC
    shown = general(c) if numeric else c
    shown = F.concat(shown, F.lit(f" {UNITS[name]}")) if name in UNITS else F.upper(shown)
    return F.when(is_missing(c, numeric), F.lit("not stated")).otherwise(shown)


def line(marker: str, text: Column, weight: float | Column, attribute: str | None = None) -> Column:
    w = F.lit(float(weight)) if not isinstance(weight, Column) else weight
    return F.struct(F.lit(marker).alias("marker"), text.alias("text"), F.lit(attribute).cast("string").alias("attribute"), w.cast("double").alias("weight"))


def ordered(lines: Column) -> Column:
    keyed = F.transform(lines, lambda x, i: F.struct((-x["weight"]).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def attribute_lines(flag: str, left: str, right: str, hard: list[str]) -> list[Column]:
    out = []
    for n in S.ATTRIBUTES:
        f, a, b = F.col(flag)[n], F.col(f"{left}.{n}"), F.col(f"{right}.{n}")
        va, vb, name = format_value(n, a), format_value(n, b), label_for(n)
        has_a, has_b = ~is_missing(a, n in S.NUMERIC), ~is_missing(b, n in S.NUMERIC)
        same = F.when(va == vb, F.concat(F.lit(f"{name} matches ("), va, F.lit(")"))).otherwise(F.concat(F.lit(f"{name} matches within tolerance ("), va, F.lit(" vs "), vb, F.lit(")")))
        differs = F.concat(F.lit(f"{name} differs ("), va, F.lit(" vs "), vb, F.lit(") - procurement-critical" if n in hard else ")"))
        only = F.concat(F.lit(f"{name} stated only by record "), F.when(has_a, F.lit("A")).otherwise("B"), F.lit(" ("), F.when(has_a, va).otherwise(vb), F.lit(") - not comparable"))
        out.append(
            F.when(f == AGREE, line(SUPPORT, same, 3.0, n))
            .when(f == CONFLICT, line(AGAINST, differs, 5.0 if n in hard else 2.0, n))
            .when(has_a != has_b, line(MISSING, only, 1.0, n))
        )
    return out


def explain_pairs(scored: DataFrame, records: DataFrame, verdict: Column, score: str = "fused", hard: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """(a, b, verdict, score, subject, lines, caveats) for scored pairs with flags."""
    hard = S.HARD_ATTRIBUTES if hard is None else hard
    r = records.select("rid", F.col(f"`{S.RAW}`").alias("_raw"), *S.ATTRIBUTES)
    j = scored.join(r.alias("l"), F.col("a") == F.col("l.rid")).join(r.alias("r"), F.col("b") == F.col("r.rid"))
    lines = []
    if with_text:
        lines += [line(INFO, F.concat(F.lit(f'{s}: "'), F.coalesce(F.col(f"{c}._raw"), F.lit("")), F.lit('"')), -1.0) for s, c in (("A", "l"), ("B", "r"))]
    lines += attribute_lines("flags", "l", "r", hard)
    lines.append(line(INFO, F.format_string("Description similarity: semantic %.2f / string %.2f", "semantic", "string"), 0.5))
    caveats = F.when(F.col("n_comparable_attrs") == 0, F.array(F.lit(NO_BASE))).otherwise(F.array().cast("array<string>"))
    return j.select(
        "a", "b", verdict.alias("verdict"), F.col(score).alias("score"), F.format_string("records %d and %d", "a", "b").alias("subject"),
        ordered(F.filter(F.array(*lines), lambda x: x.isNotNull())).alias("lines"), caveats.alias("caveats"),
    )


def weakest_pairs(clusters: DataFrame) -> DataFrame:
    """(cluster_id, a, b, tier): the pair with the least score of each cluster that has edges."""
    weakest = clusters.where(F.size("edges") > 0).select("cluster_id", "tier", F.array_min(F.transform("edges", lambda e: F.struct(e["w"].alias("w"), e["a"].alias("a"), e["b"].alias("b")))).alias("e"))
    return weakest.select("cluster_id", F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b"), "tier")


def explain_clusters(clusters: DataFrame, records: DataFrame, scored: DataFrame | None = None, score: str = "fused", hard: list[str] | None = None) -> DataFrame:
    """(cluster_id, verdict, score, subject, lines, caveats); with scored pairs also the weakest link, attribute by attribute."""
    owner, code, raw = (F.coalesce(F.col(f"r.{c}"), F.lit("")) for c in ("_own", "_code", "_raw"))
    r = records.select("rid", F.col(S.OWNER).alias("_own"), F.col(f"`{S.CODE}`").alias("_code"), F.col(f"`{S.RAW}`").alias("_raw"))
    told = clusters.select("cluster_id", F.posexplode("members").alias("pos", "rid")).join(r.alias("r"), "rid")
    told = told.select("cluster_id", "pos", line(INFO, F.concat(owner, F.lit(" / "), code, F.lit(': "'), raw, F.lit('"')), 8.0).alias("x"))
    told = told.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("people"))
    c = clusters.join(told, "cluster_id", "left")
    none = F.array().cast(f"array<{LINE}>")
    if scored is not None:
        weakest = weakest_pairs(clusters)
        detail = explain_pairs(weakest.join(scored, ["a", "b"]), records, F.col("tier"), score, hard, False)
        detail = detail.join(weakest.select("a", "b", "cluster_id"), ["a", "b"]).select("cluster_id", F.col("lines").alias("_d"), F.col("caveats").alias("_c"))
        c = c.join(detail, "cluster_id", "left")
    else:
        c = c.withColumns({"_d": F.lit(None).cast(f"array<{LINE}>"), "_c": F.lit(None).cast("array<string>")})
    head = F.concat(F.size("members").cast("string"), F.lit(" records taken as one material; owners ("), F.size("cpses").cast("string"), F.lit("): "), F.array_join("cpses", ", "))
    agreement = F.format_string("Scores inside: least %.3f, mean %.3f, of %d pairs", "min_score", "mean_score", F.size("edges"))
    below = F.transform(F.filter("_d", lambda x: x["marker"].isin(SUPPORT, AGAINST, MISSING)), lambda x: F.struct(x["marker"].alias("marker"), x["text"].alias("text"), x["attribute"].alias("attribute"), (x["weight"] - 0.1).alias("weight")))
    lines = F.concat(
        F.array(line(INFO, head, 10.0)),
        F.when(F.col("is_cross_cpse"), F.array(line(SUPPORT, F.lit(CROSS), 9.0))).otherwise(none),
        F.coalesce("people", none),
        F.array(line(INFO, agreement, 7.0)),
        F.when(F.col("tier_reason") != "", F.array(line(INFO, F.col("tier_reason"), 6.5))).otherwise(none),
        F.when(F.col("_d").isNotNull(), F.concat(F.array(line(INFO, F.lit("The pair with the least score:"), 6.0)), below)).otherwise(none),
    )
    thin = F.when(F.col("tier") == "UNKNOWN", F.array(F.lit(THIN))).otherwise(F.array().cast("array<string>"))
    return c.select("cluster_id", F.col("tier").alias("verdict"), F.col("min_score").alias("score"), F.format_string("cluster %d", "cluster_id").alias("subject"), ordered(lines).alias("lines"), F.concat(F.coalesce("_c", F.array().cast("array<string>")), thin).alias("caveats"))


def render(verdict: Column, score: Column, subject: Column, lines: Column, caveats: Column) -> Column:
    """The explanation as text."""
    head = F.format_string("Match: %s confidence (score %.2f) - %s", verdict, score, subject)
    body = F.transform(lines, lambda x: F.concat(F.lit("  "), x["marker"], F.lit(" "), x["text"]))
    return F.array_join(F.concat(F.array(head), body, F.transform(caveats, lambda x: F.concat(F.lit("  ! "), x))), "\n")


def as_json(df: DataFrame) -> DataFrame:
    """The explanation's columns as one JSON column, the score rounded to four places."""
    return df.withColumn("json", F.to_json(F.struct("verdict", F.bround("score", 4).alias("score"), "subject", "lines", "caveats")))


def supporting(lines: Column) -> Column:
    return F.filter(lines, lambda x: x["marker"] == SUPPORT)


def opposing(lines: Column) -> Column:
    return F.filter(lines, lambda x: x["marker"] == AGAINST)
