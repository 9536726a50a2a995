"""Typed attributes from normalized text and from structured columns, as Columns.

Numbers come from the first match of a rule; a structured column wins over the
text. ``attr_provenance`` tells where each of the 17 attributes is from: both,
conflict, column, regex, regex_weak or unknown. Nulls and blanks are unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import settings as S
from lodestone.functions.normalize import normalize

NUM = r"(\d+(?:\.\d+)?)"

# Nominal bore in mm of a size in inches.
INCH_TO_NB = {
    0.5: 15.0, 0.75: 20.0, 1.0: 25.0, 1.25: 32.0, 1.5: 40.0, 2.0: 50.0, 2.5: 65.0, 3.0: 80.0, 3.5: 90.0, 4.0: 100.0, 5.0: 125.0, 6.0: 150.0,
    8.0: 200.0, 10.0: 250.0, 12.0: 300.0, 14.0: 350.0, 16.0: 400.0, 18.0: 450.0, 20.0: 500.0, 24.0: 600.0, 30.0: 750.0, 36.0: 900.0,
}

# Words for a material, in order, and its name.
MATERIALS = [
    ("carbon steel", "carbon steel"), ("mild steel", "carbon steel"), ("stainless steel 304", "stainless steel 304"),
    ("stainless steel 316", "stainless steel 316"), ("stainless steel", "stainless steel"), ("alloy steel", "alloy steel"),
    ("cast iron", "cast iron"), ("spheroidal graphite", "spheroidal graphite iron"), ("aluminium", "aluminium"), ("copper", "copper"),
    ("rubber", "rubber"), ("hardox", "hardox"), ("manganese", "manganese steel"),
]

# Patterns of the attributes in normalized text, which has ASCII only.
PATTERNS = {
    "nominal_size_mm": rf"(?:{NUM}\s*(?:mm\s*)?nominal bore|nominal bore\s*{NUM}\s*(?:mm)?)",
    "inch_size": rf"{NUM}\s*inch",
    "bore_mm": rf"{NUM}\s*mm\s*bore|bore\s*{NUM}\s*mm",
    "thickness_mm": rf"{NUM}\s*mm\s*thickness|thickness\s*{NUM}\s*mm",
    "schedule": r"schedule\s*(\d+\s*s?|std|xs|xxs)",
    "pressure_class": r"class\s*(\d{2,4})",
    "spec_standard": r"\b(astm\s*a\s*\d+|asme\s*b?\s*\d+(?:\.\d+)?|is\s*\d{3,4}|en\s*\d{3,5}|api\s*\d+[a-z]?|din\s*\d+|sae\s*\d+)\b",
    "grade": r"\bgrade\s*([a-z0-9]+)\b|\b(e\s?\d{3})\b|\bb\s?7\b|\bwpb\b|\bgr\s*([a-z0-9]+)\b",
    "rating_kva": rf"{NUM}\s*kva",
    "voltage_ratio_kv": rf"{NUM}\s*/\s*{NUM}\s*kv(?!a)",
    "voltage_kv": rf"{NUM}\s*kv(?!a)",
    "power_hp": rf"{NUM}\s*hp",
    "flow_m3hr": rf"{NUM}\s*cumperhr",
    "head_m": rf"(?:head\s*{NUM}\s*m\b|{NUM}\s*m\s*head)",
    "capacity_cum": rf"{NUM}\s*cum(?![a-z])",
    "area_sqmm": rf"{NUM}\s*sqmm",
    "ratio": r"(\d+)\s*:\s*(\d+)",
    "ply": r"(\d+)\s*ply",
    "width_mm": rf"{NUM}\s*mm\s*(?:width|wide)|width\s*{NUM}\s*mm",
}
GROUPS = {"nominal_size_mm": 2, "bore_mm": 2, "thickness_mm": 2, "head_m": 2, "width_mm": 2, "grade": 3}
#: A bare size in mm that no thickness, width, bore or pair of dimensions owns.
BARE_MM = r"(?<![\d.])(?<!(?:thick|thickness|wide|width|bore) ?)(?<!\d ?[x×] ?)(\d+(?:\.\d+)?)\s*mm\b(?!\s*(?:bore|thick|thickness|wide|width))"


def _group(text: Column, name: str, g: int) -> Column:
    return F.nullif(F.regexp_extract(text, PATTERNS[name], g), F.lit(""))


def number(text: Column, name: str) -> Column:
    found = [_group(text, name, g) for g in range(1, GROUPS.get(name, 1) + 1)]
    return F.coalesce(*found).try_cast("double")


def string(text: Column, name: str) -> Column:
    found = [_group(text, name, g) for g in [*range(1, GROUPS.get(name, 1) + 1), 0]]
    out = F.trim(F.regexp_replace(F.coalesce(*found), r"(?U)\s+", " "))
    return out if name == "spec_standard" else F.replace(out, F.lit(" "), F.lit(""))


def inch_to_nb(inches: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in INCH_TO_NB.items() for x in kv])
    return table[F.bround(inches, 2)]


def from_text(text: Column) -> dict[str, Column]:
    """Attributes of a normalized text; ``bare`` is the weak size."""
    out = {n: number(text, n) for n in ("thickness_mm", "rating_kva", "voltage_kv", "power_hp", "flow_m3hr", "head_m", "capacity_cum", "area_sqmm", "width_mm", "ply")}
    out["voltage_kv"] = F.coalesce(_group(text, "voltage_ratio_kv", 1).try_cast("double"), out["voltage_kv"])
    out["nominal_size_mm"] = F.coalesce(number(text, "nominal_size_mm"), number(text, "bore_mm"), inch_to_nb(number(text, "inch_size")))
    out |= {n: string(text, n) for n in ("schedule", "pressure_class", "spec_standard", "grade")}
    out["ratio"] = F.when(_group(text, "ratio", 1).isNotNull(), F.concat_ws(":", _group(text, "ratio", 1), _group(text, "ratio", 2)))
    material = F.lit(None).cast("string")
    for word, name in reversed(MATERIALS):
        material = F.when(F.contains(text, F.lit(word)), F.lit(name)).otherwise(material)
    out["material_of_construction"] = material
    sizes = F.transform(F.regexp_extract_all(text, F.lit(BARE_MM), F.lit(1)), lambda x: x.try_cast("double"))
    other = lambda x, n: F.coalesce(x != out[n], F.lit(True))
    out["bare"] = F.get(F.filter(sizes, lambda x: other(x, "thickness_mm") & other(x, "width_mm")), F.lit(0))
    return out


def from_columns(cols: dict[str, Column | None]) -> dict[str, Column]:
    """Attributes of the structured columns; ``cols`` maps their names to Columns or None."""
    null = F.lit(None).cast("string")
    stated = lambda n: F.when(F.trim(F.regexp_replace(cols[n], r"(?U)\s+", " ")) != "", cols[n]) if cols.get(n) is not None else null
    tidy = lambda c: F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    dims, capacity = normalize(stated("Dimensions")), normalize(stated("Capacity/Rating"))
    first_mm = F.nullif(F.regexp_extract(dims, rf"{NUM}\s*mm", 1), F.lit("")).try_cast("double")
    out = {
        "grade": tidy(stated("Material/Grade")),
        "spec_standard": tidy(stated("Specification/Standard")),
        "nominal_size_mm": F.coalesce(number(dims, "nominal_size_mm"), first_mm),
        "schedule": string(dims, "schedule"),
    }
    return out | {n: number(capacity, n) for n in ("rating_kva", "voltage_kv", "power_hp", "capacity_cum", "flow_m3hr", "head_m")}


def values_agree(a: Column, b: Column, numeric: bool) -> Column:
    """Numbers within two per cent of the larger (zero only with zero); texts equal, or one within the other."""
    if numeric:
        near = F.abs(a - b) <= F.lit(S.TOLERANCE) * F.greatest(F.abs(a), F.abs(b))
        return F.when((a == 0) | (b == 0), a == b).otherwise(near)
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.contains(x, y) | F.contains(y, x)


def _text_columns(df: DataFrame, text: Column) -> DataFrame:
    """Adds the attributes of a text, as ``_t_`` columns."""
    df = df.withColumn("_text", normalize(text))
    found = from_text(F.col("_text"))
    df = df.withColumns({f"_t_{n}": found[n] for n in S.ATTRIBUTES if n != "nominal_size_mm"} | {"_t_strong": found["nominal_size_mm"]})
    return df.withColumn("_t_nominal_size_mm", F.coalesce("_t_strong", found["bare"])).drop("_text")


def with_attributes(df: DataFrame, text_col: str = S.RAW, once: bool = False) -> DataFrame:
    """Adds the 17 attributes, ``attr_provenance`` and ``n_known_attributes``.

    One pass, no shuffle; ``once`` reads every different text, and every different set
    of structured columns, once, for a shuffle of the texts and rows.
    """
    given = {n: F.col(f"`{n}`").cast("string") for n in S.ATTRIBUTE_COLUMNS if n in df.columns}
    raw, column = F.col(f"`{text_col}`").cast("string"), from_columns(given)
    if once:
        keyed = df.withColumns({"_t_key": F.coalesce(raw, F.lit("")), "_c_key": F.to_json(F.struct(F.lit(0).alias("_"), *[c.alias(f"_{i}") for i, c in enumerate(given.values())]))})
        spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        texts = _text_columns(keyed.select("_t_key").distinct().repartition(spread), F.col("_t_key"))
        stated = keyed.groupBy("_c_key").agg(*[F.first(c).alias(f"_g_{i}") for i, c in enumerate(given.values())])
        stated = stated.select("_c_key", *[c.alias(f"_c_{n}") for n, c in from_columns({n: F.col(f"_g_{i}") for i, n in enumerate(given)}).items()])
        # a small file is one task's: rows are dealt out anew before their columns are told
        df = keyed.repartition(spread).join(texts, "_t_key").join(stated, "_c_key")
    else:
        df = _text_columns(df, raw).withColumns({f"_c_{n}": c for n, c in column.items()})
    final, origin = {}, []
    for n in S.ATTRIBUTES:
        t, c = F.col(f"_t_{n}"), F.col(f"_c_{n}") if n in column else None
        weak = F.when(F.col("_t_strong").isNull(), F.lit("regex_weak")).otherwise("regex") if n == "nominal_size_mm" else F.lit("regex")
        told = F.when(t.isNotNull(), weak).otherwise("unknown")
        if c is not None:
            told = F.when(c.isNull(), told).when(t.isNull(), F.lit("column")).when(values_agree(t, c, n in S.NUMERIC), F.lit("both")).otherwise("conflict")
        final[n] = F.coalesce(c, t) if c is not None else t
        origin += [F.lit(n), told]
    df = df.withColumns(final | {"attr_provenance": F.create_map(*origin)})
    known = sum((F.col(n).isNotNull().cast("int") for n in S.ATTRIBUTES), F.lit(0))
    gone = [c for c in df.columns if c.startswith(("_t_", "_c_")) or c == "_text"]
    return df.withColumn("n_known_attributes", known).drop(*gone)


def known_map(df_cols: list[str] | None = None) -> Column:
    """Known attributes as map<string, string>."""
    pairs = F.create_map(*[x for n in df_cols or S.ATTRIBUTES for x in (F.lit(n), F.col(n).cast("string"))])
    return F.map_filter(pairs, lambda k, v: v.isNotNull())


def column_agreement(df: DataFrame, text_col: str = S.RAW) -> DataFrame:
    """How often text and columns agree: (attribute, n_comparable, n_agree, agreement_rate)."""
    given = {n: F.col(f"`{n}`").cast("string") for n in S.ATTRIBUTE_COLUMNS if n in df.columns}
    text, column = from_text(normalize(F.col(f"`{text_col}`").cast("string"))), from_columns(given)
    rows = None
    for n, source in (("grade", "Material/Grade"), ("spec_standard", "Specification/Standard"), ("nominal_size_mm", "Dimensions")):
        if source not in given:
            continue
        stated = (F.trim(given[source]) != "") & text[n].isNotNull()
        agree = stated & F.coalesce(values_agree(text[n], column[n], n in S.NUMERIC), F.lit(False))
        one = df.select(stated.cast("long").alias("s"), agree.cast("long").alias("y")).agg(F.coalesce(F.sum("s"), F.lit(0)).alias("n_comparable"), F.coalesce(F.sum("y"), F.lit(0)).alias("n_agree"))
        one = one.select(F.lit(n).alias("attribute"), "n_comparable", "n_agree", F.coalesce(F.try_divide("n_agree", "n_comparable"), F.lit(0.0)).alias("agreement_rate"))
        rows = one if rows is None else rows.unionByName(one)
    return rows if rows is not None else df.sparkSession.createDataFrame([], "attribute string, n_comparable long, n_agree long, agreement_rate double")
