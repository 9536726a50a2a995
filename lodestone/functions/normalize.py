"""Text normalization as Column expressions: three ordered passes, no UDF.

Every function takes and returns a Column; null becomes the empty string. White
space, digits and word edges are Unicode's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations of single tokens.
ABBREVIATIONS = {
    "cs": "carbon steel", "ms": "mild steel", "ss": "stainless steel", "ss304": "stainless steel 304", "ss316": "stainless steel 316",
    "al": "aluminium", "alu": "aluminium", "gi": "galvanised iron", "ci": "cast iron", "sg": "spheroidal graphite", "galv": "galvanised",
    "hdg": "hot dip galvanised", "xlpe": "cross linked polyethylene", "acsr": "aluminium conductor steel reinforced", "brg": "bearing",
    "smls": "seamless", "trf": "transformer", "trfr": "transformer", "vv": "valve", "nrv": "non return valve", "flg": "flange",
    "bfly": "butterfly", "cyl": "cylinder", "hyd": "hydraulic", "hemm": "heavy earth moving machinery", "gbx": "gearbox", "cb": "circuit breaker",
    "ct": "current transformer", "pt": "potential transformer", "mcb": "miniature circuit breaker", "dia": "diameter", "od": "outer diameter",
    "id": "inner diameter", "nb": "nominal bore", "dn": "nominal bore", "thk": "thickness", "thick": "thickness", "lg": "length", "wd": "width",
    "sch": "schedule", "hex": "hexagonal", "taper": "tapered", "cl": "class", "wp": "working pressure", "rf": "raised face", "ff": "flat face",
    "rtj": "ring type joint", "onan": "oil natural air natural", "vrla": "valve regulated lead acid", "mtd": "mounted", "tp": "triple pole",
    "dp": "double pole", "lt": "low tension", "ht": "high tension", "astm": "astm", "asme": "asme", "is": "is", "en": "en", "sae": "sae",
    "gr": "grade", "grd": "grade", "cw": "complete with", "w": "with", "approx": "approximately", "assy": "assembly", "qty": "quantity",
    "nos": "numbers", "deg": "degree",
}

# Phrases and what replaces them, in order.
PHRASES = [
    (r"\bv\s*/\s*v\b", "valve"),
    (r"\bm\s*\.\s*s\s*\.?", "mild steel"),
    (r"\bc\s*/\s*w\b", "complete with"),
    (r"\bw\s*/\s*", "with "),
    (r"\bcu\s*\.?\s*m\b", "cum"),
    (r"\bsq\s*\.?\s*mm\b", "sqmm"),
    (r"\bcu\s*\.?\s*mm\b", "cumm"),
    (r"(?<![a-z])m\s*3\s*/\s*hr\b", "cumperhr"),
    (r"(?<![a-z])m3\s*/\s*hr\b", "cumperhr"),
    (r"(?<![a-z])kg\s*/\s*cm\s*2\b", "kgpersqcm"),
    (r"\bmm\s*wg\b", "mmwg"),
]

# Spellings of units.
UNITS = {
    "millimeter": "mm", "millimetre": "mm", "millimeters": "mm", "millimetres": "mm", "mtr": "m", "mtrs": "m", "meter": "m", "metre": "m",
    "meters": "m", "metres": "m", "inches": "inch", "in": "inch", '"': "inch", "kgs": "kg", "kilogram": "kg", "kilograms": "kg", "tonne": "mt",
    "tonnes": "mt", "ton": "mt", "kvolt": "kv", "kilovolt": "kv", "amp": "a", "amps": "a", "ampere": "a", "amperes": "a", "hrs": "hr",
    "hour": "hr", "hours": "hr",
}

PASSES = ("case_punctuation", "abbreviations", "units")


def _sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, "(?U)" + pattern, to)


def _strip(c: Column) -> Column:
    return _sub(c, r"^\s+|\s+$", "")


# Patterns of dotted materials and punctuation, and of tokens that are written together.
PUNCTUATION = [
    (r"\bm\.\s*s\.?", " mild steel "),
    (r"\bc\.\s*s\.?", " carbon steel "),
    (r"\bal\.", " aluminium "),
    ("&", " and "),
    (r"[,;()\[\]{}*_+|]", " "),
    (r"(?<!\d)\.|\.(?!\d)", " "),
]
FUSED = [
    (r"\b([a-z]{2,})(\d)", "$1 $2"),
    (r"(\d)\s*[x×]\s*(\d)", "$1 x $2"),
    (r"(\d)([a-z]+)", "$1 $2"),
    (r"\b([a-z]+)-(?=\d)", "$1 "),
]


def _mapped(tokens: Column, table: dict[str, str], key=lambda t: t) -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(lookup[key(t)], t)), " ")


def fold_case_and_punctuation(c: Column) -> Column:
    """Lower case, dotted materials, ampersands, punctuation; dots stay inside numbers."""
    out = _strip(F.lower(F.coalesce(c, F.lit(""))))
    for pattern, to in PUNCTUATION:
        out = _sub(out, pattern, to)
    return _strip(_sub(out, r"\s+", " "))


def expand_abbreviations(c: Column) -> Column:
    """Phrases, fused tokens, then token by token; a token that isn't known stays as it is."""
    for pattern, to in PHRASES:
        c = _sub(c, pattern, to)
    for pattern, to in FUSED:
        c = _sub(c, pattern, to)
    tokens = F.filter(F.split(c, r"[^0-9a-z./:\-]+"), lambda t: t != "")
    return _strip(_sub(_mapped(tokens, ABBREVIATIONS, lambda t: F.btrim(t, F.lit(".-/"))), r"\s+", " "))


def canonicalize_units(c: Column) -> Column:
    tokens = F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")
    return _strip(_sub(_mapped(tokens, UNITS), r"(\d)\s+(mm|cm|m|kg|mt|kv|kva|hp|bar|inch)\b", "$1 $2"))


def normalize(c: Column) -> Column:
    return canonicalize_units(expand_abbreviations(fold_case_and_punctuation(c)))


def normalize_traced(c: Column) -> Column:
    """struct<text, original, trace array<struct<pass, before, after>>>."""
    a = F.coalesce(c, F.lit(""))
    b = fold_case_and_punctuation(a)
    d = expand_abbreviations(b)
    e = canonicalize_units(d)
    step = lambda name, x, y: F.struct(F.lit(name).alias("pass"), x.alias("before"), y.alias("after"))
    return F.struct(e.alias("text"), a.alias("original"), F.array(*[step(n, x, y) for n, x, y in zip(PASSES, (a, b, d), (b, d, e))]).alias("trace"))


def changed_passes(traced: Column) -> Column:
    """Names of the passes that changed the text."""
    return F.transform(F.filter(traced["trace"], lambda t: t["before"] != t["after"]), lambda t: t["pass"])


def token_set_key(c: Column) -> Column:
    """Sorted distinct tokens of a normalized text."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(c, r"(?U)\s+"), lambda t: t != ""))), " ")
