"""Queries whose inputs reach every rule: each row of a driver table takes one case of a list.

The cases carry the results that the rules' descriptions ask for, written by hand, so
the SQL is a lookup of these and shares no code with the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import settings as S
from lodestone.functions import attributes, normalize, strings
from lodestone.operators import blocking, matching
from lodestone.plans.bindings import table
from lodestone.plans.queries import query

BOTH = "case_punctuation,abbreviations"
ALL = "case_punctuation,abbreviations,units"

# Text, what it is normalized to, and the passes that change it.
TEXTS: list[tuple[str | None, str, str]] = [
    ("BFLY V/V LUG 300 NB CL-150", "butterfly valve lug 300 nominal bore class 150", BOTH),
    ("  PIPE   CS  40NB ", "pipe carbon steel 40 nominal bore", BOTH),
    ("PUMP 50M3/HR HEAD 20 MTR", "pump 50 cumperhr head 20 m", ALL),
    ("TANK 12 CU.M M.S. PLATE 6 MM THK", "tank 12 cum mild steel plate 6 mm thickness", BOTH),
    ("GASKET C/W BOLT W/ NUT", "gasket complete with bolt with nut", BOTH),
    ("CABLE 35 SQ.MM 11 KVOLT", "cable 35 sqmm 11 kv", ALL),
    ("VALVE 2 INCHES 10 KG/CM2", "valve 2 inch 10 kgpersqcm", ALL),
    ("BLOWER 150 MM WG 5 M3/HR", "blower 150 mmwg 5 cumperhr", BOTH),
    ("PIECE 30 CU MM V / V", "piece 30 cumm valve", BOTH),
    ("MOTOR 63KVA & 415VOLT 3 TONNES", "motor 63 kva and 415 volt 3 mt", ALL),
    (None, "", ""),
    ("", "", ""),
    ("plain words", "plain words", ""),
    ("ROLLER 100MM X 2.5M", "roller 100 mm x 2.5 m", BOTH),
    ("PLATE 3000X1500 MM", "plate 3000 x 1500 mm", BOTH),
    ("BOLT M12-GR8 NOS 10", "bolt m12-gr 8 numbers 10", BOTH),
    ("WIRE 5 KILOGRAMS 3 METRES 2 HRS 10 AMPS", "wire 5 kg 3 m 2 hr 10 a", "case_punctuation,units"),
    ("A333 GR.6 (SMLS)", "a333 grade 6 seamless", BOTH),
    ("C.S. FLG, RF; AL. TUBE", "carbon steel flange raised face aluminium tube", BOTH),
]


def cases(spark: SparkSession, sf: str, name: str, key: str, columns: str, rows: list[tuple]) -> DataFrame:
    """The rows of a table as (rid, columns of the case that its key takes)."""
    held = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_case int, {columns}")
    t = table(spark, sf, name).select(F.col(key).cast("long").alias("rid"))
    return t.withColumn("_case", F.pmod("rid", F.lit(len(rows))).cast("int")).join(F.broadcast(held), "_case").drop("_case")


def told(name: str, key: str, columns: list[str], rows: list[tuple]) -> str:
    """SQL of (rid, columns of the results of the case that a row takes)."""
    quote = lambda x: "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"
    values = ", ".join(f"({i}, {', '.join(quote(x) for x in r)})" for i, r in enumerate(rows))
    return f"SELECT {key} AS rid, {', '.join(columns)} FROM {name} JOIN (VALUES {values}) v(i, {', '.join(columns)}) ON i = {key} % {len(rows)}"


@query(told("supplier", "s_suppkey", ["normalized", "changed"], [r[1:] for r in TEXTS]))
def rule_texts(spark, sf):
    t = normalize.normalize_traced(F.col("raw"))
    rows = cases(spark, sf, "supplier", "s_suppkey", "raw string", [r[:1] for r in TEXTS]).select("rid", t.alias("t"))
    return rows.select("rid", F.col("t.text").alias("normalized"), F.array_join(normalize.changed_passes(F.col("t")), ",").alias("changed"))


# Text and structured columns (grade, dimensions, specification, capacity); attributes that are known, and where the size is from.
ATTRIBUTES: list[tuple[str, str | None, str | None, str | None, str | None, dict[str, str], str]] = [
    ("PIPE CS 40NB SCH 20 A106-B", None, None, None, None, {"nominal_size_mm": "40.0", "schedule": "20", "material_of_construction": "carbon steel"}, "regex"),
    ("BFLY V/V LUG 300 NB CL-150", None, None, None, None, {"nominal_size_mm": "300.0", "pressure_class": "150"}, "regex"),
    ("PUMP FLOW 50 M3/HR HEAD 100M 25 HP", None, None, None, None, {"power_hp": "25.0", "flow_m3hr": "50.0", "head_m": "100.0"}, "unknown"),
    ("TRANSFORMER 63KVA 11/0.433 KV", None, None, None, None, {"rating_kva": "63.0", "voltage_kv": "11.0"}, "unknown"),
    ("SWITCH 33 KV", None, None, None, None, {"voltage_kv": "33.0"}, "unknown"),
    ("GEARBOX RATIO 15:1", None, None, None, None, {"ratio": "15:1"}, "unknown"),
    ("GATE VALVE 100MM CLASS 150 CARBON STEEL BODY", None, None, None, None, {"nominal_size_mm": "100.0", "pressure_class": "150", "material_of_construction": "carbon steel"}, "regex_weak"),
    ("SHEET 6 MM THICKNESS", None, None, None, None, {"thickness_mm": "6.0"}, "unknown"),
    ("BELT 800 MM WIDTH 4 PLY RUBBER", None, None, None, None, {"ply": "4.0", "width_mm": "800.0", "material_of_construction": "rubber"}, "unknown"),
    ("PLATE 3000 X 1500 MM", None, None, None, None, {}, "unknown"),
    ("PIPE 2 INCH GR.6", None, None, None, None, {"nominal_size_mm": "50.0", "grade": "6"}, "regex"),
    ("FLANGE 1.5 INCH", None, None, None, None, {"nominal_size_mm": "40.0"}, "regex"),
    ("FLANGE 7 INCH", None, None, None, None, {}, "unknown"),
    ("CONDUCTOR ACSR 50 SQ.MM", None, None, None, None, {"area_sqmm": "50.0", "material_of_construction": "aluminium"}, "unknown"),
    ("TANK 12 CU.M", None, None, None, None, {"capacity_cum": "12.0"}, "unknown"),
    ("BEARING BORE 25 MM", None, None, None, None, {"nominal_size_mm": "25.0"}, "regex"),
    ("PIPE 40NB", None, "40 NB SCH 40", None, None, {"nominal_size_mm": "40.0", "schedule": "40"}, "both"),
    ("PIPE 40NB", None, "50 NB", None, None, {"nominal_size_mm": "50.0"}, "conflict"),
    ("PIPE", None, "80 MM", None, None, {"nominal_size_mm": "80.0"}, "column"),
    ("VALVE ASTM A105 GR B", "B", None, "ASTM A105", None, {"grade": "b", "spec_standard": "astm a105"}, "unknown"),
    ("MOTOR", None, None, None, "63 KVA", {"rating_kva": "63.0"}, "unknown"),
    ("MOTOR", "", " ", "", "", {}, "unknown"),
]
ORDER = S.ATTRIBUTES


def _known(d: dict[str, str]) -> str:
    return ";".join(f"{n}={d[n]}" for n in ORDER if n in d)


@query(told("customer", "c_custkey", ["known", "size_from", "n_known"], [(_known(r[5]), r[6], len(r[5])) for r in ATTRIBUTES]).replace("n_known FROM", "CAST(n_known AS INTEGER) AS n_known FROM"))
def rule_attributes(spark, sf):
    columns = f"`{S.RAW}` string, `Material/Grade` string, Dimensions string, `Specification/Standard` string, `Capacity/Rating` string"
    rows = attributes.with_attributes(cases(spark, sf, "customer", "c_custkey", columns, [r[:5] for r in ATTRIBUTES]))
    stated = F.filter(F.array(*[F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}="), F.col(n).cast("string"))) for n in ORDER]), lambda x: x.isNotNull())
    return rows.select("rid", F.array_join(stated, ";").alias("known"), F.col("attr_provenance")["nominal_size_mm"].alias("size_from"), F.col("n_known_attributes").alias("n_known"))


@query("SELECT c_custkey // 400 AS part, count(*) * (count(*) - 1) // 2 AS pairs, 0::BIGINT AS strangers FROM customer GROUP BY 1 HAVING count(*) > 1")
def block_oversize(spark, sf):
    """One block of all customers: it is cut in parts of 400 in the order of rid, and pairs stay inside a part."""
    null = F.lit(None)
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("rid"), F.lit("Ball Valve").alias(S.CATEGORY), F.lit(100.0).alias("nominal_size_mm"), null.cast("string").alias("spec_standard"), null.cast("string").alias("material_of_construction"), null.cast("double").alias("capacity_cum"), null.cast("double").alias("rating_kva"))
    pairs = blocking.candidate_pairs(blocking.build_blocks(rows, ["category_size"]), families=["category_size"])
    part = lambda c: F.floor(F.col(c) / 400).cast("long")
    return pairs.groupBy(part("a").alias("part")).agg(F.count("*").alias("pairs"), F.count_if(part("a") != part("b")).alias("strangers"))


# Chains of four customers, the middle link weak, and triangles without a weak link.
@query("""WITH c AS (SELECT c_custkey AS rid, c_custkey // 4 AS g, c_custkey % 4 AS i FROM customer), full_ AS (SELECT g FROM c GROUP BY g HAVING count(*) = 4)
SELECT rid, CASE WHEN g % 2 = 0 THEN rid - i % 2 ELSE g * 4 END AS part, (SELECT count(*) FROM full_ WHERE g % 2 = 0) AS n_split FROM c JOIN full_ USING (g) WHERE g % 2 = 0 OR i < 3""")
def cluster_cohesion_split(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("a"))
    full = c.groupBy(F.floor(F.col("a") / 4).alias("g")).agg(F.count("*").alias("n")).where("n = 4")
    g, i = F.floor(F.col("a") / 4), F.col("a") % 4
    chain = c.where((g % 2 == 0) & (i < 3)).select("a", (F.col("a") + 1).alias("b"), F.when(i == 1, F.lit(0.30)).otherwise(0.99).alias("w"), g.alias("g"))
    ring = c.where((g % 2 == 1) & (i < 3)).select("a", (g * 4 + (i + 1) % 3).alias("b"), F.lit(0.95).alias("w"), g.alias("g"))
    edges = chain.unionByName(ring).join(full, "g", "left_semi").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
    parts, n_split = matching.members_of(edges, 0.8)
    return parts.select("rid", "part", F.lit(n_split).cast("long").alias("n_split"))


LCS = "list_reduce(list_transform(string_split({a}, ''), lambda c: [unicode(c)]), lambda row, x: list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j]), lambda acc, j: list_append(acc, CASE WHEN x[1] = unicode(substr({b}, j[1], 1)) THEN row[j[1]] + 1 ELSE greatest(acc[-1], row[j[1] + 1]) END), [CAST(0 AS BIGINT)]), list_transform(range(0, length({b}) + 1), lambda j: CAST(0 AS BIGINT)))[-1]"
NAMES_SQL = """names AS (SELECT DISTINCT n AS t FROM (SELECT p_name AS n FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT r_name FROM region UNION ALL SELECT p_name || ' ' || p_type FROM part WHERE p_partkey < 60)),
np AS (SELECT x.t AS a, y.t AS b, list_distinct(list_filter(string_split(x.t, ' '), lambda w: w <> '')) AS x, list_distinct(list_filter(string_split(y.t, ' '), lambda w: w <> '')) AS y FROM names x JOIN names y ON x.t < y.t),
parts_ AS (SELECT a, b, x, y, list_intersect(x, y) AS both_, array_to_string(list_sort(list_filter(x, lambda w: NOT list_contains(y, w))), ' ') AS l, array_to_string(list_sort(list_filter(y, lambda w: NOT list_contains(x, w))), ' ') AS r FROM np),
apart_ AS (SELECT *, length(array_to_string(list_sort(both_), ' ')) AS s, (len(both_) > 0)::INT AS gap, CASE WHEN l = '' OR r = '' THEN 0 ELSE {lcs} END AS m FROM parts_),
sets_ AS (SELECT a, b, CASE WHEN len(both_) > 0 AND (l = '' OR r = '') THEN 100.0::DOUBLE ELSE greatest(100.0::DOUBLE * (1 - (length(l) + length(r) - 2 * m)::DOUBLE / (2 * s + 2 * gap + length(l) + length(r))),
  CASE WHEN s > 0 THEN 100.0::DOUBLE * (1 - (gap + length(l))::DOUBLE / (2 * s + gap + length(l))) ELSE 0 END, CASE WHEN s > 0 THEN 100.0::DOUBLE * (1 - (gap + length(r))::DOUBLE / (2 * s + gap + length(r))) ELSE 0 END) END AS token_set FROM apart_)""".replace("{lcs}", LCS.format(a="l", b="r"))


@query(f"WITH {NAMES_SQL} SELECT a, b, round(0.5 * jaro_winkler_similarity(a, b) + 0.5 * token_set / 100, 9) AS string FROM sets_")
def score_string_similarity(spark, sf):
    """All pairs of different names in the tables, both halves of the string channel."""
    names = None
    some = table(spark, sf, "part").where("p_partkey < 60").select(F.concat_ws(" ", "p_name", "p_type").alias("t"))
    for name, column in (("part", "p_name"), ("part", "p_type"), ("customer", "c_mktsegment"), ("orders", "o_orderpriority"), ("region", "r_name")):
        own = table(spark, sf, name).select(F.col(column).alias("t"))
        names = own if names is None else names.unionByName(own)
    names = names.unionByName(some).distinct()
    pairs = names.select(F.col("t").alias("a")).join(names.select(F.col("t").alias("b")), F.col("a") < F.col("b"))
    return strings.score_distinct(pairs, "a", "b").select("a", "b", F.round("string", 9).alias("string"))
