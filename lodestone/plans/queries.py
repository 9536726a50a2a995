"""Queries of the engine over the driver's tables, each with the SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import settings as S
from lodestone.functions import attributes, normalize, strings
from lodestone.operators import blocking, blockwise, classify, explain, governance, matching, profile, registry, review, scoring, semantic
from lodestone.operators.graph import connected_components
from lodestone.plans.bindings import AUDIT_SQL, LABELS_SQL, MATERIALS_SQL, audit, material_labels, materials, table
from lodestone.sources import uploads
from lodestone.storage import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _map(d: dict[str, str]) -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in d.items()) + "}"


def _norm_sql(src: str, col: str, out: str = "norm") -> str:
    """CTEs that normalize ``col`` of ``src`` (with rid) into table ``out`` (rid, t). RE2 has no lookbehind: decimals are held by a sign."""
    steps = [f"lower(trim(coalesce({col}, '')))"]
    sub = lambda p, to: steps.append(f"regexp_replace({steps[-1]}, '{p}', '{to}', 'g')")
    for p, to in ((r"\bm\.\s*s\.?", " mild steel "), (r"\bc\.\s*s\.?", " carbon steel "), (r"\bal\.", " aluminium "), ("&", " and "), (r"[,;()\[\]{}*_+|]", " "), (r"(\d)\.(\d)", "\\1\x01\\2"), (r"(\d)\.(\d)", "\\1\x01\\2"), (r"\.", " "), ("\x01", "."), (r"\s+", " ")):
        sub(p, to)
    folded = f"trim({steps[-1]})"
    steps = ["f"]
    for p, to in normalize.PHRASES:
        sub(p.replace("(?<![a-z])", "(^|[^a-z])"), ("\\1" if "(?<" in p else "") + to)
    for p, to in ((r"\b([a-z]{2,})(\d)", "\\1 \\2"), (r"(\d)\s*[x×]\s*(\d)", "\\1 x \\2"), (r"(\d)([a-z]+)", "\\1 \\2"), (r"\b([a-z]+)-(\d)", "\\1 \\2")):
        sub(p, to)
    words = f"list_filter(regexp_split_to_array({steps[-1]}, '[^0-9a-z./:\\-]+'), lambda x: x <> '')"
    abbreviated = f"array_to_string(list_transform({words}, lambda x: coalesce({_map(normalize.ABBREVIATIONS)}[trim(x, './-')], x)), ' ')"
    united = f"array_to_string(list_transform(list_filter(string_split(a, ' '), lambda x: x <> ''), lambda x: coalesce({_map(normalize.UNITS)}[x], x)), ' ')"
    return f"{out}_f AS (SELECT rid, {folded} AS f FROM {src}), {out}_a AS (SELECT rid, f, {abbreviated} AS a FROM {out}_f), {out} AS (SELECT rid, {united} AS t FROM {out}_a)"


NORM = f"WITH {MATERIALS_SQL}, {_norm_sql('materials', '\"Raw Description\"')}"


@query(NORM + " SELECT rid, t AS normalized FROM norm")
def norm_text(spark, sf):
    return materials(spark, sf).select("rid", normalize.normalize(F.col(f"`{S.RAW}`")).alias("normalized"))


@query(NORM + ", d AS (SELECT rid, array_to_string(list_sort(list_distinct(string_split(t, ' '))), ' ') AS token_key FROM norm) SELECT token_key, count(*) AS n FROM d GROUP BY token_key")
def norm_token_set(spark, sf):
    key = normalize.token_set_key(normalize.normalize(F.col(f"`{S.RAW}`")))
    return materials(spark, sf).groupBy(key.alias("token_key")).agg(F.count("*").alias("n"))


# Attributes of the binding, by rules written once more in RE2.
ATTR_SQL = f"""{NORM}, cols AS (SELECT rid, lower("Material/Grade") AS grade_c, lower("Specification/Standard") AS spec_c,
  CASE WHEN "Dimensions" IS NOT NULL THEN CAST(regexp_extract("Dimensions", '(\\d+) NB', 1) AS DOUBLE) END AS size_c,
  CASE WHEN "Dimensions" IS NOT NULL THEN '40' END AS schedule_c, CASE WHEN "Capacity/Rating" IS NOT NULL THEN 63.0 END AS kva_c FROM materials),
raw AS (SELECT rid, t, CAST(nullif(regexp_extract(t, '(\\d+(?:\\.\\d+)?)\\s*mm\\b', 1), '') AS DOUBLE) AS size_t,
  nullif(regexp_extract(t, 'class\\s*(\\d{{2,4}})', 1), '') AS class_t, nullif(regexp_extract(t, '\\bgrade\\s*([a-z0-9]+)\\b', 1), '') AS grade_t,
  nullif(regexp_extract(t, 'schedule\\s*(\\d+)', 1), '') AS schedule_t, nullif(regexp_extract(t, '\\b(astm\\s*a\\s*\\d+)\\b', 1), '') AS spec_t,
  CASE WHEN contains(t, 'carbon steel') THEN 'carbon steel' WHEN contains(t, 'stainless steel 304') THEN 'stainless steel 304' END AS moc FROM norm),
attrs AS (SELECT rid, coalesce(size_c, size_t) AS nominal_size_mm, kva_c AS rating_kva, coalesce(grade_c, grade_t) AS grade, coalesce(spec_c, spec_t) AS spec_standard,
  coalesce(schedule_c, schedule_t) AS schedule, class_t AS pressure_class, moc AS material_of_construction,
  CASE WHEN size_c IS NULL THEN 'regex_weak' WHEN abs(size_c - size_t) <= 0.02 * greatest(size_c, size_t) THEN 'both' ELSE 'conflict' END AS size_from FROM raw JOIN cols USING (rid))"""


@query(ATTR_SQL + " SELECT rid, nominal_size_mm, rating_kva, grade, spec_standard, schedule, pressure_class, material_of_construction, size_from, CAST((nominal_size_mm IS NOT NULL)::INT + (rating_kva IS NOT NULL)::INT + (grade IS NOT NULL)::INT + (spec_standard IS NOT NULL)::INT + (schedule IS NOT NULL)::INT + (pressure_class IS NOT NULL)::INT + (material_of_construction IS NOT NULL)::INT AS INTEGER) AS n_known_attributes FROM attrs")
def attr_extract(spark, sf):
    df = attributes.with_attributes(materials(spark, sf))
    return df.select("rid", "nominal_size_mm", "rating_kva", "grade", "spec_standard", "schedule", "pressure_class", "material_of_construction", F.col("attr_provenance")["nominal_size_mm"].alias("size_from"), "n_known_attributes")


# Blocking on the size of the part itself, so that it can be told in plain SQL.
def sized(spark: SparkSession, sf: str) -> DataFrame:
    null = F.lit(None)
    return materials(spark, sf, F.col("p_size").cast("double").alias("nominal_size_mm")).withColumns(
        {"spec_standard": F.col("`Specification/Standard`"), "material_of_construction": F.when(F.col("rid") % 6 == 0, F.lit("carbon steel")), "capacity_cum": null.cast("double"), "rating_kva": null.cast("double")}
    )


BLOCK_SQL = """sized AS (SELECT p_partkey AS rid, p_name, p_brand, p_size, CAST(floor(p_size / 25.0) AS BIGINT) AS b FROM part),
keys AS (SELECT 'category_size' AS family, 'cat::' || p_name || '|sz::' || b AS key, rid FROM sized
  UNION ALL SELECT DISTINCT 'category_token', 'tok::' || tok || '|sz::' || b, rid FROM (SELECT rid, b, unnest(string_split(p_name, ' ')) AS tok FROM sized)
  UNION ALL SELECT 'attribute_signature', 'sig::' || b || '|' || CASE WHEN rid % 7 = 0 THEN 'astm-a105' ELSE 'na' END || '|' || CASE WHEN rid % 6 = 0 THEN 'carbon steel' ELSE 'na' END || '|na|na', rid
    FROM sized WHERE rid % 7 = 0 OR rid % 6 = 0),
parts AS (SELECT family, key, rid, (row_number() OVER (PARTITION BY family, key ORDER BY rid) - 1) // 400 AS part FROM keys),
every AS (SELECT DISTINCT x.rid AS a, y.rid AS b, x.family FROM parts x JOIN parts y USING (family, key, part) WHERE x.rid < y.rid),
pairs AS (SELECT a, b, string_agg(family, ',' ORDER BY family) AS sources FROM every WHERE family <> 'attribute_signature' GROUP BY a, b)"""


def whole_sql(sql: str) -> str:
    """The same SQL over whole blocks, none cut in parts."""
    cut = "(row_number() OVER (PARTITION BY family, key ORDER BY rid) - 1) // 400 AS part"
    assert cut in sql
    return sql.replace(cut, "0 AS part")


@query(f"WITH {BLOCK_SQL} SELECT family, key, count(*) AS n, min(rid) AS first FROM keys GROUP BY family, key")
def block_keys(spark, sf):
    blocks = blocking.build_blocks(sized(spark, sf), list(blocking.FAMILIES))
    return blocks.groupBy("family", "key").agg(F.count("*").alias("n"), F.min("rid").alias("first"))


@query(f"WITH {BLOCK_SQL} SELECT a, b, sources FROM pairs")
def block_candidate_pairs(spark, sf):
    pairs = blocking.candidate_pairs(blocking.build_blocks(sized(spark, sf)))
    return pairs.select("a", "b", F.array_join("sources", ",").alias("sources"))


@query(f"""WITH {BLOCK_SQL}, n AS (SELECT count(*) AS n FROM part), s AS (SELECT count(*) AS c FROM parts WHERE family <> 'attribute_signature' GROUP BY family, key, part HAVING count(*) > 1)
SELECT n AS n_records, n * (n - 1) // 2 AS naive_comparisons, (SELECT count(*) FROM pairs) AS blocked_comparisons, (SELECT count(*) FROM s) AS n_blocks, (SELECT max(c) FROM s) AS largest_block,
  CAST(n * (n - 1) // 2 AS DOUBLE) / (SELECT count(*) FROM pairs) AS reduction_factor FROM n""")
def block_stats(spark, sf):
    df = sized(spark, sf)
    blocks = blocking.build_blocks(df)
    return blocking.block_stats(df, blocks, blocking.candidate_pairs(blocks))


TRUTH_SQL = f"{LABELS_SQL}, truth AS (SELECT x.rid AS a, y.rid AS b FROM labels_ x JOIN labels_ y USING (gt_group) WHERE x.rid < y.rid)"


@query(f"WITH {BLOCK_SQL}, {TRUTH_SQL}, r AS (SELECT count(*) AS t, count(p.a) AS k FROM truth LEFT JOIN pairs p USING (a, b)) SELECT t AS true_pairs, k AS true_pairs_retained, k / t::DOUBLE AS recall_ceiling, t - k AS pairs_lost FROM r")
def block_recall(spark, sf):
    return blocking.recall_ceiling(blocking.candidate_pairs(blocking.build_blocks(sized(spark, sf))), profile.truth_pairs(material_labels(spark, sf)))


def _scheme_sql() -> str:
    rows = ["SELECT 'none (all pairs)' AS scheme, n * (n - 1) // 2 AS comparisons, 1.0::DOUBLE AS reduction_factor, 1.0::DOUBLE AS recall_ceiling, 0 AS true_pairs_lost, n AS largest_block FROM n"]
    for name, fams in blocking.SCHEMES.items():
        f = ", ".join(f"'{x}'" for x in fams)
        p = f"(SELECT DISTINCT a, b FROM every WHERE family IN ({f}))"
        rows.append(
            f"SELECT '{name}', (SELECT count(*) FROM {p}), round_even((n * (n - 1) // 2) / (SELECT count(*) FROM {p})::DOUBLE, 1), round_even((SELECT count(*) FROM truth JOIN {p} USING (a, b)) / (SELECT count(*) FROM truth)::DOUBLE, 4), "
            f"(SELECT count(*) FROM truth) - (SELECT count(*) FROM truth JOIN {p} USING (a, b)), (SELECT max(c) FROM (SELECT count(*) AS c FROM parts WHERE family IN ({f}) GROUP BY family, key, part)) FROM n"
        )
    return f"WITH {BLOCK_SQL}, {TRUTH_SQL}, n AS (SELECT count(*) AS n FROM part) " + " UNION ALL ".join(rows)


@query(_scheme_sql())
def block_compare_schemes(spark, sf):
    return blocking.compare_schemes(sized(spark, sf), profile.truth_pairs(material_labels(spark, sf)))


# Scores over pairs of one category and size bucket.
PAIR_SQL = f"{ATTR_SQL}, {BLOCK_SQL}, cs AS (SELECT DISTINCT a, b FROM every WHERE family = 'category_size')"
_FLAG = "CASE WHEN l.{0} IS NULL OR r.{0} IS NULL THEN NULL WHEN {1} THEN 1 ELSE 0 END"
_NUMBER, _TEXT = "abs(l.{0} - r.{0}) <= 0.02 * greatest(l.{0}, r.{0})", "(contains(l.{0}, r.{0}) OR contains(r.{0}, l.{0}))"
_FLAGS = {n: _FLAG.format(n, (_NUMBER if n in S.NUMERIC else _TEXT).format(n)) for n in ("nominal_size_mm", "rating_kva", "grade", "spec_standard", "schedule", "pressure_class", "material_of_construction")}
SCORE_SQL = (
    f"{PAIR_SQL}, flags AS (SELECT a, b, {', '.join(f'{e} AS {n}' for n, e in _FLAGS.items())} FROM cs JOIN attrs l ON l.rid = a JOIN attrs r ON r.rid = b), "
    f"counts AS (SELECT a, b, {' + '.join(f'coalesce({n}, 0)' for n in _FLAGS)} AS agree, {' + '.join(f'coalesce(1 - {n}, 0)' for n in _FLAGS)} AS conflict, "
    f"coalesce(schedule = 0, false) OR coalesce(pressure_class = 0, false) OR coalesce(grade = 0, false) OR coalesce(spec_standard = 0, false) AS hard_conflict FROM flags), "
    "scores AS (SELECT a, b, CAST(agree AS INTEGER) AS n_agree_attrs, CAST(conflict AS INTEGER) AS n_conflicts, CAST(agree + conflict AS INTEGER) AS n_comparable_attrs, hard_conflict, "
    "CASE WHEN agree + conflict = 0 THEN 0.5 ELSE agree / (agree + conflict)::DOUBLE END AS attribute FROM counts)"
)


def attributed(spark: SparkSession, sf: str) -> DataFrame:
    return attributes.with_attributes(materials(spark, sf), once=True)


def compared(spark: SparkSession, sf: str, *more: str, once: bool = False) -> DataFrame:
    """The records with the columns that scores and clusters read, and ``more``; not written to a table if they are read once."""
    kept = dict.fromkeys(["rid", S.OWNER, S.CATEGORY, *more, *S.ATTRIBUTES, "n_known_attributes"])
    rows = attributed(spark, sf).select(*[F.col(f"`{c}`") for c in kept])
    return rows if once else materialize(rows, "q-records")


def size_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return blocking.build_blocks(sized(spark, sf), ["category_size"])


def size_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return blocking.candidate_pairs(size_blocks(spark, sf), families=["category_size"])


@query(f"{SCORE_SQL} SELECT scores.a, scores.b, attribute, n_agree_attrs, n_conflicts, n_comparable_attrs, hard_conflict, l.p_brand <> r.p_brand AS cross_cpse FROM scores JOIN sized l ON l.rid = scores.a JOIN sized r ON r.rid = scores.b")
def score_attributes(spark, sf):
    rows = scoring.score_attributes(materialize(attributed(spark, sf), "q-records"), size_pairs(spark, sf))
    return rows.select("a", "b", "attribute", "n_agree_attrs", "n_conflicts", "n_comparable_attrs", "hard_conflict", "cross_cpse")


@query("""WITH d AS (SELECT doc_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM documents), p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.t AS s, y.t AS t FROM d x JOIN d y ON y.doc_id = x.doc_id + 1 WHERE length(x.t) > 0 AND length(y.t) > 0)
SELECT a, b, round(jaro_winkler_similarity(s, t), 9) AS jaro_winkler FROM p""")
def score_jaro_winkler(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[^ -~]", "").alias("t")).where(F.length("t") > 0)
    p = d.alias("x").join(d.alias("y"), F.col("y.doc_id") == F.col("x.doc_id") + 1)
    return p.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), F.round(strings.jaro_winkler_udf("x.t", "y.t"), 9).alias("jaro_winkler"))


@query("""SELECT x.vec_id AS a, y.vec_id AS b, round(greatest(0.0, least(1.0, list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]))), 9) AS semantic
FROM embeddings x JOIN embeddings y ON x.label = y.label AND y.vec_id = x.vec_id + 10""")
def score_semantic(spark, sf):
    e = table(spark, sf, "embeddings")
    p = e.alias("x").join(e.alias("y"), (F.col("x.label") == F.col("y.label")) & (F.col("y.vec_id") == F.col("x.vec_id") + 10)).select(F.col("x.vec_id").alias("a"), F.col("y.vec_id").alias("b"))
    scored = semantic.semantic_similarity(p, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))
    return scored.select("a", "b", F.round("semantic", 9).alias("semantic"))


@query(NORM + """, n AS (SELECT count(*) AS n FROM norm), w AS (SELECT rid, unnest(regexp_extract_all(t, '\\w\\w+')) AS term FROM norm),
pairs2 AS (SELECT rid, regexp_extract_all(t, '\\w\\w+') AS l FROM norm), bi AS (SELECT rid, l[i] || ' ' || l[i + 1] AS term FROM (SELECT rid, l, unnest(range(1, len(l))) AS i FROM pairs2)),
tf AS (SELECT rid, term, count(*) AS c FROM (SELECT * FROM w UNION ALL SELECT * FROM bi) GROUP BY ALL), df AS (SELECT term, count(*) AS d FROM tf GROUP BY term)
SELECT term, d AS df, round(ln((1 + n) / (1 + d)::DOUBLE) + 1, 9) AS idf FROM df, n""")
def semantic_idf(spark, sf):
    texts = materials(spark, sf).select(F.col("rid").alias("id"), normalize.normalize(F.col(f"`{S.RAW}`")).alias("text"))
    n = texts.count()
    df = texts.select("id", F.explode(F.array_distinct(semantic.word_terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", "df", F.round(F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1, 9).alias("idf"))


_FUSE = "greatest(0.0, least(1.0, 0.35 * {s} + 0.4 * {t} + 0.25 * attribute - CASE WHEN hard_conflict THEN 0.3 WHEN n_conflicts > 0 THEN 0.15 ELSE 0.0 END))"


@query(f"{SCORE_SQL} SELECT a, b, round({_FUSE.format(s='0.5::DOUBLE', t='(((a + b) % 11) / 10.0::DOUBLE)')}, 9) AS fused FROM scores")
def score_fused(spark, sf):
    rows = scoring.score_attributes(materialize(attributed(spark, sf), "q-records"), size_pairs(spark, sf))
    fused = scoring.fuse(F.lit(0.5), ((F.col("a") + F.col("b")) % 11) / 10.0, F.col("attribute"), F.col("hard_conflict"), F.col("n_conflicts"))
    return rows.select("a", "b", F.round(fused, 9).alias("fused"))


@query(f"""{SCORE_SQL}, both_ AS (SELECT a AS rid, b AS other, attribute FROM scores UNION ALL SELECT b, a, attribute FROM scores), r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY attribute DESC, other) AS rank FROM both_)
SELECT rid, other, attribute, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def score_top_k(spark, sf):
    rows = blockwise.score_blocks(compared(spark, sf, once=True), size_blocks(spark, sf), best=3)
    return scoring.top_k(rows, 3, "attribute")


@query(f"{SCORE_SQL}, {LABELS_SQL} SELECT CAST((x.gt_group = y.gt_group) AS INTEGER) AS label, count(*) AS n, round(avg(attribute), 3) AS attribute, round(avg(n_conflicts), 3) AS n_conflicts FROM scores JOIN labels_ x ON x.rid = scores.a JOIN labels_ y ON y.rid = scores.b GROUP BY 1")
def channels_by_label(spark, sf):
    rows = scoring.score_attributes(materialize(attributed(spark, sf), "q-records"), size_pairs(spark, sf))
    means = classify.label_pairs(rows, material_labels(spark, sf)).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("attribute"), 3).alias("attribute"), F.round(F.avg("n_conflicts"), 3).alias("n_conflicts"))
    return means


# Graph, clusters, tiers and evaluation on attribute scores.
EDGE = 0.99
CLUSTER_SQL = f"""{SCORE_SQL.replace('WITH ', 'WITH RECURSIVE ', 1)}, {TRUTH_SQL}, edges AS (SELECT a, b, attribute AS w FROM scores WHERE attribute >= {EDGE}),
both_ AS (SELECT a AS u, b AS v FROM edges UNION ALL SELECT b, a FROM edges), reach AS (SELECT u AS node, u AS root FROM both_ UNION SELECT v, root FROM reach JOIN both_ ON node = u),
comp AS (SELECT node, min(root) AS component FROM reach GROUP BY node)"""


def edges_of(spark: SparkSession, sf: str, *more: str) -> tuple[DataFrame, DataFrame]:
    records = compared(spark, sf, *more)
    scored = blockwise.score_blocks(records, size_blocks(spark, sf), least=EDGE)
    return records, materialize(matching.build_graph(scored, EDGE, "attribute"), "q-edges")


@query(f"{CLUSTER_SQL} SELECT node, component FROM comp")
def graph_components(spark, sf):
    return connected_components(edges_of(spark, sf)[1])


_ROLLUP = f"""{CLUSTER_SQL}, known AS (SELECT rid, (nominal_size_mm IS NOT NULL)::INT + (rating_kva IS NOT NULL)::INT + (grade IS NOT NULL)::INT + (spec_standard IS NOT NULL)::INT + (schedule IS NOT NULL)::INT + (pressure_class IS NOT NULL)::INT + (material_of_construction IS NOT NULL)::INT AS k FROM attrs),
people AS (SELECT component, count(*) AS size, count(DISTINCT p_brand) AS owners, min(k) AS k FROM comp JOIN sized ON sized.rid = node JOIN known ON known.rid = node GROUP BY component),
sums AS (SELECT x.component, avg(w) AS mean_score, min(w) AS min_score, count(*) AS n_edges FROM edges JOIN comp x ON x.node = a GROUP BY x.component),
clusters AS (SELECT component, size, owners > 1 AS is_cross_cpse, CAST(k AS INTEGER) AS min_known_attrs, mean_score, min_score, n_edges, CASE WHEN k < 2 THEN 'UNKNOWN' WHEN min_score >= 0.995 THEN 'HIGH' WHEN min_score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM people JOIN sums USING (component))"""


def clusters_of(spark: SparkSession, sf: str, *more: str) -> tuple[DataFrame, DataFrame]:
    records, edges = edges_of(spark, sf, *more)
    clusters, _ = matching.cluster(edges, records, 0.0)
    return records, materialize(matching.assign_tiers(clusters, 0.995, 0.5), "q-clusters")


@query(f"{_ROLLUP} SELECT component AS first_member, CAST(size AS INTEGER) AS size, is_cross_cpse, min_known_attrs, round(mean_score, 9) AS mean_score, min_score, CAST(n_edges AS INTEGER) AS n_edges, tier FROM clusters")
def cluster_rollup(spark, sf):
    _, c = clusters_of(spark, sf)
    return c.select(F.get("members", F.lit(0)).alias("first_member"), "size", "is_cross_cpse", "min_known_attrs", F.round("mean_score", 9).alias("mean_score"), "min_score", F.size("edges").alias("n_edges"), "tier")


@query(f"{_ROLLUP} SELECT tier, x.node AS a, y.node AS b FROM comp x JOIN comp y USING (component) JOIN clusters USING (component) WHERE x.node < y.node")
def cluster_pairs(spark, sf):
    return matching.cluster_pairs(clusters_of(spark, sf)[1]).drop("cluster_id")


@query(f"{_ROLLUP} SELECT t.tier, coalesce(c.n, 0) AS n FROM (VALUES ('HIGH'), ('MEDIUM'), ('LOW'), ('UNKNOWN')) t(tier) LEFT JOIN (SELECT tier, count(*) AS n FROM clusters GROUP BY tier) c USING (tier)")
def cluster_tier_counts(spark, sf):
    return matching.tier_counts(clusters_of(spark, sf)[1])


@query(f"""{_ROLLUP}, pred AS (SELECT x.node AS a, y.node AS b FROM comp x JOIN comp y USING (component) JOIN clusters USING (component) WHERE x.node < y.node AND tier IN ('HIGH', 'MEDIUM')),
u AS (SELECT coalesce(p.a, t.a) AS a, coalesce(p.b, t.b) AS b, p.a IS NOT NULL AS p, t.a IS NOT NULL AS t FROM pred p FULL JOIN truth t ON p.a = t.a AND p.b = t.b),
x AS (SELECT p, t, l.p_brand <> r.p_brand AS c FROM u JOIN sized l ON l.rid = u.a JOIN sized r ON r.rid = u.b),
s AS (SELECT 'overall' AS scope, p, t FROM x UNION ALL SELECT CASE WHEN c THEN 'cross_cpse' ELSE 'within_cpse' END, p, t FROM x),
m AS (SELECT scope, count(*) FILTER (p AND t) AS true_positives, count(*) FILTER (p) AS predicted, count(*) FILTER (t) AS actual FROM s GROUP BY scope)
SELECT scope, coalesce(true_positives, 0) AS true_positives, coalesce(predicted, 0) AS predicted, coalesce(actual, 0) AS actual, coalesce(true_positives / nullif(predicted, 0)::DOUBLE, 0) AS precision,
  coalesce(true_positives / nullif(actual, 0)::DOUBLE, 0) AS recall, coalesce(round(2.0 * true_positives / nullif(predicted + actual, 0), 9), 0) AS f1
FROM (VALUES ('overall'), ('cross_cpse'), ('within_cpse')) v(scope) LEFT JOIN m USING (scope)""")
def cluster_evaluate(spark, sf):
    records, c = clusters_of(spark, sf)
    return matching.evaluate(c, material_labels(spark, sf), records).withColumn("f1", F.round("f1", 9))


@query(f"{_ROLLUP}, o AS (SELECT DISTINCT component, p_brand FROM comp JOIN sized ON sized.rid = node) SELECT p_brand AS owner, count(*) AS n FROM o GROUP BY p_brand")
def dashboard_clusters_per_owner(spark, sf):
    return profile.clusters_per_owner(clusters_of(spark, sf)[1])


@query(f"{whole_sql(_ROLLUP)}, s AS (SELECT count(*) AS n, CAST(sum(size) AS BIGINT) AS c, count(*) FILTER (is_cross_cpse) AS x FROM clusters) SELECT n AS n_clusters, c AS clustered, x AS cross_clusters, c / (SELECT count(*) FROM part)::DOUBLE AS duplicate_rate, c - n AS codes_eliminated, round((c - n) * 250000 * 0.08::DOUBLE, 3) AS carrying_saving, round((c - n) * 250000 * 0.03::DOUBLE, 3) AS price_saving FROM s")
def dashboard_savings(spark, sf):
    records = compared(spark, sf)
    links = blockwise.forest_blocks(records, size_blocks(spark, sf), least=EDGE)  # components are those of all pairs
    sizes = materialize(matching.cluster_sizes(matching.build_graph(links, EDGE, "attribute"), records), "q-sizes")
    return profile.savings(sizes, records).withColumns({"carrying_saving": F.round("carrying_saving", 3), "price_saving": F.round("price_saving", 3)})


# Labels, splits and thresholds.
@query(f"WITH {TRUTH_SQL} SELECT a, b FROM truth")
def truth_pairs(spark, sf):
    return profile.truth_pairs(material_labels(spark, sf))


@query(f"""WITH {TRUTH_SQL}, g AS (SELECT gt_group, count(*) AS n, count(DISTINCT p_brand) AS o FROM labels_ JOIN part ON p_partkey = rid GROUP BY gt_group),
x AS (SELECT l.p_brand <> r.p_brand AS c FROM truth JOIN part l ON l.p_partkey = a JOIN part r ON r.p_partkey = b), n AS (SELECT count(*) AS n FROM part)
SELECT (SELECT count(*) FROM g) AS total_groups, (SELECT count(*) FROM g WHERE n > 1) AS multi_member_groups, (SELECT count(*) FROM g WHERE n > 1 AND o > 1) AS cross_cpse_groups, (SELECT count(*) FROM x) AS true_pairs,
  (SELECT count(*) FROM x WHERE c) AS cross_cpse_pairs, (SELECT count(*) FROM x WHERE NOT c) AS within_cpse_pairs, n * (n - 1) // 2 AS possible_pairs FROM n""")
def truth_summary(spark, sf):
    return profile.truth_summary(material_labels(spark, sf), materials(spark, sf))


@query(f"""WITH {MATERIALS_SQL}, {LABELS_SQL}, j AS (SELECT m.*, gt_group FROM materials m JOIN labels_ USING (rid)),
g AS (SELECT gt_group FROM j GROUP BY gt_group HAVING count(*) > 1 AND count(DISTINCT "CPSE") > 1 AND count(DISTINCT trim(upper("Raw Description"))) = count(*) ORDER BY gt_group LIMIT 5)
SELECT rid, gt_group, "CPSE" AS owner, "Raw Description" AS raw FROM j JOIN g USING (gt_group)""")
def truth_examples(spark, sf):
    rows = profile.cross_owner_examples(materials(spark, sf), material_labels(spark, sf))
    return rows.select("rid", "gt_group", F.col(S.OWNER).alias("owner"), F.col(f"`{S.RAW}`").alias("raw"))


@query(f"WITH {TRUTH_SQL} SELECT least(l.p_type, r.p_type) AS category_a, greatest(l.p_type, r.p_type) AS category_b, count(*) AS n FROM truth JOIN part l ON l.p_partkey = truth.a JOIN part r ON r.p_partkey = truth.b GROUP BY 1, 2")
def truth_category_confusion(spark, sf):
    typed = table(spark, sf, "part").select(F.col("p_partkey").alias("rid"), F.col("p_type").alias(S.CATEGORY))
    return profile.category_confusion(typed, profile.truth_pairs(material_labels(spark, sf)))


@query(f"""WITH {LABELS_SQL}, g AS (SELECT DISTINCT gt_group FROM labels_), n AS (SELECT count(*) AS n FROM g), p AS (SELECT gt_group, row_number() OVER (ORDER BY md5(gt_group || '|42'), gt_group) AS r FROM g)
SELECT gt_group, CASE WHEN r <= floor(n * 0.3) THEN 'test' WHEN r <= floor(n * 0.3) + floor(n * 0.15) THEN 'val' ELSE 'train' END AS side FROM p, n""")
def split_groups(spark, sf):
    return classify.group_sides(material_labels(spark, sf))


@query(f"""WITH {BLOCK_SQL}, {LABELS_SQL}, cs AS (SELECT DISTINCT a, b FROM every WHERE family = 'category_size'), g AS (SELECT DISTINCT gt_group FROM labels_), n AS (SELECT count(*) AS n FROM g),
p AS (SELECT gt_group, row_number() OVER (ORDER BY md5(gt_group || '|42'), gt_group) AS r FROM g), s AS (SELECT rid, gt_group, CASE WHEN r <= floor(n * 0.3) THEN 'test' WHEN r <= floor(n * 0.3) + floor(n * 0.15) THEN 'val' ELSE 'train' END AS side FROM labels_ JOIN p USING (gt_group), n)
SELECT CASE WHEN x.side = y.side THEN x.side ELSE 'discarded' END AS split, count(*) AS n, CAST(sum((x.gt_group = y.gt_group)::INT) AS BIGINT) AS positives FROM cs JOIN s x ON x.rid = a JOIN s y ON y.rid = b GROUP BY 1""")
def split_pairs(spark, sf):
    labels = material_labels(spark, sf)
    rows = classify.label_pairs(classify.group_disjoint_split(size_pairs(spark, sf), labels), labels)
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("positives"))


P_SQL = "rows_ AS (SELECT l_quantity / 50.0 AS p, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem)"
GRID_SQL = f"""WITH {P_SQL}, grid AS (SELECT i / 100.0::DOUBLE AS threshold FROM range(5, 96) t(i)), m AS (SELECT threshold, count(*) FILTER (p >= threshold AND label = 1) AS tp, count(*) FILTER (p >= threshold) AS predicted, count(*) FILTER (label = 1) AS actual FROM grid, rows_ GROUP BY threshold)"""


def probabilities(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select((F.col("l_quantity") / 50.0).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("label"))


@query(GRID_SQL + " SELECT threshold, tp, predicted, actual, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(actual, 0)::DOUBLE, 0) AS recall FROM m")
def threshold_grid(spark, sf):
    return classify.threshold_table(probabilities(spark, sf), 5, 95).drop("f1")


@query(GRID_SQL + " SELECT threshold, round(2.0 * tp / (predicted + actual), 9) AS f1 FROM m ORDER BY 2.0 * tp / (predicted + actual) DESC, threshold LIMIT 1")
def threshold_best_f1(spark, sf):
    t, f1 = classify.tune_threshold(probabilities(spark, sf))
    return spark.createDataFrame([(t, f1)], "threshold double, f1 double").withColumn("f1", F.round("f1", 9))


@query(f"""WITH {P_SQL}, s AS (SELECT p, count(*) AS n, sum(label) AS y FROM rows_ GROUP BY p), c AS (SELECT y, sum(n) OVER w AS cn, sum(y) OVER w AS cy FROM s WINDOW w AS (ORDER BY p DESC))
SELECT round(sum(y * cy / cn::DOUBLE) / sum(y), 9) AS average_precision FROM c""")
def threshold_average_precision(spark, sf):
    return classify.average_precision(probabilities(spark, sf)).select(F.round("average_precision", 9).alias("average_precision"))


# Profile and mapping.
@query(f"""WITH {MATERIALS_SQL} SELECT count(*) AS n_rows, count(DISTINCT "CPSE") AS n_cpses, count(DISTINCT "Material Category") AS n_categories, count(*) - count(DISTINCT "Raw Description") AS duplicate_raw_descriptions,
count(*) - count(DISTINCT "CPSE Material Code") AS duplicate_material_codes, array_to_string(list_sort(list(DISTINCT nullif("UOM", ''))), ',') AS distinct_uoms FROM materials""")
def profile_table(spark, sf):
    return profile.profile(materials(spark, sf)).withColumn("distinct_uoms", F.array_join("distinct_uoms", ","))


@query(f"""WITH {MATERIALS_SQL} SELECT "CPSE" AS value, count(*) AS n FROM materials GROUP BY 1""")
def profile_value_counts(spark, sf):
    return profile.value_counts(materials(spark, sf), S.OWNER)


def _null_sql() -> str:
    rows = [f"SELECT '{c}' AS column, avg((\"{c}\" IS NULL OR trim(\"{c}\") = '')::INT) AS null_rate FROM materials" for c in S.ATTRIBUTE_COLUMNS]
    return f"WITH {MATERIALS_SQL}, r AS (" + " UNION ALL ".join(rows) + ") SELECT \"column\", null_rate, printf('%.1f%%', null_rate * 100) AS pct FROM r"


@query(_null_sql())
def profile_null_rates(spark, sf):
    return profile.null_rates(materials(spark, sf))


@query(NORM + f""", {LABELS_SQL}, j AS (SELECT array_to_string(list_sort(list_distinct(string_split(t, ' '))), ' ') AS k, gt_group FROM norm JOIN labels_ USING (rid)),
a AS (SELECT sum(n * (n - 1) // 2) AS p FROM (SELECT count(*) AS n FROM j GROUP BY k)), h AS (SELECT sum(n * (n - 1) // 2) AS t FROM (SELECT count(*) AS n FROM j GROUP BY k, gt_group)), g AS (SELECT sum(n * (n - 1) // 2) AS r FROM (SELECT count(*) AS n FROM j GROUP BY gt_group))
SELECT CAST(p AS BIGINT) AS pairs, CAST(t AS BIGINT) AS true_pairs, coalesce(t / nullif(p, 0)::DOUBLE, 0) AS purity, coalesce(t / nullif(r, 0)::DOUBLE, 0) AS recall FROM a, h, g""")
def collision_quality(spark, sf):
    key = normalize.token_set_key(normalize.normalize(F.col(f"`{S.RAW}`")))
    return profile.collision_quality(materials(spark, sf), material_labels(spark, sf), key)


@query("""WITH s AS (SELECT 'c_name' AS name, c_name AS v FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer)
SELECT name, count(*) AS count, count(DISTINCT v) AS n_unique, avg(length(v)) AS avg_len, avg(regexp_matches(v, '^[A-Za-z0-9]+(?:[-/][A-Za-z0-9]+)+$')::INT) AS frac_code_like,
avg((length(v) <= 28 AND regexp_matches(v, '^[A-Za-z0-9][A-Za-z0-9 .,&''()-]*$'))::INT) AS frac_name_like, 0.0::DOUBLE AS frac_unit FROM s GROUP BY name""")
def mapping_column_stats(spark, sf):
    return uploads.column_stats(table(spark, sf, "customer").select("c_name", "c_mktsegment"))


@query("SELECT string_agg(s, ', ' ORDER BY o) || '...' AS hint FROM (SELECT c_mktsegment AS s, min(c_custkey) AS o FROM customer GROUP BY 1 ORDER BY o LIMIT 3)")
def mapping_column_hint(spark, sf):
    df = table(spark, sf, "customer").withColumnRenamed("c_custkey", "rid")
    return uploads.column_hint(df, "c_mktsegment")


@query(f"""WITH {MATERIALS_SQL} SELECT 'UOM' AS name, avg((lower(trim("UOM")) IN ({', '.join(f"'{u}'" for u in uploads.UNITS)}))::INT) AS frac_unit FROM materials WHERE trim("UOM") <> ''
UNION ALL SELECT 'CPSE', avg((lower(trim("CPSE")) IN ({', '.join(f"'{u}'" for u in uploads.UNITS)}))::INT) FROM materials""")
def mapping_unit_columns(spark, sf):
    return uploads.column_stats(materials(spark, sf).select(S.UOM, S.OWNER)).select("name", "frac_unit")


@query("SELECT p_partkey AS rid, p_brand AS owner, p_name AS category, '' AS sector FROM part")
def mapping_apply(spark, sf):
    df = table(spark, sf, "part").withColumnRenamed("p_partkey", "rid").withColumn("code", F.col("rid").cast("string"))
    out = uploads.apply_mapping(df, {S.OWNER: "p_brand", S.CODE: "code", S.CATEGORY: "p_name", S.RAW: "p_type"})
    return out.select("rid", F.col(S.OWNER).alias("owner"), F.col(f"`{S.CATEGORY}`").alias("category"), F.col(S.SECTOR).alias("sector"))


# Registry.
def _registry(spark: SparkSession, sf: str) -> registry.Registry:
    """A code for the parts of each name, taken as clusters."""
    p = table(spark, sf, "part")
    clusters = p.groupBy("p_name").agg(F.sort_array(F.collect_list("p_partkey")).alias("members")).select(F.dense_rank().over(Window.orderBy("p_name")).alias("cluster_id"), "members", F.lit("HIGH").alias("tier"))
    return registry.Registry.empty(spark).assign(clusters, materials(spark, sf), created_at="1970-01-01T00:00:00Z")


REG_SQL = f"""WITH {MATERIALS_SQL}, c AS (SELECT p_name, dense_rank() OVER (ORDER BY p_name) AS k, p_partkey AS rid FROM part),
f AS (SELECT k, min(rid) AS rid FROM c GROUP BY k), codes AS (SELECT k, 'NM-' || coalesce(MAP {{'Power': 'PW', 'Steel': 'ST', 'Mining': 'MN'}}["Sector"], 'XX') || '-' || upper(left(split_part("Material Category", ' ', 1), 2) || left(split_part("Material Category", ' ', 2), 1)) || '-' || lpad(CAST(k AS VARCHAR), 5, '0') AS cnmc FROM f JOIN materials USING (rid)),
m AS (SELECT cnmc, c.rid, "CPSE" AS cpse, "CPSE Material Code" AS code, "Raw Description" AS d FROM c JOIN codes USING (k) JOIN materials ON materials.rid = c.rid)"""


@query(REG_SQL + ' SELECT cnmc AS "CNMC", rid, cpse AS "CPSE", code AS "CPSE_Material_Code" FROM m')
def registry_assign(spark, sf):
    return _registry(spark, sf).members.select(F.col("cnmc").alias("CNMC"), "rid", F.col("cpse").alias("CPSE"), F.col("code").alias("CPSE_Material_Code"))


@query(REG_SQL + ", t AS (SELECT cnmc, arg_max(d, (length(d), -rid)) AS x FROM m GROUP BY cnmc) SELECT cnmc AS \"CNMC\", 'active' AS \"Status\", '' AS \"Superseded_By\", cpse AS \"CPSE\", code AS \"CPSE_Material_Code\", d AS \"Raw_Description\", x AS \"Canonical_Description\", 'HIGH' AS \"Confidence_Tier\", 'system' AS \"Created_By\" FROM m JOIN t USING (cnmc)")
def registry_frame(spark, sf):
    return _registry(spark, sf).to_frame().drop("Created_At", "Legacy_Sector_Code")


@query(REG_SQL + " SELECT cnmc, arg_max(d, (length(d), -rid)) AS canonical_description FROM m GROUP BY cnmc")
def registry_canonical(spark, sf):
    return _registry(spark, sf).entries.select("cnmc", "canonical_description")


@query(REG_SQL + ", g AS (SELECT cnmc, count(*) AS n, count(DISTINCT cpse) AS o FROM m GROUP BY cnmc) SELECT count(*) AS codes_issued, count(*) AS active_codes, count(*) FILTER (o > 1) AS cross_cpse_codes, CAST(sum(n) AS BIGINT) AS records_mapped, CAST(sum(n) - count(*) AS BIGINT) AS codes_eliminated FROM g")
def registry_stats(spark, sf):
    return _registry(spark, sf).stats()


@query("""WITH RECURSIVE e AS (SELECT 'C' || r_regionkey AS cnmc, CASE WHEN r_regionkey = 0 THEN 'active' ELSE 'superseded' END AS status, CASE WHEN r_regionkey > 0 THEN 'C' || (r_regionkey - 1) END AS to_ FROM region),
w AS (SELECT cnmc, cnmc AS cur FROM e UNION ALL SELECT w.cnmc, e.to_ FROM w JOIN e ON e.cnmc = w.cur WHERE e.status = 'superseded') SELECT w.cnmc, cur AS resolved FROM w JOIN e ON e.cnmc = cur WHERE e.status = 'active'""")
def registry_resolve(spark, sf):
    r = table(spark, sf, "region")
    entries = r.select(F.concat(F.lit("C"), "r_regionkey").alias("cnmc"), F.when(F.col("r_regionkey") == 0, F.lit("active")).otherwise("superseded").alias("status"), F.when(F.col("r_regionkey") > 0, F.concat(F.lit("C"), F.col("r_regionkey") - 1)).alias("superseded_by"), *[F.lit("").alias(c) for c in ("created_at", "created_by", "tier", "canonical_description")])
    return registry.Registry(entries, spark.createDataFrame([], registry.MEMBERS)).resolve_all()


# Governance.
CUT = "2024-01-08 00:00:00"


@query(f"""WITH {AUDIT_SQL}, kept AS (SELECT * FROM audit WHERE ts <= TIMESTAMP '{CUT}'), gone AS (SELECT DISTINCT compensates AS event_id FROM kept WHERE action = 'rollback' AND compensates IS NOT NULL),
live AS (SELECT * FROM kept ANTI JOIN gone USING (event_id)), l AS (SELECT * FROM live WHERE action <> 'rollback' OR before <> '{{}}'),
s AS (SELECT target, arg_max(CASE WHEN action <> 'rollback' AND after = '{{}}' THEN '' ELSE after END, event_id) AS state FROM l GROUP BY target) SELECT target, state FROM s WHERE state <> ''""")
def audit_version_at(spark, sf):
    return governance.version_at(audit(spark, sf), CUT)


@query(f"WITH {AUDIT_SQL}, g AS (SELECT compensates AS event_id FROM audit WHERE compensates IS NOT NULL) SELECT event_id, action, target FROM audit ANTI JOIN g USING (event_id) WHERE action <> 'rollback'")
def audit_effective_events(spark, sf):
    return governance.effective_events(audit(spark, sf)).select("event_id", "action", "target")


@query(f"WITH {AUDIT_SQL}, b AS (SELECT compensates AS event_id, min(event_id) AS reverted_by FROM audit WHERE action = 'rollback' GROUP BY 1) SELECT event_id, action, actor, target, substr(reason, 1, 80) AS reason, compensates, reverted_by FROM audit LEFT JOIN b USING (event_id)")
def audit_frame(spark, sf):
    return governance.to_frame(audit(spark, sf)).drop("ts")


@query(f"WITH {AUDIT_SQL} SELECT event_id, target FROM audit WHERE target = 'NM-7' AND ts >= TIMESTAMP '{CUT}' AND action = 'approve'")
def audit_history(spark, sf):
    return governance.by_action(governance.since(governance.history(audit(spark, sf), "NM-7"), CUT), "approve").select("event_id", "target")


@query(f"WITH {AUDIT_SQL} SELECT action, count(*) AS n FROM audit GROUP BY action")
def audit_action_counts(spark, sf):
    return profile.value_counts(audit(spark, sf), "action").withColumnRenamed("value", "action")


@query(f"WITH {AUDIT_SQL} SELECT action, count(*) AS n FROM audit WHERE actor = 'u7' GROUP BY action")
def audit_by_actor(spark, sf):
    return governance.by_actor(audit(spark, sf), "u7").groupBy("action").agg(F.count("*").alias("n"))


@query(f"""WITH {AUDIT_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS pos, lag(ts) OVER (ORDER BY event_id) AS prev FROM audit), f AS (SELECT compensates AS c, min(event_id) FILTER (action = 'rollback') AS first FROM audit WHERE compensates IS NOT NULL GROUP BY 1),
x AS (SELECT (event_id <> pos)::INT + coalesce(ts < prev, false)::INT + (compensates IS NOT NULL AND compensates NOT IN (SELECT event_id FROM audit))::INT + (compensates IN (SELECT event_id FROM audit) AND coalesce(first <> event_id, true))::INT AS k FROM p LEFT JOIN f ON c = compensates)
SELECT sum(coalesce(k, 0)) = 0 AS ok, (SELECT count(*) FROM audit) AS n_events, (SELECT count(*) FROM audit WHERE action = 'rollback') AS n_rollbacks, CAST(sum(coalesce(k, 0)) AS BIGINT) AS n_problems FROM x""")
def audit_integrity(spark, sf):
    return governance.integrity_check(audit(spark, sf))


# Review.
_REVIEW = f"""{_ROLLUP}, q AS (SELECT component, min_score, abs(min_score - 0.9) AS u, row_number() OVER (ORDER BY abs(min_score - 0.9), component) - 1 AS item_id FROM clusters WHERE tier IN ('HIGH', 'UNKNOWN'))"""


def queue_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    records, c = clusters_of(spark, sf)
    return records, c, materialize(review.build_queue(c, 0.9, ("HIGH", "UNKNOWN")), "q-queue")


@query(f"{_REVIEW} SELECT item_id, component AS first_member, round(u, 9) AS uncertainty FROM q")
def review_queue(spark, sf):
    _, _, q = queue_of(spark, sf)
    return q.select("item_id", F.get("members", F.lit(0)).alias("first_member"), F.round("uncertainty", 9).alias("uncertainty"))


_SIM = f"""{_REVIEW}, m AS (SELECT item_id, component, node, gt_group FROM q JOIN comp USING (component) JOIN labels_ ON rid = node WHERE item_id < 25), c2 AS (SELECT item_id, gt_group, count(*) AS n FROM m GROUP BY ALL),
best AS (SELECT item_id, arg_min(gt_group, (-n, gt_group)) AS g, max(n) AS n FROM c2 GROUP BY item_id), tot AS (SELECT item_id, count(*) AS t FROM m GROUP BY item_id),
act AS (SELECT item_id, g, n, CASE WHEN n = t THEN 'approve' WHEN n < 2 THEN 'reject' ELSE 'edit' END AS action FROM best JOIN tot USING (item_id)),
lab AS (SELECT least(x.node, y.node) AS a, greatest(x.node, y.node) AS b, CASE action WHEN 'approve' THEN 1 WHEN 'reject' THEN 0 ELSE (x.gt_group = g AND y.gt_group = g)::INT END AS label
  FROM m x JOIN m y USING (item_id) JOIN act USING (item_id) WHERE x.node < y.node AND (action <> 'edit' OR x.gt_group = g OR y.gt_group = g))"""


@query(f"{_SIM} SELECT item_id, action FROM act")
def review_simulate(spark, sf):
    return review.simulate_reviews(queue_of(spark, sf)[2], material_labels(spark, sf)).select("item_id", "action")


@query(f"{_SIM} SELECT a, b, label FROM lab")
def review_labels(spark, sf):
    return review.decisions_to_labels(review.simulate_reviews(queue_of(spark, sf)[2], material_labels(spark, sf)))


@query(f"""{_SIM}, d AS (SELECT component, action, g FROM act JOIN q USING (item_id)), k AS (SELECT c.component, c.node, p_brand FROM comp c JOIN sized ON sized.rid = c.node JOIN labels_ ON labels_.rid = c.node LEFT JOIN d USING (component)
  WHERE action IS NULL OR action = 'approve' OR (action = 'edit' AND gt_group = g))
SELECT string_agg(node, ',' ORDER BY node) AS members, count(DISTINCT p_brand) > 1 AS is_cross_cpse, CASE WHEN any_value(d.action) IS NULL THEN any_value(clusters.tier) ELSE 'HIGH' END AS tier
FROM k JOIN clusters USING (component) LEFT JOIN d USING (component) GROUP BY k.component""")
def review_apply(spark, sf):
    records, c, q = queue_of(spark, sf)
    out = review.apply_decisions(c, review.simulate_reviews(q, material_labels(spark, sf)), records)
    return out.select(F.array_join("members", ",").alias("members"), "is_cross_cpse", "tier")


# Explanation.


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate duplicate pairs of the default scheme."""
    return block_candidate_pairs(spark, sf_dir)


from lodestone.plans import flow_queries, rule_queries  # noqa: E402, F401  (they add their queries here)
