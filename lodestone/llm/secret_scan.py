"""Secret scans: candidates by pattern, false positives removed by a random forest.

Everything on the main path is SQL. Candidates are long runs of key-like
characters with a digit or of a known make, values assigned to a name like
``password``, and private key blocks. Each place of a candidate becomes a struct of
features (length, shares and transitions of character classes, entropy,
dictionary coverage, path, neighbouring words), and the forest, trained from
labelled findings by MLlib in the JVM, is written out as one SQL expression: the
share of its trees that vote for a secret. A text is scored where it is read;
there is no shuffle, join or Python worker. No length is capped: a run of any
length is one candidate, a key block reaches to its end line whatever stands in it.

``scan`` gives one row for each distinct candidate of a text, ``redact`` replaces
the found secrets in the texts. Null and empty texts have no candidates and stay
as they are. Long texts are read whole. Repeated rows give repeated rows, an
empty table an empty table. A null path is an empty path. Other columns are kept
by ``redact`` and ignored by ``scan``.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "[SECRET]"

# Words of the dictionary, of secret names and of harmless names.
DICTIONARY = (
    "about access account admin after and article auth bearer before build byte cache change client code commit config content copy credential "
    "data date default demo digest document dummy example fake file for from hash hello here holder home host http image index info insert "
    "key level license list local login main master message name none null number object page param password path place placeholder port "
    "private project prod public redacted replace report sample secret server service session size some start string style table test text "
    "the this thread time title token type update upload user value version view web with word work www xxxx your"
).split()
SECRET_NAMES = "passw|passwd|pwd|secret|token|api.?key|access.?key|auth|credential|bearer|private"
HARMLESS_NAMES = "sha.?1|sha.?256|sha.?512|md5|crc|commit|checksum|digest|hash|uuid|guid|revision|etag|integrity|build|version|file|image|page|isbn|doi"
KNOWN_SHAPES = "^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_|^github_pat_|^xox[abprs]-|^sk[-_]|^AIza|^eyJ|^glpat-|^-----BEGIN"
COMMON_PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le"

#: Makes that are known by their first letters; these need no digit.
SHAPES = r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9+/_-])|gh[pousr]_|github_pat_|xox[abprs]-|sk[-_]|AIza|eyJ|glpat-"
PEM_NAME = r"[A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----"
PEM = rf"-----BEGIN {PEM_NAME}(?:[^-]++|-(?!----(?:BEGIN|END) {PEM_NAME}))*+-----END {PEM_NAME}"
LONG = PEM + r"|(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*+[0-9])|(?=" + SHAPES + r"))[A-Za-z0-9+/_-]{16,}={0,2}"
NAMED = r"(?i)(?:passw(?:or)?d|passwd|pwd|secret|token|(?:api|access|auth|private|secret)[_-]?key(?:[_-]?id)?)[\"']?\s*+[:=]\s*+[\"']?([^\s\"'=:,;]{6,})"

#: Feature name and SQL over ``v`` (candidate), ``pre`` and ``post`` (neighbours) and ``path``.
FEATURES = {
    "len": "cast(length(c.v) as double)",
    "digits": "regexp_count(c.v, '[0-9]') / length(c.v)",
    "uppers": "regexp_count(c.v, '[A-Z]') / length(c.v)",
    "lowers": "regexp_count(c.v, '[a-z]') / length(c.v)",
    "others": "regexp_count(c.v, '[^A-Za-z0-9]') / length(c.v)",
    "hex": "cast(c.v rlike '^[0-9a-f]+$' or c.v rlike '^[0-9A-F]+$' as double)",
    "moves": "regexp_count(c.v, '(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]') / length(c.v)",
    "pairs": f"regexp_count(lower(c.v), '{COMMON_PAIRS}') * 2 / length(c.v)",
    "entropy": "aggregate(array_distinct(split(c.v, '')), 0D, (e, x) -> e - "
    "((length(c.v) - length(replace(c.v, x, ''))) / length(c.v)) * "
    "log2((length(c.v) - length(replace(c.v, x, ''))) / length(c.v)))",
    "words": f"1 - length(regexp_replace(lower(c.v), '{'|'.join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))}', '')) / length(c.v)",
    "uuid": "cast(c.v rlike '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$' as double)",
    "shape": f"cast(c.v rlike '{KNOWN_SHAPES}' as double)",
    "slashes": "cast(regexp_count(c.v, '/') as double)",
    "assigned": "cast(c.pre rlike '[:=]\\\\s*[\\\"\\']?$' as double)",
    "secret_name": f"cast(lower(c.pre) rlike '({SECRET_NAMES})[^ ]{{0,20}}[ \\\"\\']*[:=]?[ \\\"\\']*$' as double)",
    "harmless_name": f"cast(lower(c.pre) rlike '({HARMLESS_NAMES})[^ ]{{0,20}}[ \\\"\\']*[:=]?[ \\\"\\']*$' as double)",
    "quoted": "cast(c.pre rlike '[\\\"\\']$' and c.post rlike '^[\\\"\\']' as double)",
    "address": "cast(c.pre rlike '[@/.]$' or c.post rlike '^[@.][A-Za-z0-9]' as double)",
    "test_path": "cast(lower(c.path) rlike 'test|example|sample|fixture|mock|doc' as double)",
}


def _featured(array: str) -> str:
    struct = ", ".join(f"'{n}', {e}" for n, e in FEATURES.items())
    return f"transform({array}, c -> named_struct('v', c.v, 'at', c.at, {struct}))"


def labelled_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """Labelled findings (v, pre, post, path, label), made from hashes of row numbers.

    True secrets of common makes in the ways they are written down, and the
    false positives that scanners report most: digests, commit and build ids,
    identifiers, placeholders, file names and addresses. ``rows`` bounds it.
    """
    hexa = "sha2(cast(id as string), 512)"
    b64 = "translate(base64(unhex(sha2(concat('b', id), 512))), '+/=', 'xYz')"
    b32 = f"translate({hexa}, '0123456789abcdef', 'ACDGHKMNQRTX2467')"
    w = "element_at(array('and', 'the', 'value', 'und', 'para', 'les', 'that', 'of', 'from', 'see', ''), cast(pmod(xxhash64(id, 1), 11) + 1 as int))"
    name = "element_at(array('token', 'password', 'secret', 'api_key', 'passwd', 'auth_token', 'access_key', 'client_secret', 'DB_PASSWORD', 'apikey'), cast(pmod(xxhash64(id, 2), 10) + 1 as int))"
    eq = "element_at(array('=', ' = ', ': ', ':', '=\"', ' = \"', ': \"', '=\\''), cast(pmod(xxhash64(id, 3), 8) + 1 as int))"
    given = f"concat({w}, ' ', {name}, {eq})"
    bare = f"concat({w}, ' ')"
    harmless = "element_at(array('commit ', 'sha256:', 'sha1 ', 'md5 = ', 'checksum: ', 'digest=', 'etag: \"', 'revision ', 'build ', 'integrity='), cast(pmod(xxhash64(id, 4), 10) + 1 as int))"
    n = "cast(pmod(xxhash64(id, 5), 24) as int)"
    made = [  # value, words before, is a secret
        (f"substring({hexa}, 1, 40)", given, 1),
        (f"substring({hexa}, 1, 16 + {n})", given, 1),
        (f"concat('AKIA', substring({b32}, 1, 16))", bare, 1),
        (f"concat('AKIA', substring({b32}, 1, 16))", given, 1),
        (f"substring({b64}, 1, 20 + {n})", given, 1),
        (f"concat('ghp_', substring({b64}, 1, 36))", bare, 1),
        (f"concat('xoxb-', substring({hexa}, 1, 12), '-', substring({b64}, 1, 24))", given, 1),
        (f"concat('sk_live_', substring({b64}, 1, 24))", bare, 1),
        (f"substring({b64}, 1, 8 + {n})", given, 1),
        (f"concat('eyJ', substring({b64}, 1, 60))", bare, 1),
        (f"concat('-----BEGIN RSA PRIVATE KEY-----', {b64}, '-----END RSA PRIVATE KEY-----')", bare, 1),
        (f"substring({hexa}, 1, 40)", harmless, 0),
        (f"substring({hexa}, 1, 64)", harmless, 0),
        (f"substring({hexa}, 1, 32)", bare, 0),
        (f"substring({hexa}, 1, 40)", bare, 0),
        (f"concat_ws('-', substring({hexa}, 1, 8), substring({hexa}, 9, 4), substring({hexa}, 13, 4), substring({hexa}, 17, 4), substring({hexa}, 21, 12))", bare, 0),
        (f"concat('your_', {name}, '_here_', pmod(id, 10))", given, 0),
        (f"concat('example-', {name}, '-', 1000 + pmod(id, 9000))", given, 0),
        ("element_at(array('changeme', 'placeholder', 'redacted', 'xxxxxxxxxxxx', '************', 'password', 'default', 'undefined'), cast(pmod(id, 8) + 1 as int))", given, 0),
        (f"concat('IMG_2020', lpad(pmod(id, 1200), 4, '0'), '_', pmod(xxhash64(id), 1000000))", bare, 0),
        (f"concat('some-long-article-title-about-', {name}, '-', pmod(id, 10000))", "'http://www.host.com/'", 0),
        (f"concat(2000 + pmod(id, 30), '/', 1 + pmod(id, 12), '/report-of-the-', {w}, '-data-file')", bare, 0),
        (f"cast(1000000000000000 + pmod(xxhash64(id), 1000000000000000) as string)", bare, 0),
        (f"concat(replace({name}, '_', '-'), '-service-version-', pmod(id, 100))", bare, 0),
    ]
    case = lambda i: "case " + " ".join(f"when pmod(id, {len(made)}) = {k} then {m[i]}" for k, m in enumerate(made)) + " end"
    quote = "case when right(pre, 1) = '\"' then '\"' when right(pre, 1) = '\\'' then '\\'' else ' ' end"
    path = "element_at(array('src', 'app/config.py', '', 'notes.txt', 'web'), cast(pmod(xxhash64(id, 6), 5) + 1 as int))"
    return (
        spark.range(0, rows, 1, 4)
        .selectExpr(f"{case(0)} as v", f"{case(1)} as pre", f"{path} as path", f"cast({case(2)} as double) as label")
        .selectExpr("v", "pre", f"concat({quote}, ' the') as post", "path", "label")
    )


def train(findings: DataFrame, trees: int = 16, depth: int = 6, seed: int = 11) -> RandomForestClassificationModel:
    """Fit the forest on labelled findings (v, pre, post, path, label)."""
    rows = findings.select("label", F.expr(_featured("array(named_struct('v', v, 'at', 0L, 'pre', pre, 'post', post, 'path', path))")).getItem(0).alias("f")).select("label", "f.*")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows).select("label", "x")
    return RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(vectors)


def forest_sql(model: RandomForestClassificationModel, row: str = "f") -> str:
    """The trained forest as SQL over a struct of features: share of the trees' votes."""
    names = list(FEATURES)

    def tree(lines: list[str]) -> str:
        line = lines.pop(0)
        if m := re.match(r"Predict: ([\d.]+)", line):
            return f"{m[1]}D"
        if not (m := re.match(r"If \(feature (\d+) (<=|>) ([-\d.E]+)\)", line)):
            raise ValueError(f"can't read the model: {line}")
        yes = tree(lines)
        if not lines.pop(0).startswith("Else"):
            raise ValueError("can't read the model: no else")
        return f"case when {row}.{names[int(m[1])]} {m[2]} {m[3]}D then {yes} else {tree(lines)} end"

    text = "\n".join(x.strip() for x in model.toDebugString.splitlines())
    parts = [p.splitlines()[1:] for p in re.split(r"(?m)^(?=Tree \d+ )", text)[1:]]
    return "(" + " + ".join(tree([x for x in p if x]) for p in parts) + f") / {len(parts)}"


_MODELS: dict[str, str] = {}


def default_forest(spark: SparkSession) -> str:
    """The forest fitted on ``labelled_findings``; fitted once a session."""
    key = spark.sparkContext.applicationId
    if key not in _MODELS:
        _MODELS[key] = forest_sql(train(labelled_findings(spark)))
    return _MODELS[key]


def with_findings(docs: DataFrame, text_col: str = "text", path_col: str | None = None, forest: str | None = None, at_least: float = 0.5, out: str = "findings") -> DataFrame:
    """Adds ``out`` (in place of a column of that name): array of (at, v, score, is_secret, starts) of the distinct candidates, in the order of their first places.

    Every place is scored with its own neighbours; the highest score is the candidate's.
    """
    forest = forest or default_forest(docs.sparkSession)
    own = {c: f"d{i}" for i, c in enumerate(docs.columns)}  # so that no column of the caller's meets ours
    t, path = f"cast({own[text_col]} as string)", f"coalesce(cast({own[path_col]} as string), '')" if path_col else "''"
    quoted = lambda p: "r'" + p.replace("'", "\\x27") + "'"

    def places(pattern: str, group: str) -> str:
        """Every match as (v, at): what stands between the matches tells where they are."""
        gaps, whole, values = f"split({t}, {quoted(pattern)}, -1)", f"regexp_extract_all({t}, {quoted(pattern)}, 0)", f"regexp_extract_all({t}, {quoted(pattern)}, {group})"
        ends = "named_struct('v', x.`1`, 'w', length(x.`0`), 'g', length(x.`2`))"
        step = "named_struct('at', s.at + x.g + x.w, 'l', concat(s.l, array(named_struct('v', x.v, 'at', s.at + x.g + x.w - length(x.v) + 1))))"
        rows = f"transform(arrays_zip({whole}, {values}, {gaps}), x -> {ends})"
        none = "named_struct('at', 0, 'l', cast(array() as array<struct<v: string, at: int>>))"
        return f"case when {t} rlike {quoted(pattern)} then aggregate(filter({rows}, x -> x.v is not null), {none}, (s, x) -> {step}).l else cast(array() as array<struct<v: string, at: int>>) end"

    values = f"array_distinct(concat({places(LONG, '0')}, {places(NAMED, '1')}))"
    around = (
        f"transform(_values, p -> named_struct('v', p.v, 'at', cast(p.at as bigint), "
        f"'pre', substring({t}, greatest(p.at - 48, 1), least(48, p.at - 1)), 'post', substring({t}, p.at + length(p.v), 24), 'path', {path}))"
    )
    scored = f"transform({_featured('_around')}, f -> named_struct('v', f.v, 'at', f.at, 'score', {forest}))"
    # the places of each value: the highest score of them counts
    each = "transform(array_distinct(transform(_scored, s -> s.v)), v -> named_struct('v', v, 'p', filter(_scored, s -> s.v = v)))"
    summed = f"transform({each}, e -> named_struct('v', e.v, 'starts', array_sort(transform(e.p, s -> s.at)), 'score', array_max(transform(e.p, s -> s.score))))"
    told = f"array_sort(transform({summed}, s -> named_struct('at', s.starts[0], 'v', s.v, 'score', s.score, 'is_secret', s.score >= {at_least}D, 'starts', s.starts)))"
    kept = [F.col(n).alias(c) for c, n in own.items() if c != out]
    return (
        docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
        .withColumn("_values", F.expr(values))
        .withColumn("_around", F.when(F.size("_values") > 0, F.expr(around)))
        .withColumn("_scored", F.when(F.size("_values") > 0, F.expr(scored)))
        .select(*kept, F.when(F.size("_values") > 0, F.expr(told)).alias(out))
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", forest: str | None = None, at_least: float = 0.5) -> DataFrame:
    """One row for each distinct candidate of a text: id, start (from 1), n_chars, value_sha256, score, is_secret, starts (all places)."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), (F.col(path_col).cast("string") if path_col else F.lit("")).alias("_path"))
    found = with_findings(slim, "_text", "_path", forest, at_least).select("_id", F.explode("findings").alias("f"))
    return found.select(
        F.col("_id").alias(id_col),
        F.col("f.at").alias("start"),
        F.length("f.v").cast("long").alias("n_chars"),
        F.sha2(F.col("f.v"), 256).alias("value_sha256"),
        F.col("f.score").alias("score"),
        F.col("f.is_secret").alias("is_secret"),
        F.col("f.starts").alias("starts"),
    )


def redact(docs: DataFrame, text_col: str = "text", path_col: str | None = None, forest: str | None = None, at_least: float = 0.5) -> DataFrame:
    """The same rows and columns, every found secret in the texts replaced by a mark."""
    name = next(f"_findings{i}" for i in range(len(docs.columns) + 1) if f"_findings{i}" not in docs.columns)
    found = with_findings(docs, text_col, path_col, forest, at_least, name)
    # longer secrets first: one may hold another
    secrets = f"array_sort(transform(filter({name}, f -> f.is_secret), f -> f.v), (a, b) -> length(b) - length(a))"
    clean = f"case when exists({name}, f -> f.is_secret) then aggregate({secrets}, cast(`{text_col}` as string), (t, s) -> replace(t, s, '{MARK}')) else cast(`{text_col}` as string) end"
    return found.withColumn(text_col, F.expr(clean)).select(*[F.col(f"`{c}`") for c in docs.columns])
