"""Normalization, attributes and string similarity on known cases."""

import pytest
from pyspark.sql import functions as F

from lodestone import settings as S
from lodestone.functions import attributes, normalize, strings


def norm(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.n for r in df.select("i", normalize.normalize(F.col("t")).alias("n")).orderBy("i").collect()]


def test_golden_and_empty(spark):
    got = norm(spark, ["BFLY V/V LUG 300 NB CL-150", None, "", "   ", " BRG  25MM "])
    assert got == ["butterfly valve lug 300 nominal bore class 150", "", "", "", "bearing 25 mm"]


def test_first_pass(spark):
    df = spark.createDataFrame([("  PIPE   CS  40NB ",), ("A333 GR.6",)], "t string")
    assert [r[0] for r in df.select(normalize.fold_case_and_punctuation(F.col("t"))).collect()] == ["pipe cs 40nb", "a333 gr 6"]


@pytest.mark.parametrize("raw, token", [("20 mtr head", "m"), ("50M3/HR", "cumperhr"), ("SCH40", "schedule"), ("M.S. PLATE", "mild"), ("50 SQ.MM", "sqmm"), ("STUD C/W NUTS", "complete"), ("10 in pipe", "inch")])
def test_tokens(spark, raw, token):
    assert token in norm(spark, [raw])[0].split()


def test_token_sets_and_idempotence(spark):
    a, b = norm(spark, ["BRG DEEP GROOVE BALL BORE 25 MM", "DEEP GROOVE BALL BEARING 25MM BORE"])
    assert set(a.split()) == set(b.split())
    texts = ["BFLY V/V LUG 300 NB CL-150", "AL. XLPE CABLE 1.1 KV, 1C CORE, 50 SQ.MM", "63KVA trfr 11/0.433 kv"]
    once = norm(spark, texts)
    assert norm(spark, once) == once


def test_trace(spark):
    df = spark.createDataFrame([("PIPE CS",), ("pipe",)], "t string")
    got = [r[0] for r in df.select(normalize.changed_passes(normalize.normalize_traced(F.col("t")))).collect()]
    assert got == [["case_punctuation", "abbreviations"], []]


def extract(spark, text, **cols):
    names = {"dims": "Dimensions", "grade": "Material/Grade", "spec": "Specification/Standard", "cap": "Capacity/Rating"}
    df = spark.createDataFrame([(text, *cols.values())], ", ".join([f"`{S.RAW}` string", *[f"`{names[k]}` string" for k in cols]]))
    return attributes.with_attributes(df).first()


@pytest.mark.parametrize(
    "text, name, value",
    [
        ("PIPE CS 40NB SCH 20 A106-B", "nominal_size_mm", 40.0), ("PIPE CS 40NB SCH 20", "schedule", "20"), ("PIPE CS 40NB", "material_of_construction", "carbon steel"),
        ("BFLY V/V LUG 300 NB CL-150", "pressure_class", "150"), ("FLOW 50 M3/HR HEAD 100M", "flow_m3hr", 50.0), ("FLOW 50 M3/HR HEAD 100M", "head_m", 100.0),
        ("TRF 63KVA", "rating_kva", 63.0), ("GEAR RATIO 15:1", "ratio", "15:1"), ("TRF 11/0.433 KV", "voltage_kv", 11.0), ("PIPE 2 INCH", "nominal_size_mm", 50.0),
        ("PIPE 7 INCH", "nominal_size_mm", None), ("BELT 4 PLY", "ply", 4.0), ("GATE VALVE 100MM CLASS 150", "nominal_size_mm", 100.0), ("PLATE 6 MM THICKNESS", "nominal_size_mm", None),
        ("BELT 800 MM WIDTH", "nominal_size_mm", None), ("PLATE 3000 X 1500 MM", "nominal_size_mm", None), ("thickness 6 mm 40 mm", "nominal_size_mm", 40.0), ("BOLT GR.B7", "grade", "b"),
    ],
)
def test_attributes(spark, text, name, value):
    got = extract(spark, text)[name]
    assert got == value or (name == "grade" and got in ("b", "b7"))


def test_columns_win_and_tell(spark):
    r = extract(spark, "PIPE 40NB GRADE B", dims="50 NB SCH 40", grade="B", spec=" ", cap=None)
    assert (r.nominal_size_mm, r.schedule, r.grade, r.spec_standard) == (50.0, "40", "b", None)
    p = r.attr_provenance
    assert (p["nominal_size_mm"], p["schedule"], p["grade"], p["ratio"]) == ("conflict", "column", "both", "unknown")
    assert extract(spark, "VALVE 100MM").attr_provenance["nominal_size_mm"] == "regex_weak"
    assert extract(spark, None).n_known_attributes == 0


@pytest.mark.parametrize("a, b, ok", [(40.0, 40.5, True), (40.0, 50.0, False), (0.0, 5.0, False), (0.0, 0.0, True)])
def test_numbers_agree(spark, a, b, ok):
    assert spark.range(1).select(attributes.values_agree(F.lit(a), F.lit(b), True)).first()[0] is ok


@pytest.mark.parametrize("a, b, ok", [("astm a106", "astm a106 grade b", True), ("astm a106", "astm a333", False)])
def test_texts_agree(spark, a, b, ok):
    assert spark.range(1).select(attributes.values_agree(F.lit(a), F.lit(b), False)).first()[0] is ok


def test_strings():
    assert strings.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611111)
    assert strings.token_set_ratio("fuzzy was a bear but not a dog", "fuzzy was a bear but not a cat") == pytest.approx(92.3077, abs=1e-3)
    assert strings.token_set_ratio("a b", "b a c") == 100 and strings.token_set_ratio("", "a") == 0
    assert strings.string_similarity("", "x") == 0 and strings.string_similarity("abc", "abc") == 1
    assert strings.string_similarity("deep groove ball bearing", "ball bearing deep groove") > 0.75
    for a, b in (("abcde", "badce"), ("", "a"), ("xyz", "abc")):
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
        assert strings.common_subsequence(a, b) == n[-1][-1]
