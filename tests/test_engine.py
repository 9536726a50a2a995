"""Matching, thresholds, registry, audit, review, explanation and mapping on small cases."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone import settings as S
from lodestone.operators import blocking, classify, explain, governance, matching, profile, registry, review, scoring, semantic
from lodestone.operators.graph import connected_components
from lodestone.plans import pipeline
from lodestone.sources import uploads


def brute_components(edges):
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    return {x: find(x) for x in top}


def test_components_random(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (500, 500)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame([*edges, *edges[:5]], "a long, b long")).collect()}
    assert got == brute_components(edges)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(
    "edges, floor, parts",
    [
        ([(0, 1, 0.99), (1, 2, 0.30), (2, 3, 0.99)], 0.80, [[0, 1], [2, 3]]),
        ([(0, 1, 0.95), (1, 2, 0.94), (0, 2, 0.96)], 0.80, [[0, 1, 2]]),
        ([(0, 1, 0.9), (1, 2, 0.1), (0, 2, 0.1), (2, 3, 0.9)], 0.8, [[0, 1], [2, 3]]),
    ],
)
def test_split(edges, floor, parts):
    assert matching.split_component(pd.DataFrame(edges, columns=["a", "b", "w"]), floor) == parts


RECORDS = "rid long, CPSE string, `CPSE Material Code` string, Legacy_Sector_Code string, Sector string, `Material Category` string, `Raw Description` string, n_known_attributes int"


def records(spark, n=4, known=5):
    return spark.createDataFrame([(i, f"O{i % 2}", f"C{i}", "L", "Oil & Gas", "Ball Valve", f"VALVE {'X' * i}", known) for i in range(n)], RECORDS)


@pytest.mark.parametrize("score, known, tier", [(0.95, 3, "HIGH"), (0.70, 3, "MEDIUM"), (0.20, 3, "LOW"), (0.85, 2, "HIGH"), (0.55, 2, "MEDIUM"), (1.0, 1, "UNKNOWN")])
def test_tiers(spark, score, known, tier):
    edges = spark.createDataFrame([(0, 1, score)], "a long, b long, w double")
    c, _ = matching.cluster(edges, records(spark, 2, known))
    assert matching.assign_tiers(c, 0.85, 0.55).first().tier == tier


def test_cluster_splits_and_evaluates(spark):
    edges = spark.createDataFrame([(0, 1, 0.99), (1, 2, 0.30), (2, 3, 0.99)], "a long, b long, w double")
    c, n_split = matching.cluster(edges, records(spark), 0.8)
    c = matching.assign_tiers(c, 0.85, 0.55)
    assert n_split == 1 and sorted(r.members for r in c.collect()) == [[0, 1], [2, 3]]
    truth = spark.createDataFrame([(0, 1), (0, 2)], "a long, b long")
    m = {r.scope: r for r in matching.evaluate(c, truth, records(spark)).collect()}
    assert (m["overall"].true_positives, m["overall"].predicted, m["overall"].actual) == (1, 2, 2)
    assert m["overall"].precision == 0.5 and m["within_cpse"].predicted == 0
    with pytest.raises(KeyError):
        matching.build_graph(truth, 0.5)


def test_blocks_are_cut_and_lose_pairs(spark):
    df = spark.createDataFrame([(i, "valve", 100.0) for i in range(7)], "rid long, `Material Category` string, nominal_size_mm double")
    pairs = blocking.candidate_pairs(blocking.build_blocks(df, ["category_size"]), 3, ["category_size"])
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5)]
    odd = spark.createDataFrame([(0, None, None), (1, "Pipe pipe spares", 30.0)], "rid long, `Material Category` string, nominal_size_mm double")
    assert sorted((r.family, r.key) for r in blocking.build_blocks(odd).collect()) == [("category_size", "cat::nan|sz::na"), ("category_size", "cat::pipe pipe spares|sz::1"), ("category_token", "tok::nan|sz::na"), ("category_token", "tok::pipe|sz::1")]
    none = df.limit(0)
    stats = blocking.block_stats(none, blocking.build_blocks(none), blocking.candidate_pairs(blocking.build_blocks(none))).first()
    assert stats.reduction_factor == float("inf") and stats.largest_block == 0


def test_flags_and_fusion(spark):
    base = dict.fromkeys(S.ATTRIBUTES)
    rows = [(0, {"schedule": "20", "head_m": 20.0}), (1, {"schedule": "40", "head_m": 20.0}), (2, {}), (3, {"head_m": float("nan"), "grade": " "})]
    kinds = ", ".join(f"{n} {'double' if n in S.NUMERIC else 'string'}" for n in S.ATTRIBUTES)
    df = spark.createDataFrame([(i, "c", "o", *[{**base, **a}[n] for n in S.ATTRIBUTES]) for i, a in rows], f"rid long, `Material Category` string, CPSE string, {kinds}")
    got = {(r.a, r.b): r for r in scoring.score_attributes(df, spark.createDataFrame([(0, 1), (2, 3)], "a long, b long")).collect()}
    assert got[0, 1].hard_conflict and got[0, 1].attribute == 0.5 and got[0, 1].flags["head_m"] == "agree"
    assert got[2, 3].attribute == 0.5 and got[2, 3].n_comparable_attrs == 0 and set(got[2, 3].flags.values()) == {"unknown"}
    fuse = lambda *a: spark.range(1).select(scoring.fuse(*[F.lit(x) for x in a])).first()[0]
    assert fuse(1.0, 1.0, 1.0, False, 0) == pytest.approx(1) and fuse(1.0, 1.0, 1.0, True, 1) == pytest.approx(0.7) and fuse(1.0, 1.0, 1.0, False, 1) == pytest.approx(0.85)
    assert fuse(0.0, 0.0, 0.0, True, 1) == 0


def test_thresholds(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "label int, p double")
    t, f1 = classify.tune_threshold(df)
    assert f1 == 1 and 0.2 < t <= 0.8
    assert classify.tune_threshold(df.withColumn("label", F.lit(0))) == (0.5, 0.0)
    tiers = classify.calibrate_tiers(df)
    assert tiers.high >= tiers.medium and tiers.achieved_high_precision == 1
    assert classify.average_precision(df).first()[0] == 1
    sweep = pd.DataFrame({"threshold": [0.1, 0.5, 0.9], "precision": [0.995, 0.6, 0.7], "recall": [1.0, 0.5, 0.1]})
    assert classify.tiers_from_sweep(sweep, 0.5).high == 0.1  # the most precise, whatever the edge threshold
    assert classify.is_backend_mismatch("a", "b") and not classify.is_backend_mismatch(None, "b")


def test_train_and_save(spark, tmp_path):
    rng = np.random.default_rng(0)
    n = 120
    groups = [f"g{i // 3}" for i in range(n)]
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "rid long, gt_group string")
    rows = []
    for a in range(n):
        for b in range(a + 1, min(n, a + 6)):
            same = groups[a] == groups[b]
            s = float(np.clip(rng.normal(0.85 if same else 0.3, 0.08), 0, 1))
            rows.append((a, b, s, s, s, 3, 3 if same else 1, 0 if same else 1, False, 3, True, a % 2 != b % 2, "tfidf_svd"))
    cols = "a long, b long, semantic double, string double, attribute double, n_comparable_attrs int, n_agree_attrs int, n_conflicts int, hard_conflict boolean, min_known_attrs int, same_category boolean, cross_cpse boolean, semantic_backend string"
    scored = spark.createDataFrame(rows, cols)
    for name, kw in (("logistic_regression", {}), ("gradient_boosting", {"iterations": 3})):
        model, report = classify.train(scored, labels, name, **kw)
        assert report.n_train_pairs + report.n_val_pairs + report.n_test_pairs + report.n_discarded_pairs == len(rows)
        assert len(report.summary_lines()) > 5 and 0 <= report.f1 <= 1
    classify.save_model(model, str(tmp_path / "m"), "tfidf_svd")
    assert classify.load_model_backend(str(tmp_path / "m")) == "tfidf_svd"
    assert classify.load_model_or_none(str(tmp_path / "m")) is not None and classify.load_model_or_none(str(tmp_path / "none")) is None
    with pytest.raises(ValueError):
        classify.train(scored, labels, "nothing")


def test_semantic_encoder(spark):
    texts = spark.createDataFrame([(0, "ball valve"), (1, "ball valve"), (2, "gate valve"), (3, None), (4, "copper cable long")], "id long, text string")
    v = semantic.SemanticEncoder().encode(texts)
    pairs = spark.createDataFrame([(0, 1), (0, 4), (0, 3)], "a long, b long")
    got = {(r.a, r.b): r.semantic for r in semantic.semantic_similarity(pairs, v).collect()}
    assert got[0, 1] == pytest.approx(1) and got[0, 4] < 0.2 and got[0, 3] == 0
    with pytest.raises(ValueError):
        semantic.SemanticEncoder("other")


def test_short_codes(spark):
    df = spark.createDataFrame([("Seamless Pipe",), ("Ball Valve",), ("Bearing",), ("",), (None,), ("Ox",), ("a b c d",)], "c string")
    assert [r[0] for r in df.select(registry.category_short_code(F.col("c"))).collect()] == ["SEP", "BAV", "BEA", "GEN", "GEN", "OXX", "ABC"]


def test_registry(spark, tmp_path):
    recs = records(spark, 6)
    clusters = spark.createDataFrame([(0, [0, 1, 2], "HIGH"), (1, [3, 4], "HIGH")], "cluster_id long, members array<long>, tier string")
    reg = registry.Registry.empty(spark).assign(clusters, recs)
    codes = [r.cnmc for r in reg.entries.orderBy("cnmc").collect()]
    assert codes == ["NM-OG-BAV-00001", "NM-OG-BAV-00002"]
    assert reg.entries.orderBy("cnmc").first().canonical_description == "VALVE XX"
    s = reg.stats().first()
    assert (s.codes_issued, s.records_mapped, s.codes_eliminated) == (2, 5, 3)
    with pytest.raises(ValueError):
        reg.assign(clusters.limit(1), recs)
    merged = reg.merge(*codes)
    assert merged.lookup(codes[0]).count() == 5 and merged.resolve(codes[1]) == codes[0] and merged.reverse_lookup("O1", "C3") == codes[0]
    for bad in (lambda: reg.merge(codes[0], codes[0]), lambda: reg.split(codes[0], [[0, 1]], recs)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        reg.merge(codes[0], "nothing")
    parted = reg.split(codes[0], [[0], [1, 2]], recs)
    assert parted.resolve(codes[0]) is None and parted.stats().first().active_codes == 3
    assert parted.reverse_lookup("O0", "C0") == "NM-OG-BAV-00003"
    merged.export_mapping(str(tmp_path / "map"))
    back = registry.import_mapping(spark, str(tmp_path / "map"), recs)
    assert back.next_sequence() == 3 and back.members.where("rid = -1").count() == 0 and back.resolve(codes[1]) == codes[0]


def test_audit(spark, tmp_path):
    log = governance.AuditLog(spark, str(tmp_path / "log"))
    assert log.record("create", "ann", "NM-1", after={"v": 1}) == 0
    assert log.record("update", " bo ", "NM-1", before={"v": 1}, after={"v": 2}) == 1
    assert log.record("create", "ann", "NM-2", after={"v": 9}, reason={"verdict": "fine"}) == 2
    assert log.rollback(1, "ann") == 3
    e = log.events()
    state = {r.target: r.state for r in governance.version_at(e, dt.datetime(2100, 1, 1)).collect()}
    assert state == {"NM-1": '{"v": 1}', "NM-2": '{"v": 9}'}
    assert [r.event_id for r in governance.effective_events(e).orderBy("event_id").collect()] == [0, 2]
    assert governance.integrity_check(e).first().ok
    assert governance.to_frame(e).first().event_id == 3 and governance.history(e, "NM-1").count() == 3
    for bad, kind in ((1, ValueError), (3, ValueError), (99, IndexError)):
        with pytest.raises(kind):
            log.rollback(bad, "ann")
    for args in (("nothing", "ann", "x"), ("create", "  ", "x")):
        with pytest.raises(ValueError):
            log.record(*args)
    broken = e.withColumn("event_id", F.when(F.col("event_id") == 2, F.lit(7)).otherwise(F.col("event_id")))
    assert governance.integrity_check(broken).first().n_problems >= 1
    assert governance.version_at(e.limit(0), dt.datetime(2100, 1, 1)).count() == 0


def test_audit_ties_and_create_rollback(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [governance.new_event(0, "create", "a", "N", after={"v": 1}, ts=t), governance.new_event(1, "update", "a", "N", before={"v": 1}, after={"v": 2}, ts=t), governance.new_event(2, "create", "a", "M", after={"v": 3}, ts=t), governance.new_event(3, "rollback", "a", "M", before={"v": 3}, after={}, compensates=2, ts=t)]
    log = spark.createDataFrame(rows, governance.SCHEMA)
    assert governance.version_at(log, t, 0).first().state == '{"v": 1}'
    assert {r.target: r.state for r in governance.version_at(log, t).collect()} == {"N": '{"v": 2}', "M": "{}"}


CLUSTER = "cluster_id long, members array<long>, tier string, min_score double, mean_score double, cpses array<string>, is_cross_cpse boolean, min_known_attrs int, edges array<struct<a:long,b:long,w:double>>, size int, tier_reason string"


def clusters(spark):
    made = lambda i, m, s: (i, m, "MEDIUM", s, s, ["O0", "O1"], True, 2, [(a, b, s) for a in m for b in m if a < b], len(m), "")
    return spark.createDataFrame([made(0, [1, 2], 0.95), made(1, [3, 4], 0.61), made(7, [0, 1, 2], 0.80)], CLUSTER)


def test_review(spark, tmp_path):
    q = review.build_queue(clusters(spark), 0.60)
    assert [r.cluster_id for r in q.orderBy("item_id").collect()] == [1, 7, 0] and review.build_queue(clusters(spark), 0.6, limit=0).count() == 3 and review.build_queue(clusters(spark), 0.6, limit=1).count() == 1
    item = q.where("cluster_id = 7").first()
    rows = [review.decision(0, item, "approve", "ann"), review.decision(1, item, "edit", "ann", corrected=[1, 2])]
    review.append_decisions(spark, rows, str(tmp_path / "d"))
    d = review.load_decisions(spark, str(tmp_path / "d"))
    assert {(r.a, r.b): r.label for r in review.decisions_to_labels(d).collect()} == {(0, 1): 0, (0, 2): 0, (1, 2): 1}
    out = {r.cluster_id: r for r in review.apply_decisions(clusters(spark), d, records(spark)).collect()}
    assert out[7].members == [1, 2] and out[7].tier == "HIGH" and len(out[7].edges) == 1 and out[0].tier == "MEDIUM"
    gone = spark.createDataFrame([review.decision(0, item, "reject", "ann"), review.decision(1, q.where("cluster_id = 1").first(), "edit", "ann", corrected=[3])], review.SCHEMA)
    assert [r.cluster_id for r in review.apply_decisions(clusters(spark), gone).collect()] == [0]
    for bad in (("other", "ann", None), ("approve", " ", None), ("edit", "ann", None)):
        with pytest.raises(ValueError):
            review.decision(0, item, bad[0], bad[1], corrected=bad[2])
    assert review.load_decisions(spark, str(tmp_path / "none")).count() == 0
    scored = spark.createDataFrame([(1, 2, 0.9)], "a long, b long, match_probability double")
    assert review.recalibrate_threshold(scored, d, 0.6) == 0.6
    assert review.measure_improvement({"f1": 0.5}, {"f1": 0.7}, 1, 2, 0.5, 0.6)["delta_f1"] == pytest.approx(0.2)


@pytest.mark.parametrize("value, text", [(40.0, "40 mm"), (0.5, "0.5 mm"), (None, "not stated"), (float("nan"), "not stated"), (1234567.0, "1.23457e+06 mm"), (12.345678, "12.3457 mm")])
def test_values(spark, value, text):
    assert spark.range(1).select(explain.format_value("nominal_size_mm", F.lit(value).cast("double"))).first()[0] == text


def test_explanations(spark):
    c = clusters(spark).where("cluster_id = 7").withColumn("tier", F.lit("UNKNOWN"))
    r = explain.explain_clusters(c, records(spark)).first()
    text = explain.explain_clusters(c, records(spark)).select(explain.render(F.col("verdict"), F.col("score"), F.col("subject"), F.col("lines"), F.col("caveats"))).first()[0]
    assert text.startswith("Match: UNKNOWN confidence (score 0.80) - cluster 7\n  = 3 records") and "  + Cross-CPSE" in text and r.caveats == [explain.THIN]
    assert [x.weight for x in r.lines] == sorted((x.weight for x in r.lines), reverse=True)
    assert '"score":0.8' in explain.as_json(explain.explain_clusters(c, records(spark))).first().json
    assert explain.label_for("some_new_field") == "Some new field"


def test_mapping(spark):
    n = 36
    rows = [(f"Plant {'AB'[i % 2]}", f"MAT-{i:04d}", ["Valves", "Pipes", "Cables"][i % 3], f"LONG DESCRIPTION OF THE ITEM NUMBER {i}", "NOS") for i in range(n)]
    df = spark.createDataFrame(rows, "`Owner Org` string, `Part No` string, `Item Class` string, `Long Text` string, UoM string")
    assert {f: uploads.infer_mapping(df)[f] for f in S.REQUIRED_COLUMNS} == {S.OWNER: "Owner Org", S.CODE: "Part No", S.CATEGORY: "Item Class", S.RAW: "Long Text"}
    opaque = df.toDF("F1", "F2", "F3", "F4", "F5")
    assert {f: uploads.infer_mapping(opaque)[f] for f in S.REQUIRED_COLUMNS} == {S.OWNER: "F1", S.CODE: "F2", S.CATEGORY: "F3", S.RAW: "F4"}
    trap = spark.createDataFrame([("NOS", "Plant A"), ("MTR", "Plant B"), ("NOS", "Plant A"), ("SET", "Plant B")], "Unit string, Plant string")
    assert uploads.infer_mapping(trap)[S.OWNER] == "Plant"
    real = uploads.match_headers(["Enterprise", "Part Number", "Item Category", "Item Description", "Material Grade", "Size", "Standard", "Rating", "Unit"], {"Unit"})
    assert (real[S.OWNER], real["Dimensions"], real["Capacity/Rating"], real["Sector"]) == ("Enterprise", "Size", "Rating", None)
    assert uploads.duplicate_sources({S.CATEGORY: "d", S.RAW: "d", "Dimensions": "d"}) == {"d": [S.CATEGORY, S.RAW]}
    for bad in ({}, dict.fromkeys(S.REQUIRED_COLUMNS, "F1")):
        with pytest.raises(ValueError):
            uploads.apply_mapping(opaque, bad)
    out = uploads.apply_mapping(opaque, {S.OWNER: "F1", S.CODE: "F2", S.CATEGORY: "F3", S.RAW: "F4"}, "F2")
    assert out.count() == n and out.where("rid = 5").first()[S.CODE] == "MAT-0005" and out.first()[S.UOM] == ""
    assert uploads.suggest_mapping([" cpse ", "Raw  description"])[S.RAW] == "Raw  description"
    hint = lambda vals: uploads.column_hint(spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "rid int, c string"), "c").first()[0]
    assert hint(["only", "two", "only"]) == "only, two" and hint(["a", "b", "c", "d"]) == "a, b, c..." and hint(["nan", " "]) == "" and len(hint(["x" * 80])) <= 25
    line = uploads.preview_row(opaque.withColumn("rid", F.col("F2")), {S.OWNER: "F1", S.CODE: "F2"}, 99)
    assert line.startswith("Company: Plant B | Code: MAT-0035 | Category: (unmapped)") and uploads.preview_row(opaque.limit(0), {}) == ""


def test_uploads(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    spark.createDataFrame([("a", "b")], "x string, y string").coalesce(1).write.option("header", True).csv(path)
    assert uploads.read_upload(spark, path).columns == ["x", "y"]
    with pytest.raises(uploads.UnsupportedFileType):
        uploads.read_upload(spark, "x.doc")
    assert uploads.read_lookup(spark, None).columns == ["Sector", "CPSE"]
    labelled = spark.createDataFrame([(0, "r", "G")], "rid long, `Raw Description` string, GroundTruth_Group string")
    recs, labels = uploads.split_labels(labelled)
    assert S.LABEL not in recs.columns and labels.first().gt_group == "G"
    with pytest.raises(AssertionError):
        uploads.assert_no_leakage(labelled)


def test_profile(spark):
    assert profile.estimate_runtime_seconds(5008) == 80 and profile.estimate_runtime_seconds(10016) > 152
    df = records(spark, 6)
    assert profile.sample(df, 2).select("rid").collect() == [(0,), (1,)] and profile.sample(df, 99) is df and profile.sample(df, 0).count() == 1
    assert profile.sample(df, 3, 1).collect() == profile.sample(df, 3, 1).collect()
    assert not profile.is_large(df, 10) and profile.is_large(df, 3)


def test_pipeline_end_to_end(spark):
    rows = [(i, f"O{i % 2}", f"C{i}", "", "Power", "Gate Valve", f"GATE VALVE {50 + 50 * (i // 2)} MM CLASS 150 CS GR.B" + ("" if i % 2 else " FLANGED")) for i in range(12)]
    recs = spark.createDataFrame(rows, "rid long, CPSE string, `CPSE Material Code` string, Legacy_Sector_Code string, Sector string, `Material Category` string, `Raw Description` string")
    run = pipeline.run(recs)
    got = sorted(tuple(r.members) for r in run.clusters.collect())
    assert (0, 1) in got and run.counts["n_records"] == 12
    labels = spark.createDataFrame([(i, f"g{i // 2}") for i in range(12)], "rid long, gt_group string")
    assert pipeline.run(recs, labels, model_name="logistic_regression").report is not None


def test_streamed_audit(spark, tmp_path):
    from lodestone.streaming import audit

    log = governance.AuditLog(spark, str(tmp_path / "log"))
    for i in range(3):
        log.record("update", "ann", f"N{i % 2}", after={"v": i})
    q = audit.latest_state(audit.read_log(spark, str(tmp_path / "log"))).writeStream.outputMode("complete").format("memory").queryName("state").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.target: r.state for r in spark.table("state").collect()} == {"N0": '{"v": 2}', "N1": '{"v": 1}'}
