"""Ranks, sweeps, reversals, exports and models that are bare."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone import settings as S
from lodestone.operators import classify, governance, matching, profile, registry
from lodestone.operators.order import with_rank
from lodestone.sources import uploads


def test_ranks_equal_sorting(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, 1.5, 2.5, rnd.random()]), rnd.choice("abc")) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, x double, s string").repartition(7)
    got = {r.i: r.place for r in with_rank(df, [F.desc_nulls_last("x"), "s", "i"], "place").collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2], r[0]))
    assert [got[r[0]] for r in want] == list(range(500))
    assert with_rank(df.limit(0), ["i"]).count() == 0


def test_sweep_equals_one_graph_at_a_time(spark):
    rnd = random.Random(5)
    rows = [(a, b, rnd.random()) for a in range(60) for b in range(a + 1, 60) if rnd.random() < 0.06]
    df = spark.createDataFrame(rows, "a long, b long, p double")
    at = [0.1, 0.4, 0.45, 0.8, 0.999999]
    got = {}
    for r in matching.members_at(df, "p", at).collect():
        got.setdefault(r.k, {})[r.rid] = r.part
    for k, t in enumerate(at):
        top = {}

        def find(x, top=top):
            while top.setdefault(x, x) != x:
                x = top[x]
            return x

        for a, b, w in rows:
            if w >= t:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
        assert got.get(k, {}) == {x: find(x) for x in list(top)}


def test_batch_of_reversals(spark, tmp_path):
    log = governance.AuditLog(spark, str(tmp_path / "log"))
    for i in range(4):
        log.record("update", "ana", f"t{i}", before={"n": i}, after={"n": i + 1})
    assert log.rollback_all([3, 1], "bo", "why") == [4, 5]
    events = {r.event_id: r for r in log.events().collect()}
    assert (events[4].compensates, events[5].compensates, events[4].before, events[4].after, events[4].reason) == (3, 1, '{"n": 4}', '{"n": 3}', "why")
    for asked, error in (([0, 3], ValueError), ([0, 99], IndexError), ([0, 4], ValueError), ([0, 0], ValueError)):
        with pytest.raises(error):
            log.rollback_all(asked, "bo")
    assert log.events().count() == 6  # a batch that is refused writes nothing
    other = governance.AuditLog(spark, str(tmp_path / "log"))
    assert other.record("create", "ana", "t9") == 6


def test_split_of_a_merged_code(spark):
    cols = ["Sector", S.OWNER, S.CODE, S.LEGACY, S.CATEGORY, S.RAW]
    rows = [(i, "Power", f"O{i % 2}", f"c{i}", "L", "Ball Valve", f"text {i} ") for i in range(4)]
    records = spark.createDataFrame(rows, ["rid", *cols])
    clusters = spark.createDataFrame([(0, [0, 1], "HIGH"), (1, [2, 3], "HIGH")], "cluster_id long, members array<long>, tier string")
    reg = registry.Registry.empty(spark).assign(clusters, records)
    one, two = (r.cnmc for r in reg.entries.orderBy("cnmc").collect())
    merged = reg.merge(one, two)
    with pytest.raises(ValueError):  # still mapped, through the survivor
        merged.assign(clusters, records)
    out = merged.split(one, [[0, 2], [1, 3]], records)
    assert {r.status for r in out.entries.where(F.col("cnmc").isin(one, two)).collect()} == {"superseded"}
    new = out.reverse_lookup("O0", "c2")
    assert new not in (one, two, None) and new == out.reverse_lookup("O0", "c0") != out.reverse_lookup("O1", "c3")
    assert out.stats().first().active_codes == 2


def test_bare_model_has_no_backend(spark, tmp_path):
    assert classify.load_model_backend(str(tmp_path / "bare")) is None
    assert not classify.is_backend_mismatch(classify.load_model_backend(str(tmp_path / "bare")), "tfidf_svd")


def test_exports(spark, tmp_path):
    cols = [S.OWNER, S.CODE, S.CATEGORY, S.RAW]
    df = spark.createDataFrame([("a", "2", "x", "t", "S", "G1"), ("b", "1", "x", "t, u\nv", "S", "G1")], [*cols, S.LABEL_TEXT, S.LABEL])
    df.write.option("header", True).option("escape", '"').csv(str(tmp_path / "with.csv"))
    got = uploads.load_export(spark, str(tmp_path / "with.csv"), order=S.CODE)
    assert got.has_labels and sorted((r.rid, r[S.CODE]) for r in got.records.collect()) == [(0, "1"), (1, "2")] and got.truth().count() == 2
    assert not set(S.LABEL_COLUMNS) & set(got.records.columns)
    df.drop(S.LABEL_TEXT, S.LABEL).write.option("header", True).csv(str(tmp_path / "without.csv"))
    bare = uploads.load_export(spark, str(tmp_path / "without.csv"))
    assert not bare.has_labels and bare.labels.count() == 0
    with pytest.raises(ValueError):
        bare.truth()
    df.drop(S.RAW).write.option("header", True).csv(str(tmp_path / "less.csv"))
    with pytest.raises(ValueError):
        uploads.load_export(spark, str(tmp_path / "less.csv"))
    with pytest.raises(AssertionError):
        uploads.wrap_upload(df)


def test_filters(spark):
    df = spark.createDataFrame([(1, "Power", "x"), (2, "Steel", "y"), (3, None, "x")], ["rid", S.SECTOR, S.CATEGORY])
    ids = lambda **kw: sorted(r.rid for r in profile.filtered(df, **kw).collect())
    assert ids() == ids(sectors=[]) == [1, 2, 3] and ids(sectors=["Power"]) == [1] and ids(categories=["x"]) == [1, 3] and ids(sectors=["Steel"], categories=["x"]) == []


def test_boosting_of_equal_rows(spark):
    """Rows that are equal after binning weigh as many: repeating every row changes nothing but the least leaf."""
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        y = i % 2
        s = min(1.0, max(0.0, rnd.gauss(0.7 if y else 0.4, 0.1)))
        rows.append((s, s / 2, s, 3, 3 * y, 1 - y, False, 3, True, y, 20.0))
    names = [*classify.FEATURES, "label", "_w"]
    df = spark.createDataFrame(rows, names)
    one = classify.fit_boosting(df, 5)
    two = classify.fit_boosting(df.withColumn("_w", F.lit(10.0)).unionByName(df.withColumn("_w", F.lit(10.0))), 5)
    p = [[round(r.p, 9) for r in classify.predict_proba(m, df).orderBy("semantic").collect()] for m in (one, two)]
    assert p[0] == p[1] and len(set(p[0])) > 1
