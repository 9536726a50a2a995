"""Tables in the shared folder: written, dropped, released."""

import os

from lodestone import storage


def test_drop_and_release(spark):
    df = spark.range(10)
    a, b = storage.materialize(df, "a"), storage.materialize(df, "b")
    where = {t: storage._PATHS[t] for t in (a, b)}
    assert a.count() == 10 and all(os.path.isdir(p) for p in where.values())
    kept, gone = where[b], where[a]
    storage.drop(a, df)  # a table that isn't ours is left alone
    assert not os.path.exists(gone) and os.path.isdir(kept) and b.count() == 10
    storage.drop(a)
    assert storage.qualified(spark, kept).startswith("file:")


def test_components_leave_no_rounds(spark):
    from lodestone.operators.graph import connected_components

    before = set(os.listdir(os.path.dirname(storage.new_path(spark, "x")))) if os.path.isdir(os.path.dirname(storage.new_path(spark, "x"))) else set()
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert connected_components(edges).where("component = 0").count() == 41
    after = set(os.listdir(os.path.dirname(storage.new_path(spark, "x"))))
    assert len([x for x in after - before if x.startswith("cc-round")]) == 1
