"""A value is judged at each of its places."""

from lodestone.llm import secret_scan

KEY = "9f86d081884c7d659a2feaa0c55ad0153f2b1c4e"


def test_every_place_is_scored(spark):
    first = f"commit {KEY} was\n"
    rows = [(1, first), (2, first + f'token = "{KEY}" x'), (3, f"und {KEY} the\nx{KEY}y\n" + f'password="{KEY}"')]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.scan(df, path_col=None).where(f"value_sha256 = sha2('{KEY}', 256)").collect()}
    assert {i: r.is_secret for i, r in got.items()} == {1: False, 2: True, 3: True}
    second = rows[1][1].rindex(KEY) + 1
    assert (got[2].start, got[2].starts) == (8, [8, second])
    assert got[3].starts == [5, rows[2][1].rindex(KEY) + 1]
    out = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert out[1] == first and KEY not in out[2]


def test_entropy_reads_whole_candidates(spark):
    entropy = secret_scan.FEATURES["entropy"]
    got = spark.sql(f"select {entropy} as e from (select named_struct('v', concat(repeat('a', 256), repeat('b', 256))) as c)").first().e
    assert abs(got - 1.0) < 1e-9
