"""Features and read tasks of media columns, told again from the texts."""

import math
from hashlib import sha256

import pytest

from lodestone.llm import media


def plain_feature(raw):
    """The feature by loops: mean, spread, and a bit for each of 64 even stretches over the mean."""
    n = len(raw)
    mean = sum(raw) / n
    spread = math.sqrt(sum((x - mean) ** 2 for x in raw) / n)
    bits = 0
    for k in range(64):
        part = raw[int(k * n / 64) : int((k + 1) * n / 64)]
        bits = 2 * bits + (sum(part) / len(part) > mean)
    return mean, spread, bits


@pytest.mark.parametrize("chunk", [64, 1 << 10, 1 << 24])
def test_features_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(media, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(media, "SHARD_BYTES", 3000)
    texts = {1: "a" * 64, 2: "héllo wörld " * 20, 3: None, 4: "", 5: "x y " * 5000, 6: "".join(chr(33 + i % 90) for i in range(777)), 7: "a" * 64}
    rows, folder = media.store(spark.createDataFrame([*texts.items(), (5, texts[5])], "doc_id long, text string").repartition(3))
    got = media.read_columns(rows, folder).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4, 5, 5, 6, 7]
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        raw += bytes(-len(raw) % 64 or (0 if raw else 64))
        mean, spread, bits = r.feature.split(":")
        want = plain_feature(raw)
        assert abs(float(mean) - want[0]) < 1e-3 and abs(float(spread) - want[1]) < 1e-3 and int(bits, 16) == want[2]
        assert r.payload_sha256 == sha256(raw).hexdigest()
    assert len({r.media_sha256 for r in got if r.doc_id in (1, 7)}) == 1
