"""Stages of the pipeline against brute force, and the whole chain."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from lodestone.llm import ngram_join, secret_scan
from lodestone.llm.queries import TOKENIZER
from lodestone.storage import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_kept(rows):
    """Rows that stay: of each (id, text) the smallest other columns, of each component the smallest id, null last."""
    by = {}
    for r in rows:
        by.setdefault(r[:2], []).append(r)
    docs = list(by)
    sets, top = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                top[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(docs[i])
    return [sorted(x, key=lambda d: (d[0] is None, d[0] or 0)) for x in groups.values()], by


def odd_rows(seed):
    rnd = random.Random(seed)
    base = [" ".join(f"w{rnd.randrange(500)}" for _ in range(40)) for _ in range(12)]
    rows = []
    for i in range(60):
        words = rnd.choice(base).split()
        if rnd.random() < 0.5:
            words[rnd.randrange(40)] = f"x{rnd.randrange(99)}"
        rows.append((rnd.choice([i, i, rnd.randrange(20), None]), " ".join(words), rnd.choice(["en", None]), rnd.choice(["a", "b", None]), 7))
    rows += [(3, None, "en", "a", 0), (3, "", "en", "a", 0), (None, None, None, None, None), (None, "", None, None, None)]
    return rows + rows[:9] + rows[-3:]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = odd_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("key", "k1", "component_id", "c0", "id")})
    first = corpus_pipeline.near_duplicates(spark, df.repartition(5), "").collect()
    again = corpus_pipeline.near_duplicates(spark, df.repartition(3, "text"), "").collect()
    assert df.columns == list(first[0].__fields__) and sorted(map(str, first)) == sorted(map(str, again))
    groups, by = brute_kept(rows)
    kept = {(r.doc_id, r.text): r for r in first}
    assert len(kept) == len(first) == len(groups)
    for docs in groups:
        found = [d for d in docs if d in kept]
        assert len(found) == 1 and (found[0][0] is None) == (docs[0][0] is None) and found[0][0] == docs[0][0]
        assert tuple(kept[found[0]])[:5] in by[found[0]]


def test_stages_keep_clashing_columns(spark):
    rows = [(i, f"the cat and the dog went away from here with number {i} and {i * 7} again", "en", "a", 60) for i in range(8)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("lang_pred", "score", "t", "d0", "findings", "cell", "target", "key")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns, name
        assert all(r[c] == c for r in out.collect() for c in ("lang_pred", "score", "t", "d0", "findings", "cell", "target", "key")), name


def test_chain(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256").collect()))
    kept, step = docs, None
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept, step = materialize(stage(spark, kept, sf), "chain"), kept
    mixed = kept.collect()
    from hashlib import sha256

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    want = []
    for r in mixed:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()))
        assert r.n_chars == len(r.text)
    assert out == sorted(want)
    # what the stages decided holds in the mix: no two linked documents, no found secret
    ids = {r.doc_id for r in mixed}
    assert ngram_join.components(step.where(F.col("doc_id").isin(*ids))).where("component_id <> doc_id").count() == 0
    assert secret_scan.scan(step).where("is_secret").count() == 0
