"""Texts that share a passage and stock phrases: near misses all over, few links."""

import random

import numpy as np
import pytest

from lodestone.llm import ngram_join


def stock_texts(count, seed=3):
    rnd = random.Random(seed)
    passage = [f"p{i}" for i in range(100)]
    phrases = [[f"f{k}x{i}" for i in range(8)] for k in range(60)]
    return [" ".join(passage + [w for k in rnd.sample(range(60), 4) for w in phrases[k]]) for _ in range(count)]


def routed(spark, monkeypatch, texts):
    """Components, and how many rows were sent from sets to groups."""
    sent = []
    plain = ngram_join.routes_of
    monkeypatch.setattr(ngram_join, "routes_of", lambda sets, percent: (lambda r: sent.append(r.count()) or r)(plain(sets, percent)))
    rows = list(enumerate(texts))
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    return {r.doc_id: r.component_id for r in got}, sent[0]


def brute(texts, percent=75):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    place = {g: i for i, g in enumerate({g for s in sets for g in s})}
    m = np.zeros((len(sets), len(place)), np.int32)
    for i, s in enumerate(sets):
        m[i, [place[g] for g in s]] = 1
    inter, n = m @ m.T, m.sum(1)
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links = 0
    for i, j in zip(*np.nonzero(100 * inter >= percent * (n[:, None] + n[None] - inter))):
        if i < j:
            links += 1
            a, b = find(i), find(j)
            top[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(sets))}, links


@pytest.mark.parametrize("count", [400, 800, 1600])
def test_near_misses_make_few_rows(spark, monkeypatch, count):
    texts = stock_texts(count)
    got, sent = routed(spark, monkeypatch, texts)
    want, links = brute(texts)
    assert got == want
    assert sent <= 2 * (count + links), sent


def test_small_groups_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_MEMBERS", 16)
    monkeypatch.setattr(ngram_join, "GROUP_QUERIES", 7)
    monkeypatch.setattr(ngram_join, "CHUNK", 20)
    texts = stock_texts(300, 8)
    assert routed(spark, monkeypatch, texts)[0] == brute(texts)[0]


def test_union_bound_opens_only_groups_that_can_reach(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, 60)).astype(np.uint64) for _ in range(50)]
    group = ngram_join.Group([len(s) for s in sets], list(range(100, 150)), sets)
    for turn in range(200):
        q = np.unique(np.concatenate([sets[turn % 50][: rng.integers(20, 60)], rng.integers(0, 500, rng.integers(0, 30)).astype(np.uint64)]))
        group.links.clear()
        group.ask(7, len(q), q, 75)
        want = {(7, 100 + i) for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 75 * len(np.union1d(q, s))}
        assert group.links == want
