"""Reply trees against brute force: cycles, leaves under cycles, chains, ties, null scores."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat_format

SCHEMA = "tree long, node long, parent long, role string, text string, score double"


def brute(rows):
    """(tree, leaf) to (path from the root, score) of every leaf that has a root."""
    out = {}
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        parents = {r[2] for r in own.values()}
        for leaf in own:
            if leaf in parents:
                continue
            path, at, seen = [], leaf, set()
            while at in own and at not in seen:
                seen.add(at)
                path.append(at)
                at = own[at][2]
            if at not in seen:
                out[tree, leaf] = path[::-1], sum(own[x][5] or 0.0 for x in path)
    return out


def forest(seed):
    rnd = random.Random(seed)
    rows = []
    for tree in range(6):
        n = rnd.choice([1, 2, 5, 17, 40])
        for node in range(n):
            # chains, bushes, orphans and now and then a cycle
            parent = rnd.choice([None, node - 1, node - 1, rnd.randrange(n), 1000])
            rows.append((tree, node, parent, rnd.choice(["user", "assistant", None]), f"{tree}.{node}", rnd.choice([None, 0.0, 1.0, 0.5])))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_paths_equal_brute_force(spark, seed):
    rows = forest(seed)
    df, want = spark.createDataFrame(rows, SCHEMA), brute(rows)
    found = {}
    for r in chat_format.paths(df).collect():
        found.setdefault((r.tree, r.leaf), {})[r.up] = r.node
    assert {k: [v[i] for i in sorted(v, reverse=True)] for k, v in found.items()} == {k: p for k, (p, _) in want.items()}
    best = {}
    for (tree, leaf), (path, score) in want.items():
        best[tree] = max(best.get(tree, (-1.0, 0, [])), (score, -leaf, path))
    got = {r.tree: (r.score, -r.leaf, r.n_turns) for r in chat_format.format_trees(df).collect()}
    assert got == {t: (s, x, len(p)) for t, (s, x, p) in best.items()}


def test_leaf_under_a_cycle(spark):
    rows = [(1, 1, 2, "user", "a", 1.0), (1, 2, 1, "user", "b", 1.0), (1, 3, 2, "assistant", "c", 1.0), (2, 1, 1, "user", "self", 0.0), (2, 2, 1, "user", "d", 0.0), (3, 1, None, "user", "e", 0.0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("above", F.lit("clash")).withColumn("leaf", F.lit("clash"))
    assert [(r.tree, r.n_turns) for r in chat_format.format_trees(df, None).collect()] == [(3, 1)]
    assert chat_format.format_trees(df.where("tree < 3")).count() == 0


def test_long_chain(spark):
    rows = [(1, i, i - 1 if i else None, "user", f"t{i}", 1.0) for i in range(300)]
    got = chat_format.read_back(chat_format.format_trees(spark.createDataFrame(rows, SCHEMA))).first()
    assert got.n_turns == 300 and got.score == 300.0 and [t.text for t in got.turns] == [f"t{i}" for i in range(300)]
