"""Chat formatting: reply trees to conversations, in DataFrame operations only.

Messages are nodes of reply trees. Iterative self-joins with doubled steps build,
for every node, its ancestors 1, 2, 4, ... steps up with the sum of the scores on
the way. From these each leaf's path gets its score in a number of joins that is
logarithmic in the depth, one row a leaf; leaves are ranked within their tree, and
only the chosen ones are written out as root-to-leaf paths, by the same steps,
and formatted as one conversation each. Only keys travel through the joins;
texts are fetched once, for the chosen paths. A conversation is one row of the
result, so its turns meet in one task.

A turn is ``### Role:\\n`` + text + ``\\n</turn>\\n``. In roles and texts a backslash is
put before every backslash, ``#`` and ``<`` (in roles before ``:`` and line breaks
too), so no text can hold a control string and taking away the backslashes gives the text back. ``loss`` marks the text of
each assistant turn: turn number, offset in the turn, and length, in code points.

Null texts and roles are empty. An orphan (its parent isn't there) is a root. A
cycle has no root, so neither its nodes nor what hangs under it give a path. A
null score is 0. Repeated rows are separate messages; ties
are ordered by turn, role and text (null first). A null conversation id is a conversation. Empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.storage import materialize

START, COLON, END = "### ", ":\n", "\n</turn>\n"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\#<])", r"\\$1")


def escape_role(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\#<:\n])", r"\\$1")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def linear_tree(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Reply tree of plain conversations: (tree, node, parent, role, text, score); a turn replies to the one before."""
    w = Window.partitionBy("tree").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    out = rows.select(F.col(conv_col).alias("tree"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    out = out.withColumn("node", F.row_number().over(w).cast("long"))
    return out.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def same(a: str, x: str, b: str, y: str) -> Column:
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree")) & (F.col(f"{a}.{x}") == F.col(f"{b}.{y}"))


def jumps_of(keys: DataFrame) -> list[DataFrame]:
    """Doubled steps of (tree, node, parent, score): the k-th has (tree, k, above, sum).

    ``above`` is the ancestor 2^k steps up, ``sum`` the scores from the node to just
    under it. Together they reach a root from every node that has one.
    """
    most = keys.groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    known = keys.select("tree", F.col("node").alias("k"))
    first = keys.alias("n").join(known.alias("p"), same("n", "parent", "p", "k"))
    jumps = [materialize(first.select("n.tree", F.col("n.node").alias("k"), F.col("p.k").alias("above"), F.col("n.score").alias("sum")), "chat-jump")]
    for _ in range(math.ceil(math.log2(max(2, most))) - 1):
        low, high = jumps[-1].alias("n"), jumps[-1].alias("p")
        twice = low.join(high, same("n", "above", "p", "k"))
        jumps.append(materialize(twice.select("n.tree", "n.k", "p.above", (F.col("n.sum") + F.col("p.sum")).alias("sum")), "chat-jump"))
    return jumps


def scored_leaves(keys: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(tree, leaf, score) of every leaf that has a root; one row a leaf on the whole way."""
    parents = jumps[0].select("tree", F.col("above").alias("k")).distinct()
    leaves = keys.alias("n").join(parents.alias("p"), same("n", "node", "p", "k"), "left_anti")
    at = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0.0).alias("score"))
    for k in reversed(range(len(jumps))):
        up = at.alias("n").join(jumps[k].alias("p"), same("n", "node", "p", "k"), "left")
        at = up.select("n.tree", "n.leaf", F.coalesce("p.above", "n.node").alias("node"), (F.col("n.score") + F.coalesce("p.sum", F.lit(0.0))).alias("score"))
        at = materialize(at, "chat-leaves") if k % 4 == 3 else at
    rooted = at.alias("n").join(jumps[0].alias("p"), same("n", "node", "p", "k"), "left_anti")  # the others hang on a cycle
    return rooted.alias("n").join(keys.alias("k"), same("n", "node", "k", "node")).select("n.tree", "n.leaf", (F.col("n.score") + F.col("k.score")).alias("score"))


def expand(leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """Root-to-leaf paths of the leaves given: (tree, leaf, node, up), ``up`` steps above the leaf."""
    found = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(jumps))):
        found = materialize(found, "chat-paths") if k % 4 == 3 else found
        higher = found.alias("n").join(jumps[k].alias("p"), same("n", "node", "p", "k"))
        found = found.unionByName(higher.select("n.tree", "n.leaf", F.col("p.above").alias("node"), (F.col("n.up") + 2**k).alias("up")))
    return found


def keys_of(nodes: DataFrame) -> DataFrame:
    return materialize(nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "chat-nodes")


def paths(nodes: DataFrame) -> DataFrame:
    """All root-to-leaf paths of (tree, node, parent, score): (tree, leaf, node, up)."""
    keys = keys_of(nodes)
    jumps = jumps_of(keys)
    return expand(scored_leaves(keys, jumps), jumps)


def format_trees(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """One row for each chosen path: tree, leaf, rank, score, n_turns, formatted, loss.

    ``best`` keeps that many branches of a tree, by score (ties: smaller leaf);
    None keeps all.
    """
    keys = keys_of(nodes)
    jumps = jumps_of(keys)
    ranked = scored_leaves(keys, jumps).withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    ranked = materialize(ranked if best is None else ranked.where(F.col("rank") <= best), "chat-ranked")
    chosen = expand(ranked, jumps).alias("p").join(ranked.alias("r"), same("p", "leaf", "r", "leaf")).select("p.tree", "p.leaf", "p.node", "p.up", "r.rank", "r.score")
    turn = F.concat(F.lit(START), escape_role(F.coalesce(F.col("n.role"), F.lit(""))), F.lit(COLON))
    text = escape(F.coalesce(F.col("n.text"), F.lit("")))
    rows = chosen.alias("c").join(nodes.alias("n"), same("c", "node", "n", "node")).select(
        "c.tree", "c.leaf", "c.rank", "c.score", (-F.col("c.up")).alias("at"), F.concat(turn, text, F.lit(END)).alias("turn"), (F.col("n.role") == "assistant").alias("own"), F.length(turn).alias("start"), F.length(text).alias("n")
    )
    packed = rows.groupBy("tree", "leaf", "rank", "score").agg(F.sort_array(F.collect_list(F.struct("at", "turn", "own", "start", "n"))).alias("t"))
    loss = F.expr("filter(transform(t, (x, i) -> named_struct('turn', i, 'start', x.start, 'n', x.n, 'own', x.own)), x -> x.own)")
    return packed.select("tree", "leaf", "rank", "score", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"), F.transform(loss, lambda x: F.struct(x["turn"], x["start"], x["n"])).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and the text under the loss mask, from the formatted strings and masks alone.

    The end mark holds a bare ``<`` after a line break, which no escaped text has,
    so turns are split at it; likewise the head ends at the first colon and line break.
    """
    segments = F.split("formatted", END, -1)
    head = lambda s: F.substring_index(s, COLON, 1)
    role = lambda s: unescape(F.substr(head(s), F.lit(len(START) + 1)))
    body = lambda s: unescape(F.substr(s, F.length(head(s)) + len(COLON) + 1))
    return (
        formatted.withColumn("_turns", F.slice(segments, 1, F.size(segments) - 1))
        .withColumn("turns", F.transform("_turns", lambda s: F.struct(role(s).alias("role"), body(s).alias("text"))))
        .withColumn("loss_text", F.array_join(F.transform("loss", lambda m: unescape(F.substr(F.get("_turns", m["turn"]), (m["start"] + 1).cast("int"), m["n"].cast("int")))), ""))
        .drop("_turns")
    )
